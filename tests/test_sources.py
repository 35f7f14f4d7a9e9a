"""Sources on small inputs that follow the formats."""

import io
import json
import struct
import zipfile

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tracewright.operators import evidence
from tracewright.sources import archives, captures, events, logs, snapshots, store

NGINX = '10.0.0.9 - - [05/Mar/2026:10:00:01 +0200] "GET /api/search?q=%27%20OR%20%271%27=%271#x HTTP/1.1" 200 512 "-" "curl/8" upstream=172.18.0.3:8000 upstream_status=200 request_time=0.004'
ACCESS = "\n".join(["start worker process 29", NGINX, "2026-03-05T08:00:02.123456789Z " + NGINX.replace("upstream=172.18.0.3:8000", "upstream=-"), "", "bad line", NGINX.replace("/api", "/ftp")])
APP = '2026-03-05T08:00:01.5Z INFO:     172.18.0.2:40000 - "GET /search?q=a HTTP/1.1" 200 OK\nINFO: started\n2026-03-05T08:00:03Z INFO:     172.18.0.2:40001 - "POST /login HTTP/1.1" 401 Unauthorized'
AUTH = "2026-03-05T08:01:00Z web1 sshd: pam_unix(sshd:auth): authentication failure; logname= uid=0 tty=ssh ruser= rhost=10.0.0.9  user=root user=admin\n2026-03-05T08:02:00Z web1 sshd: pam_unix(sshd:auth): session opened for user root\nnothing"


def write(tmp_path, name, data):
    f = tmp_path / name
    f.write_bytes(data if isinstance(data, bytes) else data.encode())
    return "file://" + str(f)


def test_access_log(spark, tmp_path):
    lines = logs.numbered_lines(spark, write(tmp_path, "nginx.log", ACCESS))
    rows = {r["event_id"]: r for r in logs.access_events(lines).collect()}
    assert sorted(rows) == ["nginx-2", "nginx-3", "nginx-6"]
    r = rows["nginx-2"]
    assert r["action"] == "GET /api/search" and r["destination_entity"] == "172.18.0.3" and r["source_entity"] == "10.0.0.9"
    assert r["attributes"]["query"] == "q=%27%20OR%20%271%27=%271" and r["attributes"]["status"] == "200"
    assert r["ts_text"] == "2026-03-05T08:00:01Z"
    assert rows["nginx-3"]["destination_entity"] is None and rows["nginx-3"]["ts_text"] == "2026-03-05T08:00:01Z"
    spark.conf.set("spark.sql.session.timeZone", "America/Lima")
    try:
        assert {r["ts_text"] for r in logs.access_events(lines).collect()} == {"2026-03-05T08:00:01Z"}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    by_prefix = {r["event_id"]: r["ts_text"] for r in logs.access_events(lines, prefix_time=True).collect()}
    assert by_prefix["nginx-3"] == "2026-03-05T08:00:02.123456789Z"


def test_line_numbers_over_splits(spark, tmp_path):
    path = write(tmp_path, "long.log", "".join(f"line {i}\n" for i in range(1, 20001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        lines = logs.numbered_lines(spark, path)
        assert spark.read.text(path).rdd.getNumPartitions() > 5
        assert lines.where(F.concat(F.lit("line "), "n") != F.col("value")).count() == 0 and lines.count() == 20000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_application_and_auth(spark, tmp_path):
    app = {r["event_id"]: r for r in logs.application_events(logs.numbered_lines(spark, write(tmp_path, "a.log", APP))).collect()}
    assert sorted(app) == ["application-1", "application-3"] and app["application-3"]["attributes"]["status_text"] == "Unauthorized"
    auth = {r["event_id"]: r for r in logs.auth_events(logs.numbered_lines(spark, write(tmp_path, "auth.log", AUTH))).collect()}
    assert auth["linux-auth-1"]["event_type"] == "authentication_failure" and auth["linux-auth-1"]["attributes"]["user"] == "admin"
    assert auth["linux-auth-1"]["source_entity"] == "10.0.0.9" and auth["linux-auth-2"]["event_type"] == "session_opened"
    pairs = logs.header_lines(logs.numbered_lines(spark, write(tmp_path, "h.txt", "Method: GET\nno colon\nURL: http://x:1/y"))).collect()
    assert {(r["key"], r["value"]) for r in pairs} == {("Method", "GET"), ("URL", "http://x:1/y")}


CONTAINERS = [
    {"Id": "c1", "Name": "/web", "Created": "2026-03-05T07:00:00Z", "RestartCount": 0, "State": {"StartedAt": "2026-03-05T07:00:01.123456789Z", "Status": "running", "Running": True}, "HostConfig": {"NetworkMode": "net"}, "Config": {"Image": "web:1", "ExposedPorts": {"80/tcp": {}}, "Env": ["DB_HOST=db", "X=1=2", "PLAIN"]},
     "NetworkSettings": {"Ports": {"80/tcp": [{"HostIp": "0.0.0.0", "HostPort": "8080"}], "81/tcp": None}, "Networks": {"net": {"NetworkID": "n1", "EndpointID": "e1", "IPAddress": "172.18.0.3", "Aliases": None, "DNSNames": ["web", "c1"]}}}},
    {"Id": "c2", "Name": "/db", "Created": "2026-03-05T07:00:00Z", "State": {}, "Config": {"Image": "db"}, "NetworkSettings": {"Networks": {"net": {"NetworkID": "n1", "IPAddress": "172.18.0.4", "Aliases": ["store"]}}}},
]
NETWORKS = [{"Name": "net", "Id": "n1", "Created": "2026-03-05T06:00:00Z", "Scope": "local", "Driver": "bridge", "Containers": {"c1": {"Name": "web", "EndpointID": "e1", "IPv4Address": "172.18.0.3/16"}}}]


def test_snapshots_resolution_and_dedup(spark, tmp_path):
    path = write(tmp_path, "containers_before.json", json.dumps(CONTAINERS))
    docker = snapshots.docker_events(spark, path)
    rows = {r["event_id"]: r for r in docker.collect()}
    assert sorted(rows) == ["docker-container-0", "docker-container-1", "docker-container-network-0-net", "docker-container-network-1-net"]
    assert json.loads(rows["docker-container-0"]["attributes"]["published_ports"]) == [{"container_port": "80/tcp", "host_ip": "0.0.0.0", "host_port": "8080"}]
    assert rows["docker-container-1"]["action"] == "unknown" and rows["docker-container-1"]["ts_text"] == "2026-03-05T07:00:00Z"
    assert rows["docker-container-0"]["ts"] is not None
    net = snapshots.docker_events(spark, write(tmp_path, "network_after.json", json.dumps(NETWORKS)))
    assert net.first()["attributes"]["ip_address"] == "172.18.0.3"
    app = logs.application_events(logs.numbered_lines(spark, write(tmp_path, "a.log", APP.replace("172.18.0.2", "172.18.0.3"))))
    every = events.union_sources(spark, app, docker, net, None)
    keys = evidence.entity_keys(every)
    known = {(r["kind"], r["key"]): r["canonical"] for r in keys.collect()}
    assert known["ip", "172.18.0.3"] == "container:web" and known["name", "store"] == "container:db"
    resolved = evidence.resolve(every, keys)
    got = {r["event_id"]: r for r in resolved.collect()}
    assert got["application-1"]["source_entity_canonical"] == "container:web" and got["application-1"]["source_entity_type"] == "ip"
    assert got["docker-container-0"]["source_entity_type"] == "name"
    merged = {r["event_id"]: r for r in evidence.merge_observations(every).collect()}
    assert len(merged) == 6
    firsts = {r["event_id"]: r["first_id"] for r in evidence.observations(every).collect()}
    assert len(firsts) == every.count() and set(firsts.values()) == set(merged)
    assert all(merged[f]["n_observations"] == list(firsts.values()).count(f) for f in merged)
    env = {(r["name"], r["key"]): r["value"] for r in snapshots.environment(snapshots.read_array(spark, path, snapshots.CONTAINER)).collect()}
    assert env == {("web", "DB_HOST"): "db", ("web", "X"): "1=2"}
    with pytest.raises(ValueError):
        snapshots.docker_events(spark, "file:///x/other.json")


def test_event_files(spark, tmp_path):
    app = logs.application_events(logs.numbered_lines(spark, write(tmp_path, "a.log", APP)))
    out = "file://" + str(tmp_path / "events")
    events.write_events(app, out)
    back = events.read_events(spark, out)
    assert {(r["event_id"], r["ts_text"], r["attributes"]["method"]) for r in back.collect()} == {("application-1", "2026-03-05T08:00:01.5Z", "GET"), ("application-3", "2026-03-05T08:00:03Z", "POST")}
    bad = write(tmp_path, "bad.jsonl", '{"event_id":"x"}\n{broken\n')
    with pytest.raises(Exception):
        events.read_events(spark, bad).collect()
    assert events.broken_lines(spark, bad).count() == 1
    assert events.union_sources(spark).count() == 0


def ip_packet(src, dst, proto=6, sport=57828, dport=80):
    head = bytes([0x45, 0, 0, 40, 0, 0, 0, 0, 64, proto, 0, 0]) + bytes(map(int, src.split("."))) + bytes(map(int, dst.split(".")))
    return head + struct.pack(">HH", sport, dport) + bytes(16)


def pcapng(order="<"):
    block = lambda kind, body: struct.pack(order + "II", kind, len(body) + 12) + body + struct.pack(order + "I", len(body) + 12)
    shb = b"\x0a\x0d\x0d\x0a" + struct.pack(order + "I", 28) + struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1) + struct.pack(order + "I", 28)
    data = struct.pack("<I", 2) + ip_packet("127.0.0.1", "127.0.0.1")
    data += bytes(-len(data) % 4)
    epb = block(6, struct.pack(order + "IIIII", 0, 0, 1_000_000, len(data), len(data)) + data)
    return shb + block(1, struct.pack(order + "HHI", 0, 0, 0)) + epb + epb


def test_captures(spark, tmp_path):
    for order in "<>":
        path = write(tmp_path, f"cap{ord(order)}.pcapng", pcapng(order))
        rows = captures.packets(spark, path).collect()
        assert [(r["src"], r["sport"], r["protocol"], r["micros"]) for r in rows] == [("127.0.0.1", 57828, "TCP", 1_000_000)] * 2
    events_ = captures.packet_events(captures.packets(spark, path)).collect()
    assert events_[0]["event_id"].startswith("pcapng-packet-") and events_[0]["ts_text"] == "1970-01-01T00:00:01.000000Z"
    frame = bytes(12) + b"\x81\x00\x00\x05\x08\x00" + ip_packet("10.0.0.1", "10.0.0.2", 17)
    arp = bytes(12) + b"\x08\x06" + bytes(14) + bytes([10, 0, 0, 1]) + bytes(6) + bytes([10, 0, 0, 9])
    pcap = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + b"".join(struct.pack("<IIII", t, 5, len(p), len(p)) + p for t, p in ((1, frame), (3, frame), (4, arp)))
    found = captures.packets(spark, write(tmp_path, "x.pcap", pcap))
    flow = {r["protocol"]: r for r in captures.traffic_flows(found).collect()}
    assert flow["UDP"]["packets"] == 2 and flow["UDP"]["seconds"] == 2.0 and flow["ARP"]["dst"] == "10.0.0.9"
    named = spark.createDataFrame([("10.0.0.1", "web")], "address string, container string")
    counts = {(r["kind"], r["name"]): (r["packets"], r["container"]) for r in captures.traffic_counts(found, named).collect()}
    assert counts["source", "10.0.0.1"] == (3, "web") and counts["protocol", "ARP"] == (1, None)
    with pytest.raises(Exception):
        captures.packets(spark, write(tmp_path, "cut.pcapng", pcapng()[:-6])).collect()


CATALOG = """<?xml version="1.0"?><Weakness_Catalog xmlns="http://x" xmlns:xhtml="http://www.w3.org/1999/xhtml" Version="4.1"><Weaknesses>
<Weakness ID="89" Name="SQL Injection" Status="Stable"><Description>Bad <xhtml:b>query</xhtml:b>
 building.</Description><Extended_Description><xhtml:p>One.</xhtml:p><xhtml:ul><xhtml:li>a</xhtml:li><xhtml:li>b</xhtml:li></xhtml:ul></Extended_Description>
<Related_Weaknesses><Related_Weakness Nature="ChildOf" CWE_ID="943"/></Related_Weaknesses><References><Reference External_Reference_ID="REF-1"/><Reference External_Reference_ID="REF-9"/></References>
<Taxonomy_Mappings><Taxonomy_Mapping Taxonomy_Name="T"><Entry_ID></Entry_ID><Entry_Name>Inj</Entry_Name></Taxonomy_Mapping></Taxonomy_Mappings>
<Content_History><Submission><Submission_Date>2006-07-19</Submission_Date></Submission><Modification><Modification_Date>2024-02-29</Modification_Date></Modification></Content_History></Weakness>
</Weaknesses><External_References><External_Reference Reference_ID="REF-1"><Title>Book</Title><URL>http://b</URL></External_Reference></External_References></Weakness_Catalog>"""


def zipped(text):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a.xml", text)
    return held.getvalue()


def test_archives(spark, tmp_path):
    path = write(tmp_path, "cwe.zip", zipped(CATALOG))
    records = archives.read_catalog(spark, path)
    r = records.first()
    assert (r["id"], r["catalog_version"], r["status"]) == ("89", "4.1", "Stable")
    assert {s["title"]: s["body"] for s in r["sections"]} == {"Description": "Bad query building.", "Extended Description": "One.\n\n- a\n- b", "Relationships": "- ChildOf CWE-943", "Taxonomy Mappings": "- T: Inj"}
    references = archives.read_references(spark, path)
    with pytest.raises(Exception, match="cites the unknown REF-9"):
        archives.documents(records, references).collect()
    refs = archives.citations(records, references).collect()
    assert {(x["reference_id"], x["known"]) for x in refs} == {("REF-1", True), ("REF-9", False)}
    assert archives.taxonomy_entries(records).first()["entry"] == "Inj"
    assert archives.relationship_edges(records).first()["target"] == "CWE-943"
    wanted = spark.createDataFrame([("89", "SQL Injection"), ("79", "XSS")], "id string, name string")
    assert {x["id"]: x["status"] for x in archives.select_records(records, wanted).collect()} == {"89": "selected", "79": "missing"}
    with pytest.raises(Exception, match="SHA-256"):
        archives.read_catalog(spark, path, digest="0" * 64).collect()
    right = archives.Pinned("http://x", "Weakness_Catalog", "CWE", "4.1", "2026-01-01")
    said = write(tmp_path, "said.zip", zipped(CATALOG.replace('Version="4.1"', 'Name="CWE" Date="2026-01-01" Version="4.1"')))
    assert archives.read_catalog(spark, said, pinned=right).first()["catalog_version"] == "4.1"
    for change in ({"namespace": "http://y"}, {"root": "Other"}, {"name": "CAPEC"}, {"version": "4.2"}, {"date": "2026-01-02"}):
        with pytest.raises(Exception, match="the catalog's"):
            archives.read_catalog(spark, said, pinned=replace(right, **change)).collect()


def test_catalog_files_in_splits(spark, tmp_path):
    one = CATALOG[CATALOG.index("<Weakness ID") : CATALOG.index("</Weaknesses>")]
    head, tail = CATALOG[: CATALOG.index("<Weakness ID")], CATALOG[CATALOG.index("</Weaknesses>") :]
    path = write(tmp_path, "big.xml", head + "\n".join(one.replace('"89"', f'"{i}"') for i in range(500)) + '<Weakness ID="x" Name="empty"/>' + tail)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert spark.read.option("lineSep", "</Weakness>").text(path).rdd.getNumPartitions() > 5
        records = archives.read_catalog(spark, path)
        assert {r["id"] for r in records.select("id").collect()} == {str(i) for i in range(500)} and records.count() == 500
        assert archives.read_references(spark, path).first().asDict() == {"file": records.first()["file"], "reference_id": "REF-1", "title": "Book", "authors": [], "url": "http://b"}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, text, why in (("cut.xml", CATALOG[:-20], "cut short"), ("bad.xml", CATALOG.replace("</Extended_Description>", ""), "(?i)malformed"), ("dtd.xml", CATALOG.replace("<Weakness_Catalog", "<!DOCTYPE x><Weakness_Catalog"), "refused"), ("none.xml", "<a/>", "another root")):
        got = archives.read_catalog(spark, write(tmp_path, name, text))
        if name == "none.xml":
            assert got.count() == 0  # no record, nothing to refuse
            continue
        with pytest.raises(Exception, match=why):
            got.collect()


TEXTS = {
    None: "",
    "": "",
    " a \n b ": "a b",
    "One<xhtml:br></xhtml:br><xhtml:br/>two": "One\ntwo",
    "<xhtml:p>a</xhtml:p><xhtml:p class='x>y'>b <xhtml:i>c</xhtml:i> d</xhtml:p>": "a\n\nb c d",
    "x<xhtml:ul><xhtml:li><xhtml:p>a</xhtml:p></xhtml:li><xhtml:li></xhtml:li><xhtml:li>b</xhtml:li></xhtml:ul>y": "x\n\n- a\n\n- b\n\ny",
    "<Other>kept</Other> \ufdd0p>": "kept <p>",
    "<xhtml:li>a</xhtml:li>tail<xhtml:li> </xhtml:li>": "- atail",
    "no-break\u00a0blank": "no-break blank",
    "word " * 100_000: ("word " * 100_000).strip(),
}


def test_flat_text(spark):
    rows = spark.createDataFrame([(k,) for k in TEXTS], "t string")
    assert {r["t"]: r["f"] for r in rows.select("t", archives.flat_text(F.col("t")).alias("f")).collect()} == TEXTS


FULL = """<Attack_Pattern_Catalog xmlns="http://y" xmlns:xhtml="http://www.w3.org/1999/xhtml" Version="3.9"><Attack_Patterns>
<Attack_Pattern ID="66" Name="SQL  Injection" Status="Draft" Abstraction="Standard"><Description>d &lt;b&gt; &amp;lt;</Description>
<Alternate_Terms><Alternate_Term><Term>SQLi</Term><Description><xhtml:p>short</xhtml:p></Description></Alternate_Term><Alternate_Term><Term/></Alternate_Term></Alternate_Terms>
<Likelihood_Of_Attack>High</Likelihood_Of_Attack><Prerequisites><Prerequisite>one</Prerequisite><Prerequisite> </Prerequisite></Prerequisites>
<Skills_Required><Skill Level="Low">easy <xhtml:b>x</xhtml:b></Skill><Skill>plain</Skill><Skill Level="High"/></Skills_Required>
<Execution_Flow><Attack_Step><Step>1</Step><Phase>Explore</Phase><Description>look</Description><Technique>t1</Technique><Technique>t2</Technique></Attack_Step><Attack_Step><Step>2</Step></Attack_Step></Execution_Flow>
<Consequences><Consequence><Scope>C</Scope><Scope>I</Scope><Impact>Read</Impact><Note>n</Note></Consequence><Consequence/></Consequences>
<Related_Attack_Patterns><Related_Attack_Pattern Nature="ChildOf" CAPEC_ID="248"/></Related_Attack_Patterns><Related_Weaknesses><Related_Weakness CWE_ID="89"/></Related_Weaknesses>
<Notes><Note Type="Other">why</Note></Notes><References><Reference External_Reference_ID="REF-2" Section="p. 3"/><Reference External_Reference_ID="REF-2"/></References></Attack_Pattern></Attack_Patterns>
<External_References><External_Reference Reference_ID="REF-2"><Author>A B</Author><Author>C</Author><Title>T</Title></External_Reference></External_References></Attack_Pattern_Catalog>"""


def test_pattern_document(spark, tmp_path):
    path = write(tmp_path, "capec.xml", FULL)
    doc = archives.documents(archives.read_catalog(spark, path, archives.PATTERNS), archives.read_references(spark, path, archives.PATTERNS)).first()
    want = ["# CAPEC-66: SQL Injection", "Status: Draft\nAbstraction: Standard", "## Description\nd <b> &lt;", "## Alternate Terms\n- SQLi: short", "## Likelihood of Attack\nHigh", "## Prerequisites\n- one", "## Skills Required\n- (Low) easy x\n- plain", "## Execution Flow\n- Step 1 [Explore]: look\n  - Technique: t1\n  - Technique: t2\n- Step 2", "## Consequences\n- Scope: C, I | Impact: Read | Note: n", "## Related Attack Patterns\n- ChildOf CAPEC-248", "## Related Weaknesses\n- CWE-89", "## Notes\n- Other: why", "## References\n- REF-2: T (A B; C), p. 3\n- REF-2: T (A B; C)"]
    assert doc["content"].split("\n\n") == want
    assert (doc["doc_id"], doc["reference_ids"], doc["source_modified"]) == ("capec:CAPEC-66", ["REF-2"], None)


def test_store(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "x")], "k int, text string, lang string")
    new = spark.createDataFrame([(2, "b", "y"), (3, "c", "x"), (4, "d", "x")], "k int, text string, lang string")
    change = {r["k"]: (r["change"], r["content_changed"], r["metadata_changed"]) for r in store.change_classes(old, new, "k", ["text"], ["lang"]).collect()}
    assert change == {1: ("absent", False, False), 2: ("updated", False, True), 3: ("unchanged", False, False), 4: ("created", False, False)}
    after = store.upsert(old, new, "k")
    assert {r["k"]: r["lang"] for r in after.collect()} == {1: "x", 2: "y", 3: "x", 4: "x"}
    again = store.change_classes(after, new, "k", ["text"], ["lang"])
    assert again.where("change in ('created', 'updated')").count() == 0
    assert {r["k"] for r in store.delete(after, old.where("k = 1"), "k").collect()} == {2, 3, 4}
    docs = spark.createDataFrame([("a", "hello"), ("b", "world")], "doc_id string, text string")
    one, two = store.corpus_fingerprint(docs).first(), store.corpus_fingerprint(docs.orderBy(F.desc("doc_id")).repartition(3)).first()
    assert one == two and one["n_documents"] == 2 and store.corpus_fingerprint(docs.withColumn("text", F.lit("x"))).first() != one
    chunks = spark.createDataFrame([("c1", "a", 0, 4, "hell"), ("c2", "a", 1, 3, "xx"), ("c3", "z", 0, 1, "q")], "chunk_id string, doc_id string, char_start int, char_end int, text string")
    assert {r["chunk_id"]: r["issue"] for r in store.integrity(chunks, docs.withColumnRenamed("text", "content")).collect()} == {"c2": "not_a_slice", "c3": "unknown_document"}
    dup = store.duplicates(docs.union(docs.where("doc_id = 'a'")), "doc_id", "text").collect()
    assert [(r["doc_id"], r["n"], r["conflict"]) for r in dup] == [("a", 2, False)]
