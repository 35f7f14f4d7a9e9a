"""Operators on small fixtures with known answers."""

import datetime as dt
import math
import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.functions import claims, requests, text
from tracewright.operators import evaluation, evidence, gnn, gnn_training, graph, grounding, reconstruct, retrieval, risk, rules
from tracewright.schema import EVENT, EDGE, NODE, parse_time
from tracewright.streaming import windows


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column(F.col("t")).alias("r")).first()["r"]


def event(i, at, source="nginx", kind="http_request", action="GET /x", a=None, b=None, seq=0, **attrs):
    return (i, seq, at, None, source, kind, a, b, action, attrs)


def events(spark, rows):
    return spark.createDataFrame(rows, EVENT).withColumn("ts", parse_time(F.col("ts_text")))


def test_percent_decoding(spark):
    from urllib.parse import unquote

    for t in ["a+b%20c", "%zz%4", "%2527", "100%", "%C3%A9", "", "%e2%82%ac+"]:
        assert one(spark, t, text.percent_decode) == unquote(t)


def test_terms_budget_and_identifiers(spark):
    said = "Potential SQL injection (cwe-89) via the 2024 login form, see CAPEC-66 and CWE-89"
    assert one(spark, said, text.identifiers) == ["CWE-89", "CAPEC-66"]
    assert one(spark, said, text.query_terms) == ["CWE-89", "CAPEC-66", "sql", "injection", "via", "login", "form", "see"]
    assert one(spark, "CWE_89 cwe 79", text.loose_identifiers) == ["CWE-89", "CWE-79"]
    terms = spark.createDataFrame([(["aaa", "bbbb", "c"],)], "t array<string>")
    assert terms.select(text.within_budget(F.col("t"), 14).alias("r")).first()["r"] == ["aaa"]
    assert terms.select(text.within_budget(F.col("t"), 21).alias("r")).first()["r"] == ["aaa", "bbbb"]
    assert terms.select(text.within_budget(F.col("t"), 22).alias("r")).first()["r"] == ["aaa", "bbbb", "c"]
    assert one(spark, "one two three", lambda c: text.shortened(c, 9)) == "one two […]"
    assert one(spark, "password = hunter2, x", text.redact_credentials) == "password = [REDACTED], x"
    assert one(spark, "Not confirmed yet", text.is_placeholder) is True


def test_normalizing_and_chunks(spark):
    assert text.normalize_text("﻿a  \r\nb\x07 \t\n\n\n\né") == "a  \nb\n\né"
    assert text.normalize_text("```\n\n\nx\n```") == "```\n\n\nx\n```"
    rng = random.Random(1)
    body = "\n\n".join(" ".join("word" * rng.randrange(1, 4) for _ in range(rng.randrange(5, 90))) for _ in range(30))
    rows = text.chunks(spark.createDataFrame([("d", body), ("e", ""), ("f", None), ("g", "x" * 3000)], "doc_id string, text string")).collect()
    own = sorted((r for r in rows if r["doc_id"] == "d"), key=lambda r: r["ordinal"])
    assert [r["ordinal"] for r in own] == list(range(len(own)))
    plain = text.normalize_text(body)
    assert all(plain[r["char_start"] : r["char_end"]] == r["text"] and len(r["text"]) <= 1200 for r in own)
    covered = set()
    for r in own:
        covered |= set(range(r["char_start"], r["char_end"]))
    assert all(plain[i].isspace() for i in range(len(plain)) if i not in covered)
    assert sum(r["doc_id"] == "g" for r in rows) == 3 and not any(r["doc_id"] == "e" for r in rows)
    assert text.plain_html("<title>A &amp; b</title><script>x</script><ul><li>one</li><li>two</li></ul><p>c <b>d</b></p>") == "A & b\n- one\n- two\nc d"


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("a\x0bb\x0cc\x85d\u2028e\x1cf", "a\nb\nc\nd\ne\nf"),
        ("foo\x1fbar\x00\x1b\x7f", "foo bar"),
        ("\n\ufeff\n\ufeff  indented\n\n", "  indented"),
        ("line one\n\ufeffline two", "line one\n\ufeffline two"),
        ("one      \ntwo", "one  \ntwo"),
        ("one \ntwo\t \nthree  \n\nfour  ", "one\ntwo\nthree\n\nfour"),
        ("a\n \t \n\n b", "a\n\n b"),
        ("intro\n\n```sh  \nA  \n\n\n\nB\t\n```\n\n\nend", "intro\n\n```sh\nA  \n\n\n\nB\t\n```\n\nend"),
        ("````\n```\ny  \n````\n\n\nz", "````\n```\ny  \n````\n\nz"),
        ("```x```  \n\n\n\ny", "```x```\n\ny"),
        ("~~~ a`b\nx  \n\n\n```\n", "~~~ a`b\nx  \n\n\n```"),
        ("> ```\nA  \n\n\n\nB", "> ```\nA\n\nB"),
        ("e\x00\u0301", "é"),
        ("   ", ""),
        (None, None),
    ],
)
def test_normal_form(given, want):
    assert text.normalize_text(given) == want
    assert text.normalize_text(want) == want


@pytest.mark.parametrize(
    ("said", "most", "overlap", "want"),
    [
        ("aa bb\n\ncc dd\nee ff gg", 16, 0, ["aa bb\n\n", "cc dd\nee ff gg"]),
        ("aa\n\nbb\n\ncc dd ee ff gg hh", 11, 0, ["aa\n\nbb\n\n", "cc dd ee ", "ff gg hh"]),
        ("aa bb cc\ndd ee ff gg", 14, 0, ["aa bb cc\n", "dd ee ff gg"]),
        ("aaaa bbbb cccc dddd", 12, 0, ["aaaa bbbb ", "cccc dddd"]),
        ("aa\n\nbbbbbbbbbbbbbb", 8, 5, [(0, 8), (3, 11), (6, 14), (9, 17), (12, 18)]),
        ("aa\n\nbbbbbbbbbbbbbb", 8, 3, [(0, 4), (1, 9), (6, 14), (11, 18)]),
        ("ab" + "e\u0301" * 3 + "cd", 3, 0, [(0, 2), (2, 4), (4, 6), (6, 9), (9, 10)]),
        ("x" + " " * 9 + "y", 4, 0, [(0, 4), (8, 11)]),
        ("", 4, 0, []),
        ("p one.\n\n" + "w " * 700, 1200, 120, [(0, 1200), (1080, 1408)]),
    ],
)
def test_chunk_rules(said, most, overlap, want):
    got = text.chunk_bounds(said, most, overlap)
    assert (got if want and isinstance(want[0], tuple) else [said[a:b] for a, b in got]) == want


def test_literals(spark):
    rows = spark.createDataFrame([("Run `Sed -i x` on /etc/app.conf, see / and `/etc/app.conf`. (/API/v1).", "/etc/app.conf sed -i x")], "t string, c string")
    got = rows.select(text.literals(F.col("t")).alias("l"), text.ungrounded_literals(F.col("t"), F.col("c")).alias("u")).first()
    assert got["l"] == ["Sed -i x", "/etc/app.conf", "/API/v1"] and got["u"] == ["Sed -i x", "/API/v1"]


def test_timeline_and_correlation(spark):
    rows = [
        event("nginx-1", "2026-01-01T00:00:00Z", method="GET", path="/api/search", query="q=%27%20or%20%271%27%3D%271"),
        event("application-1", "2026-01-01T00:00:02Z", source="application", method="get", path="/search", query="q=' or '1'='1"),
        event("application-2", "2026-01-01T00:00:06Z", source="application", method="GET", path="/search", query="q=' or '1'='1"),
        event("application-3", "2026-01-01T01:00:00Z", source="application", method="GET", path="/z", request_id="r1", query="x"),
        event("nginx-2", "2026-01-01T02:00:00Z", method="POST", path="/z", request_id="r1", query="1; drop table users"),
        event("auth-1", "2026-01-01T03:00:00Z", source="linux_auth", kind="authentication_failure", action="authentication_failed"),
        event("docker-1", "2026-01-01T03:00:00Z", source="docker", kind="container_state", action="running"),
    ]
    line = reconstruct.timeline(events(spark, rows))
    got = {r["event_id"]: (r["suspicious"], r["stage_label"]) for r in line.collect()}
    assert got["nginx-1"] == (True, "exploitation_attempt_indicator") and got["auth-1"][1] == "authentication_activity_observed"
    assert got["docker-1"][1] == "system_state_or_process_event" and got["application-3"] == (False, "web_request_observed")
    pairs = {(r["left_id"], r["right_id"]): r for r in reconstruct.correlate(reconstruct.requests(events(spark, rows))).collect()}
    assert set(pairs) == {("nginx-1", "application-1"), ("application-3", "nginx-2")}
    assert pairs["nginx-1", "application-1"]["strength"] == "strong_candidate" and pairs["nginx-1", "application-1"]["timestamp_delta_seconds"] == 2.0
    assert pairs["application-3", "nginx-2"]["signals"] == ["request_id_matches"]
    said = reconstruct.numbered_ids(reconstruct.claims(line), "claim", "claim_id", "observed_at", "event_id").collect()
    assert [r["claim_id"] for r in said] == ["claim_001", "claim_002", "claim_003", "claim_004"]
    cause = reconstruct.root_cause(line).first()
    assert (cause["status"], cause["confidence"], cause["n_supporting"]) == ("hypothesis_not_confirmed", 0.55, 4)
    assert reconstruct.root_cause(line.where("event_id = 'auth-1'")).first()["status"] == "insufficient_evidence"
    assert reconstruct.unknown_references(reconstruct.claims(line), "evidence_ids", events(spark, rows[1:]), "event_id").first()["missing_id"] == "nginx-1"


def test_answers_are_withheld(spark):
    rows = events(spark, [event("a", "x", method="GET", expected_stage="z", ground_truth="y")])
    assert evidence.without_answers(rows).first()["attributes"] == {"method": "GET"}
    with pytest.raises(Exception, match="answer-key"):
        evidence.refuse_answers(rows).collect()
    assert evidence.text_view(rows).first()["line"].startswith("id=a time=x source=nginx from=- to=- action=GET /x method=GET path=-")
    ips = spark.createDataFrame([("1.2.3.4",), ("256.1.1.1",), ("::1",), ("fe80::1%eth0",), ("web",), ("1.2.3",)], "t string").select(evidence.is_ip(F.col("t")).alias("r")).collect()
    assert [r["r"] for r in ips] == [True, False, True, True, False, False]


def graph_of(spark, edges):
    names = sorted({x for a, b, *_ in edges for x in (a, b)})
    nodes = spark.createDataFrame([(n, "service", n, "observed", {}, [], [], 0) for n in names], NODE)
    return nodes, spark.createDataFrame([(a, b, t, basis, {}, [], [], i) for i, (a, b, t, basis) in enumerate(edges)], EDGE)


def plain_paths(nodes, edges, source, target, max_hops, max_paths):
    """A breadth-first search that stops expanding when enough are found."""
    near = {}
    for a, b, t, basis in sorted(edges, key=lambda e: (e[1], e[2])):
        near.setdefault(a, []).append((b, graph.WEIGHTS.get(t, 0.1) * (1 if basis == "observed" else 0.25)))
    queue, out = [((source,), ())], []
    while queue and len(out) < max_paths:
        path, w = queue.pop(0)
        if len(w) < max_hops:
            for b, x in near.get(path[-1], []):
                if b == target:
                    out.append(((*path, b), sum((*w, x)) / (len(w) + 1)))
                elif b not in path:
                    queue.append(((*path, b), (*w, x)))
    return sorted(out, key=lambda p: (-round(p[1], 9), len(p[0]), p[0]))


def test_paths(spark):
    nodes, edges = graph_of(spark, [("a", "b", "forwards", "observed"), ("b", "c", "depends_on", "configured"), ("a", "d", "connects_to", "configured"), ("d", "c", "forwards", "observed")])
    ends = spark.createDataFrame([("a", "c"), ("a", "a"), ("a", "x")], "source string, target string")
    got = [(r["nodes"], round(r["score"], 9)) for r in graph.candidate_paths(nodes, edges, ends).orderBy(F.desc("target"), "rank").collect()]
    assert got == [(["a", "b", "c"], 0.575), (["a", "d", "c"], 0.5625), (["a"], 1.0)]
    rng = random.Random(4)
    raw = sorted({(rng.choice("abcdefg"), rng.choice("abcdefg"), rng.choice(sorted(graph.WEIGHTS)), rng.choice(["observed", "configured"])) for _ in range(30)})
    raw = [e for e in {(a, b, t): (a, b, t, s) for a, b, t, s in raw}.values() if e[0] != e[1]]
    nodes, edges = graph_of(spark, raw)
    for most in (1, 3, 50):
        got = [(tuple(r["nodes"]), round(r["score"], 9)) for r in graph.candidate_paths(nodes, edges, spark.createDataFrame([("a", "g")], "source string, target string"), 4, most).collect()]
        want = [(p, round(s, 9)) for p, s in plain_paths("", raw, "a", "g", 4, most)]
        assert sorted(got) == sorted(want)
    with pytest.raises(ValueError):
        graph.candidate_paths(nodes, edges, ends, 0)


def test_graph_construction(spark):
    rows = [
        event("d1", "t", source="docker", kind="container_state", a="api", action="running", seq=1, container_id="c1", exposed_ports='["8000/tcp"]'),
        event("d2", "t", source="docker", kind="network_membership", a="api", b="net", seq=2, ip_address="172.18.0.3"),
        event("n1", "t", a="10.0.0.9", b="172.18.0.3", seq=3, method="GET", path="/"),
        event("n2", "t", a="10.0.0.9", b="172.18.0.3", seq=4, method="GET", path="/y"),
        event("p1", "t", source="packet_capture", kind="network_packet", a="10.0.0.9", b="172.18.0.3", seq=5),
        event("p2", "t", source="packet_capture", kind="network_packet", a="10.0.0.9", b="8.8.8.8", seq=6),
    ]
    env = spark.createDataFrame([("web", "API_HOST", "api"), ("web", "X_HOST", "gone"), ("web", "API", "api")], "name string, key string, value string")
    nodes, edges = graph.build_graph(events(spark, rows), env)
    kinds = {r["node_id"]: r["basis"] for r in nodes.collect()}
    assert kinds["ip:172.18.0.3"] == "observed" and kinds["service:api"] == "configured" and "ip:8.8.8.8" not in kinds
    got = {(r["source"], r["target"], r["edge_type"]): r for r in edges.collect()}
    assert set(got) == {("container:api", "service:api", "hosts"), ("container:api", "ip:172.18.0.3", "connects_to"), ("ip:10.0.0.9", "service:nginx", "accesses"), ("service:nginx", "service:api", "forwards"), ("ip:10.0.0.9", "ip:172.18.0.3", "communicates_with"), ("service:web", "service:api", "depends_on")}
    assert got["ip:10.0.0.9", "service:nginx", "accesses"]["n_evidence"] == 2
    key = ("source", "target", "edge_type")
    cited = graph.evidence_of(graph.graph_rows(events(spark, rows), env)[1], *key)
    whole = {tuple(r[c] for c in key): r["evidence_ids"] for r in graph.exported(edges, cited, *key).collect()}
    assert whole["ip:10.0.0.9", "service:nginx", "accesses"] == ["n1", "n2"] and whole["service:web", "service:api", "depends_on"] == []
    line = events(spark, rows).withColumn("suspicious", F.col("event_id") == "n2")
    met = reconstruct.request_relationships(line, reconstruct.relationships(nodes, edges), cited).collect()
    assert {(r["event_id"], r["relationship"]) for r in met} == {("n2", "accesses"), ("n2", "forwards")}


def test_bm25_equals_full_text_index(spark):
    rng = random.Random(6)
    vocabulary = ["injection", "query", "server", "token", "login", "attack", "user", "data", "the"]
    rows = [(f"d{i // 2}", i % 2, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 40)))) for i in range(40)]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(body, tokenize='unicode61')")
    con.executemany("insert into f(rowid, body) values (?, ?)", [(i + 1, t) for i, (_, _, t) in enumerate(rows)])
    terms = ["injection", "token", "sql", "login user"]
    want = {rows[i - 1][:2]: -s for i, s in con.execute("select rowid, bm25(f) from f where f match ?", (" OR ".join(f'"{t}"' for t in terms),))}
    chunks = spark.createDataFrame(rows, "doc_id string, ordinal int, text string")
    asked = spark.createDataFrame([(1, t) for t in terms], "query_id int, term string")
    got = {(r["doc_id"], r["ordinal"]): r["score"] for r in retrieval.bm25_hits(chunks, asked).collect()}
    assert set(got) == set(want)
    assert all(math.isclose(got[k], want[k], abs_tol=1e-8) for k in want)


def test_fusion_and_measures(spark):
    lane = lambda ids: spark.createDataFrame([(1, d, i) for i, d in enumerate(ids, 1)], "query_id int, doc_id string, rank int")
    fused = retrieval.fuse([("x", lane(["a", "b", "c"])), ("y", lane(["c", "d"]))]).orderBy("rank").collect()
    assert [r["doc_id"] for r in fused] == ["c", "a", "b", "d"] and math.isclose(fused[0]["score"], 1 / 63 + 1 / 61)
    judged = spark.createDataFrame([(1, "b"), (1, "z"), (2, "q")], "query_id int, doc_id string")
    each = {r["query_id"]: r for r in evaluation.ranking_measures(lane(["a", "b", "c"]), judged).collect()}
    assert each[1]["recall_at_3"] == 0.5 and each[1]["reciprocal_rank"] == 0.5 and each[2]["reciprocal_rank"] == 0.0
    assert math.isclose(evaluation.random_reciprocal_rank(3, 1), (1 + 1 / 2 + 1 / 3) / 3)
    people = spark.createDataFrame([(1, "a", "author", "p", 0), (1, "b", "author", "p", 1), (1, "b", "reviewer", "q", 0)], "case_id int, doc_id string, role string, person string, position int")
    assert [r["doc_id"] for r in evaluation.agreed_labels(people).collect()] == ["b"]
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([0.6, 0.8],), ([float("nan"), 1.0],), (None,)], "v array<double>")
    assert [r["i"] for r in v.select(retrieval.vector_issue(F.col("v"), 2).alias("i")).collect()] == ["not_unit", "zero", None, "not_finite", "shape"]


BODY = '{"data":[{"id":1,"message":"alpha one"},{"id":2,"message":"beta"}]}'


def test_probe_rules(spark):
    base = spark.createDataFrame([(c, t, 200, b) for c in "abcde" for t, b in (("alpha", '{"data":[{"id":1,"message":"alpha one"}]}'), ("beta", '{"data":[{"id":2,"message":"beta"}]}'))] + [("f", "alpha", 500, None)], "case_id string, term string, status_code int, body string")
    probe = spark.createDataFrame(
        [("a", "zz", 200, BODY), ("b", "zz", 200, '{"data":[{"id":9,"message":"new"}]}'), ("c", "alpha", 200, '{"data":[{"id":1,"message":"alpha one"}]}'), ("d", "zz", 200, '{"data":[{"id":1,"message":"other"}]}'), ("e", "zz", 200, "oops"), ("f", "zz", 200, BODY)],
        "case_id string, literal string, status_code int, body string",
    )
    results = rules.probe_conditions(probe, base)
    got = {r["case_id"]: r["status"] for r in rules.first_rule(results, spark.createDataFrame(rules.SEARCH_RULES, rules.RULE)).collect()}
    assert got == {"a": "objective_achieved", "b": "inconclusive", "c": "objective_not_observed", "d": "inconclusive", "e": "inconclusive", "f": "inconclusive"}
    assert one(spark, '{"data":[{"id":1,"message":"x"},{"id":1,"message":"y"}]}', rules.parse_records) is None


REPORT = "struct<report_kind:string,run_id:string,incident_id:string,scenario_id:string,definition_sha256:string,oracle:string,origin:string,tested_state:string,pre_state_id:string,post_state_id:string,application_state:string,applied_ids:array<string>,transport_kind:string,started_at:string,finished_at:string,status:string>"


def report(**changes):
    base = dict(report_kind="validation", run_id="r1", incident_id="i", scenario_id="s", definition_sha256="h", oracle="o:1", origin="http://x", tested_state="pre_remediation", pre_state_id="p", post_state_id=None, application_state=None, applied_ids=[], transport_kind="http", started_at="2026-01-01T00", finished_at="2026-01-01T01", status="objective_achieved")
    return tuple((base | changes).values())


def test_comparison_and_judge(spark):
    after = dict(run_id="r2", tested_state="post_remediation", post_state_id="q", application_state="independently_attested", applied_ids=["x"], started_at="2026-01-02T00", finished_at="2026-01-02T01", status="objective_not_observed")
    rows = [(1, report(), report(**after)), (2, report(), report(**after | {"run_id": "r1", "post_state_id": "p"})), (3, report(status="blocked"), report(**after)), (4, report(transport_kind="fake"), report(**after | {"transport_kind": "fake"})), (5, report(status="inconclusive"), report(**after))]
    got = {r["k"]: r for r in rules.compare_reports(spark.createDataFrame(rows, f"k int, a {REPORT}, b {REPORT}")).collect()}
    assert got[1]["category"] == "objective_not_observed_after_baseline_achieved" and got[1]["usable"]
    assert got[2]["problems"] == ["same_run", "states_not_distinct"] and got[2]["category"] == "not_comparable"
    assert got[3]["category"] == "baseline_not_run" and not got[3]["comparable"]
    assert got[4]["interpretation"] == "simulation_only" and not got[4]["usable"]
    assert got[5]["category"] == "baseline_inconclusive"
    s = "status string, reason_code string, mode_conflict boolean, id_collision boolean, roles_conflict boolean, n_dangling int, rule_confirmed boolean, provenance string, claim string, n_proposals int, attested boolean"
    cases = [("blocked", None, False, False, False, 0, True, "live", None, 0, False), ("objective_not_observed", None, False, False, False, 0, True, "live", "application_secure", 0, False), ("objective_not_observed", None, False, False, True, 0, True, "live", None, 0, False), ("objective_not_observed", None, False, False, False, 0, True, None, None, 0, False), ("objective_achieved", None, False, False, False, 0, True, "mocked", "objective_achieved", 0, False)]
    assert [r["decision"] for r in rules.judge(spark.createDataFrame(cases, s)).collect()] == ["blocked", "not_supported", "inconclusive", "inconclusive", "supported"]


SAID = [
        ("The database was compromised.", "compromise", True),
        ("There is no evidence that the database was compromised.", "compromise", False),
        ("It does not establish A, or that the server was breached.", "compromise", False),
        ("No evidence. The server was breached.", "compromise", True),
        ("If the server was breached, logs would show it.", "compromise", False),
        ("SQL injection is confirmed.", "confirmation", True),
        ("SQL injection has not been confirmed.", "confirmation", False),
        ("This will prevent all SQL injection.", "success", True),
        ("This does not guarantee safety.", "success", False),
        ("Successful exploitation cannot be confirmed.", "impact", False),
        ("Successful exploitation occurred.", "impact", True),
        ("", "impact", False),
        ("We cannot say whether this will prevent all attacks.", "success", False),
        ("No claim is made that the service is now secure.", "success", False),
        ("It could completely eliminate the risk.", "success", True),
        ("Suspicious requests represent observed activity rather than confirmed exploitation.", "confirmation", False),
        ("No server-side vulnerability or successful query manipulation has been proven by the evidence.", "confirmation", False),
        ("No vulnerability has been proven, but exploitation is confirmed.", "confirmation", True),
        ("The vulnerability has been proven.", "confirmation", True),
        ("It may be that the attack is confirmed.", "confirmation", True),
        ("It may be established that the app is injectable.", "confirmation", False),
        ("There is no confirmed access in which the server was breached.", "compromise", False),
        ("No evidence of theft, but the database was breached.", "compromise", True),
        ("No evidence of theft was found. The database was breached.", "compromise", True),
        ("It does not establish access, exfiltration, or successful exploitation.", "impact", False),
        ("It does not establish access, and successful exploitation occurred.", "impact", True),
        ("It does not establish access, successful exploitation occurred.", "impact", True),
        ("Successful exploitation has not yet been established.", "impact", False),
        ("It does not currently establish that data was exfiltrated.", "impact", False),
        ("No evidence. Data was exfiltrated.", "impact", True),
        ("The logs don't show that the system was compromised.", "compromise", False),
        ("Nothing is known; the attacker gained root, however.", "impact", True),
        ("It is not clear that the host was breached.", "compromise", False),
        ("Root cause is confirmed (see below).", "stated", True),
        ("Neither theft nor data exfiltrated elsewhere.", "impact", False),
]


def test_claim_screens(spark):
    rows = spark.createDataFrame([(i, said) for i, (said, _, _) in enumerate(SAID)], "k int, t string")
    got = {(r["k"], r["screen"]) for r in claims.screen_claims(rows, "k", "t", tuple(claims.SCREENS)).collect()}
    assert [(said, screen, (i, screen) in got) for i, (said, screen, _) in enumerate(SAID)] == SAID


def test_claim_places(spark):
    text = "Ça va.\nThe database was\nbreached! The database was breached."
    got = claims.screen_claims(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t", ("compromise",)).collect()
    assert sorted((r["start"], text[r["start"] : r["end"]]) for r in got) == [(11, "database was\nbreached"), (38, "database was breached")]
    assert all(text[r["start"] : r["end"]] == r["words"] for r in got)


def test_claim_rows_and_facts(spark):
    rows = spark.createDataFrame([(1, "The attacker gained root. Fine."), (2, None)], "k int, t string")
    assert {(r["k"], r["words"]) for r in claims.screen_claims(rows, "k", "t").collect()} >= {(1, "attacker gained root")}
    denied = "The logs do not confirm that an attack succeeded or that the system was compromised."
    cases = [
        (f"All good. {denied} then end.", ["attack succeeded", "system was compromised"], f"All good. {claims.DENIAL} Then end."),
        (f"{denied} No logs were available to confirm successful exploitation.", ["successful exploitation"], f"{denied} {claims.DENIAL}"),
        (f"{denied} No logs show theft. End.", ["Attack Succeeded", "theft"], f"{claims.DENIAL} End."),
        (f"{denied} The attack succeeded.", ["attack succeeded"], None),
        ("It does not show theft but the attack succeeded.", ["attack succeeded"], None),
        ("Nothing here.", ["attack succeeded"], None),
        (denied, ["attack succeeded"], claims.DENIAL),
        (denied, [], None),
        (None, ["x"], None),
        ("", ["x"], None),
        (denied, None, None),
    ]
    texts = spark.createDataFrame([(i, t, p) for i, (t, p, _) in enumerate(cases)], "i int, t string, p array<string>").orderBy("i")
    assert [r[0] for r in texts.select(claims.neutral_text(F.col("t"), F.col("p"))).collect()] == [want for _, _, want in cases]
    said = spark.createDataFrame([("GET /a/b returned HTTP 200, POST too", ["GET"], ["200"], ["/a/b"])], "t string, m array<string>, s array<string>, p array<string>")
    assert said.select(claims.fact_issues(F.col("t"), F.col("m"), F.col("s"), F.col("p")).alias("r")).first()["r"] == ["method:POST"]


def test_grounding(spark):
    facts = spark.createDataFrame([("db", "port", "1", True, ["a"]), ("db", "port", "1", False, ["b"]), ("db", "port", "2", True, ["c"]), ("db", "env", "x", False, []), ("db", "env", "y", False, [])], "subject string, attribute string, value string, single_valued boolean, evidence_ids array<string>")
    merged = grounding.merge_facts(facts)
    assert {(r["attribute"], r["value"]): r["n_evidence"] for r in merged.collect()} == {("port", "1"): 2, ("port", "2"): 1, ("env", "x"): 0, ("env", "y"): 0}
    assert {r["evidence_id"] for r in grounding.fact_evidence(facts).where("value = '1'").collect()} == {"a", "b"}
    assert [(r["attribute"], r["values"]) for r in grounding.fact_conflicts(merged).collect()] == [("port", ["1", "2"])]
    assert {r["attribute"] for r in grounding.usable_facts(merged).collect()} == {"env"}
    drafts = spark.createDataFrame([(0, [], "high", "low", "reversible"), (1, ["e"], "low", "high", "weird"), (2, ["e"], "low", "low", None)], "index int, observed_evidence_ids array<string>, severity string, disruption string, reversibility string")
    assert [r["index"] for r in grounding.rank_proposals(drafts).orderBy("priority_rank").collect()] == [2, 1, 0]
    cited = spark.createDataFrame([("s[0]", "e1", "observed"), ("s[1]", "d1", "observed"), ("s[2]", "no", "reference")], "location string, id string, expected string")
    catalog = spark.createDataFrame([("e1", "observed"), ("d1", "reference")], "id string, kind string")
    assert {r["location"]: r["code"] for r in grounding.citation_issues(cited, catalog).collect()} == {"s[1]": "wrong_category", "s[2]": "unknown_id"}


def test_request_features(spark):
    row = spark.createDataFrame([("get", "/API/search?x", "q=%27%20OR%201=1--", "200"), (None, None, None, None)], "m string, p string, q string, s string")
    f = row.select(requests.features(*map(F.col, "mpqs")).alias("f")).collect()
    assert len(f[0]["f"]) == 23 and f[0]["f"][0] == 1.0 and f[0]["f"][6] == 1.0 and f[0]["f"][17:22] == [1.0, 1.0, 0.0, 0.0, 1.0]
    assert f[1]["f"][5] == 1.0 and f[1]["f"][10] == 1.0 and f[1]["f"][16] == 1.0 and f[1]["f"][22] == 0.0


def test_risk(spark):
    rows = spark.createDataFrame([(1, 0.5, 2.0), (2, None, 1.0)], "k int, a double, b double")
    with pytest.raises(Exception, match="unknown risk features: a"):
        risk.require_known(rows, "a", "b").collect()
    rng = np.random.default_rng(0)
    data = [(float(a), float(b), int(a + 0.2 * rng.normal() > 0)) for a, b in rng.normal(size=(300, 2))]
    train = spark.createDataFrame(data, "a double, b double, y int")
    model = risk.logistic_baseline(train, ["a", "b"], "y")
    w = model.coefficients.toArray()
    assert w[0] > 5 * abs(w[1])
    # the gradient of mean loss plus half the penalty vanishes at the optimum
    x, y = np.array([d[:2] for d in data]), np.array([d[2] for d in data])
    p = 1 / (1 + np.exp(-(x @ w + model.intercept)))
    assert np.abs(x.T @ (p - y) / len(y) + w / (0.1 * len(y))).max() < 1e-3
    out = risk.shapley(train.limit(5), ["a", "b"], {"a": 0.0, "b": 0.0}, lambda c: c["a"] * c["b"] + 3 * c["a"]).collect()
    assert all(math.isclose(r["phi_a"] + r["phi_b"], r["a"] * r["b"] + 3 * r["a"], abs_tol=1e-9) for r in out)


def test_graph_network(spark):
    rng = random.Random(2)
    nodes, edges = [], []
    for g in range(12):
        names = [f"n{i}" for i in range(6)]
        nodes += [(f"g{g}", n, rng.choice(gnn.NODE_TYPES), "observed") for n in names]
        for a in names:
            for b in names:
                if a != b and rng.random() < 0.4:
                    kind = rng.choice(["accesses", "hosts"])
                    edges.append((f"g{g}", a, b, kind, "observed", kind == "accesses"))
    n = spark.createDataFrame(nodes, "graph_id string, node_id string, node_type string, basis string")
    e = spark.createDataFrame(edges, "graph_id string, source string, target string, edge_type string, basis string, label boolean")
    vectors = gnn.node_vectors(n, spark.createDataFrame([], "graph_id string, node_id string, features array<double>"))
    labelled = e.withColumn("label", F.col("label").cast("int")).withColumn("split", F.when(F.col("graph_id").isin("g9", "g10", "g11"), "validation").otherwise("train"))
    trained = gnn_training.train(vectors, e, labelled, epochs=15, rate=0.05)
    w = trained.weights
    assert trained.validation_losses[-1] < trained.validation_losses[0]
    scored = gnn.score_edges(vectors, e, w).join(e, ["graph_id", "source", "target", "edge_type"])
    m = evaluation.binary_scores(scored, F.col("label"), F.col("probability") > 0.5).first()
    assert m["accuracy"] > 0.85 and scored.count() == len(edges)
    paths = spark.createDataFrame([("g0", 1, ["n0", "n1"]), ("g0", 2, ["n0"])], "graph_id string, path_id int, nodes array<string>")
    got = {r["path_id"]: r["coherence"] for r in gnn.path_coherence(paths, gnn.embed_nodes(vectors, e, w)).collect()}
    assert -1 <= got[1] <= 1 and got[2] == 1.0


def test_message_passing_equals_plain_layers(spark):
    """Two layers over joins are those of plain sums over each graph, with repeated edges, loops and ends that are no nodes."""
    import numpy as np

    rng, w = random.Random(5), gnn.initial_weights()
    names = {g: [f"n{i}" for i in range(5)] for g in ("x", "y")}
    nodes = [(g, n, rng.choice(gnn.NODE_TYPES), rng.choice(gnn.BASES)) for g, own in names.items() for n in own]
    edges = [(g, rng.choice(own), rng.choice([*own, "gone"]), rng.choice([*gnn.EDGE_TYPES, "odd"]), rng.choice([*gnn.BASES, None])) for g, own in names.items() for _ in range(14)]
    n = spark.createDataFrame(nodes, "graph_id string, node_id string, node_type string, basis string")
    e = spark.createDataFrame(edges, "graph_id string, source string, target string, edge_type string, basis string")
    vectors = gnn.node_vectors(n, spark.createDataFrame([], "graph_id string, node_id string, features array<double>"))
    h = {(r["graph_id"], r["node_id"]): np.array(r["features"]) for r in vectors.collect()}
    for own, rel, relu in (("own1", "rel1", False), ("own2", "rel2", True)):
        h = {k: np.maximum(v, 0) if relu else v for k, v in h.items()}
        new = {k: v @ w[own] for k, v in h.items()}
        for g, node in new:
            groups = {}
            for gg, a, b, kind, basis in edges:
                if gg == g and b == node:
                    r = (gnn.EDGE_TYPES.index(kind) if kind in gnn.EDGE_TYPES else 0) * 2 + (gnn.BASES.index(basis) if basis in gnn.BASES else 1)
                    groups.setdefault(r, []).append(h[g, a])
            new[g, node] = new[g, node] + sum((np.mean(v, 0) @ w[rel][r] for r, v in groups.items()), 0)
        h = new
    got = {(r["graph_id"], r["node_id"]): np.array(r["embedding"]) for r in gnn.embed_nodes(vectors, e, w).collect()}
    assert set(got) == set(h) and all(np.allclose(got[k], h[k]) for k in h)
    scored = gnn.score_edges(vectors, e, w)
    assert scored.count() == sum(b != "gone" for _, _, b, *_ in edges)


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    base = dt.datetime(2026, 1, 1)
    rows = [("r%d" % i, "acc", base + dt.timedelta(seconds=10 * i), 40) for i in range(12)]
    spark.createDataFrame(rows, "request_id string, account string, at timestamp, tokens long").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("request_id string, account string, at timestamp, tokens long").parquet(src)

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    counts = run(windows.activity(stream, "at", ["account"], "1 minute"), "w", "complete")
    assert sorted(r["n"] for r in counts) == [6, 6]
    batch = spark.createDataFrame(rows, "request_id string, account string, at timestamp, tokens long")
    assert max(r["used"] for r in windows.used_tokens(batch, "account", "at", "tokens").collect()) == 240
    assert windows.sessions(batch, "at", "account").first()["n"] == 12
