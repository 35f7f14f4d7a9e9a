"""Registered queries of the sources, over files and rows made from the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import events as event_files
from ..sources import captures, documents, formats, logs, snapshots
from ..sources.scratch import scratch_dir
from .registry import query
from .tables import events, table


def _folder(spark, name):
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("""
    select event_id::varchar as event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts_text, epoch_us(ts) as micros, user_id::varchar as source_entity, event_type as action, '/' || event_type as path, event_type <> 'view' as has_method from events
""")
def q_event_files(spark, d):
    """Events written as JSON lines and read back."""
    at = _folder(spark, "events")
    event_files.write_events(events(spark, d), at)
    got = event_files.read_events(spark, at)
    micros = F.unix_micros(F.to_utc_timestamp("ts", F.current_timezone())) - F.unix_micros(F.to_utc_timestamp(F.timestamp_seconds(F.lit(0)), F.current_timezone()))
    return got.select("event_id", "ts_text", micros.alias("micros"), "source_entity", "action", F.element_at("attributes", F.lit("path")).alias("path"), F.element_at("attributes", F.lit("method")).isNotNull().alias("has_method"))


@query("select 'broken ' || event_id as broken from events where event_id % 7 = 0 union all select '{\"event_id\": ' || event_id as broken from events where event_id % 7 = 1")
def q_broken_lines(spark, d):
    at = _folder(spark, "lines")
    i = F.col("event_id").cast("string")
    line = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("broken "), i)).when(F.col("event_id") % 7 == 1, F.concat(F.lit('{"event_id": '), i)).otherwise(F.to_json(F.struct(i.alias("event_id"), F.col("event_type").alias("action"))))
    table(spark, d, "events").select(line.alias("value")).write.text(at)
    return event_files.broken_lines(spark, at).select("broken")


@query("""
    select source, count(*) as n, min(seq) as first_seq, max(seq) as last_seq from (
        select 'docker' as source, 281474976710656::bigint + s_suppkey as seq from supplier union all select 'nginx', 2 * 281474976710656::bigint + event_id from events
        union all select 'other', 6 * 281474976710656::bigint + c_custkey from customer) group by 1
""")
def q_union_sources(spark, d):
    from ..schema import event_columns

    rows = lambda t, key, name: table(spark, d, t).select(*event_columns(event_id=F.col(key), seq=F.col(key), source=F.lit(name)))
    found = event_files.union_sources(spark, rows("supplier", "s_suppkey", "docker"), None, rows("events", "event_id", "nginx"), rows("customer", "c_custkey", "other"))
    return found.groupBy("source").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query("""
    select 'docker-network-' || r_regionkey || '-' || substr('nation' || n_nationkey || 'xxxxxxxxxxxx', 1, 12) as event_id, n_name as source_entity, r_name as destination_entity, '10.0.' || r_regionkey || '.' || n_nationkey as ip
    from nation join region on r_regionkey = n_regionkey
""")
def q_network_snapshot(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    key = F.concat(F.lit("nation"), "n_nationkey", F.lit("xxxxxxxxxxxx"))
    body = F.struct(F.col("n_name").alias("Name"), F.concat(F.lit("10.0."), "n_regionkey", F.lit("."), "n_nationkey", F.lit("/24")).alias("IPv4Address"))
    held = n.groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct(key, body))).alias("Containers"))  # five regions
    whole = r.join(held, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_regionkey").alias("index"), F.to_json(F.struct(F.col("r_name").alias("Name"), F.lit("2026-01-01T00:00:00Z").alias("Created"), "Containers")).alias("j"))
    item = F.from_json("j", "struct<" + snapshots._as_struct(" ".join(snapshots.NETWORK.split())) + ">")
    found = snapshots.network_events(whole.select("index", item.alias("item")))
    return found.select("event_id", "source_entity", "destination_entity", F.element_at("attributes", F.lit("ip_address")).alias("ip"))


@query("select s_name as name, 'DB_HOST' as key, 'h=' || s_nationkey as value from supplier union all select s_name, 'EMPTY', '' from supplier")
def q_environment(spark, d):
    said = F.array(F.concat(F.lit("DB_HOST=h="), "s_nationkey"), F.lit("EMPTY="), F.lit("no setting"))
    body = F.to_json(F.struct(F.concat(F.lit("/"), "s_name").alias("Name"), F.struct(said.alias("Env")).alias("Config")))
    item = F.from_json(body, "struct<" + snapshots._as_struct(" ".join(snapshots.CONTAINER.split())) + ">")
    return snapshots.environment(table(spark, d, "supplier").select(F.col("s_suppkey").alias("index"), item.alias("item")))


@query("""
    with l as (select page_id, unnest(string_split(html, chr(10))) as v from pages where html is not null)
    select page_id, count(*) as n, sum(len(trim(split_part(v, ':', 1))))::bigint as key_chars from l where contains(v, ':') and trim(split_part(v, ':', 1)) <> '' group by 1
""")
def q_header_lines(spark, d):
    pages = table(spark, d, "pages").where("html is not null")
    lines = pages.select(F.col("page_id").alias("file"), F.posexplode(F.split("html", "\n")).alias("n", "value"))
    found = logs.header_lines(lines)
    return found.groupBy(F.col("file").alias("page_id")).agg(F.count("*").alias("n"), F.sum(F.length("key")).alias("key_chars"))


@query("select o_orderkey::varchar as id, o_orderstatus as status, o_orderpriority as priority from orders")
def q_request_results(spark, d):
    at = _folder(spark, "results")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    rows.write.option("sep", "\t").option("header", True).csv(at)
    return logs.request_results(spark, at)


@query("""
    select epoch_us(ts) as micros, 'UDP' as protocol, '10.' || (user_id // 65536) % 256 || '.' || (user_id // 256) % 256 || '.' || user_id % 256 as src,
        '192.0.2.' || len(event_type) as dst, (event_id % 65536)::int as sport, 80 + len(event_type)::int as dport, 43 + len(event_type)::int + case when event_id % 3 = 0 then 200 else 0 end as size from events
""")
def q_captured_packets(spark, d):
    """A packet for each event, written as classic captures of one file a task and decoded in chunks.

    A record ends with the line feed that the text writer puts there; a file's first row begins with the file's head."""
    at = _folder(spark, "capture")
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.to_utc_timestamp("ts", "UTC")).alias("micros"))
    number = lambda c, size: F.lpad(F.hex(c.cast("long")), 2 * size, "0")
    n, i, u = F.length("event_type"), F.col("event_id"), F.col("user_id")
    filler = F.when(i % 3 == 0, F.repeat(F.lit("0A"), 200)).otherwise("")
    ip = [F.lit("4500002800000000401100000A"), number(u % (1 << 24), 3), F.lit("C00002"), number(n, 1), number(i % 65536, 2), number(80 + n, 2)]
    size = 43 + n + F.when(i % 3 == 0, 200).otherwise(0)
    record = F.concat(number(F.floor(F.col("micros") / 1_000_000), 4), number(F.pmod("micros", F.lit(1_000_000)), 4), number(size, 4), number(size, 4), F.repeat(F.lit("00"), 12), F.lit("0800"), *ip, F.lit("00000000"), F.hex("event_type"), filler)
    head = F.lit("A1B2C3D4000200040000000000000000" + "0000FFFF" + "00000001")
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    e.repartition(4, "event_id").select(F.unhex(F.concat(F.when(first, head).otherwise(""), record)).cast("string").alias("value")).write.option("lineSep", "\n").text(at)
    return captures.packets(spark, at).select("micros", "protocol", "src", "dst", "sport", "dport", "size")


@query("""
    with f as (select doc_id // 10 as f, min_by(lang, doc_id) as lang from documents group by 1),
        g as (select f, case lang when 'de' then 'file:a key is repeated' when 'fr' then 'file:the format is not corpus' when 'es' then 'file:not one JSON value' end as issue from f)
    select f as file, doc_id % 10 as index, 'made:' || doc_id as doc_id, case when n_chars > 1000 then source end as title, text as content, case when n_chars > 1000 then null else 'missing:title' end as issue
    from documents join g on f = doc_id // 10 where issue is null
    union all select f, 10, null, null, null, 'not_an_object' from g where issue is null
    union all select f, null, null, null, null, issue from g where issue is not null
""")
def q_local_documents(spark, d):
    """Ten documents to a JSON file, short ones without a title, and a number after them; the language of a file's first
    document says what is wrong with the file as a whole."""
    docs, at = table(spark, d, "documents"), _folder(spark, "local-documents")
    docs = docs.withColumn("file", F.floor(F.col("doc_id") / 10))
    record = F.to_json(F.struct(F.lit("made").alias("source"), F.col("doc_id").cast("string").alias("source_id"), F.lit("1").alias("source_version"), F.lit("page").alias("doc_type"), F.when(F.col("n_chars") > 1000, F.col("source")).alias("title"), F.col("text").alias("content")))
    kinds = docs.groupBy("file").agg(F.min_by("lang", "doc_id").alias("lang"))
    start = F.concat(F.lit('{"format": '), F.when(F.col("lang") == "fr", F.lit('"other", ')).otherwise(F.lit('"corpus", ')), F.when(F.col("lang") == "de", F.lit('"documents": [], ')).otherwise(""), F.lit('"documents": ['))
    end = F.when(F.col("lang") == "es", F.lit("3]")).otherwise(F.lit("3]}"))
    rows = kinds.select("file", F.lit(-1).cast("long").alias("k"), start.alias("value")).union(docs.select("file", "doc_id", F.concat(record, F.lit(",")))).union(kinds.select("file", F.lit((1 << 63) - 1), end))
    rows.repartition("file").sortWithinPartitions("file", "k").select("file", "value").write.partitionBy("file").text(at)
    got = documents.read_documents(spark, at, "corpus")
    return got.select(F.regexp_extract("file", r"file=(\d+)", 1).cast("long").alias("file"), F.col("index").cast("long").alias("index"), "doc_id", "title", "content", "issue")


def access_files(spark, d):
    """A folder of access logs with a line for each event and its line number for its size; every eleventh line is none of the format."""
    at = _folder(spark, "access")
    e = table(spark, d, "events").repartition("event_id").withColumn("n", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    status = F.when(F.col("event_type") == "error", "500").when(F.col("event_type") == "purchase", "201").otherwise("200")
    line = F.format_string('10.0.0.%d - - [%s +0000] "GET /%s?id=%d HTTP/1.1" %s %d "-" "check" upstream=- upstream_status=- request_time=0.1', F.col("user_id"), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), "event_type", "event_id", status, "n")
    e.select(F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("worker "), "event_id")).otherwise(line).alias("value")).write.text(at)
    return at


@query("""
    select event_id::varchar as id, '/' || event_type as path, '10.0.0.' || user_id as source_entity, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as ts_text, case event_type when 'error' then '500' else '201' end as status, true as numbered
    from events where event_id % 11 <> 0 and event_type in ('error', 'purchase')
""")
def q_log_ranges(spark, d):
    """Access logs read as byte ranges, with a filter at the reader and every line's number in its file."""
    lines = formats.log_lines(spark, access_files(spark, d), "access", 1 << 18).where(F.col("status").isin("500", "201"))
    got, said = logs.access_events(lines), lambda k: F.element_at("attributes", F.lit(k))
    return got.select(F.regexp_extract(said("query"), r"^id=(\d+)$", 1).alias("id"), said("path").alias("path"), "source_entity", "ts_text", said("status").alias("status"), (F.col("event_id") == F.concat(F.lit("nginx-"), said("body_bytes"))).alias("numbered"))
