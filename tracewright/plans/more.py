"""Further registered queries: log formats, context, checks, paths and models over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks, text
from ..operators import attribution, bayes, evaluation, evidence, gnn, gnn_training, graph, grounding, intake, paths, reconstruct, retrieval, risk, rules
from ..schema import event_columns
from ..sources import logs, snapshots, store
from ..streaming import windows
from .registry import query
from .tables import document_chunks, events, geography, table


def _lines(spark, d, line):
    """Events written as log lines, with their number as line number."""
    return table(spark, d, "events").select((F.col("event_id") + 1).alias("n"), line.alias("value"))


@query("""
    select 'nginx-' || (event_id + 1) as event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as ts_text, 'u' || user_id as source_entity, case when event_type = 'view' then null else '172.18.0.' || user_id end as destination_entity,
        'GET /' || event_type as action, 'k=' || user_id as query, '200' as status from events where event_type <> 'signup'
""")
def q_access_log(spark, d):
    up = F.when(F.col("event_type") == "view", "-").otherwise(F.concat(F.lit("172.18.0."), "user_id", F.lit(":8000")))
    tail = F.concat(F.lit(' HTTP/1.1" 200 17 "-" "agent" upstream='), up, F.lit(" upstream_status=200 request_time=0.01"))
    line = F.concat(F.lit("u"), "user_id", F.lit(" - - ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET /'), "event_type", F.lit("?k="), "user_id", tail)
    line = F.when(F.col("event_type") == "signup", "not a request").when(F.col("event_type") == "error", F.concat(F.lit("2024-01-01T00:00:00Z "), line)).otherwise(line)
    found = logs.access_events(_lines(spark, d, line))
    return found.select("event_id", "ts_text", "source_entity", "destination_entity", "action", F.element_at("attributes", F.lit("query")).alias("query"), F.element_at("attributes", F.lit("status")).alias("status"))


@query("""
    select 'linux-auth-' || (event_id + 1) as event_id, case event_type when 'error' then 'authentication_failure' when 'signup' then 'session_opened' when 'view' then 'session_closed' else 'authentication_event' end as event_type,
        'h' || user_id as source_entity, 'v' || event_id as user from events
""")
def q_auth_log(spark, d):
    said = F.when(F.col("event_type") == "error", "authentication failure").when(F.col("event_type") == "signup", "session opened").when(F.col("event_type") == "view", "session closed").otherwise("check pass")
    line = F.concat(F.lit("2026-01-01T00:00:00Z web sshd: pam_unix(sshd:auth): "), said, F.lit("; tty=ssh user=x rhost=h"), "user_id", F.lit(" user=v"), "event_id")
    return logs.auth_events(_lines(spark, d, line)).select("event_id", "event_type", "source_entity", F.element_at("attributes", F.lit("user")).alias("user"))


@query("select 'application-' || (event_id + 1) as event_id, '10.0.0.' || user_id as source_entity, 'POST /' || event_type as action, (40000 + user_id)::varchar as client_port from events where event_type <> 'view'")
def q_application_log(spark, d):
    line = F.concat(F.lit("2026-01-01T00:00:00Z INFO:     10.0.0."), "user_id", F.lit(":"), (F.col("user_id") + 40000).cast("string"), F.lit(' - "POST /'), "event_type", F.lit(' HTTP/1.1" 201 Created'))
    line = F.when(F.col("event_type") == "view", "INFO: started").otherwise(line)
    return logs.application_events(_lines(spark, d, line)).select("event_id", "source_entity", "action", F.element_at("attributes", F.lit("client_port")).alias("client_port"))


@query("""
    select 'docker-container-network-' || s_suppkey || '-' || n_name as event_id, s_name as source_entity, n_name as destination_entity, '10.' || s_nationkey || '.0.' || s_suppkey as ip
    from supplier join nation on n_nationkey = s_nationkey
""")
def q_container_snapshot(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    net = F.to_json(F.struct(F.concat(F.lit("10."), "s_nationkey", F.lit(".0."), "s_suppkey").alias("IPAddress"), F.lit(None).cast("array<string>").alias("Aliases")))
    body = F.concat(F.lit('{"Id":"'), "s_suppkey", F.lit('","Name":"/'), "s_name", F.lit('","Created":"2026-01-01T00:00:00Z","State":{"Status":"running"},"NetworkSettings":{"Networks":{"'), "n_name", F.lit('":'), net, F.lit("}}}"))
    item = F.from_json(body, "struct<" + snapshots._as_struct(" ".join(snapshots.CONTAINER.split())) + ">")
    found = snapshots.container_events(s.select(F.col("s_suppkey").alias("index"), item.alias("item")))
    return found.where("event_type = 'network_membership'").select("event_id", "source_entity", "destination_entity", F.element_at("attributes", F.lit("ip_address")).alias("ip"))


@query("""
    select 'container:' || s_name as canonical, string_agg(distinct l_shipmode, ',' order by l_shipmode) as aliases from (
        select s_name, l_returnflag || l_linestatus as l_shipmode from lineitem join supplier on s_suppkey = l_suppkey) group by 1
""")
def q_entities(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    held = F.create_map(F.lit("aliases"), F.to_json(F.array(F.concat("l_returnflag", "l_linestatus"))), F.lit("container_id"), F.col("s_suppkey").cast("string"))
    seen = rows.select(F.col("l_orderkey").alias("seq"), F.lit("docker").alias("source"), F.lit("network_membership").alias("event_type"), F.col("s_name").alias("source_entity"), held.alias("attributes"))
    return evidence.entities(seen).select("canonical", F.array_join("aliases", ",").alias("aliases"))


@query("select event_id::varchar as event_id, 'Event ' || event_id || ' contains SQL-injection-like syntax in /' || event_type || '.' as statement from events where event_type = 'error'")
def q_claims(spark, d):
    line = reconstruct.timeline(events(spark, d)).withColumn("suspicious", F.col("source") == "error")
    return reconstruct.claims(line).select("event_id", "statement")


@query("""
    with e as (select event_id, case when event_type = 'error' and value > 50 then 'exploitation_attempt_indicator' when event_type = 'signup' then 'authentication_activity_observed' when event_type in ('error', 'purchase') then 'web_request_observed'
        when event_type = 'click' then 'network_activity_observed' when value > 50 then 'system_state_or_process_event' else 'unclassified_event' end as stage_label from events)
    select event_id::varchar as event_id, stage_label, case when stage_label = 'exploitation_attempt_indicator' then 'attempt_indicator_observed_success_unconfirmed' when stage_label = 'authentication_activity_observed' then 'activity_observed_outcome_requires_evidence'
        when stage_label = 'unclassified_event' then 'observed_event_stage_unknown' else 'activity_observed' end as interpretation_status from e
""")
def q_stage_labels(spark, d):
    """Events of all stages: errors ask for something (an injection, twice encoded, where the value is high), clicks are packets,
    views are states of containers or notes, sign-ups are logins."""
    kind, high = F.col("event_type"), F.coalesce(F.col("value") > 50, F.lit(False))
    source = F.when(kind == "signup", "sshd").when(kind == "click", "tcp capture").when((kind == "view") & high, "docker").when(kind == "view", "notes").otherwise("proxy")
    asked = F.when((kind == "error") & high, "q=%2527%20OR%20%25271%2527=%25271").otherwise("q=plain+words")
    held = F.when(kind.isin("error", "purchase"), F.create_map(F.lit("method"), F.lit("GET"), F.lit("query"), asked)).otherwise(F.create_map().cast("map<string,string>"))
    rows = table(spark, d, "events").select(*event_columns(event_id=F.col("event_id"), seq=F.col("event_id"), ts_text=F.col("ts").cast("string"), ts=F.col("ts"), source=source, event_type=F.lit("record"), source_entity=F.col("user_id"), destination_entity=F.lit("host"), action=F.lit("seen"), attributes=held))
    return reconstruct.timeline(rows).select("event_id", "stage_label", "interpretation_status")


@query("""
    select user_id::varchar as user_id, case when count(case when event_type = 'error' then 1 end) > 0 then 'hypothesis_not_confirmed' else 'insufficient_evidence' end as status,
        case when count(case when event_type = 'error' then 1 end) > 0 then 0.55 else 0.0 end::double as confidence, count(case when event_type = 'error' then 1 end)::int as n from events group by 1
""")
def q_root_cause(spark, d):
    line = events(spark, d).withColumn("suspicious", F.col("source") == "error")
    out = reconstruct.root_cause(line, "source_entity")
    return out.select(F.col("source_entity").alias("user_id"), "status", "confidence", F.col("n_supporting").cast("int").alias("n"))


@query("""
    with e as (select 'nation:' || c_nationkey as source, 'customer:' || c_custkey as target, 'observed' as basis, c_mktsegment as kind from customer)
    select source, coalesce(n_name, source) as source_name, target, target as target_name, kind as relationship from e left join nation on 'nation:' || n_nationkey = source
""")
def q_relationships(spark, d):
    nodes = table(spark, d, "nation").select(F.concat(F.lit("nation:"), "n_nationkey").alias("node_id"), F.col("n_name").alias("name"))
    none = F.array().cast("array<string>")
    edges = table(spark, d, "customer").select(F.concat(F.lit("nation:"), "c_nationkey").alias("source"), F.concat(F.lit("customer:"), "c_custkey").alias("target"), F.lit("observed").alias("basis"), F.col("c_mktsegment").alias("edge_type"), none.alias("evidence_ids"), none.alias("source_artifacts"))
    return reconstruct.relationships(nodes, edges).select("source", "source_name", "target", "target_name", "relationship")


@query("""
    with t as (select *, row_number() over (partition by user_id order by case when event_type = 'error' then 0 else 1 end, ts, event_id) as place, count(*) over (partition by user_id) as n from events)
    select event_id, place::int as place, greatest(n - 12, 0)::bigint as left_out from t where place <= 12
""")
def q_bounded_payload(spark, d):
    rows = table(spark, d, "events").withColumn("section", F.lit("events"))
    out = grounding.bounded(rows, {"events": 12}, "section", F.col("event_type") == "error", "ts", "event_id", by=("user_id",))
    return out.select("event_id", "place", F.col("left_out").cast("long").alias("left_out"))


@query("""
    with f as (select o_custkey, o_orderstatus as attribute, o_orderpriority as value from orders group by all), c as (select o_custkey, attribute from f group by all having count(*) > 1)
    select f.o_custkey::varchar as subject, f.attribute, f.value from f anti join c on f.o_custkey = c.o_custkey and f.attribute = c.attribute
""")
def q_usable_facts(spark, d):
    facts = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("subject"), F.col("o_orderstatus").alias("attribute"), F.col("o_orderpriority").alias("value"), F.lit(True).alias("single_valued"), F.array(F.col("o_orderkey").cast("string")).alias("evidence_ids"))
    return grounding.usable_facts(grounding.merge_facts(facts)).select("subject", "attribute", "value")


@query("select d.doc_id, case when quality is null then 'unassessed' when quality = 1 then 'relevant' else 'not_relevant' end as assessment, coalesce(quality = 1, false) as usable from documents d left join labels l on l.doc_id = d.doc_id")
def q_usable_references(spark, d):
    own = table(spark, d, "labels").select(F.col("doc_id").alias("reference_id"), F.when(F.col("quality") == 1, "relevant").otherwise("not_relevant").alias("assessment"))
    out = grounding.usable_references(table(spark, d, "documents").select(F.col("doc_id").alias("reference_id")), own)
    return out.select(F.col("reference_id").alias("doc_id"), "assessment", "usable")


@query("select text as t, count(*) as n, count(distinct source) as n_kinds, count(distinct source) > 1 as conflict from (select sha256(text) as text, coalesce(source, '-') as source from documents where text is not null) group by 1 having count(*) > 1")
def q_duplicate_records(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select(F.sha2("text", 256).alias("t"), F.coalesce("source", F.lit("-")).alias("source"))
    return store.duplicates(rows, "t", "source")


@query("""
    with c as (select doc_id, o::int as ordinal, o * 1200 as char_start, least((o + 1) * 1200, len(text)) as char_end, case when lang = 'es' then substr(text, o * 1200 + 2, 1200) else substr(text, o * 1200 + 1, 1200) end as text, text as whole
        from (select doc_id, text, lang, unnest(range(ceil(len(text) / 1200.0)::bigint)) as o from documents where text is not null))
    select doc_id || '#' || ordinal as chunk_id, 'not_a_slice' as issue from c where text <> substr(whole, char_start + 1, char_end - char_start)
""")
def q_integrity(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    parts = text.fixed_chunks(docs).join(docs.select("doc_id", "lang", F.col("text").alias("whole")), "doc_id")
    start = F.col("ordinal") * 1200
    cut = F.when(F.col("lang") == "es", F.expr("substring(whole, ordinal * 1200 + 2, 1200)")).otherwise(F.col("text"))
    chunks = parts.select(F.concat_ws("#", "doc_id", "ordinal").alias("chunk_id"), "doc_id", start.alias("char_start"), F.least(start + 1200, F.length("whole")).alias("char_end"), cut.alias("text"))
    return store.integrity(chunks, docs.select("doc_id", F.col("text").alias("content")))


@query("select vec_id, label is not null as cached from embeddings where label is null or label <> 3 union all select vec_id, false from embeddings where label = 3")
def q_reuse_vectors(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.coalesce("label", F.lit(3)).alias("label"), F.sha2(F.col("vec_id").cast("string"), 256).alias("entry_key"), "embedding")
    have, miss = store.reuse_vectors(rows.select("vec_id", "entry_key"), rows.where("label <> 3").select("entry_key", F.col("embedding").alias("vector")))
    return have.select("vec_id", F.lit(True).alias("cached")).union(miss.select("vec_id", F.lit(False)))


@query("""
    with e as (select vec_id, embedding::double[] as v from embeddings where embedding is not null)
    select vec_id, 'own' as form, case when len(v) <> 64 then 'shape' when sqrt(list_dot_product(v, v)) = 0 then 'zero' when abs(sqrt(list_dot_product(v, v)) - 1) > 1e-4 then 'not_unit' end as issue from e
    union all select vec_id, 'cut', 'shape' from e union all select vec_id, 'holed', 'not_finite' from e union all select vec_id, 'endless', 'not_finite' from e
    union all select vec_id, 'zeros', 'zero' from e union all select vec_id, 'doubled', case when sqrt(list_dot_product(v, v)) = 0 then 'zero' else 'not_unit' end from e
""")
def q_vector_checks(spark, d):
    """Every vector as it is and in five broken forms."""
    e = F.col("embedding")
    put = lambda c: F.concat(F.array(c.cast("float")), F.slice(e, 2, 63))
    forms = {"own": e, "cut": F.slice(e, 1, 63), "holed": put(F.lit(None)), "endless": put(F.lit(float("inf"))), "zeros": F.transform(e, lambda x: F.lit(0.0).cast("float")), "doubled": F.transform(e, lambda x: (x * 2).cast("float"))}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("form"), v.alias("v")) for k, v in forms.items()])).alias("f")
    rows = table(spark, d, "embeddings").where("embedding is not null").select("vec_id", each)
    return rows.select("vec_id", "f.form", retrieval.vector_issue(F.col("f.v"), 64).alias("issue"))


@query("""
    with l as (select doc_id as case_id, quality, toxic from labels), r as (select case_id, 'author' as person, 'a' as item from l union all select case_id, 'author', 'b' from l
        union all select case_id, 'reviewer', 'a' from l where quality = 1 union all select case_id, 'reviewer', 'b' from l where toxic = 1)
    select case_id, item as doc_id from r group by case_id, item having count(distinct person) = (select count(distinct person) from r x where x.case_id = r.case_id)
""")
def q_agreed_labels(spark, d):
    said = lambda who, role, item, cond: table(spark, d, "labels").where(cond).select(F.col("doc_id").alias("case_id"), F.lit(item).alias("doc_id"), F.lit(role).alias("role"), F.lit(who).alias("person"), F.lit(0).alias("position"))
    rows = said("author", "author", "a", "true").union(said("author", "author", "b", "true")).union(said("reviewer", "reviewer", "a", "quality = 1")).union(said("reviewer", "reviewer", "b", "toxic = 1"))
    return evaluation.agreed_labels(rows).select("case_id", "doc_id")


@query("select user_id, count(*) filter (event_type = 'error') as n_true, count(*) filter (event_type <> 'error') as n_false from events group by 1 having n_true > 0 and n_false > 0")
def q_contradicting_labels(spark, d):
    return evaluation.contradicting_labels(table(spark, d, "events").withColumn("label", F.col("event_type") == "error"), "user_id")


@query("""
    select url, 'own' as form, case when url is null then 'missing' when regexp_matches(url, '\\s') then 'white_space' when not regexp_matches(url, '^[hH][tT][tT][pP][sS]?:') then 'scheme' when not regexp_matches(url, '^[a-zA-Z]+://[^/?#]+') then 'host' end as issue from pages
    union all select url, 'blank', 'white_space' from pages where url is not null union all select url, 'bare', 'scheme' from pages where url is not null
    union all select url, 'no_host', 'host' from pages where url is not null union all select url, 'none', 'missing' from pages union all select url, 'with_user', null from pages where url is not null
""")
def q_url_checks(spark, d):
    """Every URL as it is and in five other forms."""
    u = F.col("url")
    path = F.regexp_replace(u, "^[a-z]+://[^/]*", "")
    forms = {"own": u, "blank": F.concat(u, F.lit(" x")), "bare": F.regexp_replace(u, "^[a-z]+:", ""), "no_host": F.concat(F.lit("https://"), path), "none": F.lit(None).cast("string"), "with_user": F.concat(F.lit("HTTPS://user@host:8080"), path)}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("form"), v.alias("v")) for k, v in forms.items()])).alias("f")
    rows = table(spark, d, "pages").select("url", each).where("url is not null or f.form in ('own', 'none')")
    return rows.select("url", "f.form", checks.url_issue(F.col("f.v")).alias("issue"))


@query("""
    select event_id, case when event_type in ('view', 'click') then null when event_type = 'error' then 'no_such_time' when event_type is null then 'missing' else 'form' end as time_issue,
        case when event_type in ('view', 'click') then null when event_type is null then 'missing' else 'form' end as hash_issue,
        case event_type when 'view' then null when 'click' then 'absolute' when 'error' then 'parent_segment' when 'purchase' then 'backslash' end as path_issue
    from events
""")
def q_stored_values(spark, d):
    """Times, hashes and paths made from events; the kind of event says how each is written."""
    kind, path = F.col("event_type"), F.concat(F.lit("logs/"), F.col("event_id").cast("string"), F.lit(".txt"))
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    time = F.when(kind.isin("view", "click"), F.concat(time, F.lit("Z"))).when(kind == "error", F.concat(F.lit("2025-02-30"), F.substring(time, 11, 9), F.lit("Z"))).when(kind.isNotNull(), time)
    digest = F.sha2(F.col("event_id").cast("string"), 256)
    digest = F.when(kind.isin("view", "click"), digest).when(kind.isNotNull(), F.concat(digest, F.lit("0")))
    path = F.when(kind == "click", F.concat(F.lit("/"), path)).when(kind == "error", F.concat(F.lit("a/../"), path)).when(kind == "purchase", F.concat(F.lit("a\\"), path)).otherwise(path)
    return table(spark, d, "events").select("event_id", checks.utc_time_issue(time).alias("time_issue"), checks.sha256_issue(digest).alias("hash_issue"), checks.relative_path_issue(path).alias("path_issue"))


@query("select c_custkey, case when length(c_name) > 300 then 'too_long' when c_name <> trim(c_name) then 'outer_white_space' end as label_issue, case when contains(c_name, '#') then 'reserved_character' end as id_issue from customer")
def q_label_checks(spark, d):
    return table(spark, d, "customer").select("c_custkey", checks.label_issue(F.col("c_name")).alias("label_issue"), checks.source_id_issue(F.col("c_name")).alias("id_issue"))


@query("""
    select doc_id, case when lang is null then 'remediation_plan_missing' when lang = 'fr' then 'remediation_plan_unavailable' when lang = 'de' then 'remediation_plan_rejected' when lang = 'es' then 'remediation_plan_insufficient_context' else 'usable' end as reason from documents
""")
def q_plan_intake(spark, d):
    lang = F.col("lang")
    status = F.when(lang == "fr", "llm_error").when(lang == "de", "invalid_response").when(lang == "es", "insufficient_evidence").when(lang.isNotNull(), "planned")
    short = lang == "es"
    rows = table(spark, d, "documents").select("doc_id", status.alias("status"), lang.isin("en", "es").alias("has_plan"), F.lit("i").alias("plan_incident"), F.lit("i").alias("incident_id"), F.lit(0).alias("plan_finding"), F.lit(0).alias("finding"), F.when(short, "insufficient_evidence").otherwise("proposals").alias("outcome"), F.when(short, F.array().cast("array<string>")).otherwise(F.array(F.lit("p"))).alias("proposal_ids"), F.lit(True).alias("grounding_passed"))
    return rows.select("doc_id", intake.plan_intake().alias("reason"))


@query("""
    select c_custkey, list_filter([case when c_acctbal < 0 then 'target_not_allowed' end, case when c_mktsegment = 'BUILDING' then 'scenario_not_allowed' end], lambda x: x is not null)::varchar as codes from customer
""")
def q_scope_codes(spark, d):
    ask = F.struct(F.when(F.col("c_acctbal") < 0, "http://b:1").otherwise("http://a:1").alias("target_origin"), F.col("c_mktsegment").alias("scenario_id"), F.lit("id").alias("identity"), F.lit(True).alias("authorized"), F.lit("offline").alias("mode"))
    others = table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").agg(F.collect_set("c_mktsegment").alias("segments"))  # five market segments
    rows = table(spark, d, "customer").crossJoin(F.broadcast(others)).select("c_custkey", ask.alias("request"), F.struct(F.array(F.lit("http://a:1")).alias("origins"), F.col("segments").alias("scenarios"), F.lit("id").alias("identity"), F.array(F.lit("offline")).alias("modes")).alias("policy"))
    return rows.select("c_custkey", F.concat(F.lit("["), F.array_join(rules.scope_codes(), ", "), F.lit("]")).alias("codes"))


@query("""
    with p as (select n_nationkey as k, s_suppkey, row_number() over (partition by n_nationkey order by s_suppkey) - 1 as position, (s_suppkey % 7) / 7.0 as w, (s_suppkey % 3) / 3.0 as c from supplier join nation on n_nationkey = s_nationkey),
    s as (select *, w as e, (c + w) / 2 as g, (c + w) / 2 * case when s_suppkey % 2 = 0 then 1.0 else 0.25 end as a from p), t as (select k, min(s_suppkey) as want from p group by k),
    r as (select *, row_number() over (partition by k order by g desc, position) as rg, row_number() over (partition by k order by a desc, position) as ra, row_number() over (partition by k order by e desc, position) as re from s)
    select r.k, min(case when s_suppkey = want then rg end)::int as rank_guided_score, min(case when s_suppkey = want then ra end)::int as rank_adjusted_score, min(case when s_suppkey = want then re end)::int as rank_evidence_score from r join t on r.k = t.k group by r.k
""")
def q_truth_ranks(spark, d):
    from pyspark.sql import Window

    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    base = F.when(F.col("s_suppkey") % 2 == 0, "observed").otherwise("configured")
    place = F.row_number().over(Window.partitionBy("n_nationkey").orderBy("s_suppkey")) - 1
    each = rows.select(F.col("n_nationkey").alias("k"), place.alias("position"), F.array("n_nationkey", "s_suppkey").alias("nodes"), F.array((F.col("s_suppkey") % 7) / 7.0).alias("weights"), F.array(base).alias("bases"), ((F.col("s_suppkey") % 3) / 3.0).alias("coherence"))
    truth = rows.groupBy(F.col("n_nationkey").alias("k")).agg(F.min("s_suppkey").alias("m")).select("k", F.array("k", "m").alias("path"))
    return paths.truth_ranks(paths.path_scores(each), truth, "k")


@query("""
    select n_nationkey as graph_id, s_suppkey::varchar as target, s_suppkey = (select min(s_suppkey) from supplier x where x.s_nationkey = n_nationkey) as label from nation join supplier on s_nationkey = n_nationkey
""")
def q_positive_edges(spark, d):
    rows = table(spark, d, "nation").join(table(spark, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"))
    truth = rows.groupBy(F.col("n_nationkey").alias("graph_id")).agg(F.min("s_suppkey").alias("m")).select("graph_id", F.array(F.lit("root"), F.col("m").cast("string")).alias("path"))
    edges = rows.select(F.col("n_nationkey").alias("graph_id"), F.lit("root").alias("source"), F.col("s_suppkey").cast("string").alias("target"), F.lit("observed").alias("basis"))
    return graph.positive_edges(truth, edges, "graph_id").select("graph_id", "target", "label")


@query()
def q_edge_scores(spark, d):
    """Edges of each region's graph, scored by the seeded network."""
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    rows = n.join(s, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").cast("string").alias("graph_id"), F.concat(F.lit("n"), "n_nationkey").alias("source"), F.concat(F.lit("s"), "s_suppkey").alias("target"), F.lit("forwards").alias("edge_type"), F.lit("observed").alias("basis"))
    nodes = rows.select("graph_id", F.col("source").alias("node_id"), F.lit("service").alias("node_type"), "basis").union(rows.select("graph_id", "target", F.lit("container"), "basis")).distinct()
    vectors = gnn.node_vectors(nodes, spark.createDataFrame([], "graph_id string, node_id string, features array<double>"))
    return gnn.score_edges(vectors, rows, gnn.initial_weights())


@query()
def q_trained_edges(spark, d):
    """Edges from nations to customers, a graph for each region, scored after three epochs of training on customers of a high
    balance; the last region validates. A customer's request features hold its balance."""
    n, c = table(spark, d, "nation"), table(spark, d, "customer").where("c_acctbal is not null")
    rows = n.join(c, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").cast("string").alias("graph_id"), F.concat(F.lit("n"), "n_nationkey").alias("source"), F.concat(F.lit("c"), "c_custkey").alias("target"), F.lit("forwards").alias("edge_type"), F.lit("observed").alias("basis"), (F.col("c_acctbal") > 4000).cast("int").alias("label"), (F.col("c_acctbal") / 10000).alias("balance"))
    pooled = rows.select("graph_id", F.col("target").alias("node_id"), F.concat(F.array("balance"), F.array_repeat(F.lit(0.0), gnn.HTTP - 1)).alias("features"))
    nodes = rows.select("graph_id", F.col("source").alias("node_id"), F.lit("service").alias("node_type"), "basis").distinct().union(rows.select("graph_id", "target", F.lit("container"), "basis"))
    vectors = gnn.node_vectors(nodes, pooled)
    labelled = rows.withColumn("split", F.when(F.col("graph_id") == "4", "validation").otherwise("train"))
    return gnn.score_edges(vectors, rows, gnn_training.train(vectors, rows, labelled, epochs=3).weights)


@query()
def q_edge_attribution(spark, d):
    """Users and the kinds of their events as a graph whose request features are counts by hour; the edge from the first user
    to its most frequent kind is explained."""
    e = table(spark, d, "events").where("user_id is not null").select(F.concat(F.lit("user:"), "user_id").alias("source"), F.concat(F.lit("kind:"), "event_type").alias("target"), F.least(F.hour("ts"), F.lit(gnn.HTTP - 1)).alias("slot"))
    ends = e.select(F.col("source").alias("node_id"), "slot").union(e.select("target", "slot"))
    hours = F.array(*[F.log1p(F.count_if(F.col("slot") == k)) for k in range(gnn.HTTP)])
    pooled = ends.groupBy(F.lit("g").alias("graph_id"), "node_id").agg(hours.alias("features"))
    nodes = pooled.select("graph_id", "node_id", F.when(F.col("node_id").startswith("user:"), "user").otherwise("service").alias("node_type"), F.lit("observed").alias("basis"))
    edges = e.groupBy("source", "target").agg(F.count("*").alias("n")).select(F.lit("g").alias("graph_id"), "source", "target", F.lit("accesses").alias("edge_type"), F.lit("observed").alias("basis"), "n")
    chosen = edges.agg(F.min(F.struct("source", -F.col("n"), "target")).alias("m")).select("m.source", "m.target").first()
    return attribution.explain_edge(gnn.node_vectors(nodes, pooled), edges, gnn.initial_weights(), "g", chosen["source"], chosen["target"], "accesses")


@query()
def q_posterior_draws(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("doc_id", F.col("toxic").alias("y"), (F.coalesce("n_chars", F.lit(0)) / 5000.0).alias("size"), F.col("quality").cast("double").alias("q"))
    return bayes.posterior_summary(bayes.fit(rows, ["size", "q"], "y"), rows, "doc_id")


@query("select user_id, max_by(event_id, (ts, event_id)) as event_id from events group by 1")
def q_latest(spark, d):
    return windows.latest(table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", "ts", "event_id").select("user_id", "event_id")


@query("select doc_id, ceil(len(text) / 3.0)::bigint as tokens from documents where text is not null")
def q_token_estimate(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", text.estimated_tokens(F.col("text")).alias("tokens"))


@query("""
    with s as (select region.r_regionkey as k, n_name as f, n_nationkey as v from region join nation on n_regionkey = r_regionkey)
    select k, count(*) as n, count(*) filter (v > 10) as n_known from s group by k
""")
def q_feature_provenance(spark, d):
    rows = table(spark, d, "region").join(table(spark, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_regionkey").alias("k"), F.when(F.col("n_nationkey") > 10, F.col("n_nationkey")).alias("f"))
    long = risk.feature_provenance(rows, "k", ["f"])
    return long.groupBy("k").agg(F.count("*").alias("n"), F.count_if("known").alias("n_known"))


@query("""
    with e as (select 'region:' || n_regionkey as source, 'nation:' || n_nationkey as target, 0.25 as o from nation), x as (select 'nation:' || s_nationkey as source, 'supplier:' || s_suppkey as target from supplier)
    select target, count(*) as n_paths from (select x.target from e join x on e.target = x.source) group by 1
""")
def q_observed_paths(spark, d):
    nodes, edges = geography(spark, d)
    ends = nodes.where("node_id like 'nation:%'").select(F.col("node_id").alias("source")).join(edges.where("basis = 'observed'").select("source", "target"), "source").select("source", "target")
    found = graph.candidate_paths(nodes, edges, ends, max_hops=2, observed_only=True)
    return found.groupBy("target").agg(F.count("*").alias("n_paths"))


@query("select doc_id, count(*) as n_chunks, sum(len(text))::bigint as n_chars from (select doc_id, substr(text, o * 1200 + 1, 1200) as text from (select doc_id, text, unnest(range(ceil(len(text) / 1200.0)::bigint)) as o from documents where text is not null)) group by 1")
def q_fixed_chunks(spark, d):
    return document_chunks(spark, d, 1200).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"))
