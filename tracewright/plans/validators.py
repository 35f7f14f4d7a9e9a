"""Registered queries of gates, attestations, judgements, claims and model output, on rows made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import claims, text
from ..operators import evaluation, graph, grounded, judging, paths, retrieval, risk, rules
from ..sources import store
from .registry import query
from .tables import table


def _k():
    return F.col("o_orderkey")


def _every(n, *values):
    """A value by the order's key: the last one for all keys beyond the list."""
    out = F.lit(values[-1])
    for i, v in reversed(list(enumerate(values[:-1]))):
        out = F.when(_k() % n == i, v).otherwise(out)
    return out


GATE_SQL = """
    g as (select o_orderkey as k, case o_orderkey % 5 when 0 then 'inconclusive' when 1 then 'objective_achieved' else 'objective_not_observed' end as status,
        o_orderkey % 7 <> 0 as attempted, o_orderkey % 11 <> 0 as completed, case o_orderkey % 3 when 0 then 'pre_remediation' else 'post_remediation' end as tested_state,
        case o_orderkey % 3 when 0 then 'not_applicable' when 1 then 'independently_attested' else case when o_orderkey % 2 = 0 then 'independently_attested' else 'claimed' end end as application_state,
        case o_orderkey % 13 when 0 then 'fake' when 1 then 'none' when 2 then null else 'live' end as transport_kind, o_orderkey % 17 <> 0 as has_identity, o_orderkey % 19 <> 0 as live_suitable,
        o_orderkey % 23 <> 0 as authoritative, o_orderkey % 29 <> 0 as issued, case when o_orderkey % 3 = 0 then 'pre_remediation_observation' else 'validation' end as report_kind,
        case when o_orderkey % 31 = 0 then 2 else 0 end as n_proposals, case when o_orderkey % 37 = 0 then 's' end as post_state_id,
        case o_orderkey % 6 when 0 then 'live' when 1 then 'dry-run' when 2 then 'live-refused-x' when 3 then 'observation' when 4 then 'observation-blocked' else 'other' end as mode from orders),
    c as (select *, list_filter([case when status not in ('objective_achieved', 'objective_not_observed') then 'status_not_conclusive' end, case when not (attempted and completed) then 'check_not_completed' end,
            case when tested_state <> 'post_remediation' then 'not_post_remediation' end, case when application_state <> 'independently_attested' then 'remediation_not_attested' end,
            case when transport_kind is distinct from 'live' then 'transport_not_live' end, case when not has_identity then 'legacy_report_without_identity_provenance' end,
            case when has_identity and not (live_suitable and authoritative) then 'identity_not_live_suitable' end, case when not issued then 'report_not_issued_by_runner' end], lambda x: x is not null) as post,
        list_filter([case when report_kind <> 'pre_remediation_observation' then 'not_an_observation_report' end, case when status not in ('objective_achieved', 'objective_not_observed') then 'status_not_conclusive' end, case when not (attempted and completed) then 'check_not_completed' end,
            case when tested_state <> 'pre_remediation' then 'not_pre_remediation' end, case when transport_kind is distinct from 'live' then 'transport_not_live' end, case when not has_identity then 'legacy_report_without_identity_provenance' end,
            case when has_identity and not (live_suitable and authoritative) then 'identity_not_live_suitable' end, case when not issued then 'report_not_issued_by_runner' end,
            case when n_proposals > 0 or application_state <> 'not_applicable' then 'remediation_claim_present' end, case when post_state_id is not null then 'post_remediation_state_present' end], lambda x: x is not null) as seen from g),
    p as (select *, case when len(post) = 0 then list_append(seen, 'post_remediation_gate_passed') else seen end as observed,
        case when transport_kind = 'live' and len(post) = 0 then 'live' when transport_kind = 'live' and len(seen) = 0 then 'pre_remediation_observation' when transport_kind = 'fake' then 'mocked'
            when transport_kind = 'none' or not attempted then 'dry_run' else 'unverified' end as provenance,
        case when mode = 'dry-run' then attempted or transport_kind is distinct from 'none' when mode in ('live', 'observation') then transport_kind is distinct from 'live' when mode in ('live-refused-x', 'observation-blocked') then attempted else false end as mode_conflict from c)
"""


def _reports(spark, d):
    o = table(spark, d, "orders")
    third = _k() % 3 == 0
    return o.select(
        _k().alias("report_id"),
        _every(5, "inconclusive", "objective_achieved", "objective_not_observed").alias("status"),
        (_k() % 7 != 0).alias("attempted"), (_k() % 11 != 0).alias("completed"),
        F.when(third, "pre_remediation").otherwise("post_remediation").alias("tested_state"),
        F.when(third, "not_applicable").when((_k() % 3 == 1) | (_k() % 2 == 0), "independently_attested").otherwise("claimed").alias("application_state"),
        F.when(_k() % 13 == 0, "fake").when(_k() % 13 == 1, "none").when(_k() % 13 != 2, "live").alias("transport_kind"),
        (_k() % 17 != 0).alias("has_identity"), (_k() % 19 != 0).alias("live_suitable"), (_k() % 23 != 0).alias("authoritative"), (_k() % 29 != 0).alias("issued"),
        F.when(third, "pre_remediation_observation").otherwise("validation").alias("report_kind"),
        F.when(_k() % 31 == 0, 2).otherwise(0).alias("n_proposals"), F.when(_k() % 37 == 0, "s").alias("post_state_id"),
        _every(6, "live", "dry-run", "live-refused-x", "observation", "observation-blocked", "other").alias("mode"),
    )


@query(f"with {GATE_SQL} select k as report_id, array_to_string(post, ',') as post_codes, array_to_string(observed, ',') as observation_codes, provenance, mode_conflict from p")
def q_gates(spark, d):
    rows = _reports(spark, d)
    return rows.select("report_id", F.array_join(judging.gate_codes(), ",").alias("post_codes"), F.array_join(judging.observation_codes(), ",").alias("observation_codes"), judging.provenance().alias("provenance"), judging.mode_conflict().alias("mode_conflict"))


@query(f"""
    with {GATE_SQL},
    o as (select l_orderkey, count(distinct l_linestatus) as n, l_returnflag from lineitem group by l_orderkey, l_returnflag), x as (select distinct l_orderkey from o where n > 1),
    cat as (select l_orderkey, l_suppkey % 7 as e, case when l_quantity > 25 then 'validation_observation' else 'oracle_condition' end as role from lineitem),
    a as (select distinct l_orderkey from (select l_orderkey, e, count(distinct role) as r, count(*) filter (role = 'validation_observation') as s from cat group by all) where r > 1 or s > 1),
    w as (select l_orderkey, count(distinct l_partkey % 9) as n from lineitem where (l_orderkey, l_partkey % 9) not in (select l_orderkey, e from cat) group by 1),
    j as (select k, status, mode_conflict, provenance, a.l_orderkey is not null as id_collision, x.l_orderkey is not null as roles_conflict, coalesce(w.n, 0) as n_dangling, k % 10 <> 3 as rule_confirmed,
        case k % 4 when 0 then 'application_secure' when 1 then 'remediation_applied' when 2 then 'objective_achieved' end as claim, n_proposals, application_state = 'independently_attested' as attested from p
        left join a on a.l_orderkey = k left join x on x.l_orderkey = k left join w on w.l_orderkey = k)
    select k as report_id, id_collision, roles_conflict, n_dangling::int as n_dangling,
        case when mode_conflict then 'execution_mode_conflict' when id_collision then 'evidence_id_ambiguous' when roles_conflict then 'observations_contradict' when n_dangling > 0 then 'dangling_evidence'
            when status = 'inconclusive' then 'upstream_inconclusive' when not rule_confirmed then 'rule_not_confirmed' when provenance not in ('mocked', 'live') then 'evidence_gate_unsatisfied'
            when claim = 'application_secure' then 'security_claim_not_supported' when claim = 'remediation_applied' and attested then 'attestation_not_verified' when claim = 'remediation_applied' then 'proposal_not_executed'
            when claim is null or claim = status then 'rules_confirmed' else 'rules_contradict_claim' end as reason from j
""")
def q_judge(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    name = lambda c, n: (F.col(c) % n).cast("string")
    observations = l.select(F.col("l_orderkey").alias("report_id"), F.col("l_returnflag").alias("role"), F.col("l_linestatus").alias("http_status"))
    catalog = l.select(F.col("l_orderkey").alias("report_id"), name("l_suppkey", 7).alias("evidence_id"), F.when(F.col("l_quantity") > 25, "validation_observation").otherwise("oracle_condition").alias("role"))
    cited = l.select(F.col("l_orderkey").alias("report_id"), name("l_partkey", 9).alias("evidence_id"))
    reports = _reports(spark, d)
    confirmed = reports.select("report_id", F.when(F.col("report_id") % 10 != 3, "rules_confirmed").otherwise("rules_conflict").alias("confirmation"))
    rows = judging.judge_inputs(reports, observations, catalog, cited, confirmed)
    claim = F.when(F.col("report_id") % 4 == 0, "application_secure").when(F.col("report_id") % 4 == 1, "remediation_applied").when(F.col("report_id") % 4 == 2, "objective_achieved")
    rows = rows.withColumns({"claim": claim, "attested": F.col("application_state") == "independently_attested", "reason_code": F.lit(None).cast("string")})
    out = rules.judge(rows)
    return out.select("report_id", "id_collision", "roles_conflict", "n_dangling", F.get("reason_codes", F.lit(0)).alias("reason"))


@query("""
    with a as (select *, o_orderkey as k, timestamp '2026-01-01 12:00:00' as now, timestamp '2026-01-01 12:00:00' - interval (o_orderkey % 5000 - 100) second as at from orders),
    c as (select k, case when k % 41 = 0 then ['attestation_missing'] when k % 43 = 0 then ['plan_unusable'] else list_filter([
        case when k % 3 = 0 then 'incident_mismatch' end, case when k % 5 = 0 then 'scenario_mismatch' end, case when k % 7 = 0 then 'plan_binding_mismatch' end, case when k % 11 = 0 then 'applied_proposals_not_in_plan' end,
        case when k % 13 = 0 then 'authorization_missing' end, case when k % 13 <> 0 and k % 17 = 0 then 'authorization_id_mismatch' end, case when k % 13 <> 0 and k % 19 = 0 then 'attester_not_authorized_operator' end,
        case when k % 13 <> 0 and k % 23 = 0 then 'authorization_lab_mismatch' end, case when k % 13 <> 0 and k % 5 = 0 then 'authorization_scenario_mismatch' end, case when k % 13 <> 0 and k % 3 = 0 then 'authorization_incident_mismatch' end,
        case when k % 5000 - 100 < -60 then 'attestation_from_future' end, case when k % 5000 - 100 > 3600 then 'attestation_stale' end], lambda x: x is not null) end as claim,
        case when k % 41 = 0 or k % 43 = 0 then [] else list_filter([case when k % 29 = 0 then 'lab_identity_missing' end, case when k % 29 <> 0 and k % 31 = 0 then 'lab_identity_stale' end, case when k % 29 <> 0 and k % 37 = 0 then 'lab_identity_not_independently_verified' end,
            case when k % 29 <> 0 and k % 23 = 0 then 'lab_identity_lab_mismatch' end, case when k % 29 <> 0 and k % 4 = 0 then 'lab_state_is_pre_remediation' end, case when k % 29 <> 0 and k % 4 = 1 then 'lab_state_mismatch' end,
            case when k % 29 <> 0 and k % 47 = 0 then 'lab_observation_predates_attestation' end], lambda x: x is not null) end as evidence from a)
    select k as o_orderkey, array_to_string(claim, ',') as claim_codes, array_to_string(evidence, ',') as evidence_codes, len(claim) = 0 and len(evidence) = 0 as ready, case when len(claim) = 0 then 'p2' else '' end as not_applied from c
""")
def q_attestation(spark, d):
    off = lambda n, right, wrong="x": F.when(_k() % n == 0, wrong).otherwise(right)
    now = F.timestamp_seconds(F.lit(1767268800))
    at = F.timestamp_seconds(F.lit(1767268800) - (_k() % 5000 - 100))
    attested = F.struct(off(3, "i").alias("incident_id"), off(5, "s").alias("scenario_id"), off(7, "h").alias("plan_sha256"), F.when(_k() % 11 == 0, F.array(F.lit("p1"), F.lit("p9"))).otherwise(F.array(F.lit("p1"))).alias("applied_ids"), F.lit("a").alias("authorization_id"), F.lit("o").alias("attested_by"), F.lit("lab").alias("lab_id"), at.alias("attested_at"), F.lit("pre").alias("pre_state_id"), F.lit("post").alias("post_state_id"))
    plan = F.struct(F.lit("i").alias("incident_id"), (_k() % 43 != 0).alias("usable"), F.lit("h").alias("sha256"), F.array(F.lit("p1"), F.lit("p2")).alias("proposal_ids"))
    allowed = F.struct(off(17, "a").alias("authorization_id"), off(19, "o").alias("operator_id"), off(23, "lab").alias("lab_id"), F.lit("s").alias("scenario_id"), F.lit("i").alias("incident_id"))
    state = F.when(_k() % 4 == 0, "pre").when(_k() % 4 == 1, "other").otherwise("post")
    seen = F.struct(F.when(_k() % 29 != 0, "obs").alias("observation_id"), (_k() % 31 != 0).alias("fresh"), (_k() % 37 != 0).alias("independently_verified"), off(23, "lab").alias("lab_id"), state.alias("lab_state_id"), F.when(_k() % 47 == 0, F.timestamp_seconds(F.lit(0))).otherwise(F.timestamp_seconds(F.lit(1767270000))).alias("observed_at"))
    rows = table(spark, d, "orders").select("o_orderkey", F.lit("i").alias("incident_id"), F.lit("s").alias("scenario_id"), F.when(_k() % 41 != 0, attested).alias("attestation"), plan.alias("plan"), F.when(_k() % 13 != 0, allowed).alias("authorization"), seen.alias("identity"))
    out = judging.attestations(rows, now)
    return out.select("o_orderkey", F.array_join("claim_codes", ",").alias("claim_codes"), F.array_join("evidence_codes", ",").alias("evidence_codes"), "ready", F.array_join("not_applied", ",").alias("not_applied"))


SAID = [
    "The database was breached.", "No evidence that the database was breached.", "If the database was breached, logs would show it.", "We cannot say whether this will prevent all attacks.",
    "This will prevent all attacks.", "No claim is made that the service is now secure.", "The service is now secure.", "Observed activity rather than confirmed exploitation.",
    "There is no confirmed access in which the server was breached.", "No vulnerability has been proven, but exploitation is confirmed.", "It does not establish access or successful exploitation.", "Nothing to see.",
]
CLAIMED = {0: "compromise:database was breached", 4: "success:prevent all,success:will prevent all,success:will prevent all attacks", 6: "success:is now secure", 9: "confirmation:exploitation is confirmed"}


@query(f"""
    select event_id, case event_id % {len(SAID)} {" ".join(f"when {k} then '{v}'" for k, v in CLAIMED.items())} else '' end as claims from events
""")
def q_claim_screen(spark, d):
    """A sentence for each event, some of which claim what evidence cannot carry."""
    said = F.element_at(F.array(*[F.lit(x) for x in SAID]), (F.col("event_id") % len(SAID) + 1).cast("int"))
    rows = table(spark, d, "events").select("event_id", F.concat(F.lit("Note "), "event_type", F.lit(". "), said).alias("said"))
    found = claims.screen_claims(rows, "event_id", "said").groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "screen", "words"))), ",").alias("claims"))  # of one sentence
    return rows.select("event_id").join(found, "event_id", "left").select("event_id", F.coalesce("claims", F.lit("")).alias("claims"))


@query("select doc_id, 0::bigint as n from documents where text is not null")
def q_document_claims(spark, d):
    """All documents through all screens: the invented prose claims nothing."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    found = claims.screen_claims(docs, "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("n"))
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("""
    with f as (select doc_id, unnest(regexp_extract_all(text, '(?:^|[^A-Za-z0-9/])(/[A-Za-z0-9._~!$&''()*+,;=:@%/-]*)', 1)) as p from documents where text is not null),
    s as (select distinct doc_id, regexp_replace(p, '[.,;:)]+$', '') as p from f)
    select d.doc_id, coalesce(n, 0) as n_paths from documents d left join (select doc_id, count(*) as n from s where p not in ('', '/', '//') group by 1) c on c.doc_id = d.doc_id where text is not null
""")
def q_literals(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.size(text.paths_in(F.col("text"))).cast("long").alias("n_paths"))


@query("""
    with c as (select conv_id, turn, role from conversations where conv_id is not null and turn is not null), e as (select distinct conv_id, turn from c where role = 'user'),
        t as (select conv_id, unnest(range(0, max(turn) + 1)) as turn from c group by 1)
    select conv_id::varchar as incident_id, 'observed_evidence[' || turn || ']' as location, 'http_fact_mismatch' as code from t where turn % 3 = 0 or (conv_id, turn - 1) not in (select conv_id, turn from e)
    union all select conv_id::varchar, 'observed_evidence[' || turn || '].evidence_ids', 'unknown_evidence_id' from t where (conv_id, turn - 1) not in (select conv_id, turn from e)
""")
def q_answer_issues(spark, d):
    """An answer for each conversation: statements up to its last turn cite the turn before and name a method; all issues."""
    c = table(spark, d, "conversations").where("conv_id is not null and turn is not null").select(F.col("conv_id").cast("string").alias("incident_id"), "turn", "role")
    event = lambda t: F.concat(F.lit("api-"), t.cast("string"))
    said = F.concat(F.when(F.col("turn") % 3 == 0, "A POST").otherwise("A GET"), F.lit(" was seen."))
    last = c.groupBy("incident_id").agg(F.max("turn").alias("last"))
    every = last.select("incident_id", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("turn"))
    item = F.struct(said.alias("statement"), F.array(event(F.col("turn") - 1)).alias("evidence_ids"))
    answers = every.groupBy("incident_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("i")))), lambda x: x["i"]).alias("items"))  # of one conversation
    none = F.array().cast("array<string>")
    body = F.to_json(F.struct(F.lit("1.0").alias("schema_version"), "incident_id", F.col("items").alias("observed_evidence"), *[none.alias(k) for k in ("hypotheses", "reference_guidance", "reference_relevance", "evidence_gaps", "limitations")]))
    seen = c.where("role = 'user'").select("incident_id", event(F.col("turn")).alias("id")).distinct()
    catalog = seen.select("incident_id", "id", F.lit("evidence").alias("kind"))
    facts = seen.select("incident_id", "id", F.lit("method").alias("kind"), F.lit("get").alias("value"))
    empty = spark.createDataFrame([], "incident_id string, id string, identifier string")
    context = grounded.Context(catalog, empty, facts, spark.createDataFrame([], "incident_id string"))
    return grounded.answer_checks(answers.select("incident_id", body.alias("response")), context).select("incident_id", "location", "code")


@query("select sha256(string_agg(line, chr(10) order by line)) as fingerprint, count(*) as n_documents from (select doc_id || chr(9) || sha256(coalesce(text, '')) as line from documents)")
def q_corpus_fingerprint(spark, d):
    return store.corpus_fingerprint(table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).select("fingerprint", "n_documents")


@query("select user_id, event_type, min(ts) as ts from events group by 1, 2")
def q_first_seen(spark, d):
    from ..streaming import windows

    return windows.first_seen(table(spark, d, "events").select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts").select("user_id", "event_type", "ts")


BLANK, SOLID = "[ \\t\\n\\x0B\\f\\r]", "[^ \\t\\n\\x0B\\f\\r]"


@query(f"""
    with h as (select doc_id, text, substr(text, 1, 200) as head from documents where text is not null), c as (select *, regexp_replace(head, '{BLANK}+{SOLID}*$', '') as cut from h)
    select doc_id, case when len(text) <= 200 then text when cut = '' then head || ' […]' else cut || ' […]' end as short from c
""")
def q_shortened(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", text.shortened(F.col("text"), 200).alias("short"))


@query("""
    select doc_id, regexp_replace(text, '(?i)\\b(password|passwd|pwd|secret|token|api[_-]?key)(\\s*[=:]\\s*)("[^"]*"|''[^'']*''|[^\\s,;]+)', '\\1\\2[REDACTED]', 'g') as said from documents where text is not null
""")
def q_redacted(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", text.redact_credentials(F.col("text")).alias("said"))


@query("select o_orderkey, case when o_totalprice > 150000 then 'out_of_range' when o_custkey % 7 = 0 then 'not_finite' end as issue from orders")
def q_output_contract(spark, d):
    value = F.when(F.col("o_custkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice") / 150000.0)
    value = F.when(F.col("o_totalprice") > 150000, F.lit(1.5)).otherwise(value)
    return table(spark, d, "orders").select("o_orderkey", risk.output_issue(value, "risk_probability").alias("issue"))


@query("""
    with l as (select n_nationkey as k, 'nation:' || n_nationkey as label, 0 as pos from nation union all select n_nationkey, n_name, 1 from nation union all select n_nationkey, 'attacker', 2 from nation union all select n_nationkey, r_name, 3 from nation join region on r_regionkey = n_regionkey),
    n as (select 'container:nation:' || n_nationkey as node_id, case when n_nationkey % 2 = 0 then n_name else 'same' end as name from nation union all select 'region:' || r_regionkey, r_name from region union all select 'again', 'ASIA'),
    u as (select name, min(node_id) as id from n group by name having count(*) = 1)
    select k, pos::int as position, case when label = 'attacker' then null when 'container:' || label in (select node_id from n) then 'container:' || label else u.id end as node_id from l left join u on u.name = l.label
""")
def q_mapped_labels(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    own = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    name = F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string"))
    labels = own.select(F.col("n_nationkey").alias("k"), F.posexplode(F.array(name, F.col("n_name"), F.lit("attacker"), F.col("r_name"))).alias("position", "label"))
    nodes = n.select(F.concat(F.lit("container:"), name).alias("node_id"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise("same").alias("name"))
    nodes = nodes.union(r.select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")), "r_name")).union(spark.createDataFrame([("again", "ASIA")], "node_id string, name string"))
    return graph.mapped_labels(labels, nodes).select("k", "position", "node_id")


@query("""
    with p as (select 'n' || n_nationkey as s, 'o' || o.o_orderpriority as t, count(*) as n from nation join customer on c_nationkey = n_nationkey join orders o on o_custkey = c_custkey group by all),
    e as (select distinct 'r' || n_regionkey as a, 'n' || n_nationkey as b, n_nationkey as pos from nation union all select s, t, 100 + row_number() over (order by s, t) from p)
    select x.a as source, y.b as target, x.a || '>' || x.b || '>' || y.b as path, row_number() over (partition by x.a, y.b order by x.pos, y.pos)::int as place from e x join e y on x.b = y.a
    qualify place <= 3
""")
def q_deep_paths(spark, d):
    from pyspark.sql import Window

    n, c, o = (table(spark, d, t) for t in ("nation", "customer", "orders"))
    text_ = lambda p, col: F.concat(F.lit(p), F.col(col).cast("string"))
    up = n.select(text_("r", "n_regionkey").alias("source"), text_("n", "n_nationkey").alias("target"), F.col("n_nationkey").cast("long").alias("position"))
    down = c.join(o, F.col("o_custkey") == F.col("c_custkey")).select(text_("n", "c_nationkey").alias("source"), text_("o", "o_orderpriority").alias("target")).distinct()
    down = down.withColumn("position", 100 + F.row_number().over(Window.orderBy("source", "target")).cast("long"))  # 25 nations, five priorities
    edges = up.union(down)
    ends = up.select("source").distinct().join(down.select("target").distinct())
    found = paths.depth_first_paths(edges, ends, max_hops=3, limit=3)
    return found.select("source", "target", F.array_join("nodes", ">").alias("path"), "place")


@query("""
    with r as (select l_orderkey as q, l_linenumber as rank, bool_or(l_quantity > 40) as good from lineitem group by 1, 2), n as (select q, count(*) filter (good) as n, min(rank) filter (good) as first, count(*) filter (good and rank <= 3) as h from r group by q)
    select count(*) as n, count(*) filter (first <= 1) as hit_at_1, count(*) filter (first <= 3) as hit_at_3, count(*) filter (h = n) as full_at_3, round(avg(h / n), 6) as recall_at_3 from n where n > 0
""")
def q_hit_counts(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("doc_id"), F.col("l_linenumber").alias("rank"), "l_quantity")
    each = evaluation.ranking_measures(rows, rows.where("l_quantity > 40"), cuts=(1, 3))
    out = evaluation.mean_measures(each, [], cuts=(1, 3))
    return out.select("n", "hit_at_1", "hit_at_3", F.col("full_at_3"), F.round("recall_at_3", 6).alias("recall_at_3"))


@query("""
    select 'CFG-' || row_number() over (order by o_custkey::varchar, o_orderstatus, o_orderpriority) as fact_id, o_custkey::varchar as subject, o_orderstatus as attribute, o_orderpriority as value from (select distinct o_custkey, o_orderstatus, o_orderpriority from orders)
""")
def q_fact_ids(spark, d):
    from ..operators import grounding

    facts = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("subject"), F.col("o_orderstatus").alias("attribute"), F.col("o_orderpriority").alias("value"), F.lit(True).alias("single_valued"), F.array(F.col("o_orderkey").cast("string")).alias("evidence_ids"))
    return grounding.numbered_facts(grounding.merge_facts(facts)).select("fact_id", "subject", "attribute", "value")


@query("""
    with w as (select item_id, sha256(unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) as h from benchmark),
    s as (select item_id, ('0x' || substr(h, 1, 8))::bigint % 64 as slot, sum(case when ('0x' || substr(h, 9, 2))::bigint % 2 = 1 then 1.0 else -1.0 end)::double as v from w group by all)
    select item_id, slot::int as slot, round(v / sqrt(sum(v * v) over (partition by item_id)), 6) as value from s where v <> 0
""")
def q_hash_embedding(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", retrieval.hash_embedding(F.col("text")).alias("e"))
    return rows.select("item_id", F.posexplode("e").alias("slot", "value")).where("value <> 0").select("item_id", "slot", F.round("value", 6).alias("value"))


@query("""
    select doc_id, case when doc_id % 5 = 0 then 'created' when doc_id % 2 = 0 or doc_id % 3 = 0 or doc_id % 7 = 0 or doc_id % 11 = 0 or doc_id % 13 = 0 then 'updated' else 'unchanged' end as change,
        doc_id % 5 <> 0 and doc_id % 2 = 0 as content_changed, doc_id % 5 <> 0 and doc_id % 3 = 0 and doc_id % 2 <> 0 as metadata_changed,
        doc_id % 5 <> 0 and doc_id % 7 = 0 and doc_id % 2 <> 0 and doc_id % 3 <> 0 as provenance_changed, doc_id % 5 <> 0 and doc_id % 11 = 0 as config_changed, doc_id % 5 <> 0 and (doc_id % 2 = 0 or doc_id % 13 = 0) as chunks_replaced
    from documents
""")
def q_ingest_changes(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    i = F.col("doc_id")

    def state(changed):
        new = lambda n, c: F.when((i % n == 0) & F.lit(changed), F.concat(c, F.lit("!"))).otherwise(c)
        content = F.sha2(new(2, F.col("text")), 256)
        return docs.select("doc_id", content.alias("content_sha256"), F.concat(content, new(3, F.lit("m"))).alias("document_sha256"), new(7, F.lit("p")).alias("provenance"), new(11, F.lit("c")).alias("config"), F.sha2(new(2, F.col("text")), 256).alias("chunks_sha256"), F.when((i % 13 == 0) & F.lit(changed), 2).otherwise(1).alias("chunk_count"))

    return store.ingest_changes(state(False).where("doc_id % 5 <> 0"), state(True))


@query("""
    with r as (select o_orderkey as k, case o_orderkey % 7 when 0 then null when 1 then 'http://A:80/x' when 2 then 'http://b:81' else 'http://A:80/' end as url from orders),
    c as (select k, list_filter([case when url is null then 'target_missing' end, case when url = 'http://A:80/x' then 'target_malformed' end, case when url = 'http://b:81' then 'target_not_approved' end,
        case when k % 11 = 0 then 'scenario_missing' end, case when k % 11 <> 0 and k % 13 = 0 then 'scenario_not_eligible' end, case when k % 11 <> 0 and k % 7 > 2 and k % 17 = 0 then 'scenario_not_approved_for_lab' end,
        case when k % 19 = 0 then 'lab_identity_missing' end, case when k % 19 <> 0 and k % 23 = 0 then 'lab_identity_not_independent' end, case when k % 19 <> 0 and k % 23 <> 0 and k % 29 = 0 then 'lab_identity_not_assessed' end,
        case when k % 19 <> 0 and k % 23 <> 0 and k % 29 <> 0 and k % 31 = 0 then 'lab_identity_freshness_unchecked' end,
        case when k % 19 <> 0 and k % 23 <> 0 and k % 29 <> 0 and k % 31 = 1 then 'lab_identity_from_future' end, case when k % 19 <> 0 and k % 23 <> 0 and k % 29 <> 0 and k % 31 = 2 then 'lab_identity_stale' end,
        case when k % 19 <> 0 and k % 23 <> 0 and k % 29 <> 0 and k % 37 = 0 then 'lab_identity_not_live_suitable' end, case when k % 19 <> 0 and k % 5 = 0 then 'lab_identity_verifier_conflict' end,
        case when k % 19 <> 0 and (k % 7 <= 2 or k % 41 = 0) then 'lab_identity_mismatch' end, case when k % 19 <> 0 and k % 3 = 0 then 'lab_state_unverified' end, case when k % 19 <> 0 and k % 3 = 1 and k % 2 = 0 then 'lab_state_mismatch' end,
        case when k % 43 = 0 then 'operator_authorization_missing' end, case when k % 43 <> 0 and k % 47 = 0 then 'operator_authorization_not_live' end,
        case when k % 43 <> 0 and (k % 7 <= 2 or k % 11 = 0 or k % 4 = 3) then 'operator_authorization_mismatch' end, 'execution_disabled'], lambda x: x is not null) as codes, url from r)
    select k as o_orderkey, array_to_string(codes, ',') as codes, len(codes) = 1 as conditions_met, false as permitted, case when k % 7 = 2 then 'http://b:81' when k % 7 > 2 then 'http://a:80' end as origin from c
""")
def q_scope_decisions(spark, d):
    at = lambda s: F.timestamp_seconds(F.lit(s))
    url = F.when(_k() % 7 == 1, "http://A:80/x").when(_k() % 7 == 2, "http://b:81").when(_k() % 7 != 0, "http://A:80/")
    record = F.struct(at(1000).alias("begin"), at(2000).alias("end"), (_k() % 37 != 0).alias("live_suitable"))
    identity = F.struct((_k() % 23 != 0).alias("independent"), F.when(_k() % 5 == 0, "bad").otherwise("v").alias("verifier"), F.lit("lab").alias("lab_id"), F.when(_k() % 41 == 0, "x").otherwise("net").alias("network"), F.array(F.lit("c2"), F.lit("c1")).alias("containers"), F.lit("h").alias("compose_sha256"), F.when(_k() % 3 == 0, None).when((_k() % 3 == 1) & (_k() % 2 == 0), "other").otherwise("s").alias("lab_state_id"), F.filter(F.array(record), lambda _: _k() % 29 != 0).alias("issued"))
    allowed = F.struct((_k() % 47 != 0).alias("live"), F.lit("lab").alias("lab_id"), F.when(_k() % 17 == 0, "s9").otherwise("s1").alias("scenario_id"), F.when(_k() % 4 == 3, "j").otherwise("i").alias("incident_id"))
    scenario = F.struct(F.when(_k() % 17 == 0, "s9").otherwise("s1").alias("scenario_id"), (_k() % 13 != 0).alias("eligible"))
    now = F.when(_k() % 31 == 1, at(10)).when(_k() % 31 == 2, at(9000)).when(_k() % 31 != 0, at(1500))
    rows = table(spark, d, "orders").select("o_orderkey", url.alias("target_url"), F.lit("i").alias("incident_id"), F.lit("s").alias("expected_state_id"), F.array(F.lit("bad")).alias("forbidden"), F.lit(True).alias("live"), now.alias("now"), F.when(_k() % 11 != 0, scenario).alias("scenario"), F.when(_k() % 19 != 0, identity).alias("identity"), F.when(_k() % 43 != 0, allowed).alias("authorization"))
    labs = spark.createDataFrame([("lab", "a", 80, ["s1"], "net", ["c1", "c2"], "h")], "lab_id string, host string, port int, scenarios array<string>, network string, containers array<string>, compose_sha256 string")
    out = judging.scope_decisions(rows, labs, False)
    return out.select("o_orderkey", F.array_join("codes", ",").alias("codes"), "conditions_met", "permitted", "origin")


@query("select c_custkey, round(2 * (c_acctbal - 100), 4) as phi_balance, round(-0.5 * (c_nationkey - 3), 4)::double as phi_nation from customer")
def q_linear_shapley(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("balance"), F.col("c_nationkey").cast("double").alias("nation"))
    out = risk.linear_shapley(rows, {"balance": 2.0, "nation": -0.5}, {"balance": 100.0, "nation": 3.0})
    return out.select("c_custkey", F.round("phi_balance", 4).alias("phi_balance"), F.round("phi_nation", 4).alias("phi_nation"))


@query("""
    with n as (select 'nation:' || n_nationkey as id from nation union all select 'nation:1'), e as (select 'nation:' || c_nationkey as a, 'customer:' || c_custkey as b, 'hosts' as t from customer union all select 'nation:' || c_nationkey, 'customer:' || c_custkey, 'hosts' from customer where c_custkey % 9 = 0)
    select 'dangling' as issue, x as item from (select distinct b as x from e) union all select 'duplicate_node', 'nation:1'
    union all select 'duplicate_edge', a || '→' || b || '→' || t from e group by a, b, t having count(*) > 1 union all select 'unassessed_edge', 'nation:' || c_nationkey || '→customer:' || c_custkey || '→hosts' from customer where c_custkey % 4 <> 0
""")
def q_graph_issues(spark, d):
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    nodes = n.select(F.concat(F.lit("nation:"), "n_nationkey").alias("node_id"))
    edges = c.select(F.concat(F.lit("nation:"), "c_nationkey").alias("source"), F.concat(F.lit("customer:"), "c_custkey").alias("target"), F.lit("hosts").alias("edge_type"), "c_custkey")
    nodes = nodes.union(nodes.where("node_id = 'nation:1'"))
    return graph.graph_issues(nodes, edges.union(edges.where("c_custkey % 9 = 0")), edges.where("c_custkey % 4 = 0").drop("c_custkey"))


@query("""
    select o_orderkey, array_to_string(list_filter([case when o_orderkey % 3 = 0 then 'condition_ids_not_unique' end, case when o_orderkey % 5 = 0 then 'rule_with_unknown_condition' end, case when o_orderkey % 7 = 0 then 'rule_contradicts_itself' end,
        case when o_orderkey % 11 = 0 then 'conclusive_rule_requires_nothing' end, case when o_orderkey % 13 = 0 then 'oracle_without_evidence_or_false_conclusions' end,
        case when o_orderkey % 17 = 0 then 'approval_not_bound' end, case when o_orderkey % 17 <> 0 and o_orderkey % 19 = 0 then 'approval_date_invalid' end, case when o_orderkey % 23 = 0 then 'pending_approval_already_bound' end, case when o_orderkey % 29 = 0 then 'approval_repeated' end,
        case when o_orderkey % 31 = 0 then 'source_of_another_incident' end, case when o_orderkey % 37 = 0 then 'limitations_missing' end, case when o_orderkey % 41 = 0 then 'ambiguity_codes_not_unique' end,
        case when o_orderkey % 2 = 0 and o_orderkey % 43 = 0 then 'approved_without_reviewer' end, case when o_orderkey % 2 = 0 and o_orderkey % 9 = 4 then 'approved_with_open_ambiguity' end, case when o_orderkey % 2 = 0 and o_orderkey % 8 = 6 then 'approved_without_fixed_probe' end,
        case when o_orderkey % 2 = 0 and o_orderkey % 10 = 4 then 'approved_without_required_approvals' end, case when o_orderkey % 2 = 0 and o_orderkey % 12 = 2 then 'approval_of_another_scenario' end, case when o_orderkey % 2 = 0 and o_orderkey % 14 = 6 then 'approval_of_another_procedure' end], lambda x: x is not null), ',') as issues,
        case when o_orderkey % 10 = 4 then 'r2' else '' end as missing from orders
""")
def q_scenario_issues(spark, d):
    from ..operators import intake

    two = lambda n, a, b: F.when(_k() % n == 0, a).otherwise(b)
    names = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    rule = F.struct(two(11, names(), two(5, names("c1", "zz"), names("c1"))).alias("requires_met"), names().alias("requires_not_met"), F.lit("objective_achieved").alias("status"))
    own = F.struct(two(5, names("zz"), names("c1")).alias("requires_met"), two(7, two(5, names("zz"), names("c1")), names()).alias("requires_not_met"), F.lit("inconclusive").alias("status"))
    approval = F.struct(F.lit("r1").alias("name"), F.lit(True).alias("approved"), (_k() % 17 != 0).alias("confirms"), two(19, F.lit("2026-02-30"), F.lit("2026-02-03")).alias("date"), F.when(_k() % 12 == 2, "other").otherwise("s").alias("scenario_id"), F.when(_k() % 14 == 6, "x").otherwise("h").alias("procedure_sha256"))
    pending = F.struct(two(29, F.lit("r1"), F.lit("r3")).alias("name"), F.lit(False).alias("approved"), F.lit(False).alias("confirms"), F.when(_k() % 23 == 0, "2026-01-01").alias("date"), F.lit(None).cast("string").alias("scenario_id"), F.lit(None).cast("string").alias("procedure_sha256"))
    doubt = lambda code, open_: F.struct(code.alias("code"), F.lit(True).alias("blocking"), (~open_).alias("resolved"))
    review = F.struct(F.when(_k() % 2 == 0, "approved").otherwise("pending").alias("status"), F.when(_k() % 43 != 0, "someone").alias("reviewer"), F.when(_k() % 10 == 4, names("r1", "r2")).otherwise(names("r1")).alias("required_approvers"), F.array(approval, pending).alias("approvals"))
    rows = table(spark, d, "orders").select("o_orderkey", F.lit("s").alias("scenario_id"), F.lit("i").alias("incident_id"), two(31, F.lit("j"), F.lit("i")).alias("source_incident_id"), two(3, names("c1", "c1"), names("c1", "c2")).alias("conditions"), F.array(rule, own).alias("rules"), two(13, names(), names("e")).alias("required_evidence"), names("f").alias("false_conclusions"), two(37, names(), names("l")).alias("limitations"), F.array(doubt(F.lit("a"), _k() % 9 == 4), doubt(two(41, F.lit("a"), F.lit("b")), F.lit(False))).alias("ambiguities"), F.when(_k() % 8 == 6, "unspecified").otherwise("utf8").alias("wire_encoding"), F.lit("v").alias("control_value"), F.lit("h").alias("procedure_sha256"), review.alias("review"))
    return rows.select("o_orderkey", F.array_join(intake.scenario_issues(), ",").alias("issues"), F.array_join(intake.missing_approvals(), ",").alias("missing"))


@query("""
    select c_custkey::varchar as incident_id, o_orderkey as finding_index, case o_orderstatus when 'F' then 'answered' when 'O' then 'citations_rejected' else 'model_error' end as answer_status, o_orderpriority = '1-URGENT' as planner_called,
        case when o_orderstatus = 'O' then 'token=[REDACTED] ' || o_orderkey end as rejected_answer from orders join customer on c_custkey = o_custkey
""")
def q_finding_reports(spark, d):
    from ..operators import intake

    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("incident_id"), F.col("o_orderkey").alias("finding_index"), "o_orderstatus", "o_orderpriority")
    status = F.when(F.col("o_orderstatus") == "F", "answered").when(F.col("o_orderstatus") == "O", "citations_rejected").otherwise("model_error")
    answers = o.select("incident_id", "finding_index", status.alias("status"), F.array(F.lit("x")).alias("issue_codes"), F.concat(F.lit("token=abc "), "finding_index").alias("response"))
    plans = o.where("o_orderpriority = '1-URGENT'").select("incident_id", "finding_index", F.lit("planned").alias("status"), F.lit(True).alias("model_called"))
    out = intake.finding_reports(o, answers, plans)
    return out.select("incident_id", "finding_index", "answer_status", "planner_called", "rejected_answer")
