"""Registered queries that build a graph from evidence events, and of the record-set oracle, over rows made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, rules
from ..schema import event_columns
from ..sources.scratch import written
from .registry import query
from .tables import table


def evidence_rows(spark, d):
    """Suppliers as containers on a network (those of nation 0 without an address), events as requests to their addresses, customers
    as packets between addresses, and each supplier's setting that names the next one."""
    text = lambda *parts: F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])
    place = lambda n: text("10.1.", F.floor(n / 250), ".", n % 250)
    s, e, c = (table(spark, d, t) for t in ("supplier", "events", "customer"))
    k, u, known = F.col("s_suppkey"), F.col("user_id"), lambda **kv: F.create_map(*[x for n, v in kv.items() for x in (F.lit(n), v)])
    states = s.select(*event_columns(event_id=text("s", k), seq=k, source=F.lit("docker"), event_type=F.lit("container_state"), source_entity=F.col("s_name"), attributes=known(container_id=k.cast("string"), image=text("image", F.col("s_nationkey")), exposed_ports=text('["', F.col("s_nationkey") + 8000, '/tcp"]'))))
    member = s.select(*event_columns(event_id=text("m", k), seq=k + (1 << 32), source=F.lit("docker"), event_type=F.lit("network_membership"), source_entity=F.col("s_name"), attributes=known(ip_address=F.when(F.col("s_nationkey") == 0, "").otherwise(place(k)))))
    front = F.when(F.col("event_type").isin("view", "click"), "nginx").otherwise("application")
    asked = e.select(*event_columns(event_id=F.col("event_id").cast("string"), seq=F.col("event_id") + (1 << 40), source=front, event_type=F.lit("http_request"), source_entity=F.when(F.col("event_type") != "signup", text("192.168.0.", u)), destination_entity=F.when(F.col("event_type").isin("click", "purchase"), place(u + 1))))
    packets = c.select(*event_columns(event_id=text("p", F.col("c_custkey")), seq=F.col("c_custkey") + (1 << 44), source=F.lit("packet_capture"), event_type=F.lit("network_packet"), source_entity=place(F.col("c_custkey")), destination_entity=text("192.168.0.", F.col("c_nationkey") * 7)))
    after = text("Supplier#", F.lpad((k + 1).cast("string"), 9, "0"))
    settings = s.select(F.col("s_name").alias("name"), F.lit("DB_HOST").alias("key"), after.alias("value")).union(s.select("s_name", F.lit("DB_PORT"), F.col("s_name")))
    return states.unionByName(member).unionByName(asked).unionByName(packets), settings


GIVEN = """
    sup as (select s_suppkey as k, s_name as name, s_nationkey as nk, case when s_nationkey = 0 then '' else '10.1.' || s_suppkey // 250 || '.' || s_suppkey % 250 end as ip from supplier),
    asked as (select event_id::varchar as id, case when event_type in ('view', 'click') then 'service:nginx' else 'service:api' end as front, case when event_type <> 'signup' then '192.168.0.' || user_id end as a,
        case when event_type in ('click', 'purchase') then '10.1.' || (user_id + 1) // 250 || '.' || (user_id + 1) % 250 end as b from events),
    packets as (select 'p' || c_custkey as id, '10.1.' || c_custkey // 250 || '.' || c_custkey % 250 as a, '192.168.0.' || c_nationkey * 7 as b from customer),
    places as (select ip from sup where ip <> '' union select a from asked where a is not null)"""


@query(f"""
    with {GIVEN}, n as (
        select 'container:' || name as node_id, 'container' as node_type, name, 'observed' as basis, 's' || k as id, 'image' || nk as image, null as container from sup
        union all select 'service:' || name, 'service', name, 'configured', 's' || k, null, null from sup
        union all select 'ip:' || ip, 'ip', ip, 'observed', 'm' || k, null, name from sup where ip <> ''
        union all select 'ip:' || a, 'ip', a, 'observed', id, null, null from asked where a is not null
        union all select front, 'service', front[9:], 'observed', id, null, null from asked
        union all select 'port:' || (nk + 8000) || '/tcp', 'port', (nk + 8000) || '/tcp', 'configured', 's' || k, null, null from sup
    )
    select node_id, min(node_type) as node_type, min(name) as name, case when bool_or(basis = 'observed') then 'observed' else 'configured' end as basis, count(distinct id) as n_evidence, max(image) as image, max(container) as container from n group by 1
""")
def q_built_nodes(spark, d):
    """The nodes of a graph built from states, memberships, requests and packets."""
    nodes, _ = graph.build_graph(*evidence_rows(spark, d))
    said = lambda k: F.element_at("attributes", F.lit(k)).alias(k)
    return nodes.select("node_id", "node_type", "name", "basis", "n_evidence", said("image"), said("container"))


@query(f"""
    with {GIVEN}, e as (
        select 'container:' || name as source, 'service:' || name as target, 'hosts' as edge_type, 'configured' as basis, 's' || k as id from sup
        union all select 'container:' || name, 'ip:' || ip, 'connects_to', 'configured', 'm' || k from sup where ip <> ''
        union all select 'ip:' || a, front, 'accesses', 'observed', id from asked where a is not null
        union all select front, 'service:' || name, 'forwards', 'observed', id from asked join sup on b = ip
        union all select 'ip:' || a, 'ip:' || b, 'communicates_with', 'observed', id from packets where a in (from places) and b in (from places)
        union all select 'service:' || x.name, 'service:' || y.name, 'depends_on', 'configured', null from sup x join sup y on y.name = 'Supplier#' || lpad((x.k + 1)::varchar, 9, '0')
    )
    select source, target, edge_type, min(basis) as basis, count(distinct id) as n_evidence from e group by 1, 2, 3
""")
def q_built_edges(spark, d):
    """The edges of the same graph: all six kinds that events can give."""
    _, edges = graph.build_graph(*evidence_rows(spark, d))
    return edges.select("source", "target", "edge_type", "basis", "n_evidence")


@query("""
    with o as (select o_custkey as c, o_orderkey as id, o_orderstatus as st, o_orderstatus || ' ' || o_orderpriority as msg, o_totalprice as p from orders),
    ends as (select c, min({'p': p, 'id': id, 'st': st, 'msg': msg}) as lo, max({'p': p, 'id': id, 'st': st, 'msg': msg}) as hi from o group by 1),
    r as (select c, lo.st as literal, lo.msg as lo, hi.msg as hi, c_mktsegment as seg, c_nationkey not in (3, 4) as valid,
            c_acctbal >= 0 and c_mktsegment <> 'FURNITURE' and (lo.id <> hi.id or c_mktsegment = 'MACHINERY') as parsed from ends join customer on c = c_custkey),
    n as (select *, (not contains(lo, literal))::int + (seg <> 'MACHINERY' and not contains(hi, literal))::int as leaked,
            (not contains(lo, literal))::int + (not contains(case seg when 'BUILDING' then 'other' else hi end, literal))::int as outside from r),
    v as (select *, case when not (valid and parsed) or seg = 'BUILDING' then 'not_evaluated' when leaked > 0 then 'met' when outside > 0 then 'not_evaluated' else 'not_met' end as verdict from n)
    select c as case_id, case when valid and parsed then leaked else 0 end::bigint as n_leaked, case when parsed then outside else 0 end::bigint as n_outside,
        case verdict when 'met' then 'objective_achieved' when 'not_met' then 'objective_not_observed' else 'inconclusive' end as status,
        case verdict when 'met' then 'objective_observed' when 'not_met' then 'objective_not_observed_under_tested_conditions' else 'evidence_insufficient' end as reason_code,
        case verdict when 'met' then 1 when 'not_met' then 2 end as rule_no from v
""")
def q_search_oracle(spark, d):
    """A probe for each customer against the records that searches for their orders established.

    A search finds one order; those of nation 3 fail, and nation 4 is told two messages of each order. The probe answers with the
    customer's cheapest and dearest order, the latter changed in one segment, unknown in another; a third answers with no list."""
    record = lambda i, m: F.struct(i.alias("id"), m.alias("message"))
    body = lambda *records: F.to_json(F.struct(F.array(*records).alias("data")))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    o = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    o = o.withColumn("msg", F.concat_ws(" ", "o_orderstatus", "o_orderpriority"))
    code = F.when(F.col("c_nationkey") == 3, 404).otherwise(200).alias("status_code")
    searches = o.select(F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("term"), code, body(record(F.col("o_orderkey"), F.col("msg"))).alias("body"))
    again = o.where("c_nationkey = 4").select("o_custkey", F.lit(""), code, body(record(F.col("o_orderkey"), F.lower("msg"))))
    order = F.struct(F.col("o_totalprice").alias("p"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("st"), "msg")
    ends = o.groupBy("o_custkey", "c_mktsegment", "c_acctbal").agg(F.min(order).alias("lo"), F.max(order).alias("hi"))
    seg, hi = F.col("c_mktsegment"), F.col("hi")
    last = record(F.when(seg == "MACHINERY", hi["id"] + 1_000_000_000_000).otherwise(hi["id"]), F.when(seg == "BUILDING", "other").otherwise(hi["msg"]))
    answer = F.when(seg == "FURNITURE", '{"data": 3}').otherwise(body(record(F.col("lo.id"), F.col("lo.msg")), last))
    probes = ends.select(F.col("o_custkey").alias("case_id"), F.col("lo.st").alias("literal"), F.when(F.col("c_acctbal") < 0, 500).otherwise(200).alias("status_code"), answer.alias("body"))
    results = written(rules.probe_conditions(probes, searches.union(again)), "conditions")
    status = rules.first_rule(results, spark.createDataFrame(rules.SEARCH_RULES, rules.RULE))
    counts = results.where("condition = 'probe_response_parseable'").select("case_id", "n_leaked", "n_outside")
    return counts.join(status, "case_id").select("case_id", "n_leaked", "n_outside", "status", "reason_code", "rule_no")


@query("""
    with r as (select l_orderkey, l_linenumber, l_partkey, round(l_discount * 100)::int as d, round(l_tax * 100)::int as t, l_quantity = 50 as none, l_linestatus = 'F' as fake,
            case when o_orderpriority = '4-NOT SPECIFIED' then 'blocked' when o_orderstatus = 'F' then 'objective_achieved' when o_orderstatus = 'O' then 'objective_not_observed' else 'inconclusive' end as sa,
            case when l_returnflag = 'R' then 'objective_achieved' when l_returnflag = 'A' then 'objective_not_observed' when l_quantity < 10 then 'not_validated' else 'inconclusive' end as sb,
            o_orderpriority = '5-LOW' as seen from lineitem join orders on l_orderkey = o_orderkey),
    p as (select *, none or (sa <> 'blocked' and sb <> 'not_validated') as run, case when none then ['report_type_invalid'] else list_filter([
            case when seen then 'observation_is_not_remediation_evidence' end, case when t = 0 then 'same_run' end, case when d = 2 then 'incident_mismatch' end, case when d = 1 then 'scenario_mismatch' end,
            case when d = 3 then 'scenario_definition_mismatch' end, case when d = 4 then 'oracle_mismatch' end, case when d = 5 then 'target_origin_mismatch' end, case when d = 6 then 'baseline_not_pre_remediation' end,
            case when d = 7 then 'post_not_post_remediation' end, case when d = 8 then 'pre_state_id_missing' end, case when d = 9 then 'pre_state_id_mismatch' end, case when t = 1 then 'post_state_id_missing' end,
            case when t = 2 then 'states_not_distinct' end, case when t = 3 then 'remediation_not_attested' end, case when t = 4 then 'transport_kinds_differ' end,
            case when t = 5 then 'timestamps_missing' end, case when t = 6 then 'baseline_not_before_post' end], lambda x: x is not null) end as problems from r),
    q as (select *, run and len(problems) = 0 as fine from p),
    c as (select *, case when run and not fine then 'not_comparable' when sa = 'blocked' then 'baseline_not_run' when sb = 'not_validated' then 'post_not_run' when sa = 'inconclusive' then 'baseline_inconclusive'
            when sb = 'inconclusive' then 'post_inconclusive' when sa = 'objective_achieved' and sb = sa then 'objective_still_achievable' when sa = 'objective_achieved' then 'objective_not_observed_after_baseline_achieved'
            when sb = 'objective_achieved' then 'objective_newly_observed' else 'objective_not_observed_in_both' end as category,
        case when not fine then null when fake then 'simulation_only' when sa = 'inconclusive' or sb = 'inconclusive' or (sa = sb and sa = 'objective_not_observed') then 'no_inference_possible'
            when sa = 'objective_achieved' and sb = sa then 'remediation_did_not_stop_tested_probe' when sa = 'objective_achieved' then 'consistent_with_remediation_blocking_tested_probe' else 'unexpected_regression' end as interpretation from q)
    select l_orderkey, l_linenumber, l_partkey, case when run then array_to_string(problems, ',') else '' end as problems, fine as comparable, category, interpretation,
        case when fine then case when fake then 'simulation' else 'live' end end as basis, fine and not fake and interpretation <> 'no_inference_possible' as usable from c
""")
def q_report_comparison(spark, d):
    """An order as the report before and each of its items as the report after; discount and tax say in what the two differ."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    rows = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    off = lambda c, n: F.round(F.col(c) * 100).cast("int") == n
    discount, tax = lambda n: off("l_discount", n), lambda n: off("l_tax", n)
    text, i = F.lit, F.col("l_orderkey").cast("string")
    kind = F.when(F.col("l_linestatus") == "F", "fake").otherwise("http")
    before = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "blocked").when(F.col("o_orderstatus") == "F", "objective_achieved").when(F.col("o_orderstatus") == "O", "objective_not_observed").otherwise("inconclusive")
    after = F.when(F.col("l_returnflag") == "R", "objective_achieved").when(F.col("l_returnflag") == "A", "objective_not_observed").when(F.col("l_quantity") < 10, "not_validated").otherwise("inconclusive")
    report = lambda **fields: F.struct(*[v.alias(k) for k, v in fields.items()])
    a = report(report_kind=F.when(F.col("o_orderpriority") == "5-LOW", "pre_remediation_observation").otherwise("validation"), run_id=text("a"), incident_id=i, scenario_id=text("s"), definition_sha256=F.when(~discount(3), "d"), oracle=text("o:1"), origin=text("http://a"), tested_state=F.when(~discount(6), "pre_remediation"), pre_state_id=text("pre"), transport_kind=kind, started_at=text("2026-01-01"), finished_at=F.when(~tax(5), F.when(tax(6), "2026-01-04").otherwise("2026-01-02")), status=before)
    b = report(report_kind=text("validation"), run_id=F.when(tax(0), "a").otherwise("b"), incident_id=F.when(discount(2), "other").otherwise(i), scenario_id=F.when(discount(1), "other").otherwise("s"), definition_sha256=text("d"), oracle=F.when(~discount(4), "o:1"), origin=F.when(discount(5), "http://b").otherwise("http://a"), tested_state=F.when(discount(7), "pre_remediation").otherwise("post_remediation"), pre_state_id=F.when(discount(9), "other").when(~discount(8), "pre"), post_state_id=F.when(tax(2), "pre").when(~tax(1), "post"), application_state=text("independently_attested"), applied_ids=F.when(tax(3), F.array().cast("array<string>")).otherwise(F.array(text("r1"))), transport_kind=F.when(tax(4), "other").otherwise(kind), started_at=text("2026-01-03"), finished_at=text("2026-01-05"), status=after)
    pairs = rows.select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_quantity") != 50, a).alias("a"), b.alias("b"))
    got = rules.compare_reports(pairs)
    return got.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join("problems", ",").alias("problems"), "comparable", "category", "interpretation", "basis", "usable")
