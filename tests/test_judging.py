"""Rule confirmation, evidence roles and the graph's labels, paths and checks, case by case."""

from pyspark.sql import functions as F

from tracewright.operators import graph, judging, paths, rules
from tracewright.sources import scratch, store


def test_confirmations(spark):
    reports = spark.createDataFrame([(1, "s", "h", True, "objective_achieved", "objective_observed"), (2, "s", "h", True, "objective_not_observed", "x"), (3, "s", "other", True, "objective_achieved", "objective_observed"), (4, "s", "h", True, "objective_achieved", "objective_observed"), (5, "s", "h", False, "objective_achieved", "objective_observed"), (6, "s", "h", True, "inconclusive", "evidence_insufficient")], "report_id int, scenario_id string, definition_sha256 string, registered boolean, status string, reason_code string")
    names = ["control_request_succeeds", "probe_response_parseable", "record_outside_literal_match"]
    results = {1: "met", 2: "met", 3: "met", 4: "not_evaluated", 5: "met", 6: "not_met"}
    rows = [(r, k, n, v if n == names[2] else "met" if r != 6 else "not_met") for r, v in results.items() for k, n in enumerate(names)]
    conditions = spark.createDataFrame(rows, "report_id int, position int, condition string, result string")
    definitions = spark.createDataFrame([("s", "h", names)], "scenario_id string, sha256 string, conditions array<string>")
    got = judging.confirmations(reports, conditions, definitions, spark.createDataFrame(rules.SEARCH_RULES, rules.RULE))
    assert {r["report_id"]: r["confirmation"] for r in got.collect()} == {1: "rules_confirmed", 2: "rules_conflict", 3: "definition_unconfirmed", 4: "definition_unconfirmed", 5: "definition_unconfirmed", 6: "rules_conflict"}


def test_evidence_roles(spark):
    catalog = spark.createDataFrame([(1, e, r) for e, r in (("a", "validation_observation"), ("b", "validation_observation"), ("c", "oracle_condition"), ("d", "hypothesis"), ("e", "proposal"))], "report_id int, evidence_id string, role string")
    used = spark.createDataFrame([(1, "a", "supporting"), (1, "b", "supporting"), (1, "b", "contradicting")], "report_id int, evidence_id string, side string")
    overrides = spark.createDataFrame([(1, "e", "own reason")], "report_id int, evidence_id string, reason string")
    got = {r["evidence_id"]: (r["used_as"], r["exclusion_reason"]) for r in judging.used_as(catalog, used, overrides).collect()}
    assert got == {"a": ("supporting", None), "b": ("excluded", "observation_not_used_for_this_claim"), "c": ("context", None), "d": ("excluded", "hypothesis_is_not_observed_evidence"), "e": ("excluded", "own reason")}


def test_depth_first_order_and_limit(spark):
    edges = spark.createDataFrame([("a", "b", 0), ("a", "c", 1), ("b", "d", 2), ("b", "c", 3), ("c", "d", 4), ("d", "a", 5)], "source string, target string, position long")
    ends = spark.createDataFrame([("a", "d"), ("d", "d")], "source string, target string")
    got = paths.depth_first_paths(edges, ends, max_hops=4, limit=2).orderBy("source", "place").collect()
    assert [r["nodes"] for r in got] == [["a", "b", "d"], ["a", "b", "c", "d"], ["d"]]


def test_service_paths(spark):
    s = "node_id string, node_type string, name string, attributes map<string,string>, position int"
    nodes = spark.createDataFrame([("service:web", "service", "nginx front", {}, 0), ("container:shop-api", "container", "x", {}, 1), ("service:a", "service", "one", {"image": "postgres:16"}, 2), ("service:b", "service", "PostgreSQL", {}, 3), ("node:postgres-1", "other", "postgres", {}, 4)], s)
    services = graph.service_nodes(nodes, graph.SERVICES | {"api": ["shop-api", *graph.SERVICES["api"]]})
    assert {r["service"]: r["node_id"] for r in services.collect()} == {"nginx": "service:web", "api": "container:shop-api", "postgres": "node:postgres-1"}
    labels = spark.createDataFrame([(1, k, x) for k, x in enumerate(["attacker", "NGINX", "nginx proxy", "unknown", "database"])], "case_id int, position int, label string")
    assert graph.service_path(labels, services).collect()[0]["nodes"] == ["service:web", "node:postgres-1"]


def test_numbering_over_ranges(spark):
    rows = spark.range(0, 1000).withColumn("k", F.pmod(F.col("id") * 7919, F.lit(1000))).repartition(7)
    got = scratch.numbered(rows, "n", "k").collect()
    assert all(r["n"] == r["k"] + 1 for r in got) and len(got) == 1000
    assert scratch.numbered(rows.where("false"), "n", "k").count() == 0


def test_checksum_ignores_order(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id int, text string")
    one, two = (store.corpus_checksum(r).first() for r in (rows, rows.orderBy(F.desc("doc_id")).repartition(5)))
    assert one == two and store.corpus_checksum(rows.where("doc_id > 0")).first() != one
