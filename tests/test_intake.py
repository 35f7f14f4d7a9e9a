"""Checks, intake, path evaluation and posterior draws."""

import json

import numpy as np
from pyspark.sql import functions as F

from tracewright.functions import checks
from tracewright.operators import bayes, intake, paths, risk


def issues(spark, check, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").select("i", check(F.col("t")).alias("r"))
    return [r["r"] for r in rows.orderBy("i").collect()]


def test_value_checks(spark):
    assert issues(spark, checks.url_issue, ["http://a/b", "HTTPS://x:1?q", "ftp://a", "http:///x", "http://a b", None]) == [None, None, "scheme", "host", "white_space", "missing"]
    assert issues(spark, checks.utc_time_issue, ["2026-01-05T01:02:03Z", "2026-1-5T1:2:3Z", "2026-02-30T00:00:00Z", None]) == [None, "form", "no_such_time", "missing"]
    assert issues(spark, checks.sha256_issue, ["a" * 64, "A" * 64, "a" * 64 + "\n"]) == [None, "form", "form"]
    assert issues(spark, checks.label_issue, ["OWASP Attacks", " x", "", "a\u200bb", "x" * 400]) == [None, "outer_white_space", "empty", "control_character", "too_long"]
    assert issues(spark, checks.source_id_issue, ["CWE-89", "a b", "a#1", "", "x" * 201]) == [None, "white_space_or_control", "reserved_character", "empty", "too_long"]
    assert issues(spark, checks.relative_path_issue, ["a/b.json", "/a", "C:/a", "a\\b", "a/../b", "a..b"]) == [None, "absolute", "absolute", "backslash", "parent_segment", None]
    assert issues(spark, checks.target_origin, ["http://Host:8080/", "http://h", "http://h:80/x", "https://h:80", "http://u:p@h:80", "http://h:99999", "http://h:80?x"]) == ["http://host:8080", None, None, None, None, None, None]


GOOD = {"relevant_event_ids": ["e1", "e9"], "direct_event_ids": ["e1"], "relevant_network_event_ids": ["e2"], "relevant_docker_paths": [], "relevant_pcap_paths": [], "summary": "s", "confidence": 0.5}


def test_extractions(spark):
    rows = spark.createDataFrame([("i1", json.dumps(GOOD)), ("i2", "{oops"), ("i3", json.dumps({k: v for k, v in GOOD.items() if k != "summary"})), ("i4", json.dumps(GOOD | {"x": 1})), ("i5", json.dumps(GOOD | {"confidence": 2})), ("i6", None)], "incident_id string, response string")
    parsed = intake.parse_extractions(rows)
    assert {r["incident_id"]: r["problem"] for r in parsed.collect()} == {"i1": None, "i2": "invalid_json", "i3": "missing_key", "i4": "unknown_key", "i5": "confidence", "i6": "invalid_json"}
    events = spark.createDataFrame([("i1", "e1", "http_request"), ("i1", "e2", "network_packet")], "incident_id string, event_id string, event_type string")
    got = {(r["field"], r["event_id"]): r["code"] for r in intake.extraction_issues(parsed, events).collect()}
    assert got == {("relevant_event_ids", "e9"): "unknown_event", ("relevant_network_event_ids", "e2"): "not_a_request"}
    labels = spark.createDataFrame([("i1", ["e1", "e2"], ["e1"], [])], "incident_id string, relevant_event_ids array<string>, direct_event_ids array<string>, relevant_network_event_ids array<string>")
    scores = {r["field"]: (r["tp"], r["fp"], r["fn"], r["missed"]) for r in intake.extraction_scores(parsed, labels).collect()}
    assert scores["relevant_event_ids"] == (1, 1, 1, ["e2"]) and scores["direct_event_ids"] == (1, 0, 0, [])


def test_plan_intake(spark):
    s = "k int, status string, has_plan boolean, plan_incident string, incident_id string, plan_finding int, finding int, outcome string, proposal_ids array<string>, grounding_passed boolean"
    ok = ("planned", True, "i", "i", 0, 0, "proposals", ["p"], True)
    cases = [(None, *ok[1:]), ("odd", *ok[1:]), ("llm_error", False, *ok[2:]), ("llm_error", *ok[1:]), ("invalid_response", False, *ok[2:]), (*ok[:2], "j", *ok[3:]), ("insufficient_evidence", True, "i", "i", 0, 0, "insufficient_evidence", [], None), (*ok[:7], ["p", "p"], True), (*ok[:8], None), ok]
    got = [r["r"] for r in spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], s).select("k", intake.plan_intake().alias("r")).orderBy("k").collect()]
    assert [x.replace("remediation_plan_", "") for x in got] == ["missing", "malformed", "unavailable", "malformed", "rejected", "malformed", "insufficient_context", "malformed", "malformed", "usable"]
    plans = spark.createDataFrame([("a", "p1"), ("b", "p2"), ("b", "p3"), ("c", None)], "incident_id string, plan_id string")
    assert {r["incident_id"]: (r["plan_id"], r["state"]) for r in intake.chosen_plan(plans).collect()} == {"a": ("p1", "one"), "b": (None, "several"), "c": (None, "none")}
    pinned, now = (spark.createDataFrame(x, "path string, sha256 string") for x in ([("a", "1"), ("b", "2"), ("c", "3")], [("a", "1"), ("b", "x"), ("d", "4")]))
    assert {r["path"]: r["state"] for r in intake.source_drift(pinned, now).collect()} == {"b": "changed", "c": "missing", "d": "unexpected"}


def test_path_evaluation(spark):
    s = "case string, path_id int, position int, nodes array<string>, weights array<double>, bases array<string>, coherence double"
    rows = [("x", 0, 0, ["a", "b"], [1.0], ["observed"], 0.0), ("x", 1, 1, ["a", "c", "b"], [0.5, 0.5], ["observed", "configured"], 0.9), ("y", 0, 0, ["q", "r"], [0.2], ["configured"], 0.1)]
    scored = paths.path_scores(spark.createDataFrame(rows, s))
    truth = spark.createDataFrame([("x", ["a", "b"]), ("y", ["q", "gone"]), ("z", ["m", "n"])], "case string, path array<string>")
    got = {r["case"]: r for r in paths.truth_ranks(scored, truth).collect()}
    assert got["x"]["rank_guided_score"] == 2 and got["x"]["rank_evidence_score"] == 1 and got["y"]["rank_guided_score"] is None
    nodes = spark.createDataFrame([("x", "a"), ("x", "b"), ("x", "c"), ("y", "q"), ("z", "m"), ("z", "n")], "case string, node_id string")
    out = {(r["case"], r["score"]): r for r in paths.reconstruction_summary(scored, truth, nodes).collect()}
    assert out["x", "evidence_score"]["exact"] and out["x", "guided_score"]["node_coverage"] == 1.0 and not out["x", "guided_score"]["exact"]
    assert out["y", "guided_score"]["status"] == "invalid_truth" and out["z", "guided_score"]["status"] == "no_candidate_path"
    edges = spark.createDataFrame([("x", "a", "b", 0.0), ("x", "a", "c", 50.0)], "case string, source string, target string, logit double")
    probability = {(r["case"], r["path_id"]): (r["valid"], r["score"]) for r in paths.path_probability(spark.createDataFrame(rows, s), edges).collect()}
    assert probability["x", 0] == (True, 0.5) and probability["x", 1][0] is False


def test_posterior_draws(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(b), int(a + 0.3 * rng.normal() > 0)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))]
    df = spark.createDataFrame(rows, "k int, a double, b double, y int")
    model = bayes.fit(df.repartition(5), ["a", "b"], "y")
    other = bayes.fit(df.coalesce(1), ["a", "b"], "y", steps=3)
    assert np.allclose(model.losses[:3], other.losses) and model.losses[-1] < model.losses[0] / 2
    long = {r["k"]: r for r in risk.posterior_summary(bayes.posterior_draws(model, df, "k", draws=40), "k", "probability").collect()}
    out = bayes.posterior_summary(model, df, "k", draws=40).join(df, "k").collect()
    assert len(out) == 400 and all(r["q05"] <= r["q95"] for r in out)
    for r in out:
        assert np.allclose([r[c] for c in ("n_draws", "mean", "std", "q05", "q95")], [long[r["k"]][c] for c in ("n_draws", "mean", "std", "q05", "q95")]) and r["band"] == long[r["k"]]["band"]
    assert np.mean([(r["mean"] > 0.5) == bool(r["y"]) for r in out]) > 0.85
    odd = spark.createDataFrame([(1, None, 1.0, 1), (2, 0.5, 0.5, None)], df.schema)
    assert bayes.fit(odd, ["a", "b"], "y").losses == ()
    got = {r["k"]: r for r in bayes.posterior_summary(model, odd.union(odd), "k", draws=40).distinct().collect()}
    assert got[1]["mean"] is None and got[1]["band"] is None and 0 < got[2]["mean"] < 1
    assert bayes.posterior_summary(model, odd.where("false"), "k").count() == 0


def test_gradient_is_that_of_the_loss():
    rng, shape = np.random.default_rng(5), bayes.Shape(3, 4)
    w, x, y = rng.normal(size=shape.size), rng.normal(size=(50, 3)), rng.integers(0, 2, 50).astype(float)
    got = bayes.gradient(shape, w, x, y)
    for i in range(shape.size):
        step = np.zeros(shape.size)
        step[i] = 1e-6
        slope = (bayes.gradient(shape, w + step, x, y)[-2] - bayes.gradient(shape, w - step, x, y)[-2]) / 2e-6
        assert abs(got[i] - slope) < 1e-4
    p = bayes.probabilities(shape, w[None], x)[:, 0]
    assert np.isclose(got[-2], -np.sum(y * np.log(p) + (1 - y) * np.log(1 - p))) and got[-1] == 50
