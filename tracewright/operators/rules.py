"""First-match rules, record-set comparison, before/after outcomes and the judge's cascade."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

CONCLUSIVE = ["objective_achieved", "objective_not_observed"]
NOT_RUN = ["not_validated", "blocked"]
#: Outcome and reading of a conclusive pair, before and after.
OUTCOMES = {
    ("objective_achieved", "objective_achieved"): ("objective_still_achievable", "remediation_did_not_stop_tested_probe"),
    ("objective_achieved", "objective_not_observed"): ("objective_not_observed_after_baseline_achieved", "consistent_with_remediation_blocking_tested_probe"),
    ("objective_not_observed", "objective_achieved"): ("objective_newly_observed", "unexpected_regression"),
    ("objective_not_observed", "objective_not_observed"): ("objective_not_observed_in_both", "no_inference_possible"),
}
#: Rules of the record-set oracle (number, condition, wanted result, status, reason).
SEARCH_RULES = [
    (1, "probe_response_parseable", "met", "objective_achieved", "objective_observed"),
    (1, "record_outside_literal_match", "met", "objective_achieved", "objective_observed"),
    (2, "control_request_succeeds", "met", "objective_not_observed", "objective_not_observed_under_tested_conditions"),
    (2, "probe_response_parseable", "met", "objective_not_observed", "objective_not_observed_under_tested_conditions"),
    (2, "record_outside_literal_match", "not_met", "objective_not_observed", "objective_not_observed_under_tested_conditions"),
]
RULE = "rule_no int, condition string, wanted string, status string, reason_code string"
RECORDS = "struct<data:array<struct<id:bigint,message:string>>>"


def codes(*pairs: tuple[Column, str]) -> Column:
    """The codes whose condition holds, in order; unknown counts as not holding."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), code) for c, code in pairs]))


def first_rule(results: DataFrame, rules: DataFrame, case: str = "case_id") -> DataFrame:
    """For each case the first rule whose conditions all have the wanted result (case, condition, result): a condition that was
    not evaluated meets neither. Cases without a rule are inconclusive."""
    needed = rules.groupBy("rule_no").agg(F.count("*").alias("needed"), F.first("status").alias("status"), F.first("reason_code").alias("reason_code"))
    hit = results.join(rules.select("rule_no", F.col("condition").alias("_c"), "wanted"), (F.col("condition") == F.col("_c")) & (F.col("result") == F.col("wanted")))
    full = hit.groupBy(case, "rule_no").agg(F.count_distinct("condition").alias("n")).join(needed, "rule_no").where("n = needed")
    best = full.groupBy(case).agg(F.min_by(F.struct("status", "reason_code", "rule_no"), "rule_no").alias("r"))
    every = results.select(case).distinct().join(best, case, "left")
    return every.select(case, F.coalesce("r.status", F.lit("inconclusive")).alias("status"), F.coalesce("r.reason_code", F.lit("evidence_insufficient")).alias("reason_code"), F.col("r.rule_no").alias("rule_no"))


def parse_records(body: Column) -> Column:
    """Records of a search response {"data": [{"id", "message"}]}; null where the body is no such list, an id or message is
    missing, or an id repeats."""
    data = F.from_json(body, RECORDS)["data"]
    ids = F.transform(data, lambda r: r["id"])
    good = data.isNotNull() & F.forall(data, lambda r: r["id"].isNotNull() & r["message"].isNotNull()) & (F.size(F.array_distinct(ids)) == F.size(ids))
    return F.when(good, data)


def known_records(baselines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(case_id, valid) and (case_id, id, message) of baseline searches (case_id, term, status_code, body): each must answer, every
    record must hold its term, and records of one id must agree. Records stay rows, so a case may have any number."""
    rows = baselines.withColumn("records", parse_records(F.col("body"))).withColumn("fine", (F.col("status_code") == 200) & F.col("records").isNotNull() & F.forall("records", lambda r: F.contains(r["message"], F.col("term"))))
    rows = written(rows.select("case_id", "records", "fine"), "baselines")  # bodies are parsed once
    each = rows.select("case_id", F.explode("records").alias("r")).groupBy("case_id", F.col("r.id").alias("id")).agg(F.min("r.message").alias("message"), F.max("r.message").alias("_last"))
    agree = each.groupBy("case_id").agg(F.bool_and(F.col("message") == F.col("_last")).alias("agree"))
    whole = rows.groupBy("case_id").agg(F.bool_and(F.coalesce("fine", F.lit(False))).alias("fine")).join(agree, "case_id", "left")
    return whole.select("case_id", (F.col("fine") & F.coalesce("agree", F.lit(True))).alias("valid")), each.select("case_id", "id", "message")


def probe_conditions(probes: DataFrame, baselines: DataFrame) -> DataFrame:
    """Condition results of probes (case_id, literal, status_code, body) against the records that their baselines established:
    case_id, condition, result, n_leaked, n_outside. Repeated probes count once.

    A known record that the literal does not match was leaked: the objective is met. A record outside the match that no
    baseline knows, or a known id with another message, proves nothing either way."""
    valid, known = known_records(baselines)
    rows = probes.select("case_id", "literal", F.when(F.col("status_code") == 200, parse_records(F.col("body"))).alias("records"), F.sha2(F.to_json(F.struct("literal", "status_code", "body")), 256).alias("probe"))
    each = rows.select("case_id", "probe", "literal", F.col("records").isNotNull().alias("parsed"), F.posexplode_outer("records").alias("pos", "r")).dropDuplicates(["case_id", "probe", "pos"])
    said, meant = F.col("r.message"), F.col("message")
    met_known = each.withColumn("id", F.col("r.id")).join(known, ["case_id", "id"], "left")
    sums = met_known.groupBy("case_id", "probe").agg(
        F.bool_or("parsed").alias("parsed"),
        F.coalesce(F.bool_or(meant != said), F.lit(False)).alias("against"),
        F.count_if(~F.contains(meant, F.col("literal"))).alias("leaked"),
        F.count_if(~F.contains(said, F.col("literal"))).alias("outside"),
    )
    found = sums.join(valid, "case_id", "left").withColumn("valid", F.coalesce("valid", F.lit(False)))
    fair, parsed = F.col("valid") & F.col("parsed"), F.col("parsed")
    verdict = F.when(~fair | F.col("against"), "not_evaluated").when(F.col("leaked") > 0, "met").when(F.col("outside") > 0, "not_evaluated").otherwise("not_met")
    met = lambda c: F.when(c, "met").otherwise("not_met")
    three = F.array(F.struct(F.lit("control_request_succeeds").alias("condition"), met(F.col("valid")).alias("result")), F.struct(F.lit("probe_response_parseable").alias("condition"), met(parsed).alias("result")), F.struct(F.lit("record_outside_literal_match").alias("condition"), verdict.alias("result")))
    return found.select("case_id", F.when(fair, F.col("leaked")).otherwise(0).alias("n_leaked"), F.when(parsed, F.col("outside")).otherwise(0).alias("n_outside"), F.explode(three).alias("c")).select("case_id", "n_leaked", "n_outside", "c.*")


def outcome(before: Column, after: Column) -> Column:
    """Category and reading of a before/after pair of statuses."""
    table = F.create_map(*[x for (a, b), (c, d) in OUTCOMES.items() for x in (F.lit(f"{a}|{b}"), F.struct(F.lit(c).alias("category"), F.lit(d).alias("interpretation")))])
    pair = lambda c, i: F.struct(F.lit(c).alias("category"), F.lit(i).cast("string").alias("interpretation"))
    return (
        F.when(F.coalesce(before.isin(NOT_RUN), F.lit(True)), pair("baseline_not_run", None))
        .when(F.coalesce(after.isin(NOT_RUN), F.lit(True)), pair("post_not_run", None))
        .when(~before.isin(CONCLUSIVE), pair("baseline_inconclusive", "no_inference_possible"))
        .when(~after.isin(CONCLUSIVE), pair("post_inconclusive", "no_inference_possible"))
        .otherwise(F.element_at(table, F.concat_ws("|", before, after)))
    )


def comparison_problems(a: str = "a", b: str = "b") -> Column:
    """Why two reports (struct columns) are no before/after pair, in order; empty if they are one."""
    x, y = lambda c: F.col(f"{a}.{c}"), lambda c: F.col(f"{b}.{c}")
    differ = lambda c: ~x(c).eqNullSafe(y(c))
    missing = x("pre_state_id").isNull() | y("pre_state_id").isNull()
    none = F.col(a).isNull() | F.col(b).isNull()
    return F.when(none, F.array(F.lit("report_type_invalid"))).otherwise(_differences(x, y, differ, missing))


def _differences(x, y, differ, missing) -> Column:
    return codes(
        ((x("report_kind") == "pre_remediation_observation") | (y("report_kind") == "pre_remediation_observation"), "observation_is_not_remediation_evidence"),
        (x("run_id") == y("run_id"), "same_run"),
        (differ("incident_id"), "incident_mismatch"),
        (differ("scenario_id"), "scenario_mismatch"),
        (x("definition_sha256").isNull() | differ("definition_sha256"), "scenario_definition_mismatch"),
        (x("oracle").isNull() | y("oracle").isNull() | differ("oracle"), "oracle_mismatch"),
        (x("origin").isNull() | differ("origin"), "target_origin_mismatch"),
        (~x("tested_state").eqNullSafe(F.lit("pre_remediation")), "baseline_not_pre_remediation"),
        (~y("tested_state").eqNullSafe(F.lit("post_remediation")), "post_not_post_remediation"),
        (missing, "pre_state_id_missing"),
        (~missing & differ("pre_state_id"), "pre_state_id_mismatch"),
        (y("post_state_id").isNull(), "post_state_id_missing"),
        ((y("post_state_id") == y("pre_state_id")) | (y("post_state_id") == x("pre_state_id")), "states_not_distinct"),
        (~y("application_state").eqNullSafe(F.lit("independently_attested")) | (F.size(F.coalesce(y("applied_ids"), F.array().cast("array<string>"))) == 0), "remediation_not_attested"),
        (differ("transport_kind"), "transport_kinds_differ"),
        (x("finished_at").isNull() | y("started_at").isNull(), "timestamps_missing"),
        (x("finished_at") > y("started_at"), "baseline_not_before_post"),
    )


def compare_reports(pairs: DataFrame) -> DataFrame:
    """pairs (a, b: reports with status) with problems, comparable, category, interpretation, basis and usable."""
    p = comparison_problems()
    none = F.col("a").isNull() | F.col("b").isNull()
    run = none | (~F.col("a.status").isin(NOT_RUN) & ~F.col("b.status").isin(NOT_RUN))
    rows = pairs.withColumn("problems", F.when(run, p).otherwise(F.array().cast("array<string>")))
    got = outcome(F.col("a.status"), F.col("b.status"))
    fine = run & (F.size("problems") == 0)
    basis = F.when(fine, F.when(F.col("a.transport_kind") == "fake", "simulation").otherwise("live"))
    rows = rows.withColumn("comparable", fine).withColumn("basis", basis).withColumn("category", F.when(run & ~fine, "not_comparable").otherwise(got["category"]))
    reading = F.when(fine, F.when(F.col("basis") == "simulation", "simulation_only").otherwise(got["interpretation"]))
    ends = F.col("a.status").isin(CONCLUSIVE) & F.col("b.status").isin(CONCLUSIVE)
    return rows.withColumn("interpretation", reading).withColumn("usable", fine & ends & (F.col("basis") == "live") & (F.col("interpretation") != "no_inference_possible"))


def scope_codes(request: str = "request", policy: str = "policy") -> Column:
    """Why a request (target_origin, scenario_id, identity, authorized, mode) is outside its policy; empty if it is inside."""
    r, p = lambda c: F.col(f"{request}.{c}"), lambda c: F.col(f"{policy}.{c}")
    inside = lambda v, allowed: F.array_contains(allowed, v)
    return codes(
        (r("target_origin").isNull(), "target_missing"),
        (r("target_origin").isNotNull() & ~F.coalesce(inside(r("target_origin"), p("origins")), F.lit(False)), "target_not_allowed"),
        (~F.coalesce(inside(r("scenario_id"), p("scenarios")), F.lit(False)), "scenario_not_allowed"),
        (~r("identity").eqNullSafe(p("identity")), "identity_not_verified"),
        (~F.coalesce(r("authorized"), F.lit(False)), "not_authorized"),
        (~F.coalesce(inside(r("mode"), p("modes")), F.lit(False)), "execution_not_allowed"),
    )


def preconditions(rows: DataFrame, order: list[str]) -> DataFrame:
    """Tri-state preconditions of boolean columns: one after the first that is not met was not evaluated. Adds checks,
    first_unmet and ready."""
    state, blocked = [], F.lit(False)
    for name in order:
        holds = F.coalesce(F.col(name), F.lit(False))
        state.append(F.struct(F.lit(name).alias("precondition"), F.when(~blocked, holds).alias("satisfied"), (~blocked).alias("evaluated")))
        blocked = blocked | ~holds
    first = F.get(F.transform(F.filter(F.array(*state), lambda s: s["evaluated"] & ~s["satisfied"]), lambda s: s["precondition"]), F.lit(0))
    return rows.withColumn("checks", F.array(*state)).withColumn("first_unmet", first).withColumn("ready", F.col("first_unmet").isNull())


def attestation_codes(prefix: str = "") -> Column:
    """Why an attestation of applied proposals does not hold, from its columns and those of the plan that it is about."""
    c = lambda n: F.col(prefix + n)
    return codes(
        (~c("plan_sha256").eqNullSafe(c("attested_sha256")), "binding_hash_mismatch"),
        (F.size(F.array_except(c("applied_ids"), c("proposal_ids"))) > 0, "unknown_proposal"),
        (F.size(c("applied_ids")) == 0, "nothing_applied"),
        (F.coalesce(F.trim(c("operator")), F.lit("")) == "", "operator_missing"),
        (c("attested_at").isNull(), "time_missing"),
        (c("attested_at") > c("now"), "time_in_future"),
        (c("attested_at") < c("now") - F.expr("interval 24 hours"), "too_old"),
    )


def judge(reports: DataFrame) -> DataFrame:
    """decision, sufficiency and reason codes of validation reports, by the first case that applies.

    Columns: status, mode_conflict, id_collision, roles_conflict, n_dangling, rule_confirmed, provenance, claim,
    n_proposals, attested."""
    c = F.col
    said = lambda d, s, *r: F.struct(F.lit(d).alias("decision"), F.lit(s).alias("sufficiency"), F.array(*[F.lit(x) for x in r]).alias("reason_codes"))
    yes = lambda n: F.coalesce(c(n), F.lit(False))
    got = (
        F.when(yes("mode_conflict"), said("inconclusive", "insufficient", "execution_mode_conflict"))
        .when(yes("id_collision"), said("inconclusive", "insufficient", "evidence_id_ambiguous"))
        .when(yes("roles_conflict"), said("inconclusive", "insufficient", "observations_contradict"))
        .when(F.coalesce("n_dangling", F.lit(0)) > 0, said("inconclusive", "insufficient", "dangling_evidence"))
        .when(c("status") == "blocked", said("blocked", "not_applicable", "blocked_execution"))
        .when((c("status") == "not_validated") & c("reason_code").eqNullSafe(F.lit("remediation_application_not_attested")), said("not_evaluated", "not_applicable", "validation_not_performed", "proposal_not_executed"))
        .when(c("status") == "not_validated", said("not_evaluated", "not_applicable", "validation_not_performed"))
        .when(~c("status").isin(CONCLUSIVE) | c("status").isNull(), said("inconclusive", "insufficient", "upstream_inconclusive"))
        .when(~yes("rule_confirmed"), said("inconclusive", "insufficient", "rule_not_confirmed"))
        .when(~F.coalesce(c("provenance").isin("mocked", "live"), F.lit(False)), said("inconclusive", "insufficient", "evidence_gate_unsatisfied", "rules_confirmed"))
        .when(c("claim") == "application_secure", said("not_supported", "sufficient", "security_claim_not_supported"))
        .when((c("claim") == "remediation_applied") & (c("n_proposals") == 0) & ~yes("attested"), said("not_supported", "sufficient", "proposal_not_executed"))
        .when((c("claim") == "remediation_applied") & yes("attested"), said("inconclusive", "insufficient", "attestation_not_verified"))
        .when(c("claim") == "remediation_applied", said("not_supported", "sufficient", "proposal_not_executed"))
        .when(c("claim").isNull() | (c("claim") == c("status")), said("supported", "sufficient", "rules_confirmed"))
        .otherwise(said("not_supported", "sufficient", "rules_contradict_claim"))
    )
    return reports.withColumn("judgement", got).select(*reports.columns, "judgement.*")


def first_status(*cases: tuple[Column, str], otherwise: str) -> Column:
    """A status machine: the first case that holds; unknown does not hold."""
    return reduce(lambda out, case: F.when(F.coalesce(case[0], F.lit(False)), case[1]).otherwise(out), reversed(cases), F.lit(otherwise))


def answer_status() -> Column:
    """Status of a grounded answer from n_evidence, n_references, model_error, parsed, n_issues."""
    return first_status((F.col("n_evidence") == 0, "insufficient_evidence"), (F.col("n_references") == 0, "no_references"), (F.col("model_error").isNotNull(), "model_error"), (~F.col("parsed"), "invalid_response"), (F.col("n_issues") > 0, "citations_rejected"), otherwise="answered")


def plan_status() -> Column:
    """Status of a remediation plan from ready, sent, model_error, parsed, n_issues, n_denied, insufficient."""
    return first_status((~F.col("ready"), "not_ready"), (~F.col("sent"), "not_sent"), (F.col("model_error").isNotNull(), "model_error"), (~F.col("parsed"), "invalid_response"), (F.col("n_issues") > F.col("n_denied"), "grounding_rejected"), (F.col("n_denied") > 0, "planned_after_rewrite"), (F.col("insufficient"), "declared_insufficient"), otherwise="planned")


def proposal_id(incident: Column, index: Column, canonical: Column) -> Column:
    """An id from a proposal's content."""
    return F.concat(F.lit("REM-"), incident, F.lit("-F"), index.cast("string"), F.lit("-"), F.substring(F.sha2(canonical, 256), 1, 12))
