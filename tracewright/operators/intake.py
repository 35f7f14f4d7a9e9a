"""Intake of model output and plans: strict parsing, referential checks and status classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import redact_credentials
from .rules import first_status

EXTRACTION = "struct<relevant_event_ids:array<string>,direct_event_ids:array<string>,relevant_network_event_ids:array<string>,relevant_docker_paths:array<string>,relevant_pcap_paths:array<string>,summary:string,confidence:double>"
ID_LISTS = ["relevant_event_ids", "direct_event_ids", "relevant_network_event_ids"]
FAILED, REJECTED, INSUFFICIENT = ["llm_error"], ["invalid_response", "grounding_rejected"], ["insufficient_evidence", "no_references", "not_ready"]
PLANNED = "planned"


def parse_extractions(rows: DataFrame, response: str = "response") -> DataFrame:
    """Adds parsed (the record) and problem: invalid_json, missing_key, unknown_key, or confidence outside 0..1."""
    held = F.try_parse_json(F.col(response))
    keys = F.json_object_keys(F.col(response))
    wanted = F.array(*[F.lit(k.split(":")[0].strip()) for k in EXTRACTION[7:-1].replace("array<string>", "list").split(",")])
    parsed = F.from_json(F.col(response), EXTRACTION)
    problem = (
        F.when(held.isNull() | keys.isNull(), "invalid_json")
        .when(F.size(F.array_except(wanted, keys)) > 0, "missing_key")
        .when(F.size(F.array_except(keys, wanted)) > 0, "unknown_key")
        .when(~F.coalesce(parsed["confidence"].between(0, 1), F.lit(False)), "confidence")
    )
    return rows.withColumn("problem", problem).withColumn("parsed", F.when(problem.isNull(), parsed))


def extraction_issues(parsed: DataFrame, events: DataFrame, key: str = "incident_id") -> DataFrame:
    """key, field, event_id, code for ids that the incident's events do not have, or that the network list may not hold."""

    def tagged(field: str) -> Column:
        return F.transform(F.coalesce(F.col(f"parsed.{field}"), F.array().cast("array<string>")), lambda x: F.struct(F.lit(field).alias("field"), x.alias("event_id")))

    each = F.concat(*[tagged(c) for c in ID_LISTS])
    rows = parsed.select(key, F.explode(each).alias("x")).select(key, "x.*").distinct()
    known = events.select(F.col(key).alias("_k"), F.col("event_id").alias("_e"), F.col("event_type").alias("_t"))
    joined = rows.join(known, (F.col(key) == F.col("_k")) & (F.col("event_id") == F.col("_e")), "left")
    code = F.when(F.col("_e").isNull(), "unknown_event").when((F.col("field") == "relevant_network_event_ids") & (F.col("_t") != "http_request"), "not_a_request")
    return joined.select(key, "field", "event_id", code.alias("code")).where("code is not null")


def extraction_scores(parsed: DataFrame, labels: DataFrame, key: str = "incident_id", fields: list[str] | None = None) -> DataFrame:
    """key, field, tp, fp, fn and the ids missed and selected too many, one row for each id list."""
    names = fields or ID_LISTS
    none = F.array().cast("array<string>")
    want = labels.select(F.col(key).alias("_k"), *[F.col(n).alias(f"_{n}") for n in names])
    joined = parsed.join(want, F.col(key) == F.col("_k"))
    each = F.array(*[F.struct(F.lit(n).alias("field"), F.array_distinct(F.coalesce(F.col(f"parsed.{n}"), none)).alias("got"), F.array_distinct(F.coalesce(F.col(f"_{n}"), none)).alias("want")) for n in names])
    rows = joined.select(key, F.explode(each).alias("x")).select(key, "x.*")
    return rows.select(key, "field", F.size(F.array_intersect("got", "want")).alias("tp"), F.size(F.array_except("got", "want")).alias("fp"), F.size(F.array_except("want", "got")).alias("fn"), F.array_sort(F.array_except("want", "got")).alias("missed"), F.array_sort(F.array_except("got", "want")).alias("over_selected"))


def plan_intake() -> Column:
    """Reason why a plan cannot be validated, from status, has_plan, plan_incident, incident_id, plan_finding, finding,
    outcome, proposal_ids and grounding_passed; `usable` if it can."""
    c = F.col
    ids = F.coalesce(c("proposal_ids"), F.array().cast("array<string>"))
    short = c("status").isin(INSUFFICIENT) | ((c("status") == "plan_only") & (c("outcome") == "insufficient_evidence"))
    return first_status(
        (c("status").isNull(), "remediation_plan_missing"),
        (~c("status").isin(*FAILED, *REJECTED, *INSUFFICIENT, PLANNED, "plan_only"), "remediation_plan_malformed"),
        (c("status").isin(*FAILED, *REJECTED) & c("has_plan"), "remediation_plan_malformed"),
        (c("status").isin(FAILED), "remediation_plan_unavailable"),
        (c("status").isin(REJECTED), "remediation_plan_rejected"),
        (~F.coalesce(c("has_plan"), F.lit(False)), "remediation_plan_malformed"),
        (~c("plan_incident").eqNullSafe(c("incident_id")) | c("incident_id").isNull(), "remediation_plan_malformed"),
        (c("finding").isNotNull() & ~c("plan_finding").eqNullSafe(c("finding")), "remediation_plan_malformed"),
        (short & ((F.size(ids) > 0) | ~c("outcome").eqNullSafe(F.lit("insufficient_evidence"))), "remediation_plan_malformed"),
        (short, "remediation_plan_insufficient_context"),
        (~F.coalesce(c("grounding_passed"), F.lit(False)), "remediation_plan_malformed"),
        ((c("outcome") != "proposals") | (F.size(ids) == 0) | (F.size(F.array_distinct(ids)) < F.size(ids)), "remediation_plan_malformed"),
        otherwise="usable",
    )


def report_issues() -> Column:
    """Contradictions inside a validation report, from status, reason_code, oracle_status, n_unmet, sent, tested_state and
    application_state."""
    c = F.col
    done = c("status").isin("objective_achieved", "objective_not_observed")
    checks = [
        (done & ~c("oracle_status").eqNullSafe(c("status")), "status_differs_from_oracle"),
        (done & (c("n_unmet") > 0), "conclusive_with_unmet_precondition"),
        (done & ~F.coalesce(c("sent"), F.lit(False)), "conclusive_without_probe"),
        ((c("status") == "blocked") & (c("n_unmet") == 0), "blocked_without_reason"),
        ((c("status") == "blocked") & F.coalesce(c("sent"), F.lit(False)), "blocked_but_sent"),
        (c("reason_code").isNull(), "reason_missing"),
        ((c("tested_state") == "post_remediation") & ~c("application_state").eqNullSafe(F.lit("independently_attested")), "post_state_without_attestation"),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(x, F.lit(False)), code) for x, code in checks]))


def chosen_plan(plans: DataFrame, key: str = "incident_id") -> DataFrame:
    """Incidents with their single plan; several or none are named, not chosen from."""
    n = plans.groupBy(key).agg(F.count("plan_id").alias("n"), F.min("plan_id").alias("plan_id"))
    return n.select(key, F.when(F.col("n") == 1, F.col("plan_id")).alias("plan_id"), F.when(F.col("n") == 0, "none").when(F.col("n") > 1, "several").otherwise("one").alias("state"))


def procedure_digest(steps: Column) -> Column:
    """SHA-256 of a procedure's steps in order."""
    return F.sha2(F.array_join(steps, "\n"), 256)


def source_drift(pinned: DataFrame, current: DataFrame, key: str = "path") -> DataFrame:
    """Files whose digest is not the pinned one: changed, missing or unexpected."""
    a, b = pinned.select(F.col(key).alias("_p"), F.col("sha256").alias("_a")), current.select(F.col(key).alias("_c"), F.col("sha256").alias("_b"))
    state = F.when(F.col("_c").isNull(), "missing").when(F.col("_p").isNull(), "unexpected").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, F.col("_p") == F.col("_c"), "full").select(F.coalesce("_p", "_c").alias(key), state.alias("state")).where("state is not null")


def scenario_issues() -> Column:
    """What is inconsistent in a scenario definition, from its columns scenario_id, incident_id, source_incident_id, conditions,
    rules (requires_met, requires_not_met, status), required_evidence, false_conclusions, limitations, ambiguities (code, blocking,
    resolved), wire_encoding, control_value, procedure_sha256 and review (status, reviewer, required_approvers, approvals: name,
    approved, confirms, date, scenario_id, procedure_sha256). An approval binds one reviewer to one procedure of one scenario."""
    c = F.col
    empty = lambda a: F.coalesce(F.size(a), F.lit(0)) <= 0
    repeats = lambda a: F.size(F.array_distinct(a)) < F.size(a)
    said = lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""
    given = c("review.approvals")
    bound = lambda a: said(a["date"]) | said(a["scenario_id"]) | said(a["procedure_sha256"])
    whole = lambda a: a["confirms"] & said(a["date"]) & said(a["scenario_id"]) & said(a["procedure_sha256"])
    day = lambda a: a["date"].rlike(r"^\d{4}-\d{2}-\d{2}$") & a["date"].try_cast("date").isNotNull()
    approved = c("review.status") == "approved"
    checks = [
        (empty("conditions") | repeats(c("conditions")), "condition_ids_not_unique"),
        (F.exists("rules", lambda r: F.size(F.array_except(F.concat(r["requires_met"], r["requires_not_met"]), c("conditions"))) > 0), "rule_with_unknown_condition"),
        (F.exists("rules", lambda r: F.arrays_overlap(r["requires_met"], r["requires_not_met"])), "rule_contradicts_itself"),
        (F.exists("rules", lambda r: r["status"].isin("objective_achieved", "objective_not_observed") & (F.size(r["requires_met"]) == 0)), "conclusive_rule_requires_nothing"),
        (empty("required_evidence") | empty("false_conclusions"), "oracle_without_evidence_or_false_conclusions"),
        (F.exists(given, lambda a: a["approved"] & ~F.coalesce(whole(a), F.lit(False))), "approval_not_bound"),
        (F.exists(given, lambda a: a["approved"] & F.coalesce(whole(a), F.lit(False)) & ~day(a)), "approval_date_invalid"),
        (F.exists(given, lambda a: ~a["approved"] & (F.coalesce(a["confirms"], F.lit(False)) | bound(a))), "pending_approval_already_bound"),
        (repeats(F.transform(given, lambda a: a["name"])), "approval_repeated"),
        (~c("source_incident_id").eqNullSafe(c("incident_id")), "source_of_another_incident"),
        (empty("limitations"), "limitations_missing"),
        (repeats(F.transform("ambiguities", lambda a: a["code"])), "ambiguity_codes_not_unique"),
        (approved & ~said(c("review.reviewer")), "approved_without_reviewer"),
        (approved & open_ambiguity(), "approved_with_open_ambiguity"),
        (approved & ((c("wire_encoding") == "unspecified") | ~said(c("control_value"))), "approved_without_fixed_probe"),
        (approved & (F.size(missing_approvals()) > 0), "approved_without_required_approvals"),
        (approved & F.exists(given, lambda a: a["approved"] & ~a["scenario_id"].eqNullSafe(c("scenario_id"))), "approval_of_another_scenario"),
        (approved & F.exists(given, lambda a: a["approved"] & ~a["procedure_sha256"].eqNullSafe(c("procedure_sha256"))), "approval_of_another_procedure"),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(x, F.lit(False)), code) for x, code in checks]))


def missing_approvals() -> Column:
    """Required reviewers of a scenario who have not approved it."""
    granted = F.transform(F.filter("review.approvals", lambda a: a["approved"]), lambda a: a["name"])
    return F.array_except("review.required_approvers", F.coalesce(granted, F.array().cast("array<string>")))


def open_ambiguity() -> Column:
    return F.exists("ambiguities", lambda a: a["blocking"] & ~F.coalesce(a["resolved"], F.lit(False)))


def finding_reports(contexts: DataFrame, answers: DataFrame, plans: DataFrame) -> DataFrame:
    """One row for each finding (incident_id, finding_index): the answer that was generated for it (status, issue_codes,
    response), which planning reuses, whether a plan was asked for (model_called), and of a rejected answer the text without
    credentials. A finding without an answer or plan says so by nulls."""
    key = ["incident_id", "finding_index"]
    a = answers.select(*key, F.col("status").alias("answer_status"), "issue_codes", F.col("response").alias("_response"))
    p = plans.select(*key, F.col("status").alias("plan_status"), "model_called")
    rows = contexts.select(*key).join(a, key, "left").join(p, key, "left")
    rejected = F.col("answer_status").isin("invalid_response", "citations_rejected")
    return rows.select(*key, "answer_status", F.when(F.col("answer_status") != "answered", F.col("issue_codes")).alias("issue_codes"), "plan_status", F.coalesce("model_called", F.lit(False)).alias("planner_called"), F.when(rejected, redact_credentials(F.col("_response"))).alias("rejected_answer"))
