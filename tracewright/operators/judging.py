"""What the judge takes as given: gates, provenance, evidence roles, contradictions and rule confirmation of reports, and
whether an attestation binds to its plan, its authorization and the lab's state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import CONCLUSIVE, codes, first_rule

# Why evidence of a role is left out, the current contract, and bounds on ages in seconds.
EXCLUDED = {
    "hypothesis": "hypothesis_is_not_observed_evidence",
    "configuration": "configuration_is_not_observed_evidence",
    "reference": "reference_is_not_observed_evidence",
    "proposal": "proposal_is_not_execution",
    "observed_incident_evidence": "incident_evidence_is_not_a_validation_observation",
    "validation_observation": "observation_not_used_for_this_claim",
    "oracle_condition": "condition_not_used_for_this_claim",
}
CLOCK_SKEW, MOST_AGE = 60, 3600
# End of fixed values


def _yes(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def gate_codes(state: str = "post_remediation") -> Column:
    """Why a report is no live evidence for a tested state, from its columns status, attempted, completed, tested_state,
    application_state, transport_kind, has_identity (the current contract with an identity), live_suitable, authoritative,
    issued (sealed by the runner)."""
    post = state == "post_remediation"
    return codes(
        (~F.coalesce(F.col("status").isin(CONCLUSIVE), F.lit(False)), "status_not_conclusive"),
        (~(_yes("attempted") & _yes("completed")), "check_not_completed"),
        (~F.col("tested_state").eqNullSafe(F.lit(state)), "not_" + state),
        (F.lit(post) & ~F.col("application_state").eqNullSafe(F.lit("independently_attested")), "remediation_not_attested"),
        (~F.col("transport_kind").eqNullSafe(F.lit("live")), "transport_not_live"),
        (~_yes("has_identity"), "legacy_report_without_identity_provenance"),
        (_yes("has_identity") & ~(_yes("live_suitable") & _yes("authoritative")), "identity_not_live_suitable"),
        (~_yes("issued"), "report_not_issued_by_runner"),
    )


def observation_codes() -> Column:
    """Why a report is no observation from before remediation; also from report_kind, n_proposals and post_state_id."""
    before = gate_codes("pre_remediation")
    return F.concat(
        codes((~F.col("report_kind").eqNullSafe(F.lit("pre_remediation_observation")), "not_an_observation_report")),
        before,
        codes(
            ((F.coalesce("n_proposals", F.lit(0)) > 0) | ~F.col("application_state").eqNullSafe(F.lit("not_applicable")), "remediation_claim_present"),
            (F.col("post_state_id").isNotNull(), "post_remediation_state_present"),
            (F.size(gate_codes()) == 0, "post_remediation_gate_passed"),
        ),
    )


def provenance() -> Column:
    """What kind of evidence a report is."""
    live = F.col("transport_kind") == "live"
    return (
        F.when(live & (F.size(gate_codes()) == 0), "live")
        .when(live & (F.size(observation_codes()) == 0), "pre_remediation_observation")
        .when(F.col("transport_kind") == "fake", "mocked")
        .when((F.col("transport_kind") == "none") | ~_yes("attempted"), "dry_run")
        .otherwise("unverified")
    )


def mode_conflict() -> Column:
    """Whether a report's execution is not what its mode allows."""
    mode, kind = F.col("mode"), F.col("transport_kind")
    refused = mode.startswith("live-refused") | mode.startswith("observation-refused") | (mode == "observation-blocked")
    return F.coalesce(
        F.when(mode == "dry-run", _yes("attempted") | ~kind.eqNullSafe(F.lit("none")))
        .when(mode.isin("live", "observation"), ~kind.eqNullSafe(F.lit("live")))
        .when(refused, _yes("attempted")),
        F.lit(False),
    )


def ambiguous_reports(catalog: DataFrame) -> DataFrame:
    """report_id of catalogs (report_id, evidence_id, role) in which an id has several roles or an observation comes twice."""
    each = catalog.groupBy("report_id", "evidence_id").agg(F.count_distinct("role").alias("roles"), F.count_if(F.col("role") == "validation_observation").alias("seen"))
    return each.where("roles > 1 or seen > 1").select("report_id").distinct()


def contradicting_reports(observations: DataFrame) -> DataFrame:
    """report_id where observations (report_id, role, http_status) of one role have several statuses."""
    said = observations.where("role <> '' and http_status is not null").groupBy("report_id", "role").agg(F.count_distinct("http_status").alias("n"))
    return said.where("n > 1").select("report_id").distinct()


def dangling(cited: DataFrame, catalog: DataFrame) -> DataFrame:
    """report_id, n_dangling: cited ids that a report's catalog lacks."""
    lost = cited.select("report_id", "evidence_id").distinct().join(catalog.select("report_id", "evidence_id"), ["report_id", "evidence_id"], "left_anti")
    return lost.groupBy("report_id").agg(F.count("*").cast("int").alias("n_dangling"))


def confirmations(reports: DataFrame, conditions: DataFrame, definitions: DataFrame, rules: DataFrame) -> DataFrame:
    """report_id, confirmation: whether the rules of the registered definition, applied again to a report's condition results
    (report_id, position, condition, result), give its status and reason. definitions: scenario_id, sha256, conditions in
    order. A definition that is unknown, changed or not fully evaluated confirms nothing."""
    ran = conditions.groupBy("report_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "condition"))), lambda x: x["condition"]).alias("ran"),  # of one report's definition
        F.bool_or(F.col("result") == "not_evaluated").alias("open"),
    )
    known = definitions.select(F.col("scenario_id").alias("_s"), F.col("sha256").alias("_h"), F.col("conditions").alias("_c"))
    again = first_rule(conditions, rules, "report_id").select("report_id", F.col("status").alias("_status"), F.col("reason_code").alias("_reason"), "rule_no")
    rows = reports.join(ran, "report_id", "left").join(known, F.col("scenario_id") == F.col("_s"), "left").join(again, "report_id", "left")
    sure = _yes("registered") & F.col("definition_sha256").eqNullSafe(F.col("_h")) & F.col("_h").isNotNull() & (F.col("ran") == F.col("_c")) & ~_yes("open")
    same = F.col("rule_no").isNotNull() & F.col("status").eqNullSafe(F.col("_status")) & F.col("reason_code").eqNullSafe(F.col("_reason"))
    state = F.when(~F.coalesce(sure, F.lit(False)), "definition_unconfirmed").when(~F.coalesce(same, F.lit(False)), "rules_conflict").otherwise("rules_confirmed")
    return rows.select("report_id", state.alias("confirmation"))


def judge_inputs(reports: DataFrame, observations: DataFrame, catalog: DataFrame, cited: DataFrame, confirmed: DataFrame) -> DataFrame:
    """reports with the columns that rules.judge takes: mode_conflict, id_collision, roles_conflict, n_dangling,
    rule_confirmed, provenance."""
    flag = lambda df, name: df.select("report_id", F.lit(True).alias(name))
    rows = reports.join(flag(ambiguous_reports(catalog), "id_collision"), "report_id", "left").join(flag(contradicting_reports(observations), "roles_conflict"), "report_id", "left")
    rows = rows.join(dangling(cited, catalog), "report_id", "left").join(confirmed, "report_id", "left")
    return rows.withColumns({
        "id_collision": _yes("id_collision"),
        "roles_conflict": _yes("roles_conflict"),
        "n_dangling": F.coalesce("n_dangling", F.lit(0)),
        "mode_conflict": mode_conflict(),
        "rule_confirmed": F.col("confirmation").eqNullSafe(F.lit("rules_confirmed")),
        "provenance": provenance(),
    })


def used_as(catalog: DataFrame, used: DataFrame, overrides: DataFrame) -> DataFrame:
    """catalog with used_as and exclusion_reason: used (report_id, evidence_id, side: supporting or contradicting) counts where
    an id is on one side only; oracle conditions are context; the rest is left out for the reason of its role, or the one
    that overrides (report_id, evidence_id, reason) name."""
    sides = used.groupBy(F.col("report_id").alias("_r"), F.col("evidence_id").alias("_e")).agg(F.min("side").alias("side"), F.count_distinct("side").alias("n"))
    own = overrides.select(F.col("report_id").alias("_or"), F.col("evidence_id").alias("_oe"), "reason")
    rows = catalog.join(sides, (F.col("report_id") == F.col("_r")) & (F.col("evidence_id") == F.col("_e")), "left").join(own, (F.col("report_id") == F.col("_or")) & (F.col("evidence_id") == F.col("_oe")), "left")
    as_ = F.when(F.col("n") == 1, F.col("side")).when(F.col("role") == "oracle_condition", "context").otherwise("excluded")
    reasons = F.create_map(*[F.lit(x) for pair in EXCLUDED.items() for x in pair])
    reason = F.when(as_ == "excluded", F.coalesce("reason", F.element_at(reasons, F.col("role"))))
    return rows.select(*catalog.columns, as_.alias("used_as"), reason.alias("exclusion_reason"))


def attestation_claims(now: Column, most_age: int = MOST_AGE) -> Column:
    """Why an attestation (struct `attestation`) does not bind to the incident, scenario, plan (struct: incident_id, sha256,
    proposal_ids) and authorization (struct) that it is about."""
    a, p, o = (lambda c, s=s: F.col(f"{s}.{c}") for s in ("attestation", "plan", "authorization"))
    differ = lambda x, y: ~x.eqNullSafe(y)
    given = F.col("authorization").isNotNull()
    age = F.unix_seconds(now) - F.unix_seconds(a("attested_at"))
    return codes(
        (differ(a("incident_id"), F.col("incident_id")) | differ(a("incident_id"), p("incident_id")), "incident_mismatch"),
        (differ(a("scenario_id"), F.col("scenario_id")), "scenario_mismatch"),
        (differ(a("plan_sha256"), p("sha256")), "plan_binding_mismatch"),
        (F.size(F.array_except(a("applied_ids"), p("proposal_ids"))) > 0, "applied_proposals_not_in_plan"),
        (~given, "authorization_missing"),
        (given & differ(a("authorization_id"), o("authorization_id")), "authorization_id_mismatch"),
        (given & differ(a("attested_by"), o("operator_id")), "attester_not_authorized_operator"),
        (given & differ(a("lab_id"), o("lab_id")), "authorization_lab_mismatch"),
        (given & differ(a("scenario_id"), o("scenario_id")), "authorization_scenario_mismatch"),
        (given & differ(a("incident_id"), o("incident_id")), "authorization_incident_mismatch"),
        (age < -CLOCK_SKEW, "attestation_from_future"),
        (age > most_age, "attestation_stale"),
    )


def attestation_evidence() -> Column:
    """Why the lab's observed identity (struct `identity`) does not show the state that an attestation claims."""
    a, i = (lambda c, s=s: F.col(f"{s}.{c}") for s in ("attestation", "identity"))
    seen = i("observation_id").isNotNull()
    yes = lambda c: F.coalesce(i(c), F.lit(False))
    before = i("lab_state_id").eqNullSafe(a("pre_state_id"))
    return codes(
        (~seen, "lab_identity_missing"),
        (seen & ~yes("fresh"), "lab_identity_stale"),
        (seen & ~yes("independently_verified"), "lab_identity_not_independently_verified"),
        (seen & ~i("lab_id").eqNullSafe(a("lab_id")), "lab_identity_lab_mismatch"),
        (seen & before, "lab_state_is_pre_remediation"),
        (seen & ~before & ~i("lab_state_id").eqNullSafe(a("post_state_id")), "lab_state_mismatch"),
        (seen & (i("observed_at") < a("attested_at")), "lab_observation_predates_attestation"),
    )


def attestations(rows: DataFrame, now: Column, most_age: int = MOST_AGE) -> DataFrame:
    """rows (incident_id, scenario_id, attestation, plan, authorization, identity) with claim_codes, evidence_codes, ready, and
    the plan's proposals as applied and not applied where the claim holds."""
    none = F.array().cast("array<string>")
    missing = F.when(F.col("attestation").isNull(), "attestation_missing").when(~F.coalesce("plan.usable", F.lit(False)), "plan_unusable")
    claim = F.when(missing.isNotNull(), F.array(missing)).otherwise(attestation_claims(now, most_age))
    evidence = F.when(missing.isNotNull(), none).otherwise(attestation_evidence())
    out = rows.withColumn("claim_codes", claim).withColumn("evidence_codes", evidence)
    holds = F.size("claim_codes") == 0
    return out.withColumns({
        "ready": holds & (F.size("evidence_codes") == 0),
        "applied": F.when(holds, F.col("attestation.applied_ids")).otherwise(none),
        "not_applied": F.when(holds, F.array_except("plan.proposal_ids", "attestation.applied_ids")).otherwise(none),
    })


def pipeline_view(judgements: DataFrame) -> DataFrame:
    """Judgements as the pipeline's decisions; confidence 0 says that no score was computed."""
    view = {"confidence": F.lit(0.0), "live_evidence": F.col("provenance").eqNullSafe(F.lit("live"))}
    return judgements.withColumns(view)


#: Fixed value: a plain origin, host and port, without credentials, path, query or escapes.
ORIGIN = r"^http://([^\s/?#@:\\%\x00-\x1f\x7f]+):([0-9]{1,5})/?$"
MOST_TARGET = 2048


def scope_decisions(requests: DataFrame, labs: DataFrame, enabled: bool) -> DataFrame:
    """requests with origin, lab_id, codes, conditions_met and permitted: every reason why a request is outside its scope.

    requests: target_url, incident_id, expected_state_id, forbidden (verifiers), live (the identity must be fit for live
    work), now; scenario (struct: scenario_id, eligible), identity (struct: independent, verifier, lab_id, network,
    containers, compose_sha256, lab_state_id, issued: array of begin, end, live_suitable) and authorization (struct: live,
    lab_id, scenario_id, incident_id), each null where there is none. labs: lab_id, host, port, scenarios, network,
    containers, compose_sha256; the lab of a request is the one at its origin. An identity counts only by the records that
    were issued for it."""
    c = F.col
    yes = lambda x: F.coalesce(x, F.lit(False))
    good = (F.length("target_url") <= MOST_TARGET) & c("target_url").rlike(ORIGIN) & (F.regexp_extract("target_url", ORIGIN, 2).try_cast("int") <= 65535)
    rows = requests.withColumns({"_host": F.when(good, F.lower(F.regexp_extract("target_url", ORIGIN, 1))), "_port": F.when(good, F.regexp_extract("target_url", ORIGIN, 2).try_cast("int"))})
    one = labs.groupBy("host", "port").agg(F.min_by(F.struct("lab_id", "scenarios", "network", "containers", "compose_sha256"), "lab_id").alias("_lab"))
    some = labs.limit(1).agg((F.count("*") > 0).alias("_any"))  # one row
    rows = rows.join(one, (c("_host") == c("host")) & (c("_port") == c("port")), "left").drop("host", "port").join(F.broadcast(some))
    lab, who, auth, plan = c("_lab"), c("identity"), c("authorization"), c("scenario")
    has = lambda x: x.isNotNull()
    issued = F.coalesce(who["issued"], F.array().cast(requests.schema["identity"].dataType["issued"].dataType))
    covers = F.filter(issued, lambda r: c("now").between(r["begin"], r["end"]))
    first = F.array_min(F.transform(issued, lambda r: r["begin"]))
    assessed = yes(who["independent"]) & (F.size(issued) > 0)
    suitable = F.exists(F.when(F.size(covers) > 0, covers).otherwise(issued), lambda r: yes(r["live_suitable"]))
    match = (who["lab_id"] == lab["lab_id"]) & (who["network"] == lab["network"]) & (F.array_sort(who["containers"]) == F.array_sort(lab["containers"])) & (lab["compose_sha256"].isNull() | who["compose_sha256"].eqNullSafe(lab["compose_sha256"]))
    expected = has(c("expected_state_id")) & has(who)
    bound = has(lab) & has(plan) & has(c("incident_id")) & auth["lab_id"].eqNullSafe(lab["lab_id"]) & auth["scenario_id"].eqNullSafe(plan["scenario_id"]) & auth["incident_id"].eqNullSafe(c("incident_id"))
    found = codes(
        (~c("_any"), "no_approved_lab"),
        (c("target_url").isNull(), "target_missing"),
        (has(c("target_url")) & c("_host").isNull(), "target_malformed"),
        (has(c("_host")) & ~has(lab) & c("_any"), "target_not_approved"),
        (~has(plan), "scenario_missing"),
        (has(plan) & ~yes(plan["eligible"]), "scenario_not_eligible"),
        (has(plan) & has(lab) & ~yes(F.array_contains(lab["scenarios"], plan["scenario_id"])), "scenario_not_approved_for_lab"),
        (~has(who), "lab_identity_missing"),
        (has(who) & ~yes(who["independent"]), "lab_identity_not_independent"),
        (yes(who["independent"]) & (F.size(issued) == 0), "lab_identity_not_assessed"),
        (assessed & c("now").isNull() & yes(c("live")), "lab_identity_freshness_unchecked"),
        (assessed & has(c("now")) & (F.size(covers) == 0) & (c("now") < first), "lab_identity_from_future"),
        (assessed & has(c("now")) & (F.size(covers) == 0) & (c("now") >= first), "lab_identity_stale"),
        (assessed & yes(c("live")) & ~yes(suitable), "lab_identity_not_live_suitable"),
        (has(who) & yes(F.array_contains(c("forbidden"), who["verifier"])), "lab_identity_verifier_conflict"),
        (has(who) & ~yes(match), "lab_identity_mismatch"),
        (expected & who["lab_state_id"].isNull(), "lab_state_unverified"),
        (expected & (who["lab_state_id"] != c("expected_state_id")), "lab_state_mismatch"),
        (~has(auth), "operator_authorization_missing"),
        (has(auth) & ~yes(auth["live"]), "operator_authorization_not_live"),
        (has(auth) & ~yes(bound), "operator_authorization_mismatch"),
        (F.lit(not enabled), "execution_disabled"),
    )
    rows = rows.withColumns({"origin": F.when(has(c("_host")), F.concat(F.lit("http://"), "_host", F.lit(":"), c("_port").cast("string"))), "lab_id": lab["lab_id"], "codes": found})
    met = F.size(F.array_except("codes", F.array(F.lit("execution_disabled")))) == 0
    return rows.withColumns({"conditions_met": met, "permitted": F.size("codes") == 0}).drop("_host", "_port", "_lab", "_any")
