"""Issues of answers, plans and narratives, case by case."""

import json

import pytest

from tracewright.operators import grounded

EVENT, REF = "nginx-1", "cwe:CWE-89#0001"


@pytest.fixture(scope="module")
def context(spark):
    rows = lambda data, schema: spark.createDataFrame(data, schema)
    every = lambda data: [(f"i{n}", *r) for n in range(12) for r in data]
    catalog = [("i", EVENT, "evidence"), ("i", "nginx-2", "evidence"), ("i", REF, "reference"), ("i", "cwe:CWE-79#0001", "reference"), ("i", "H1", "hypothesis"), ("i", "CFG-1", "configuration"), ("i", "CFG-2", "conflicting"), ("i", "cwe:CWE-20#0001", "excluded")]
    catalog = every([r[1:] for r in catalog]) + [("c", "H1", "hypothesis"), ("c", "H1", "confirmed_hypothesis")]
    return grounded.Context(
        rows(catalog, "incident_id string, id string, kind string"),
        rows(every([(REF, "CWE-89"), ("cwe:CWE-79#0001", "cwe-79"), (None, "CAPEC-66")]), "incident_id string, id string, identifier string"),
        rows(every([(EVENT, "method", "get"), (EVENT, "status", "200"), (EVENT, "path", "/api/search"), ("nginx-2", "path", "/other")]), "incident_id string, id string, kind string, value string"),
        rows([("c",)], "incident_id string"),
    )


def answer(**changes):
    base = {
        "schema_version": "1.0", "incident_id": "i",
        "observed_evidence": [{"statement": "A GET to /api/search gave HTTP 200 (nginx-1).", "evidence_ids": [EVENT]}],
        "hypotheses": [{"hypothesis_id": "H1", "statement": "CAPEC-66 or CWE-89 may apply; no evidence of successful exploitation.", "status": "hypothesis_only", "evidence_ids": [EVENT], "reference_ids": [REF]}],
        "reference_guidance": [{"statement": "CWE-89 is about injection.", "reference_ids": [REF]}],
        "reference_relevance": [{"reference_id": REF, "assessment": "relevant"}, {"reference_id": "cwe:CWE-79#0001", "assessment": "not_relevant"}],
        "evidence_gaps": ["Database logs; CWE-79 is general."], "limitations": ["Few events."],
    }
    return base | changes


def grouped(issues):
    out = {}
    for r in issues.collect():
        out.setdefault(r["incident_id"], set()).add((r["location"], r["code"]))
    return out


def test_answers(spark, context):
    observed = [
        {"statement": "A POST to /etc gave status 500.", "evidence_ids": [EVENT]},
        {"statement": "nginx-2 and nginx-9 show CWE-22; data was exfiltrated; the attack is confirmed.", "evidence_ids": [EVENT]},
        {"statement": "x" * 2001, "evidence_ids": [REF]}, {"statement": "ok", "evidence_ids": []}, {"statement": " ", "evidence_ids": "no"}, 3,
    ]
    held = [{"hypothesis_id": "H1", "statement": "a", "status": "sure", "evidence_ids": [], "reference_ids": ["cwe:CWE-79#0001"]}, {"hypothesis_id": "H1", "statement": "b", "status": "hypothesis_only", "evidence_ids": ["gone"], "reference_ids": []}, {"hypothesis_id": "H9", "statement": "b", "status": "insufficient_evidence", "evidence_ids": [], "reference_ids": []}]
    seen = [{"reference_id": REF, "assessment": "relevant"}, {"reference_id": REF, "assessment": "unclear"}, {"reference_id": "z", "assessment": "relevant"}, {"reference_id": REF, "assessment": "yes"}]
    o, h, r = "observed_evidence", "hypotheses", "reference_relevance"
    cases = [
        (answer(), set()),
        (answer(incident_id="x", schema_version="2", extra=1), {("answer", "unknown_key"), ("incident_id", "wrong_incident"), ("schema_version", "invalid_value")}),
        (answer(observed_evidence=observed), {(o + "[0]", "http_fact_mismatch"), (o + "[1]", "prose_citation_mismatch"), (o + "[1]", "unknown_evidence_id"), (o + "[1]", "unsupported_identifier"), (o + "[1]", "high_impact_claim"), (o + "[1]", "confirmation_claim"), (o + "[2]", "statement_too_long"), (o + "[2].evidence_ids", "category_mixing"), (o + "[3]", "missing_citation"), (o + "[4]", "invalid_structure"), (o + "[4].evidence_ids", "invalid_structure"), (o + "[4]", "missing_citation"), (o + "[5]", "invalid_structure")}),
        (answer(hypotheses=held), {(h + "[0]", "invalid_value"), (h + "[0].reference_ids", "not_relevant_reference_cited"), (h + "[1]", "duplicate_hypothesis"), (h + "[1].evidence_ids", "unknown_evidence_id"), (h + "[1]", "missing_citation"), (h + "[2]", "unknown_hypothesis_id")}),
        (answer(hypotheses=[]), {(h, "missing_hypothesis")}),
        (answer(reference_relevance=seen), {(r + "[1]", "duplicate_assessment"), (r + "[2]", "unknown_reference_id"), (r + "[3]", "invalid_value"), (r, "missing_assessment")}),
        ("no json", {("answer", "invalid_answer")}), ("[1]", {("answer", "invalid_answer")}), (None, {("answer", "invalid_answer")}),
    ]
    text = lambda n, x: x if x is None or isinstance(x, str) else json.dumps(x | {"incident_id": f"i{n}" if x["incident_id"] == "i" else "x"})
    rows = spark.createDataFrame([(f"i{n}", text(n, x)) for n, (x, _) in enumerate(cases)], "incident_id string, response string")
    assert grouped(grounded.answer_checks(rows, context)) == {f"i{n}": w for n, (_, w) in enumerate(cases) if w}


def proposal(**changes):
    base = {
        "title": "Bind parameters", "description": "Use bound parameters.", "problem_addressed": "Injection (CAPEC-66)", "affected_area": {"state": "identified", "description": "the search"},
        "observed_evidence_ids": [EVENT], "hypothesis_ids": ["H1"], "configuration_fact_ids": ["CFG-1"], "reference_ids": [REF], "rationale": "CWE-89", "reference_support_limits": "general",
        "severity": {"level": "high", "rationale": "r"}, "expected_security_effect": "less risk", "operational_side_effects": ["none known"], "implementation_steps": [{"text": "Change `the query`", "origin": "cited_reference"}],
        "configuration_dependent": True, "disruption": "low", "reversibility": "reversible", "preconditions": [], "dependencies": [], "unresolved_questions": ["which driver"], "validation": {"procedure": "p", "expected_result": "e"}, "confidence": {"level": "medium", "rationale": "r"},
    }
    return base | changes


def plan(*proposals, **changes):
    return {"schema_version": "1.0", "incident_id": "i", "outcome": "proposals", "insufficient_reason": "", "proposals": list(proposals), "unresolved_questions": [], "limitations": []} | changes


def test_plans(spark, context):
    at = "proposals[0]."
    bad = proposal(observed_evidence_ids=[EVENT, EVENT, REF], hypothesis_ids=[], configuration_fact_ids=["CFG-2", "CFG-9"], reference_ids=["cwe:CWE-20#0001"], operational_side_effects=[], implementation_steps=[], configuration_dependent=False, disruption="high", unresolved_questions=[], confidence={"level": "high", "rationale": "r"})
    said = proposal(description="This will prevent all attacks; run `rm -rf /x`, see CFG-2.", rationale="The database was breached and the attack is confirmed.")
    cases = [
        (plan(proposal()), set()),
        (plan(schema_version="9"), {("plan", "invalid_plan")}),
        (plan(incident_id="x"), {("incident_id", "wrong_incident"), ("proposals", "no_proposals")}),
        (plan(proposal(), outcome="insufficient_evidence"), {("insufficient_reason", "missing_reason"), ("proposals", "insufficient_with_proposals")}),
        (plan(proposal(), proposal(title="bind PARAMETERS ", description="other")), {("proposals[1]", "duplicate_proposal")}),
        (plan(bad), {(at + "observed_evidence_ids", "duplicate_citation"), (at + "observed_evidence_ids", "category_mixing"), (at + "hypothesis_ids", "missing_hypothesis_link"), (at + "configuration_fact_ids", "conflicting_configuration_cited"), (at + "configuration_fact_ids", "unknown_configuration_id"), (at + "reference_ids", "excluded_reference_cited"), (at + "operational_side_effects", "missing_side_effects"), (at + "implementation_steps", "missing_steps"), (at + "configuration_dependent", "configuration_dependency_missing"), (at + "unresolved_questions", "missing_unresolved_question"), (at + "preconditions", "missing_precondition"), (at + "confidence.level", "confidence_exceeds_support"), (at + "rationale", "unsupported_identifier")}),
        (plan(said), {(at + "description", "remediation_success_claim"), (at + "description", "ungrounded_literal"), (at + "description", "conflicting_configuration_cited"), (at + "rationale", "unsupported_compromise_claim"), (at + "rationale", "confirmation_claim")}),
        (plan(proposal(confidence={"level": "medium", "rationale": "r"}, implementation_steps=[{"text": "t", "origin": "own"}])), {(at + "confidence.level", "confidence_exceeds_support")}),
        (plan(proposal(), limitations=["CWE-79 too, nginx-2"] * 13), {("limitations", "too_many_items")}),
    ]
    rows = spark.createDataFrame([(f"i{n}", json.dumps(x | {"incident_id": f"i{n}" if x["incident_id"] == "i" else "x"})) for n, (x, _) in enumerate(cases)], "incident_id string, response string")
    rows = rows.select("incident_id", grounded.parsed_plan(rows["response"]).alias("plan"))
    shown = spark.createDataFrame([(f"i{n}", "the query and /api") for n in range(12)], "incident_id string, corpus string")
    configuration = spark.createDataFrame([(f"i{n}", "unavailable") for n in range(12)], "incident_id string, status string")
    assert grouped(grounded.plan_checks(rows, context, shown, configuration)) == {f"i{n}": w for n, (_, w) in enumerate(cases) if w}


def test_narratives(spark, context):
    rows = [("i0", "a", "A GET to /api/search, status 200", [EVENT], None), ("i0", "b", "A PUT to /other", ["nginx-2"], "k1"), ("i0", "c", "Data was exfiltrated by GET", ["nginx-9"], "k9"), ("i0", "d", "Data was exfiltrated.", [EVENT], None), ("i0", "e", "Data was exfiltrated.", ["nginx-2"], None)]
    said = spark.createDataFrame(rows, "incident_id string, location string, said string, event_ids array<string>, correlation_id string")
    roots = spark.createDataFrame([("i0", "Confirmed"), ("j", "hypothesis")], "incident_id string, status string")
    links = spark.createDataFrame([("i0", "k1")], "incident_id string, correlation_id string")
    acts = spark.createDataFrame([("i0", "nginx-2", "DATA_EXFILTRATION seen"), ("i0", EVENT, "GET")], "incident_id string, id string, said string")
    got = sorted((r["location"], r["code"]) for r in grounded.narrative_checks(said, roots, context, links, acts).collect())
    assert got == sorted([("b", "http_fact_mismatch"), ("c", "unknown_event_id"), ("c", "unknown_correlation_id"), ("d", "high_impact_claim"), ("root_cause_assessment", "root_cause_confirmed")])
