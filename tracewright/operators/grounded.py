"""Checks of model output against what it was shown: answers, remediation plans and narratives, as rows of issues.

Everything is long: texts, citations, tokens, identifiers and facts are rows that meet the context's rows in joins, so a
run checks all incidents at once. An issue is (incident_id, location, code, detail). A context is given by

- catalog (incident_id, id, kind): what there is to cite: evidence, reference, hypothesis, configuration, and what may not
  be cited: excluded references, conflicting configuration;
- named (incident_id, id, identifier): weakness identifiers that a reference states; under a null id those of hypotheses;
- facts (incident_id, id, kind, value): methods, statuses and paths of the requests behind evidence;
- confirmed (incident_id): incidents with a confirmed finding."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import claims, text
from ..sources.scratch import written

# Keys and allowed values of answers and plans, and the names of issues that screens give.
ANSWER_KEYS = ["schema_version", "incident_id", "observed_evidence", "hypotheses", "reference_guidance", "reference_relevance", "evidence_gaps", "limitations"]
SECTIONS = {"observed_evidence": ["statement", "evidence_ids"], "hypotheses": ["hypothesis_id", "statement", "status", "evidence_ids", "reference_ids"], "reference_guidance": ["statement", "reference_ids"], "reference_relevance": ["reference_id", "assessment"]}
FREE_SECTIONS = ["evidence_gaps", "limitations"]
VERSION = "1.0"
HYPOTHESIS_STATUSES = ["hypothesis_only", "insufficient_evidence"]
ASSESSMENTS = ["relevant", "not_relevant", "unclear"]
MOST_STATEMENT, MOST_ITEMS, MOST_PROPOSALS = 2000, 12, 8
CONFIG_TOKEN = r"\bCFG-[0-9]+\b"
ANSWER_SCREENS = {"impact": "high_impact_claim", "stated": "confirmation_claim"}
PLAN_SCREENS = {"compromise": "unsupported_compromise_claim", "confirmation": "confirmation_claim", "success": "remediation_success_claim"}
CONFIRMATIONS = ["stated", "confirmation"]
STATES_OUTCOME = ["sql_execution", "query_executed", "database_access", "data_exfiltration", "privilege_escalation", "admin_granted", "compromise_confirmed", "successful_exploit"]
# End of fixed values

PLAN = """
    schema_version string, incident_id string, outcome string, insufficient_reason string,
    proposals array<struct<title:string, description:string, problem_addressed:string, affected_area:struct<state:string, description:string>,
        observed_evidence_ids:array<string>, hypothesis_ids:array<string>, configuration_fact_ids:array<string>, reference_ids:array<string>,
        rationale:string, reference_support_limits:string, severity:struct<level:string, rationale:string>, expected_security_effect:string,
        operational_side_effects:array<string>, implementation_steps:array<struct<text:string, origin:string>>, configuration_dependent:boolean,
        disruption:string, reversibility:string, preconditions:array<string>, dependencies:array<string>, unresolved_questions:array<string>,
        validation:struct<procedure:string, expected_result:string>, confidence:struct<level:string, rationale:string>>>,
    unresolved_questions array<string>, limitations array<string>
"""


@dataclass
class Context:
    """What model output may refer to; see the module."""

    catalog: DataFrame
    named: DataFrame
    facts: DataFrame
    confirmed: DataFrame


def issue(rows: DataFrame, test: Column, code: str, location: str | Column = "location", detail: Column | None = None) -> DataFrame:
    at = F.lit(location) if isinstance(location, str) and location not in rows.columns else F.col(location) if isinstance(location, str) else location
    return rows.where(F.coalesce(test, F.lit(False))).select("incident_id", at.alias("location"), F.lit(code).alias("code"), (F.lit(None).cast("string") if detail is None else detail.cast("string")).alias("detail"))


def together(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def _kinds(context: Context) -> DataFrame:
    """incident, id and all kinds that it is known as; there are six."""
    return context.catalog.groupBy(F.col("incident_id").alias("_i"), F.col("id").alias("_id")).agg(F.collect_set("kind").alias("kinds"))


def _met(rows: DataFrame, context: Context, column: str) -> DataFrame:
    known = _kinds(context)
    return rows.join(known, (F.col("incident_id") == F.col("_i")) & (F.col(column) == F.col("_id")), "left").drop("_i", "_id").withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>")))


def citations(cited: DataFrame, context: Context, barred: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Citations (incident_id, item, location, id, expected: a kind) as issues, and those that hold (incident_id, item, id,
    expected). barred (incident_id, id) are references that the output itself found not relevant."""
    rows = _met(cited.distinct(), context, "id")
    has = lambda k: F.array_contains("kinds", k)
    fine = F.array_contains(F.col("kinds"), F.col("expected"))
    if barred is not None:
        own = barred.select(F.col("incident_id").alias("_b"), F.col("id").alias("_bid")).distinct()
        rows = rows.join(own, (F.col("incident_id") == F.col("_b")) & (F.col("id") == F.col("_bid")), "left")
        no = F.col("_bid").isNotNull() & (F.col("expected") == "reference")
    else:
        no = F.lit(False)
    code = (
        F.when(fine & no, "not_relevant_reference_cited")
        .when(fine, None)
        .when(has("excluded") & (F.col("expected") == "reference"), "excluded_reference_cited")
        .when(has("conflicting") & (F.col("expected") == "configuration"), "conflicting_configuration_cited")
        .when(F.size(F.array_remove("kinds", "conflicting")) > 0, "category_mixing")
        .otherwise(F.concat(F.lit("unknown_"), F.col("expected"), F.lit("_id")))
    )
    rows = written(rows.withColumn("code", code), "cited")
    return rows.where("code is not null").select("incident_id", "location", "code", F.col("id").alias("detail")), rows.where("code is null").select("incident_id", "item", "id", "expected")


def prose(texts: DataFrame, valid: DataFrame, context: Context, screens: dict[str, str], tokens: dict[str, str]) -> DataFrame:
    """Issues of texts (incident_id, item, location, said, free: it may speak of all that is known, factual: its requests
    count), with the citations that hold."""
    of_kind = lambda k: lambda t: F.struct(F.lit(k).alias("expected"), t.alias("id"))
    found = F.concat(*[F.transform(F.array_distinct(F.regexp_extract_all("said", F.lit(p), 0)), of_kind(k)) for k, p in tokens.items()])
    mention = _met(texts.select("incident_id", "item", "location", "free", F.explode(found).alias("t")).select("*", "t.expected", "t.id").drop("t"), context, "id")
    own = valid.select(F.col("incident_id").alias("_vi"), F.col("item").alias("_vt"), F.col("id").alias("_vid"), F.col("expected").alias("_ve")).distinct()
    mention = mention.join(own, (F.col("incident_id") == F.col("_vi")) & (F.col("item") == F.col("_vt")) & (F.col("id") == F.col("_vid")) & (F.col("expected") == F.col("_ve")), "left")
    has = lambda k: F.array_contains("kinds", k)
    code = (
        F.when((F.col("expected") == "reference") & has("excluded"), "excluded_reference_cited")
        .when((F.col("expected") == "configuration") & has("conflicting"), "conflicting_configuration_cited")
        .when(~F.array_contains(F.col("kinds"), F.col("expected")), F.concat(F.lit("unknown_"), F.col("expected"), F.lit("_id")))
        .when(~F.col("free") & F.col("_vid").isNull(), "prose_citation_mismatch")
    )
    tokens_ = mention.select("incident_id", "location", code.alias("code"), F.col("id").alias("detail")).where("code is not null")

    stated = texts.select("incident_id", "item", "location", "free", F.explode(text.identifiers(F.col("said"))).alias("identifier"))
    by_all = context.named.select(F.col("incident_id").alias("_n"), F.upper("identifier").alias("_ni"), F.col("id").isNull().alias("_h")).groupBy("_n", "_ni").agg(F.bool_or("_h").alias("_h"))
    by_item = valid.where("expected = 'reference'").join(context.named, ["incident_id", "id"]).select(F.col("incident_id").alias("_c"), F.col("item").alias("_ci"), F.upper("identifier").alias("_cn")).distinct()
    checked = stated.join(by_all, (F.col("incident_id") == F.col("_n")) & (F.col("identifier") == F.col("_ni")), "left").join(by_item, (F.col("incident_id") == F.col("_c")) & (F.col("item") == F.col("_ci")) & (F.col("identifier") == F.col("_cn")), "left")
    allowed = F.coalesce("_h", F.lit(False)) | F.col("_cn").isNotNull() | (F.col("free") & F.col("_ni").isNotNull())
    identifiers = issue(checked, ~allowed, "unsupported_identifier", detail=F.col("identifier"))

    key = texts.select(F.to_json(F.struct("incident_id", "location")).alias("key"), "said")
    said = claims.screen_claims(key, "key", "said", tuple(screens))
    at = F.from_json("key", "incident_id string, location string")
    said = said.select(at["incident_id"].alias("incident_id"), at["location"].alias("location"), "screen", F.col("words").alias("detail"))
    sure = context.confirmed.select("incident_id").distinct()
    said = said.where(~F.col("screen").isin(CONFIRMATIONS)).unionByName(said.where(F.col("screen").isin(CONFIRMATIONS)).join(sure, "incident_id", "left_anti"))
    names = F.create_map(*[F.lit(x) for pair in screens.items() for x in pair])
    claimed = said.select("incident_id", "location", F.element_at(names, F.col("screen")).alias("code"), "detail")

    return together(tokens_, identifiers, claimed, fact_issues(texts.where("factual"), valid, context))


def fact_issues(texts: DataFrame, valid: DataFrame, context: Context) -> DataFrame:
    """Methods, statuses and paths that a text states and no request behind its evidence has."""
    methods, statuses, _ = claims.stated_facts(F.col("said"))
    of_kind = lambda k: lambda v: F.struct(F.lit(k).alias("kind"), v.alias("value"))
    each = F.concat(*[F.transform(found, of_kind(k)) for k, found in (("method", methods), ("status", statuses), ("path", text.paths_in(F.col("said"))))])
    stated = texts.select("incident_id", "item", "location", F.explode(each).alias("f")).select("incident_id", "item", "location", "f.kind", "f.value")
    own = valid.where("expected = 'evidence'").join(context.facts, ["incident_id", "id"]).select("incident_id", "item", "kind", F.when(F.col("kind") == "method", F.upper("value")).otherwise(F.col("value")).alias("value")).distinct()
    missing = stated.join(own, ["incident_id", "item", "kind", "value"], "left_anti")
    return missing.select("incident_id", "location", F.lit("http_fact_mismatch").alias("code"), F.concat_ws(":", "kind", "value").alias("detail"))


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _keys(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Objects that are none, lack keys or have others."""
    v = F.col(value)
    own = F.map_keys(_get(v, "$", "map<string,variant>"))
    want = F.array(*[F.lit(k) for k in keys])
    listed = rows.where(_is(v, "OBJECT")).select("incident_id", "location", F.explode(F.concat(F.transform(F.array_except(want, own), lambda k: F.struct(F.lit("missing_key").alias("code"), k.alias("detail"))), F.transform(F.array_except(own, want), lambda k: F.struct(F.lit("unknown_key").alias("code"), k.alias("detail"))))).alias("x"))
    return issue(rows, ~_is(v, "OBJECT"), "invalid_structure").unionByName(listed.select("incident_id", "location", "x.code", "x.detail"))


def _whole(value: str, keys: list[str]) -> Column:
    own = F.coalesce(F.map_keys(_get(F.col(value), "$", "map<string,variant>")), F.array().cast("array<string>"))
    return F.size(F.array_except(F.array(*[F.lit(k) for k in keys]), own)) == 0


def _names(v: Column, path: str) -> Column:
    """An array of strings that say something; null where it is none."""
    each = _get(v, path, "array<variant>")
    return F.when(F.forall(each, lambda x: _is(x, "STRING") & (F.trim(F.coalesce(_get(x, "$", "string"), F.lit(""))) != "")), _get(v, path, "array<string>"))


ITEMS = "array<struct<section:string,k:int,location:string,json:string>>"


def _numbered_in(section: str):
    return lambda v, k: F.struct(F.lit(section).alias("section"), k.alias("k"), F.concat(F.lit(section + "["), k.cast("string"), F.lit("]")).alias("location"), F.to_json(v).alias("json"))


def answer_checks(answers: DataFrame, context: Context) -> DataFrame:
    """Every issue of answers (incident_id, response: JSON text)."""
    parsed = answers.select("incident_id", F.try_parse_json(F.trim("response")).alias("body"), F.lit("answer").alias("location"))
    bad = issue(parsed, ~_is(F.col("body"), "OBJECT"), "invalid_answer")
    rows = parsed.where(_is(F.col("body"), "OBJECT"))
    body = F.col("body")
    out = [bad, _keys(rows, "body", ANSWER_KEYS)]
    out.append(issue(rows, ~_get(body, "$.schema_version", "string").eqNullSafe(F.lit(VERSION)), "invalid_value", "schema_version"))
    out.append(issue(rows, ~_get(body, "$.incident_id", "string").eqNullSafe(F.col("incident_id")), "wrong_incident", F.lit("incident_id")))

    names = [*SECTIONS, *FREE_SECTIONS]
    listed = {n: _get(body, f"$.{n}", "array<variant>") for n in names}
    out += [issue(rows, listed[n].isNull(), "invalid_structure", n) for n in names]
    each = F.concat(*[F.coalesce(F.transform(listed[n], _numbered_in(n)), F.array().cast(ITEMS)) for n in names])
    # taken apart once; every rule reads its section
    every = written(rows.select("incident_id", F.explode(each).alias("x")).select("incident_id", "x.*"), "items")
    items = {n: every.where(F.col("section") == n).withColumn("v", F.parse_json("json")) for n in names}
    for section, keys in SECTIONS.items():
        out.append(_keys(items[section], "v", keys))
        items[section] = items[section].where(_whole("v", keys))
    known = lambda kind: context.catalog.where(F.col("kind") == kind).select("incident_id", "id").distinct()
    asked = rows.select("incident_id").distinct()

    # each passage is assessed once, by a known value
    v = F.col("v")
    judged = items["reference_relevance"].select("incident_id", "location", "k", _get(v, "$.reference_id", "string").alias("id"), _get(v, "$.assessment", "string").alias("said"))
    valued = F.coalesce(F.col("said").isin(ASSESSMENTS), F.lit(False))
    out.append(issue(judged, ~valued, "invalid_value"))
    good = judged.where(valued)
    strange = good.join(known("reference"), ["incident_id", "id"], "left_anti")
    out.append(issue(strange, F.lit(True), "unknown_reference_id", detail=F.col("id")))
    good = good.join(known("reference"), ["incident_id", "id"], "left_semi")
    first = good.groupBy("incident_id", "id").agg(F.min_by("said", "k").alias("said"), F.min("k").alias("first"))
    again = good.join(first.select("incident_id", "id", "first"), ["incident_id", "id"])
    out.append(issue(again, F.col("k") > F.col("first"), "duplicate_assessment", detail=F.col("id")))
    silent = known("reference").join(asked, "incident_id", "left_semi").join(first, ["incident_id", "id"], "left_anti")
    out.append(issue(silent, F.lit(True), "missing_assessment", "reference_relevance", F.col("id")))
    barred = first.where("said = 'not_relevant'").select("incident_id", "id")

    # statements, citations
    texts, cited = [], []
    none = F.array().cast("array<string>")
    for section, fields in {"observed_evidence": ["evidence"], "hypotheses": ["evidence", "reference"], "reference_guidance": ["reference"]}.items():
        own = items[section].withColumn("said", F.when(_is(_get(v, "$.statement", "variant"), "STRING"), _get(v, "$.statement", "string")))
        out.append(issue(own, F.trim(F.coalesce("said", F.lit(""))) == "", "invalid_structure"))
        out.append(issue(own, F.length("said") > MOST_STATEMENT, "statement_too_long"))
        texts.append(own.where(F.length("said") <= MOST_STATEMENT).select("incident_id", F.col("location").alias("item"), "location", "said", F.lit(False).alias("free"), F.lit(section != "reference_guidance").alias("factual")))
        for kind in fields:
            ids = _names(v, f"$.{kind}_ids")
            out.append(issue(own, ids.isNull(), "invalid_structure", F.concat("location", F.lit(f".{kind}_ids"))))
            cited.append(own.select("incident_id", F.col("location").alias("item"), F.concat("location", F.lit(f".{kind}_ids")).alias("location"), F.explode(F.coalesce(ids, none)).alias("id"), F.lit(kind).alias("expected")))
            if section != "hypotheses":
                out.append(issue(own, F.size(F.coalesce(ids, none)) == 0, "missing_citation"))
    for section in FREE_SECTIONS:
        own = items[section].withColumn("said", F.when(_is(v, "STRING"), _get(v, "$", "string")))
        out.append(issue(own, F.trim(F.coalesce("said", F.lit(""))) == "", "invalid_structure"))
        out.append(issue(own, F.length("said") > MOST_STATEMENT, "statement_too_long"))
        texts.append(own.where(F.length("said") <= MOST_STATEMENT).select("incident_id", F.col("location").alias("item"), "location", "said", F.lit(True).alias("free"), F.lit(False).alias("factual")))
    wrong, valid = citations(reduce(lambda a, b: a.unionByName(b), cited), context, barred)
    out.append(wrong)

    # hypotheses are addressed once each, with a status that their evidence carries
    held = items["hypotheses"].select("incident_id", "location", "k", _get(v, "$.hypothesis_id", "string").alias("id"), _get(v, "$.status", "string").alias("status"))
    unknown = held.join(known("hypothesis"), ["incident_id", "id"], "left_anti")
    out.append(issue(unknown, F.lit(True), "unknown_hypothesis_id", detail=F.col("id")))
    real = held.join(known("hypothesis"), ["incident_id", "id"], "left_semi")
    firsts = real.groupBy("incident_id", "id").agg(F.min("k").alias("first"))
    out.append(issue(real.join(firsts, ["incident_id", "id"]), F.col("k") > F.col("first"), "duplicate_hypothesis", detail=F.col("id")))
    open_ = known("hypothesis").join(asked, "incident_id", "left_semi").join(firsts, ["incident_id", "id"], "left_anti")
    out.append(issue(open_, F.lit(True), "missing_hypothesis", "hypotheses", F.col("id")))
    out.append(issue(held, ~F.coalesce(F.col("status").isin(HYPOTHESIS_STATUSES), F.lit(False)), "invalid_value"))
    carried = valid.where("expected = 'evidence'").select("incident_id", F.col("item").alias("location")).distinct()
    out.append(issue(held.where("status = 'hypothesis_only'").join(carried, ["incident_id", "location"], "left_anti"), F.lit(True), "missing_citation"))
    empty = items["reference_guidance"].select("incident_id").distinct().join(known("reference"), "incident_id", "left_anti")
    out.append(issue(empty, F.lit(True), "no_reference_material", "reference_guidance"))

    said = reduce(lambda a, b: a.unionByName(b), texts).where(F.trim("said") != "")
    out.append(prose(said, valid, context, ANSWER_SCREENS, {"evidence": claims.EVIDENCE_TOKEN, "reference": claims.REFERENCE_TOKEN}))
    return together(*out)


def plan_checks(plans: DataFrame, context: Context, shown: DataFrame, configuration: DataFrame) -> DataFrame:
    """Every issue of plans (incident_id, plan: a struct as PLAN, null where the response was none) against shown (incident_id,
    corpus: all that the model saw) and configuration (incident_id, status)."""
    rows = plans.select("incident_id", "plan", F.lit("plan").alias("location"))
    out = [issue(rows, F.col("plan").isNull(), "invalid_plan")]
    rows = rows.where("plan is not null")
    p = lambda c: F.col(f"plan.{c}")
    n = F.size(F.coalesce(p("proposals"), F.array().cast(rows.schema["plan"].dataType["proposals"].dataType)))
    out.append(issue(rows, ~p("incident_id").eqNullSafe(F.col("incident_id")), "wrong_incident", F.lit("incident_id")))
    out.append(issue(rows, (p("outcome") == "proposals") & (n == 0), "no_proposals", "proposals"))
    out.append(issue(rows, (p("outcome") != "proposals") & (n > 0), "insufficient_with_proposals", "proposals"))
    out.append(issue(rows, (p("outcome") != "proposals") & (F.trim(F.coalesce(p("insufficient_reason"), F.lit(""))) == ""), "missing_reason", "insufficient_reason"))
    out.append(issue(rows, n > MOST_PROPOSALS, "too_many_items", "proposals"))
    for c in ("unresolved_questions", "limitations"):
        out.append(issue(rows, F.size(p(c)) > MOST_ITEMS, "too_many_items", c))

    each = rows.select("incident_id", F.posexplode(p("proposals")).alias("k", "p")).select("incident_id", "k", F.concat(F.lit("proposals["), F.col("k").cast("string"), F.lit("]")).alias("item"), "p")
    q = lambda c: F.col(f"p.{c}")
    at = lambda c: F.concat("item", F.lit("." + c))
    fields = {"observed_evidence_ids": "evidence", "hypothesis_ids": "hypothesis", "configuration_fact_ids": "configuration", "reference_ids": "reference"}
    cited = reduce(lambda a, b: a.unionByName(b), [each.select("incident_id", "item", at(c).alias("location"), F.explode(q(c)).alias("id"), F.lit(k).alias("expected")) for c, k in fields.items()])
    wrong, valid = citations(cited, context)
    out.append(wrong)
    for c in fields:
        out.append(issue(each, F.size(q(c)) > MOST_ITEMS, "too_many_items", at(c)))
        out.append(issue(each, F.size(F.array_distinct(q(c))) < F.size(q(c)), "duplicate_citation", at(c)))
    sure = context.catalog.where("kind = 'confirmed_hypothesis'").select("incident_id", "id")
    held = valid.groupBy("incident_id", "item").agg(*[F.bool_or(F.col("expected") == k).alias("has_" + k) for k in fields.values()])
    proven = valid.where("expected = 'hypothesis'").join(sure, ["incident_id", "id"], "left_semi").select("incident_id", "item", F.lit(True).alias("proven")).distinct()
    each = each.join(held, ["incident_id", "item"], "left").join(proven, ["incident_id", "item"], "left").join(configuration.select("incident_id", F.col("status").alias("config")), "incident_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    blank = lambda c: F.coalesce(F.size(q(c)), F.lit(0)) <= 0
    no_config = ~F.col("config").eqNullSafe(F.lit("available"))
    stepped = F.exists(q("implementation_steps"), lambda s: s["origin"] == "cited_reference")
    rules = [
        (blank("reference_ids"), "missing_citation", "reference_ids"),
        (yes("has_evidence") & ~yes("has_hypothesis"), "missing_hypothesis_link", "hypothesis_ids"),
        ((q("affected_area.state") == "identified") & ~yes("has_evidence") & ~yes("has_configuration"), "unsupported_affected_area", "affected_area"),
        (blank("operational_side_effects"), "missing_side_effects", "operational_side_effects"),
        (blank("implementation_steps"), "missing_steps", "implementation_steps"),
        (F.size(q("implementation_steps")) > MOST_ITEMS, "too_many_items", "implementation_steps"),
        (no_config & ~F.coalesce(q("configuration_dependent"), F.lit(False)), "configuration_dependency_missing", "configuration_dependent"),
        (no_config & blank("unresolved_questions"), "missing_unresolved_question", "unresolved_questions"),
        (((q("disruption") != "low") | (q("reversibility") != "reversible")) & blank("preconditions"), "missing_precondition", "preconditions"),
        ((q("confidence.level") == "high") & ~(~no_config & yes("proven")), "confidence_exceeds_support", "confidence.level"),
        ((q("confidence.level") == "medium") & ~F.coalesce(stepped, F.lit(False)), "confidence_exceeds_support", "confidence.level"),
    ]
    out += [issue(each, test, code, at(c)) for test, code, c in rules]

    # a proposal repeats an earlier one by its whole content or by its title
    same = each.select("incident_id", "k", "item", F.explode(F.array(F.to_json("p"), F.concat(F.lit("title:"), F.lower(F.trim(q("title")))))).alias("mark"))
    first = same.groupBy("incident_id", "mark").agg(F.min("k").alias("first"))
    out.append(issue(same.join(first, ["incident_id", "mark"]), F.col("k") > F.col("first"), "duplicate_proposal", F.col("item")))

    single = ["title", "description", "problem_addressed", "affected_area.description", "rationale", "reference_support_limits", "severity.rationale", "expected_security_effect", "validation.procedure", "validation.expected_result", "confidence.rationale"]
    part = lambda c, t: F.struct(c.alias("where"), t.alias("said"))
    lists = ["operational_side_effects", "preconditions", "dependencies", "unresolved_questions"]
    numbered = lambda name, of, dot=".": F.transform(of, lambda t, i: part(F.concat(F.lit(f"{dot}{name}["), i.cast("string"), F.lit("]")), t))
    kind = "array<struct<where:string,said:string>>"
    empty = F.array().cast(kind)
    said = F.concat(F.array(*[part(F.lit("." + c), q(c)) for c in single]), *[F.coalesce(numbered(c, q(c)), empty) for c in lists], F.coalesce(F.transform(q("implementation_steps"), lambda s, i: part(F.concat(F.lit(".implementation_steps["), i.cast("string"), F.lit("].text")), s["text"])), empty))
    texts = each.select("incident_id", "item", F.explode(said).alias("t")).select("incident_id", "item", F.concat("item", "t.where").alias("location"), "t.said", F.lit(False).alias("free"))
    plain = F.concat(F.array(part(F.lit("insufficient_reason"), p("insufficient_reason"))), *[F.coalesce(numbered(c, p(c), ""), empty) for c in ("unresolved_questions", "limitations")])
    whole = rows.select("incident_id", F.explode(plain).alias("t")).select("incident_id", F.lit("plan").alias("item"), F.col("t.where").alias("location"), "t.said", F.lit(True).alias("free"))
    texts = texts.unionByName(whole).where(F.trim("said") != "").withColumn("factual", F.lit(False))
    out.append(prose(texts, valid, context, PLAN_SCREENS, {"evidence": claims.EVIDENCE_TOKEN, "reference": claims.REFERENCE_TOKEN, "configuration": CONFIG_TOKEN}))
    made_up = texts.join(shown.select("incident_id", "corpus"), "incident_id", "left").select("incident_id", "location", F.explode(text.ungrounded_literals(F.col("said"), F.coalesce("corpus", F.lit("")))).alias("detail"))
    out.append(made_up.select("incident_id", "location", F.lit("ungrounded_literal").alias("code"), "detail"))
    return together(*out)


def parsed_plan(response: Column) -> Column:
    """A plan from a response that is a JSON object of this version and outcome; null otherwise."""
    plan = F.from_json(response, PLAN)
    return F.when(F.get_json_object(response, "$.schema_version").eqNullSafe(F.lit(VERSION)) & plan["outcome"].isin("proposals", "insufficient_evidence"), plan)


def narrative_checks(statements: DataFrame, roots: DataFrame, context: Context, correlations: DataFrame, actions: DataFrame) -> DataFrame:
    """Issues of narratives: statements (incident_id, location, said, event_ids, correlation_id) and roots (incident_id, status).

    A statement that cites an unknown event has that issue only. Its requests' facts must be those of events that it
    cites, and an outcome may be asserted only where an event itself states one (actions: incident_id, id, said). Status
    and path of any request are no support. Root causes are not for a narrative to confirm."""
    cited = statements.select("incident_id", F.col("location").alias("item"), "location", F.explode("event_ids").alias("id"), F.lit("evidence").alias("expected"))
    rows = _met(cited.distinct(), context, "id")
    lost = rows.where(~F.array_contains("kinds", "evidence"))
    unknown = issue(lost, F.lit(True), "unknown_event_id", detail=F.col("id"))
    links = statements.where("correlation_id is not null").join(correlations.select("incident_id", "correlation_id"), ["incident_id", "correlation_id"], "left_anti")
    fine = statements.where(F.trim(F.coalesce("said", F.lit(""))) != "").join(lost.select("incident_id", "location"), ["incident_id", "location"], "left_anti")
    texts = fine.select("incident_id", F.col("location").alias("item"), "location", "said")
    valid = rows.where(F.array_contains("kinds", "evidence")).select("incident_id", "item", "id", "expected")
    key = texts.select(F.to_json(F.struct("incident_id", "location")).alias("key"), "said")
    at = F.from_json("key", "incident_id string, location string")
    said = claims.screen_claims(key, "key", "said", ("impact",)).select(at["incident_id"].alias("incident_id"), at["location"].alias("item"), F.col("words").alias("detail"))
    states = F.lower("said").rlike("|".join(STATES_OUTCOME))
    carried = valid.join(actions.where(states).select("incident_id", "id"), ["incident_id", "id"], "left_semi").select("incident_id", "item").distinct()
    bold = said.join(carried, ["incident_id", "item"], "left_anti").select("incident_id", F.col("item").alias("location"), F.lit("high_impact_claim").alias("code"), "detail")
    return together(
        unknown,
        issue(links, F.lit(True), "unknown_correlation_id", detail=F.col("correlation_id")),
        fact_issues(texts, valid, context),
        bold,
        issue(roots, F.lower("status").isin("confirmed", "confirmed_root_cause"), "root_cause_confirmed", F.lit("root_cause_assessment")),
    )
