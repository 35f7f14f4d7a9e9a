"""Grounded context, citations, configuration facts and ranking of proposals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import numbered

#: Places of levels when proposals are ranked.
SEVERITY = ["high", "medium", "low", "unknown"]
DISRUPTION = ["low", "medium", "high", "unknown"]
REVERSIBILITY = ["reversible", "partially_reversible", "unknown", "irreversible"]


def observed_items(cited: DataFrame, line: DataFrame, claims: DataFrame) -> DataFrame:
    """evidence_id, statement, origin for cited ids (finding_id, evidence_id): from the timeline, with the claim where one
    cites it; unresolved where neither knows it."""
    known = line.select(F.col("event_id").alias("_e"), F.col("action").alias("_action"))
    said = claims.select(F.explode("evidence_ids").alias("_c"), "statement").groupBy("_c").agg(F.min("statement").alias("_said"))
    both = cited.join(known, F.col("evidence_id") == F.col("_e"), "left").join(said, F.col("evidence_id") == F.col("_c"), "left")
    origin = F.when(F.col("_said").isNotNull(), "claim").when(F.col("_e").isNotNull(), "timeline").otherwise("unresolved")
    return both.select(*cited.columns, F.coalesce("_said", "_action").alias("statement"), origin.alias("origin"))


def context_passages(ranked: DataFrame, chunks: DataFrame, documents: int = 5, per_document: int = 2) -> DataFrame:
    """Passages of the best documents with text as it is stored; differs marks a hit whose text is not the stored one."""
    top = ranked.where(F.col("rank") <= documents)
    own = chunks.select(F.col("doc_id").alias("_d"), F.col("ordinal").alias("_o"), F.col("text").alias("stored"))
    joined = top.join(own, (F.col("doc_id") == F.col("_d")) & (F.col("ordinal") == F.col("_o"))).drop("_d", "_o")
    w = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("chunk_score"), "ordinal")
    n = F.count("*").over(Window.partitionBy("query_id", "doc_id"))
    return joined.withColumn("place", F.row_number().over(w)).withColumn("omitted", F.greatest(n - per_document, F.lit(0))).where(F.col("place") <= per_document).withColumn("differs", F.col("text") != F.col("stored"))


def citation_issues(cited: DataFrame, catalog: DataFrame) -> DataFrame:
    """Citations (location, id, expected) that the catalog (id, kind) does not know, or knows as another kind."""
    kinds = catalog.groupBy(F.col("id").alias("_id")).agg(F.collect_set("kind").alias("_kinds"))
    code = F.when(F.col("_kinds").isNull(), "unknown_id").when(~F.array_contains("_kinds", F.col("expected")), "wrong_category")
    return cited.join(kinds, F.col("id") == F.col("_id"), "left").select("location", "id", "expected", code.alias("code")).where("code is not null")


def ambiguous_ids(catalog: DataFrame) -> DataFrame:
    """Ids that are listed twice or in several roles."""
    return catalog.groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("kind").alias("n_kinds")).where("n > 1")


def merge_facts(facts: DataFrame) -> DataFrame:
    """One row for each (subject, attribute, value): flags or-ed and evidence counted; fact_evidence lists it."""
    key = ["subject", "attribute", "value"]
    merged = facts.groupBy(*key).agg(F.bool_or("single_valued").alias("single_valued"))
    n = fact_evidence(facts).groupBy(*[F.col(k).alias("_" + k) for k in key]).agg(F.count("*").alias("n_evidence"))
    same = [F.col(k).eqNullSafe(F.col("_" + k)) for k in key]
    return merged.join(n, reduce(lambda a, b: a & b, same), "left").select(*key, "single_valued", F.coalesce("n_evidence", F.lit(0).cast("long")).alias("n_evidence"))


def fact_evidence(facts: DataFrame) -> DataFrame:
    """subject, attribute, value, evidence_id: what each fact rests on, once."""
    return facts.select("subject", "attribute", "value", F.explode("evidence_ids").alias("evidence_id")).distinct()


def numbered_facts(facts: DataFrame, prefix: str = "CFG-") -> DataFrame:
    """Merged facts with their fact_id: prefix and place in the order of subject, attribute and value."""
    out = numbered(facts, "_n", "subject", "attribute", "value")
    return out.withColumn("fact_id", F.concat(F.lit(prefix), F.col("_n").cast("string"))).drop("_n")


def fact_conflicts(facts: DataFrame) -> DataFrame:
    """Single-valued (subject, attribute) with several values."""
    sums = facts.groupBy("subject", "attribute").agg(F.bool_or("single_valued").alias("single"), F.array_sort(F.collect_set("value")).alias("values"))
    return sums.where(F.col("single") & (F.size("values") > 1)).select("subject", "attribute", "values")


def usable_facts(facts: DataFrame) -> DataFrame:
    """Facts without the conflicting ones: those are withheld, all of them."""
    return facts.join(fact_conflicts(facts).select("subject", "attribute"), ["subject", "attribute"], "left_anti")


def place_in(levels: list[str], level: Column) -> Column:
    """Place of a level in a list from 0; what the list lacks is unknown."""
    at = F.array_position(F.array(*[F.lit(x) for x in levels]), F.coalesce(level, F.lit("unknown")))
    return (F.when(at > 0, at).otherwise(levels.index("unknown") + 1) - 1).cast("int")


def rank_proposals(drafts: DataFrame, *by: str) -> DataFrame:
    """Proposals by evidence linkage, severity, disruption, reversibility and original place, within by."""
    linked = F.when(F.size("observed_evidence_ids") > 0, 0).otherwise(1)
    order = [linked, place_in(SEVERITY, F.col("severity")), place_in(DISRUPTION, F.col("disruption")), place_in(REVERSIBILITY, F.col("reversibility")), F.col("index")]
    basis = F.when(linked == 0, "incident_linked").otherwise("general_hardening")
    return drafts.withColumn("evidence_linkage", basis).withColumn("priority_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def usable_references(references: DataFrame, labels: DataFrame) -> DataFrame:
    """References with their relevance: unassessed where no label says; usable only if relevant."""
    own = labels.select(F.col("reference_id").alias("_r"), F.col("assessment").alias("_a"))
    joined = references.join(own, F.col("reference_id") == F.col("_r"), "left")
    return joined.withColumn("assessment", F.coalesce("_a", F.lit("unassessed"))).drop("_r", "_a").withColumn("usable", F.col("assessment") == "relevant")


def gaps(n_evidence: Column, n_references: Column, n_assessed: Column, n_relevant: Column) -> Column:
    """Why a finding cannot be answered for, in order; empty if it can."""
    return F.array_compact(F.array(F.when(n_evidence == 0, "no_observed_evidence"), F.when(n_references == 0, "no_references"), F.when((n_references > 0) & (n_assessed == 0), "references_not_assessed"), F.when((n_assessed > 0) & (n_relevant == 0), "no_relevant_references")))


def bounded(rows: DataFrame, limits: dict[str, int], section: str, priority: Column, *order: str | Column, by: tuple[str, ...] = ()) -> DataFrame:
    """The first rows of each section of a payload, those of priority before others, with the number left out."""
    most = F.element_at(F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]), F.col(section))
    w = Window.partitionBy(*by, section)
    out = rows.withColumn("place", F.row_number().over(w.orderBy(F.when(priority, 0).otherwise(1), *order))).withColumn("left_out", F.greatest(F.count("*").over(w) - most, F.lit(0)))
    return out.where(F.col("place") <= most)


def answer_issues(answers: DataFrame, catalog: DataFrame) -> DataFrame:
    """Issues of answers (answer_id, section, position, statement, evidence_ids, reference_ids, http facts of their citations)
    as rows: answer_id, location, code."""
    where = F.concat(F.col("section"), F.lit("["), F.col("position").cast("string"), F.lit("]"))
    rows = answers.withColumn("location", where)
    cited = rows.select("answer_id", "location", F.explode(F.concat(F.transform("evidence_ids", lambda x: F.struct(x.alias("id"), F.lit("observed").alias("expected"))), F.transform("reference_ids", lambda x: F.struct(x.alias("id"), F.lit("reference").alias("expected"))))).alias("c")).select("answer_id", "location", "c.id", "c.expected")
    kinds = catalog.groupBy(F.col("id").alias("_id")).agg(F.collect_set("kind").alias("_kinds"))
    code = F.when(F.col("_kinds").isNull(), "unknown_id").when(~F.array_contains("_kinds", F.col("expected")), "wrong_category")
    known = cited.join(kinds, F.col("id") == F.col("_id"), "left").select("answer_id", "location", code.alias("code")).where("code is not null")
    uncited = rows.where((F.size("evidence_ids") == 0) & (F.size("reference_ids") == 0)).select("answer_id", "location", F.lit("uncited_statement").alias("code"))
    long = rows.where(F.length("statement") > 2000).select("answer_id", "location", F.lit("statement_too_long").alias("code"))
    empty = rows.where(F.trim(F.coalesce("statement", F.lit(""))) == "").select("answer_id", "location", F.lit("empty_statement").alias("code"))
    return reduce(lambda a, b: a.unionByName(b), [known, uncited, long, empty])
