"""Mixing sources to target weights by hash thresholds.

Every document has a fixed 60-bit hash. Words are summed by source and by the hash's leading bits; the bucket in which
a source's budget runs out is the only one that is summed again by the next bits, until the budget's end is one hash
value. A source then takes all documents up to that value: nested budgets give nested selections, and no document is
sorted or moved for it.

Defined cases: a null text has size 0; a null source is a source, last in order; documents that share a doc_id share
its hash and are taken together; a source without words has target 0; an empty table gives no rows; extra columns
never clash. A hash value at the end of a budget is taken if that comes nearer to the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize
from .components import numbered

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BITS, LEVELS = 12, 5


def doc_hash(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), doc_hash(F.col("doc_id")).alias("h"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target: weights repeat over sources in code-point order; what exceeds a source's most is
    shared again by weight until none exceeds it."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = numbered(sums, "k", F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    ranked = materialize(ranked.select("source", "source_size", weight.alias("w"), (F.col("source_size") * F.lit(most)).alias("top")), "sources")
    total, weighed = ranked.agg(F.sum("source_size"), F.sum("w")).first()
    if not weighed:
        return ranked.select("source", "source_size", F.lit(0.0).alias("target"))
    budget, rate, before = share * total, share * total / weighed, -1
    while True:  # the rate only rises, so sources only join those at their most
        full = F.col("top") <= F.lit(rate) * F.col("w")
        n, given, left = ranked.agg(F.count_if(full), F.sum(F.when(full, F.col("top"))), F.sum(F.when(~full, F.col("w")))).first()
        if n == before or not left:
            break
        rate, before = (budget - (given or 0.0)) / left, n
    return ranked.select("source", "source_size", F.least("top", F.lit(rate) * F.col("w")).alias("target"))


def thresholds(sized: DataFrame, aims: DataFrame) -> DataFrame:
    """source, source_size, target, times (whole takes of every document), cut (hashes up to it are taken once more)."""
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = aims.withColumn("times", times).withColumn("rest", F.col("target") - F.col("times") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long"))
    state = materialize(state, "budgets")
    for level in range(1, LEVELS + 1):
        own = state.select(F.col("source").alias("s"), "rest", "prefix")
        shift = BITS * (LEVELS - level)
        inside = sized.join(own, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift + BITS) == F.col("prefix")))
        sums = inside.groupBy("s", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"), F.first("rest").alias("rest"))
        upto = F.sum("n").over(Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))  # at most 2^BITS rows a source
        edge = sums.withColumn("upto", upto).where(F.col("upto") > F.col("rest")).groupBy("s").agg(F.min_by(F.struct("bucket", "n", "upto"), "bucket").alias("e"))
        joined = state.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        rest = F.when(F.col("e").isNotNull(), F.col("rest") - (F.col("e.upto") - F.col("e.n"))).otherwise(F.col("rest"))
        # where nothing lies beyond the budget, a prefix no hash has, so that the search ends
        state = joined.select("source", "source_size", "target", "times", rest.alias("rest"), F.coalesce("e.bucket", F.lit(-1)).cast("long").alias("prefix"), F.col("e.n").alias("last"))
        state = materialize(state, "budgets")
    nearer = F.col("rest") * 2 >= F.col("last")
    cut = F.when(F.col("prefix") < 0, F.when(F.col("rest") > 0, F.lit((1 << 60) - 1)).otherwise(F.lit(-1))).when(nearer, F.col("prefix")).otherwise(F.col("prefix") - 1)
    return materialize(state.select("source", "source_size", "target", "times", cut.cast("long").alias("cut")), "cuts")


def plan_mix(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """The documents' sizes and hashes, and the thresholds of their sources; texts are read once."""
    sized = materialize(sizes(docs), "sizes")
    return sized, thresholds(sized, targets(sized, **options))


def _taken(h: Column) -> Column:
    return F.col("times") + (h <= F.col("cut")).cast("long")


def mix(docs: DataFrame, **options) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, taken."""
    sized, cuts = plan_mix(docs, **options)
    own = cuts.withColumnRenamed("source", "s")
    joined = sized.join(own, F.col("source").eqNullSafe(F.col("s")))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * _taken(F.col("h"))).alias("taken"))


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them: rows dropped, kept or repeated, with all their columns."""
    _, cuts = plan_mix(docs, **options)
    own = cuts.select(F.col("source").alias("_s"), F.col("times").alias("times"), F.col("cut").alias("cut"))
    names = docs.columns
    rows = docs.select(F.struct(*names).alias("_row"), F.col("source").cast("string").alias("_source"), doc_hash(F.col("doc_id")).alias("_h"))
    joined = rows.join(own, F.col("_source").eqNullSafe(F.col("_s"))).withColumn("_n", _taken(F.col("_h")).cast("int"))
    return joined.where("_n > 0").select("_row", F.explode(F.sequence(F.lit(1), "_n"))).select("_row.*")
