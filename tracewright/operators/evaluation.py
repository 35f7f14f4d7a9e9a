"""Measures of rankings, id sets and binary predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS = (1, 3, 5, 10)


def ranking_measures(run: DataFrame, judged: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """query_id, n_relevant, recall_at_k and reciprocal rank of a run (query_id, doc_id, rank) against judged (query_id,
    doc_id). A query without relevant documents has no measures; one that finds nothing has zeros."""
    good = judged.select("query_id", "doc_id").distinct()
    n = good.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    best = run.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank")).join(good, ["query_id", "doc_id"])
    found = best.groupBy("query_id").agg(F.min("rank").alias("first"), *[F.count_if(F.col("rank") <= k).alias(f"hits_{k}") for k in cuts])
    both = n.join(found, "query_id", "left")
    recall = [(F.coalesce(f"hits_{k}", F.lit(0)) / F.col("n_relevant")).alias(f"recall_at_{k}") for k in cuts]
    return both.select("query_id", "n_relevant", *recall, F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"))


def mean_measures(each: DataFrame, groups: list[str], cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """Means over all queries and by each of the groups, in one pass: kind (the group's column or all), value, n,
    queries with a hit (hit_at_k) and with all that is relevant (full_at_k), means."""
    means = [F.avg(f"recall_at_{k}").alias(f"recall_at_{k}") for k in cuts] + [F.avg("reciprocal_rank").alias("mrr")]
    sums = (each.groupingSets([[], *[[g] for g in groups]], *groups) if groups else each.groupBy()).agg(F.count("*").alias("n"), *[F.count_if(F.col(f"recall_at_{k}") > 0).alias(f"hit_at_{k}") for k in cuts], *[F.count_if(F.col(f"recall_at_{k}") == 1).alias(f"full_at_{k}") for k in cuts], *means, *[F.grouping(g).alias(f"_{g}") for g in groups])
    kind, value = F.lit("all"), F.lit(None).cast("string")
    for g in groups:
        kind, value = F.when(F.col(f"_{g}") == 0, g).otherwise(kind), F.when(F.col(f"_{g}") == 0, F.col(g).cast("string")).otherwise(value)
    return sums.select(kind.alias("kind"), value.alias("value"), *[c for c in sums.columns if c not in groups and not c.startswith("_")])


def paired_changes(a: DataFrame, b: DataFrame, measure: str = "reciprocal_rank") -> DataFrame:
    """change (improved, worsened, unchanged, only_first, only_second), n: two runs compared query by query."""
    x, y = a.select("query_id", F.col(measure).alias("x")), b.select(F.col("query_id").alias("q"), F.col(measure).alias("y"))
    change = F.when(F.col("q").isNull(), "only_first").when(F.col("query_id").isNull(), "only_second").when(F.col("y") > F.col("x"), "improved").when(F.col("y") < F.col("x"), "worsened").otherwise("unchanged")
    return x.join(y, F.col("query_id") == F.col("q"), "full").groupBy(change.alias("change")).agg(F.count("*").alias("n"))


def random_recall(k: Column, n: Column) -> Column:
    """Recall that a random order of n documents has at k."""
    return F.least(k, n) / n


def random_reciprocal_rank(n: int, relevant: int) -> float:
    """Mean reciprocal rank of a random order of n documents of which some are relevant."""
    miss, total = 1.0, 0.0
    for r in range(1, n - relevant + 2):
        hit = relevant / (n - r + 1)
        total += miss * hit / r
        miss *= 1 - hit
    return total


def set_scores(rows: DataFrame, expected: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and the differing ids of two id arrays; an empty side against an empty one is right."""
    e, p = F.array_distinct(expected), F.array_distinct(predicted)
    hit = F.size(F.array_intersect(e, p))
    precision, recall = F.when(F.size(p) > 0, hit / F.size(p)).otherwise(F.when(F.size(e) == 0, 1.0).otherwise(0.0)), F.when(F.size(e) > 0, hit / F.size(e)).otherwise(F.when(F.size(p) == 0, 1.0).otherwise(0.0))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return rows.select("*", hit.alias("n_hit"), F.array_sort(F.array_except(e, p)).alias("missed"), F.array_sort(F.array_except(p, e)).alias("extra"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def binary_scores(rows: DataFrame, truth: Column, said: Column, *by: str) -> DataFrame:
    """Confusion counts and their scores; a score without a denominator is 0."""
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    c = rows.select(*by, truth.alias("_t"), said.alias("_s")).groupBy(*by).agg(F.count_if(F.col("_t") & F.col("_s")).alias("tp"), F.count_if(~F.col("_t") & F.col("_s")).alias("fp"), F.count_if(F.col("_t") & ~F.col("_s")).alias("fn"), F.count_if(~F.col("_t") & ~F.col("_s")).alias("tn"))
    out = c.withColumns({"precision": safe(F.col("tp"), F.col("tp") + F.col("fp")), "recall": safe(F.col("tp"), F.col("tp") + F.col("fn")), "accuracy": safe(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))})
    return out.withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def probability_scores(rows: DataFrame, truth: str, probability: str) -> DataFrame:
    """n, Brier score, mean absolute error and area under the curve (tied scores share their mean rank).

    Scores are counted by value before they are ordered; the running sum is over distinct values of a value's bucket first."""
    t, p = F.col(truth).cast("int"), F.col(probability)
    base = rows.agg(F.count("*").alias("n"), F.avg((p - t) ** 2).alias("brier"), F.avg(F.abs(p - t)).alias("mae"))
    values = rows.groupBy(p.alias("p")).agg(F.sum(t).alias("pos"), F.sum(1 - t).alias("neg"))
    slot = F.greatest(F.least(F.floor(F.col("p") * 1024), F.lit(1023)), F.lit(0))
    inner = F.sum("neg").over(Window.partitionBy("slot").orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    within = values.withColumn("slot", slot).withColumn("below", F.coalesce(inner, F.lit(0)))
    slots = within.groupBy("slot").agg(F.sum("neg").alias("sneg"), F.sum("pos").alias("spos"), F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)).alias("area"))
    before = F.coalesce(F.sum("sneg").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most 1024 rows
    total = slots.withColumn("before", before).agg(F.sum(F.col("area") + F.col("spos") * F.col("before")).alias("area"), F.sum("spos").alias("pos"), F.sum("sneg").alias("neg"))
    auc = F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("area") / (F.col("pos") * F.col("neg")))
    return base.crossJoin(total).select("n", "brier", "mae", auc.alias("auc"))  # one row each


def agreed_labels(labels: DataFrame) -> DataFrame:
    """case_id, doc_id that the author and every reviewer of a case name, with the author's position."""
    people = labels.groupBy("case_id").agg(F.count_distinct("person").alias("n_people"))
    each = labels.groupBy("case_id", "doc_id").agg(F.count_distinct("person").alias("n"), F.min(F.when(F.col("role") == "author", F.col("position"))).alias("position"))
    return each.join(people, "case_id").where("n = n_people and position is not null").select("case_id", "doc_id", "position")


def split_leaks(rows: DataFrame, family: str, split: str = "split") -> DataFrame:
    """Families that lie in more than one split."""
    return rows.groupBy(family).agg(F.array_sort(F.collect_set(split)).alias("splits"), F.count("*").alias("n")).where(F.size("splits") > 1)


def contradicting_labels(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that are labelled both ways."""
    return rows.groupBy(*key).agg(F.count_if("label").alias("n_true"), F.count_if(~F.col("label")).alias("n_false")).where("n_true > 0 and n_false > 0")


def key_mismatch(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, and which."""
    x, y = a.select(F.col(key).alias("x")).distinct(), b.select(F.col(key).alias("y")).distinct()
    return x.join(y, F.col("x") == F.col("y"), "full").where("x is null or y is null").select(F.coalesce("x", "y").alias(key), F.when(F.col("y").isNull(), "only_first").otherwise("only_second").alias("side"))
