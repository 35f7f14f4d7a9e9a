"""Risk features, scaling, a logistic baseline, posterior summaries and exact attributions."""

from __future__ import annotations

from itertools import combinations
from math import factorial

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BANDS = ((0.33, "low"), (0.67, "medium"))
NODE_TYPES = ["container", "service", "ip", "port", "process", "user"]
EDGE_TYPES = ["hosts", "executes", "connects_to", "depends_on", "forwards", "accesses", "communicates_with", "authenticates_to"]


def require_known(rows: DataFrame, *features: str) -> DataFrame:
    """The same rows; running them fails where a feature is unknown: null is not zero."""
    missing = F.array_compact(F.array(*[F.when(F.col(f).isNull(), f) for f in features]))
    first = F.col(features[0])
    checked = F.when(F.size(missing) > 0, F.raise_error(F.concat(F.lit("unknown risk features: "), F.array_join(missing, ", ")))).otherwise(first)
    return rows.withColumn(features[0], checked)


def feature_provenance(rows: DataFrame, key: str, features: list[str]) -> DataFrame:
    """key, feature, value, known in long form."""
    each = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return rows.select(key, F.explode(each).alias("x")).select(key, "x.feature", "x.value", F.col("x.value").isNotNull().alias("known"))


def risk_band(score: Column) -> Column:
    out = F.lit("high")
    for most, name in reversed(BANDS):
        out = F.when(score < most, name).otherwise(out)
    return F.when(score.isNotNull(), out)


def posterior_summary(draws: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, population deviation, 5 % and 95 % quantiles (interpolated) and band of the draws of each key."""
    p = draws.groupBy(key).agg(F.count(value).alias("n_draws"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.percentile(value, F.array(F.lit(0.05), F.lit(0.95))).alias("q"))
    return p.select(key, "n_draws", "mean", "std", F.get("q", F.lit(0)).alias("q05"), F.get("q", F.lit(1)).alias("q95"), risk_band(F.col("mean")).alias("band"))


def one_hot(value: Column, names: list[str]) -> list[Column]:
    return [F.coalesce((value == n).cast("double"), F.lit(0.0)) for n in names]


def edge_features(edges: DataFrame, vectors: DataFrame, degree: DataFrame, n_nodes: int) -> DataFrame:
    """Feature array of each edge: both ends' vectors, their absolute difference, type, basis and the ends' degrees over the
    number of nodes."""
    for side, name in (("source", "a"), ("target", "b")):
        edges = edges.join(vectors.select(F.col("node_id").alias(side), F.col("features").alias(f"f{name}")), side)
        edges = edges.join(degree.select(F.col("node").alias(side), F.col("n_in").alias(f"i{name}"), F.col("n_out").alias(f"o{name}")), side, "left")
    share = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.lit(float(max(n_nodes, 1)))
    rest = F.array(*one_hot(F.col("edge_type"), EDGE_TYPES), *one_hot(F.col("basis"), ["observed", "configured"]), *[share(c) for c in ("ia", "oa", "ib", "ob")])
    return edges.withColumn("x", F.concat("fa", "fb", F.zip_with("fa", "fb", lambda a, b: F.abs(a - b)), rest)).drop("fa", "fb", "ia", "oa", "ib", "ob")


def standardize(rows: DataFrame, train: Column, features: list[str]) -> DataFrame:
    """Features scaled by mean and population deviation of the training rows only; a constant one is only shifted."""
    stats = rows.where(train).agg(*[f(c).alias(f"{n}_{c}") for c in features for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))])
    joined = rows.crossJoin(F.broadcast(stats))  # one row
    out = {c: (F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0) for c in features}
    return joined.withColumns(out).drop(*stats.columns)


def logistic_baseline(train: DataFrame, features: list[str], label: str, c: float = 0.1):
    """A fitted logistic regression with L2 penalty 1 / (c n)."""
    n = max(train.count(), 1)
    rows = VectorAssembler(inputCols=features, outputCol="_x").transform(train.withColumn("_y", F.col(label).cast("double")))
    return LogisticRegression(featuresCol="_x", labelCol="_y", regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=200).fit(rows)


def linear_shapley(rows: DataFrame, weights: dict[str, float], base: dict[str, float]) -> DataFrame:
    """Shapley values of a linear score in closed form, for any number of features: phi_<feature> is the weight times the
    distance from the base. They add up to the score minus the base's."""
    return rows.withColumns({f"phi_{f}": F.lit(float(w)) * (F.col(f) - F.lit(float(base[f]))) for f, w in weights.items()})


def shapley(rows: DataFrame, features: list[str], base: dict[str, float], score) -> DataFrame:
    """Exact Shapley values of score(columns) for up to ten features: each coalition's score is a column expression, with the
    others at their base. Adds phi_<feature>; they add up to score minus base score."""
    if len(features) > 10:
        raise ValueError("exact values are for ten features at most")
    names = list(features)
    value = {s: score({f: F.col(f) if f in s else F.lit(float(base[f])) for f in names}) for k in range(len(names) + 1) for s in map(frozenset, combinations(names, k))}
    rows = rows.withColumns({f"_v{i}": v for i, v in enumerate(value.values())})
    at = {s: F.col(f"_v{i}") for i, s in enumerate(value)}
    n, out = len(names), {}
    for f in names:
        total = F.lit(0.0)
        for s in at:
            if f not in s:
                weight = factorial(len(s)) * factorial(n - len(s) - 1) / factorial(n)
                total = total + F.lit(weight) * (at[s | {f}] - at[s])
        out[f"phi_{f}"] = total
    return rows.withColumns(out).drop(*[f"_v{i}" for i in range(len(value))])


def strongest(rows: DataFrame, key: str, features: list[str], top: int = 5) -> DataFrame:
    """The features of largest absolute contribution of each row, in order."""
    listed = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"phi_{f}").alias("phi")) for f in features])
    return rows.select(key, F.slice(F.array_sort(listed, lambda a, b: F.when(F.abs(a["phi"]) > F.abs(b["phi"]), -1).when(F.abs(a["phi"]) < F.abs(b["phi"]), 1).otherwise(F.when(a["feature"] < b["feature"], -1).otherwise(1))), 1, top).alias("top"))


def output_issue(value: Column, meaning: str) -> Column:
    """Why a model's output breaks its contract, or null: it must be finite, and a risk_probability lies within 0 and 1."""
    odd = value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    outside = (value < 0) | (value > 1)
    return F.when(odd, "not_finite").when(outside & F.lit(meaning == "risk_probability"), "out_of_range")
