"""Evaluation of ranked candidate paths against verified ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

from .graph import adjusted_score, distances, path_coverage, ways_to


def depth_first_paths(edges: DataFrame, ends: DataFrame, max_hops: int = 8, limit: int = 100) -> DataFrame:
    """The first `limit` simple paths of each (source, target) of ends as a depth-first search meets them: source, target,
    nodes, positions of their edges, place.

    edges are (source, target, position in the file). Depth first is the order of the arrays of positions, and the order of
    two open paths is that of all that becomes of them. So the limit acts hop by hop: an open path is sure to arrive if no
    node before its last one is as near to the target as that, for a shortest way on meets none of them; once `limit` paths
    that arrived or surely will come before a path, it goes. Paths from whose end the target is too far go at once."""
    steps = written(edges.select(F.col("source").alias("s"), F.col("target").alias("t"), F.col("position").cast("long").alias("p")), "steps")
    ahead = distances(steps, ends.select(F.col("target").alias("t")), max_hops)
    ways = ways_to(steps, ahead)
    empty = F.array().cast("array<bigint>")
    start = ends.select("source", "target", F.array("source").alias("nodes"), empty.alias("positions"), F.col("source").alias("at"), F.lit(None).cast("int").alias("nearest"))
    found = start.where("source = target").select("source", "target", "nodes", "positions")
    open_ = start.where("source <> target").join(ahead.select(F.col("target").alias("_end"), F.col("node").alias("_node"), "d"), (F.col("target") == F.col("_end")) & (F.col("at") == F.col("_node"))).drop("_end", "_node")
    sooner = Window.partitionBy("source", "target").orderBy("positions").rowsBetween(Window.unboundedPreceding, -1)
    for hop in range(max_hops):
        grown = open_.withColumn("nearest", F.least("nearest", "d")).drop("d").join(ways, (F.col("target") == F.col("_end")) & (F.col("at") == F.col("s")) & (F.col("d") < max_hops - hop) & ~F.array_contains("nodes", F.col("t")))
        grown = grown.select("source", "target", F.concat("nodes", F.array("t")).alias("nodes"), F.concat("positions", F.array("p")).alias("positions"), F.col("t").alias("at"), "nearest", "d")
        grown = grown.withColumn("sure", (F.col("d") <= F.col("nearest")).cast("int"))
        arrived = found.select("source", "target", "nodes", "positions", F.col("target").alias("at"), F.lit(0).alias("nearest"), F.lit(0).alias("d"), F.lit(1).alias("sure"))
        rows = grown.unionByName(arrived).withColumn("sooner", F.coalesce(F.sum("sure").over(sooner), F.lit(0))).where(F.col("sooner") < limit).drop("sure", "sooner")
        rows = written(rows, "deep")
        found, open_ = rows.where("at = target").select("source", "target", "nodes", "positions"), rows.where("at <> target")
        if hop + 1 == max_hops or open_.limit(1).count() == 0:
            break
    place = F.row_number().over(Window.partitionBy("source", "target").orderBy("positions"))
    return found.withColumn("place", place).where(F.col("place") <= limit)


def path_scores(paths: DataFrame) -> DataFrame:
    """paths (case, nodes, weights, bases, coherence, position) with evidence, guided, observed share and adjusted score."""
    mean = F.when(F.size("weights") > 0, F.aggregate("weights", F.lit(0.0), lambda a, x: a + x) / F.size("weights")).otherwise(0.0)
    share = F.when(F.size("bases") > 0, F.size(F.filter("bases", lambda b: b == "observed")) / F.size("bases")).otherwise(0.0)
    out = paths.withColumn("evidence_score", mean).withColumn("guided_score", (F.col("coherence") + F.col("evidence_score")) / 2).withColumn("observed_share", share)
    return out.withColumn("adjusted_score", adjusted_score(F.col("guided_score"), F.col("observed_share"))).withColumn("evidence_status", F.when(share == 1.0, "observed_transitions_only").otherwise("includes_configured_transitions"))


def truth_ranks(scored: DataFrame, truth: DataFrame, key: str = "case", scores: tuple[str, ...] = ("guided_score", "adjusted_score", "evidence_score")) -> DataFrame:
    """key with the rank of its true path under each score, null where it is no candidate; ties keep the candidates' order."""
    own = truth.select(F.col(key).alias("_k"), F.col("path").alias("_path"))
    ranked = scored
    for s in scores:
        ranked = ranked.withColumn(f"rank_{s}", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(s), "position")))
    joined = ranked.join(own, F.col(key) == F.col("_k"))
    return joined.groupBy(key).agg(*[F.min(F.when(F.col("nodes") == F.col("_path"), F.col(f"rank_{s}"))).alias(f"rank_{s}") for s in scores])


def best_paths(scored: DataFrame, score: str, key: str = "case") -> DataFrame:
    """The best candidate of each case under a score, ties by the candidates' order."""
    return scored.groupBy(key).agg(F.max_by(F.col("nodes"), F.struct(F.col(score), -F.col("position"))).alias("path"), F.count("*").alias("n_candidates"))


def reconstruction_summary(scored: DataFrame, truth: DataFrame, nodes: DataFrame, key: str = "case", scores: tuple[str, ...] = ("guided_score", "evidence_score")) -> DataFrame:
    """One row for each case and score: status (evaluated, no_candidate_path, invalid_truth where the graph lacks a node of the
    true path), candidates, exact match, node and transition coverage."""
    known = nodes.select(F.col(key).alias("_nk"), F.col("node_id").alias("_n"))
    each = truth.select(key, F.explode("path").alias("node_id"))
    bad = each.join(known, (F.col(key) == F.col("_nk")) & (F.col("node_id") == F.col("_n")), "left_anti").select(F.col(key).alias("_bad")).distinct()
    out = None
    for s in scores:
        best = best_paths(scored, s, key)
        cover = path_coverage(truth, best, key)
        rows = cover.join(best.select(F.col(key).alias("_b"), "n_candidates"), F.col(key) == F.col("_b"), "left").join(bad, F.col(key) == F.col("_bad"), "left")
        status = F.when(F.col("_bad").isNotNull(), "invalid_truth").when(F.col("n_candidates").isNull(), "no_candidate_path").otherwise("evaluated")
        part = rows.select(key, F.lit(s).alias("score"), status.alias("status"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), F.coalesce("exact", F.lit(False)).alias("exact"), (F.col("n_nodes_covered") / F.greatest("n_nodes", F.lit(1))).alias("node_coverage"), (F.col("n_transitions_covered") / F.greatest("n_transitions", F.lit(1))).alias("transition_coverage"))
        out = part if out is None else out.unionByName(part)
    return out


def path_probability(paths: DataFrame, edges: DataFrame, key: str = "case") -> DataFrame:
    """Score of a path as the mean probability of its edges (edges: key, source, target, logit); a step without an edge makes
    the path invalid."""
    steps = paths.select(key, "path_id", F.posexplode(F.when(F.size("nodes") > 1, F.zip_with(F.slice("nodes", 1, F.size("nodes") - 1), F.slice("nodes", 2, F.size("nodes") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))).alias("pos", "s"))
    best = edges.groupBy(F.col(key).alias("_k"), "source", "target").agg(F.max("logit").alias("logit"))
    joined = steps.join(best, (F.col(key) == F.col("_k")) & (F.col("s.a") == F.col("source")) & (F.col("s.b") == F.col("target")), "left")
    return joined.groupBy(key, "path_id").agg(F.bool_and(F.col("logit").isNotNull()).alias("valid"), F.avg(1 / (1 + F.exp(-F.col("logit")))).alias("score"))
