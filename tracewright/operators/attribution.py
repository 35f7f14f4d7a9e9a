"""What the request features of an edge's two ends add to its logit, by Shapley values.

Topology, types, bases and all other nodes stay as they are; only the ends' request features move, between their own values and
those of a background drawn from the graph's nodes. Ahead of the first ReLU a node's vector is affine in them, so the graph is
gone through once: it leaves, for each node that hears from an end and is heard by one, a base vector and its shares of messages.
Coalitions are then worked out in blocks against those nodes, tasks sum what arrives at the ends, and the scorer runs on the sums.
In-neighbours that hear from neither end add a constant."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from . import gnn
from .risk import EDGE_TYPES

RELATIONS = len(EDGE_TYPES) * len(gnn.BASES)
SIDES = ("source", "target")
NAMES = [f"{side}_http_feature_{i}" for side in SIDES for i in range(gnn.HTTP)]
BLOCK = 32  # coalitions worked out at once, each against the whole background


def coalitions(varying: list[int], permutations: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks (a row each, true where a feature has the edge's own value) and, for each mask and feature, its weight in the
    feature's Shapley value: every coalition of up to ten features, else the prefixes of random orders and of their reverses."""
    n, width = len(varying), len(NAMES)
    if n <= 10:
        sets = [s for k in range(n + 1) for s in combinations(varying, k)]
        masks, weights = np.zeros((len(sets), width), bool), np.zeros((len(sets), width))
        for row, s in enumerate(sets):
            masks[row, list(s)] = True
            for f in varying:
                held = f in s
                weights[row, f] = (1 if held else -1) / (n * comb(n - 1, len(s) - held))
        return masks, weights
    rng = np.random.default_rng(seed)
    orders = [o for _ in range(permutations) for one in [rng.permutation(varying)] for o in (one, one[::-1])]
    masks, weights = np.zeros((len(orders) * (n + 1), width), bool), np.zeros((len(orders) * (n + 1), width))
    for p, order in enumerate(orders):
        at = p * (n + 1)
        for k, f in enumerate(order):
            masks[at + k + 1 : at + n + 1, f] = True
            weights[at + k, f] -= 1 / len(orders)
            weights[at + k + 1, f] += 1 / len(orders)
    return masks, weights


def _roles(nodes: DataFrame, edges: DataFrame, source: str, target: str) -> DataFrame:
    """node_id and, in arrays by relation, its shares of what it hears from either end and of what either end hears from it."""
    known = edges.join(nodes.select(F.col("node_id").alias("source")), "source")
    ends = [source, target]
    near = known.where(F.col("source").isin(ends)).select("target").union(nodes.where(F.col("node_id").isin(ends)).select("node_id")).distinct()
    into = known.join(near, "target").groupBy("target", "relation").agg(F.count("*").alias("n"))
    touching = known.where(F.col("source").isin(ends) | F.col("target").isin(ends)).groupBy("source", "target", "relation").agg(F.count("*").alias("k"))
    shares = touching.join(into, ["target", "relation"]).withColumn("share", F.col("k") / F.col("n"))

    def row(end: str, there: str, role: str) -> DataFrame:
        return shares.where(F.col(end).isin(ends)).select(F.col(there).alias("node_id"), F.when(F.col(end) == source, f"{role}0").otherwise(f"{role}1").alias("role"), "relation", "share")

    rows = row("source", "target", "hears").union(row("target", "source", "heard"))
    by = lambda role: F.array(*[F.coalesce(F.sum(F.when((F.col("role") == role) & (F.col("relation") == r), F.col("share"))), F.lit(0.0)) for r in range(RELATIONS)]).alias(role)
    return rows.groupBy("node_id").agg(*[by(f"{role}{side}") for role in ("hears", "heard") for side in (0, 1)])


def _stack(column: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, float) for v in column])


def _background(nodes: DataFrame, samples: int, seed: int) -> np.ndarray:
    """Pairs of request features of nodes, the first by hash for each end; repeated where the graph has fewer nodes."""
    sides = []
    for side in range(2):
        held = nodes.orderBy(F.xxhash64(F.lit(seed * 2 + side), "node_id"), "node_id").limit(samples).select("features").toPandas()
        own = _stack(held["features"])[:, -gnn.HTTP :]
        sides.append(own[np.arange(samples) % len(own)])
    return np.hstack(sides)


def explain_edge(nodes: DataFrame, edges: DataFrame, weights: dict[str, np.ndarray], graph_id: str, source: str, target: str, edge_type: str, varying: list[int] | None = None, background: int = 100, permutations: int = 5, seed: int = 7) -> DataFrame:
    """feature, contribution, direction, score, baseline: one row for each of the 46 features of the two ends.

    `varying` limits the features that move (the others keep their own values and get 0). Contributions add up to score minus
    baseline. The edge itself need not be in the graph. Unknown ends or types, or one node as both ends, are refused."""
    if edge_type not in EDGE_TYPES:
        raise ValueError(f"unknown edge type {edge_type}")
    if source == target:
        raise ValueError("the ends must be two nodes")
    if background < 1 or permutations < 1:
        raise ValueError("background and permutations must be positive")
    nodes = nodes.where(F.col("graph_id") == graph_id).select("graph_id", "node_id", "features")
    edges = edges.where(F.col("graph_id") == graph_id).select("graph_id", "source", "target", gnn._relation().alias("relation"))
    is_end = F.col("node_id").isin(source, target)
    own = {r["node_id"]: np.array(r["features"], float) for r in nodes.where(is_end).collect()}
    if len(own) < 2:
        raise ValueError("an end is no node of the graph")
    x = np.concatenate([own[source][-gnn.HTTP :], own[target][-gnn.HTTP :]])
    varying = list(range(len(NAMES))) if varying is None else list(varying)
    masks, shares = coalitions(varying, permutations, seed)
    fixed = np.setdiff1d(np.arange(len(NAMES)), varying)
    masks[:, fixed] = True
    drawn = _background(nodes, background, seed)

    bare = F.concat(F.slice("features", 1, gnn.WIDTH - gnn.HTTP), F.array_repeat(F.lit(0.0), gnn.HTTP))
    h = gnn._layer(nodes.select("graph_id", "node_id", F.when(is_end, bare).otherwise(F.col("features")).alias("v")), edges, weights["own1"], weights["rel1"], False)
    none = F.array_repeat(F.lit(0.0), RELATIONS)
    roles = _roles(nodes, edges, source, target)
    near = nodes.where(is_end).select("node_id").union(roles.select("node_id")).distinct().join(roles, "node_id", "left")
    parts = ("hears0", "hears1", "heard0", "heard1")
    state = near.select("node_id", *[F.coalesce(c, none).alias(c) for c in parts]).join(h.select("node_id", "v"), "node_id")
    some = lambda c: F.exists(c, lambda s: s > 0)
    moves: Column = is_end | some("hears0") | some("hears1")
    state = written(state.withColumn("moves", moves).where(is_end | some("heard0") | some("heard1")), "ends")
    lower, rel2, own2 = gnn.WIDTH - gnn.HTTP, weights["rel2"], weights["own2"]
    own1, rel1 = weights["own1"][lower:], weights["rel1"][:, lower:]

    def after(f: pd.DataFrame) -> np.ndarray:
        """For each node and end, the matrix that takes the node's first vector into the end's second."""
        heard = np.stack([_stack(f["heard0"]), _stack(f["heard1"])], 1)
        out = np.einsum("ner,rho->neho", heard, rel2)
        for e, name in enumerate((source, target)):
            out[(f["node_id"] == name).to_numpy(), e] += own2
        return out

    def still(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, gnn.OUT))
        for f in frames:
            if len(f):
                total += np.einsum("nh,neho->eo", np.maximum(_stack(f["v"]), 0), after(f), optimize=True)
        yield pd.DataFrame({"s": [total.ravel().tolist()]})

    constant = np.zeros(2 * gnn.OUT)
    for r in state.where("not moves").mapInPandas(still, "s array<double>").select(F.posexplode("s").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect():
        constant[r["at"]] = r["v"]

    def moved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for f in frames:
            for block, rows in f.groupby("block"):
                mask = masks[block * BLOCK : (block + 1) * BLOCK]
                z = np.where(mask[:, None], x, drawn).reshape(-1, len(x))
                into = np.stack([_stack(rows["hears0"]), _stack(rows["hears1"])], 1)
                first = np.einsum("ner,rih->neih", into, rel1)
                for e, name in enumerate((source, target)):
                    first[(rows["node_id"] == name).to_numpy(), e] += own1
                total = totals.setdefault(int(block), np.zeros((len(z), 2, gnn.OUT)))
                for base, take, give in zip(_stack(rows["v"]), first.reshape(len(rows), len(x), -1), after(rows), strict=True):
                    total += np.einsum("zh,eho->zeo", np.maximum(base + z @ take, 0), give, optimize=True)
        for block, total in totals.items():
            yield pd.DataFrame({"block": [block], "s": [total.ravel().tolist()]})

    kind = EDGE_TYPES.index(edge_type)

    def valued(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        s = (np.sum(_stack(rows["s"]), 0).reshape(-1, 2 * gnn.OUT) + constant).reshape(-1, 2, gnn.OUT)
        logit = gnn.edge_logits(gnn.edge_inputs(s[:, 0], s[:, 1], np.full(len(s), kind), weights), weights)
        value = logit.reshape(-1, background).mean(1)
        return pd.DataFrame({"mask": key[0] * BLOCK + np.arange(len(value)), "value": value})

    blocks = F.explode(F.sequence(F.lit(0), F.lit((len(masks) - 1) // BLOCK))).alias("block")
    sums = state.where("moves").select("node_id", "v", *parts, blocks).mapInPandas(moved, "block int, s array<double>")
    values = written(sums.groupBy("block").applyInPandas(valued, "mask long, value double"), "coalitions")  # a row for each task in a group
    value = np.array([r["value"] for r in values.orderBy("mask").collect()])  # their number is that of the coalitions
    contribution = value @ shares
    full, empty = value[masks.all(1)].mean(), value[~masks[:, varying].any(1)].mean()
    names = [(n, float(c), float(full), float(empty)) for n, c in zip(NAMES, contribution, strict=True)]
    rows = nodes.sparkSession.createDataFrame(names, "feature string, contribution double, score double, baseline double")
    direction = F.when(F.col("contribution") > 1e-10, "increases").when(F.col("contribution") < -1e-10, "decreases").otherwise("no_change")
    return rows.select("feature", "contribution", direction.alias("direction"), "score", "baseline")
