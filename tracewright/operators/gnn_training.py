"""Training of the whole graph network: back-propagation through the joins that pass its messages.

What a layer takes in is a table of a node's own vector and the mean of its in-neighbours' over each relation; the gradient at a
node goes back along the same links with the same shares. Gradients of matrices are sums of outer products that tasks add up, so
all labelled edges and all nodes count in each epoch, and only the weights' gradients reach the driver. Every table of an epoch is
written once, survives lost executors and is deleted when the epoch is done."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import released, written
from . import gnn
from .attribution import RELATIONS

OWN = RELATIONS  # the place of a node's own vector among the relations
SCORER = ["kind", "hid", "bias", "out", "last"]
VECTOR = "graph_id string, node_id string, v array<double>"


@dataclass(frozen=True)
class Trained:
    weights: dict[str, np.ndarray]
    train_losses: tuple[float, ...]
    validation_losses: tuple[float, ...]


@dataclass(frozen=True)
class Prepared:
    """links: graph_id, source, target, relation, share; first: the first layer's inputs; labelled: edges with y and train."""

    links: DataFrame
    first: DataFrame
    labelled: DataFrame
    n_train: int
    n_validation: int


def _pulled(links: DataFrame, vectors: DataFrame, there: str, here: str, width: int) -> DataFrame:
    """The vectors' weighted sums at one end of the links, by relation."""
    sent = links.join(vectors.select("graph_id", F.col("node_id").alias(there), "v"), ["graph_id", there])
    return sent.groupBy("graph_id", F.col(here).alias("node_id"), "relation").agg(F.array(*[F.sum(F.col("v")[k] * F.col("share")) for k in range(width)]).alias("v"))


def _inputs(links: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    return _pulled(links, vectors, "source", "target", width).unionByName(vectors.withColumn("relation", F.lit(OWN)))


def _combined(inputs: DataFrame, matrices: np.ndarray) -> DataFrame:
    return gnn._times(inputs, matrices, False).groupBy(*gnn.NODE_KEY).agg(F.array(*[F.sum(F.col("v")[k]) for k in range(matrices.shape[2])]).alias("v"))


def _totals(arrays: DataFrame, size: int) -> np.ndarray:
    """Sums by place of one array for each task."""
    out = np.zeros(size)
    for r in arrays.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect():
        out[r["at"]] = r["x"]
    return out


def _outer(inputs: DataFrame, gradients: DataFrame, shape: tuple[int, int, int]) -> np.ndarray:
    """The gradient of a layer's matrices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            if b.num_rows:
                x, g, relation = gnn._matrix(b.column("v")), gnn._matrix(b.column("g")), b.column("relation").to_numpy()
                for r in np.unique(relation):
                    total[r] += x[relation == r].T @ g[relation == r]
        yield pa.RecordBatch.from_arrays([gnn._lists(total.reshape(1, -1))], ["v"])

    both = inputs.join(gradients.select(*gnn.NODE_KEY, F.col("v").alias("g")), gnn.NODE_KEY).select("v", "g", "relation")
    return _totals(both.mapInArrow(run, "v array<double>"), int(np.prod(shape))).reshape(shape)


def prepare(nodes: DataFrame, edges: DataFrame, labelled: DataFrame) -> Prepared:
    """labelled: graph_id, source, target, edge_type, basis, label (0 or 1), split (train or validation).

    Refused: a label or split that is null or another, a labelled end that is no node, a graph in both splits, a split without both
    labels. Links whose ends are not both nodes carry nothing."""
    h = nodes.select(*gnn.NODE_KEY, F.col("features").alias("v"))
    ends = h.select(*gnn.NODE_KEY)
    raw = edges.select("graph_id", "source", "target", gnn._relation().alias("relation"))
    for end in ("source", "target"):
        raw = raw.join(ends.withColumnRenamed("node_id", end), ["graph_id", end])
    n = raw.groupBy("graph_id", "target", "relation").agg((1 / F.count("*")).alias("share"))
    links = written(raw.join(n, ["graph_id", "target", "relation"]), "links")
    odd = labelled.where("not coalesce(label in (0, 1) and split in ('train', 'validation'), false)")
    lost = labelled.join(ends.withColumnRenamed("node_id", "source"), ["graph_id", "source"], "left_anti").select("graph_id").union(labelled.join(ends.withColumnRenamed("node_id", "target"), ["graph_id", "target"], "left_anti").select("graph_id"))
    mixed = labelled.groupBy("graph_id").agg(F.count_distinct("split").alias("n")).where("n > 1")
    for rows, why in ((odd, "a label or split is not known"), (lost, "a labelled end is no node of its graph"), (mixed, "a graph is in both splits")):
        if not rows.isEmpty():
            raise ValueError(why)
    counts = {(r["split"], r["label"]): r["count"] for r in labelled.groupBy("split", F.col("label").cast("int").alias("label")).count().collect()}
    if len(counts) < 4:
        raise ValueError("each split needs both labels")
    kind = F.floor(gnn._relation() / len(gnn.BASES)).cast("int")
    rows = labelled.select("graph_id", "source", "target", kind.alias("kind"), F.col("label").cast("double").alias("y"), (F.col("split") == "train").alias("train"))
    of = lambda split: sum(c for (s, _), c in counts.items() if s == split)
    return Prepared(links, written(_inputs(links, h, gnn.WIDTH), "first"), written(rows, "labelled"), of("train"), of("validation"))


def _scorer(weights: dict[str, np.ndarray], n_train: int):
    """Arrow batches of labelled edges with both ends' vectors, to gradients at the ends and one row of sums for each task."""
    sizes = [weights[k].size for k in SCORER]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros_like(weights[k]) for k in SCORER}
        losses = np.zeros(2)
        for b in batches:
            if not b.num_rows:
                continue
            a, c, kinds = gnn._matrix(b.column("a")), gnn._matrix(b.column("b")), b.column("kind").to_numpy()
            y, train = b.column("y").to_numpy(), b.column("train").to_numpy(zero_copy_only=False)
            z = gnn.edge_inputs(a, c, kinds, weights)
            pre = z @ weights["hid"] + weights["bias"]
            hidden = np.maximum(pre, 0)
            logit = hidden @ weights["out"] + weights["last"][0]
            loss = np.logaddexp(0, logit) - y * logit
            losses += loss[train].sum(), loss[~train].sum()
            wrong = np.where(train, 1 / (1 + np.exp(-logit)) - y, 0) / n_train
            back = np.outer(wrong, weights["out"]) * (pre > 0)
            sums["hid"] += z.T @ back
            sums["bias"] += back.sum(0)
            sums["out"] += hidden.T @ wrong
            sums["last"] += wrong.sum()
            into = back @ weights["hid"].T
            np.add.at(sums["kind"], kinds, into[:, 3 * gnn.OUT :])
            apart = np.sign(a - c) * into[:, 2 * gnn.OUT : 3 * gnn.OUT]
            for end, g in (("source", into[:, : gnn.OUT] + apart), ("target", into[:, gnn.OUT : 2 * gnn.OUT] - apart)):
                yield pa.RecordBatch.from_arrays([b.column("graph_id"), b.column(end), gnn._lists(g)], ["graph_id", "node_id", "v"])
        flat = np.concatenate([*[sums[k].ravel() for k in SCORER], losses])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), gnn._lists(flat[None])], ["graph_id", "node_id", "v"])

    return run, sizes


def gradients(data: Prepared, w: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], float, float]:
    """The gradient of the mean training loss by every weight, that loss, and the validation loss."""
    one, two = np.concatenate([w["rel1"], w["own1"][None]]), np.concatenate([w["rel2"], w["own2"][None]])
    h1 = written(_combined(data.first, one), "h1")
    second = written(_inputs(data.links, h1.withColumn("v", F.transform("v", lambda x: F.greatest(x, F.lit(0.0)))), gnn.HIDDEN), "second")
    h2 = _combined(second, two)
    rows = data.labelled
    for end, name in (("source", "a"), ("target", "b")):
        rows = rows.join(h2.select("graph_id", F.col("node_id").alias(end), F.col("v").alias(name)), ["graph_id", end])
    run, sizes = _scorer(w, data.n_train)
    scored = written(rows.mapInArrow(run, VECTOR), "scored")
    flat = _totals(scored.where("node_id is null"), sum(sizes) + 2)
    g = {k: part.reshape(w[k].shape) for k, part in zip(SCORER, np.split(flat[:-2], np.cumsum(sizes)[:-1]), strict=True)}
    at_two = written(scored.where("node_id is not null").groupBy(*gnn.NODE_KEY).agg(F.array(*[F.sum(F.col("v")[k]) for k in range(gnn.OUT)]).alias("v")), "g2")
    by_two = _outer(second, at_two, two.shape)
    back = _pulled(data.links, at_two, "target", "source", gnn.OUT).unionByName(at_two.withColumn("relation", F.lit(OWN)))
    at_one = _combined(back, two.transpose(0, 2, 1)).join(h1.withColumnRenamed("v", "h"), gnn.NODE_KEY)
    at_one = at_one.select(*gnn.NODE_KEY, F.zip_with("v", "h", lambda x, h: F.when(h > 0, x).otherwise(0.0)).alias("v"))
    by_one = _outer(data.first, at_one, one.shape)
    released(h1, second, scored, at_two)
    g |= {"rel1": by_one[:OWN], "own1": by_one[OWN], "rel2": by_two[:OWN], "own2": by_two[OWN]}
    return g, flat[-2] / data.n_train, flat[-1] / data.n_validation


def train(nodes: DataFrame, edges: DataFrame, labelled: DataFrame, epochs: int = 50, rate: float = 0.01, seed: int = 7) -> Trained:
    """Adam on the mean cross-entropy of the labelled training edges; validation edges only have their loss told."""
    if epochs < 1 or rate <= 0:
        raise ValueError("epochs and rate must be positive")
    data, w = prepare(nodes, edges, labelled), gnn.initial_weights(seed)
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    told = []
    for t in range(1, epochs + 1):
        g, *losses = gradients(data, w)
        told.append(losses)
        for k in w:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
            w[k] = w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    released(data.links, data.first, data.labelled)
    return Trained(w, *map(tuple, zip(*told, strict=True)))
