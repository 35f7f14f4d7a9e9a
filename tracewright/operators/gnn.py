"""A small relation-aware graph network by message passing in joins.

A layer joins edges to the vectors of their sources, averages them by target and relation with partial sums, applies the
small weight matrices to Arrow batches of rows, and adds what arrives at a node. So a graph may have any number of edges:
nothing is gathered by graph. Weights come from a seed or from gnn_training."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .risk import EDGE_TYPES, NODE_TYPES

BASES = ["observed", "configured"]
HTTP, HIDDEN, OUT = 23, 32, 16
WIDTH = len(NODE_TYPES) + len(BASES) + HTTP


def node_vectors(nodes: DataFrame, pooled: DataFrame) -> DataFrame:
    """graph_id, node_id, features: type and basis one-hot, then the pooled request features (zeros where there are none)."""
    zeros = F.array_repeat(F.lit(0.0), HTTP)
    hot = [(F.col("node_type") == t).cast("double") for t in NODE_TYPES] + [(F.col("basis") == b).cast("double") for b in BASES]
    own = pooled.select("graph_id", "node_id", F.col("features").alias("_http"))
    return nodes.join(own, ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.concat(F.array(*hot), F.coalesce("_http", zeros)).alias("features"))


def initial_weights(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, np.sqrt(2 / (shape[-2] + shape[-1])), shape)
    n = len(EDGE_TYPES) * len(BASES)
    return {"own1": draw(WIDTH, HIDDEN), "rel1": draw(n, WIDTH, HIDDEN), "own2": draw(HIDDEN, OUT), "rel2": draw(n, HIDDEN, OUT), "kind": rng.normal(0, 0.1, (len(EDGE_TYPES), 8)), "hid": draw(3 * OUT + 8, HIDDEN), "bias": np.zeros(HIDDEN), "out": draw(HIDDEN, 1)[:, 0], "last": np.zeros(1)}


NODE_KEY = ["graph_id", "node_id"]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))


def _times(rows: DataFrame, matrices: np.ndarray, relu: bool) -> DataFrame:
    """graph_id, node_id, v times the matrix that relation names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, relation = _matrix(b.column("v")), b.column("relation").to_numpy()
                x = np.maximum(x, 0) if relu else x
                out = np.zeros((len(x), matrices.shape[2]))
                for r in np.unique(relation):
                    out[relation == r] = x[relation == r] @ matrices[r]
                yield pa.RecordBatch.from_arrays([b.column("graph_id"), b.column("node_id"), _lists(out)], [*NODE_KEY, "v"])

    return rows.select(*NODE_KEY, "v", "relation").mapInArrow(run, "graph_id string, node_id string, v array<double>")


def _relation() -> Column:
    """The place of an edge's type and basis; types that are not known count as the first, bases as configured."""
    place = lambda names, c, other: F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(n) for n in names]), F.col(c)), F.lit(0).cast("long")), F.lit(other + 1)) - 1
    return (place(EDGE_TYPES, "edge_type", 0) * len(BASES) + place(BASES, "basis", 1)).cast("int")


def _each(size: int, how) -> Column:
    return F.array(*[how(F.col("v")[k]) for k in range(size)])


def _layer(h: DataFrame, edges: DataFrame, own: np.ndarray, rel: np.ndarray, relu: bool) -> DataFrame:
    """graph_id, node_id, v: a node's own vector and the means of its in-neighbours' over each relation, each by its matrix."""
    width, out = own.shape
    sent = edges.join(h.select("graph_id", F.col("node_id").alias("source"), F.transform("v", lambda x: F.greatest(x, F.lit(0.0))).alias("v") if relu else F.col("v")), ["graph_id", "source"])
    means = sent.groupBy("graph_id", F.col("target").alias("node_id"), "relation").agg(_each(width, F.avg).alias("v"))
    arrived = _times(means, rel, False).withColumn("own", F.lit(0))
    mine = _times(h.withColumn("relation", F.lit(0)), own[None], relu).withColumn("own", F.lit(1))
    both = mine.unionByName(arrived).groupBy(*NODE_KEY).agg(_each(out, F.sum).alias("v"), F.max("own").alias("own"))
    return written(both.where("own = 1").drop("own"), "layer")


def embed_nodes(nodes: DataFrame, edges: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """graph_id, node_id, embedding after two layers; edges whose end is no node count for nothing."""
    h = nodes.select(*NODE_KEY, F.col("features").alias("v"))
    own = edges.select("graph_id", "source", "target", _relation().alias("relation"))
    h = _layer(h, own, weights["own1"], weights["rel1"], False)
    return _layer(h, own, weights["own2"], weights["rel2"], True).withColumnRenamed("v", "embedding")


def _ends(embeddings: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the embeddings of both ends, a and b."""
    side = lambda end, name: embeddings.select("graph_id", F.col("node_id").alias(end), F.col("embedding").alias(name))
    return edges.join(side("source", "a"), ["graph_id", "source"]).join(side("target", "b"), ["graph_id", "target"]).withColumn("kind", F.floor(_relation() / len(BASES)).cast("int"))


def edge_inputs(a: np.ndarray, b: np.ndarray, kinds: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    return np.hstack([a, b, np.abs(a - b), w["kind"][kinds]])


def edge_logits(z: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    return np.maximum(z @ w["hid"] + w["bias"], 0) @ w["out"] + w["last"][0]


def score_edges(nodes: DataFrame, edges: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """graph_id, source, target, edge_type, logit, probability."""
    names = ["graph_id", "source", "target", "edge_type"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                logit = edge_logits(edge_inputs(_matrix(b.column("a")), _matrix(b.column("b")), b.column("kind").to_numpy(), weights), weights)
                yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(logit), pa.array(1 / (1 + np.exp(-logit)))], [*names, "logit", "probability"])

    rows = _ends(embed_nodes(nodes, edges, weights), edges).select(*names, "kind", "a", "b")
    return rows.mapInArrow(run, "graph_id string, source string, target string, edge_type string, logit double, probability double")


def path_coherence(paths: DataFrame, embeddings: DataFrame) -> DataFrame:
    """graph_id, path_id, coherence: mean cosine of consecutive nodes of a path, in -1..1; a single node has 1."""
    steps = paths.select("graph_id", "path_id", F.posexplode("nodes").alias("pos", "node_id")).join(embeddings, ["graph_id", "node_id"])
    after = steps.select("graph_id", "path_id", (F.col("pos") - 1).alias("pos"), F.col("embedding").alias("then"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    pair = steps.join(after, ["graph_id", "path_id", "pos"]).withColumn("c", dot("embedding", "then") / F.greatest(F.sqrt(dot("embedding", "embedding")) * F.sqrt(dot("then", "then")), F.lit(1e-8)))
    mean = pair.groupBy("graph_id", "path_id").agg(F.avg("c").alias("c"))
    return paths.join(mean, ["graph_id", "path_id"], "left").select("graph_id", "path_id", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce("c", F.lit(1.0)))).alias("coherence"))
