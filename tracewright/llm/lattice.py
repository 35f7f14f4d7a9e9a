"""Near-duplicate vectors by lattice hashing.

A unit vector is projected at random into pairs of eight dimensions, and each eight-dimensional point is decoded to its
nearest point of the E8 lattice; both points together name a cell. Several tables have projections of their own. A
vector is stored in its own cell of each table and looks it up together with the lattice neighbours that lie nearest
to it. All pairs that meet are verified by cosine in double precision.

Those at home in a cell and those that look into it are dealt to blocks; each two blocks meet in a task as one matrix
product, and no pair is a row. A link counts where its two vectors meet first, which their own cells tell, so a task passes
on sums by vector and a few edges that hold its links together, however many links there are.

Defined cases: a vector that is null, empty or zero, or holds null or non-finite components, or whose label is null,
links with nothing and stays; equal vectors of a label are compared once and counted each; vectors of different length
do not link; repeated rows count as vectors of their own; an empty table gives no rows; extra columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

TABLES, PROBES, SCALE = 10, 3, 1.6
#: Vectors of a cell that meet as many others in one product.
MEET = 512


@lru_cache(maxsize=1)
def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number of minus signs."""
    rows = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            rows.append(v)
    rows += [np.array(s) / 2 for s in product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(rows)


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest point with integer entries of even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(1) % 2 != 0)
    off = x[odd] - near[odd]
    worst = np.abs(off).argmax(1)
    near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def _names(points: np.ndarray) -> np.ndarray:
    """One 64-bit name for each row of doubled lattice coordinates."""
    out = np.full(len(points), 0x9E3779B97F4A7C15, np.uint64)
    for column in np.rint(points * 2).astype(np.int64).astype(np.uint64).T:
        out = (out ^ column) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def cells(unit: np.ndarray, table: int, probes: int = PROBES, scale: float = SCALE, seed: int = 11) -> np.ndarray:
    """Own cell and `probes` nearest neighbouring cells of each row, in one table."""
    rng = np.random.default_rng([seed, table, unit.shape[1]])
    x = unit @ rng.normal(size=(unit.shape[1], 16)) / scale
    halves = [x[:, :8], x[:, 8:]]
    own = [decode(h) for h in halves]
    out = [_names(np.hstack(own))]
    if probes:
        steps = shortest()
        gain = np.hstack([(h - p) @ steps.T for h, p in zip(halves, own, strict=True)])  # larger is nearer
        best = np.argsort(-gain, axis=1, kind="stable")[:, :probes]
        for k in range(probes):
            step, second = steps[best[:, k] % 240], (best[:, k] >= 240)[:, None]
            out.append(_names(np.hstack([own[0] + np.where(second, 0, step), own[1] + np.where(second, step, 0)])))
    return np.stack(out, 1)


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        vectors = b.column("v").to_pylist()
        by_size: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            by_size.setdefault(len(v), []).append(i)
        for rows in by_size.values():
            x = np.array([vectors[i] for i in rows], np.float64)
            x /= np.abs(x).max(1, keepdims=True)
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            found = np.stack([cells(x, t) for t in range(TABLES)], 1)
            at = b.take(pa.array(rows))
            look = pa.array(found.reshape(len(rows), -1).tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([at.column("rep"), at.column("label"), at.column("copies"), at.column("v"), look], ["rep", "label", "copies", "v", "look"])


def _matrix(column: pa.ListArray, size: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    return x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares


def _roots(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The smallest place that each of n places is held together with by the pairs (p, q)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[p], root[q])
        new = root.copy()
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _meet(batch: pa.Table, table: int, least: float) -> tuple[list, list]:
    """Of one pair of blocks: (vector, sum of the copies that it links to here first), and edges between linked vectors."""
    sums, edges = [], []
    sizes = pa.compute.list_value_length(batch.column("v")).to_numpy()
    for size in np.unique(sizes).tolist():  # vectors of different length do not link
        own = batch.filter(pa.array(sizes == size))
        rep, copies = own.column("rep").to_numpy(), own.column("copies").to_numpy()
        asks, answers = (np.flatnonzero(own.column(c).to_numpy(zero_copy_only=False)) for c in ("asks", "answers"))
        x = _matrix(own.column("v").combine_chunks(), size)
        norm = (x * x).sum(1)
        near = (x[asks] @ x[answers].T) / np.sqrt(norm[asks][:, None] * norm[answers][None, :])
        i, j = np.nonzero(near >= least - 1e-9)
        p, q = asks[i], answers[j]
        sure = p != q
        p, q = p[sure], q[sure]
        if not len(p):
            continue
        cosine = (x[p] * x[q]).sum(1) / np.sqrt(norm[p] * norm[q])
        p, q = p[cosine >= least], q[cosine >= least]
        look = own.column("look").combine_chunks().flatten().to_numpy().reshape(len(rep), TABLES, -1)
        sees = (look[q] == look[p][:, :, :1]).any(2)  # q looks into p's own cell, by table
        seen = (look[p] == look[q][:, :, :1]).any(2)
        first = ~(sees | seen)[:, :table].any(1) & ((rep[p] < rep[q]) | ~seen[:, table])
        p, q = p[first], q[first]
        n = np.zeros(len(rep), np.int64)
        np.add.at(n, p, copies[q])
        np.add.at(n, q, copies[p])
        some = np.flatnonzero(n)
        sums += zip(rep[some].tolist(), n[some].tolist(), strict=True)
        root = _roots(len(rep), p, q)
        held = np.flatnonzero(root != np.arange(len(rep)))
        edges += zip(rep[root[held]].tolist(), rep[held].tolist(), strict=True)
    return sums, edges


def _met(least: float):
    """_meet over rows that are sorted by their pair of blocks."""
    names = ["label", "t", "cell", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close(t: pa.Table) -> pa.RecordBatch:
            keys = t.select(names).to_pydict()
            keys = list(zip(*keys.values(), strict=True))
            cuts = [0, *[k for k in range(1, len(keys)) if keys[k] != keys[k - 1]], len(keys)]
            a, b, n = [], [], []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi - lo > 1:
                    sums, edges = _meet(t.slice(lo, hi - lo), keys[lo][1], least)
                    a += [r for r, _ in sums] + [r for r, _ in edges]
                    b += [None] * len(sums) + [r for _, r in edges]
                    n += [k for _, k in sums] + [None] * len(edges)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, n)], ["a", "b", "n"])

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(c).to_pylist() for c in names), strict=True))
            cut = max((k for k in range(batch.num_rows) if keys[k] != (keys[k - 1] if k else last)), default=None)
            if cut is None:  # all of it goes on with what is held
                held.append(batch)
            else:
                held.append(batch.slice(0, cut))
                whole = pa.Table.from_batches(held)
                if whole.num_rows:
                    yield close(whole)
                held = [batch.slice(cut)]
            last = keys[-1]
        if held:
            yield close(pa.Table.from_batches(held))

    return run


def link_vectors(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """Per row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    v = F.col("embedding")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    good = F.col("label").isNotNull() & F.coalesce(fine, F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), v, good.alias("good"), F.xxhash64("label", v).alias("k1"), F.xxhash64(v, F.lit(1), "label").alias("k2"))
    reps = materialize(rows.where("good").groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min_by("embedding", "vec_id").alias("v")), "vectors")
    kind, element = vectors.schema["label"].dataType.simpleString(), vectors.schema["embedding"].dataType.simpleString()
    hashed = materialize(reps.select("rep", "label", "copies", "v").mapInArrow(_hash, f"rep long, label {kind}, copies long, v {element}, look array<long>"), "cells")
    place = F.posexplode("look").alias("at", "cell")
    spots = hashed.select("rep", "label", place).select("rep", "label", F.floor(F.col("at") / (PROBES + 1)).cast("int").alias("t"), (F.col("at") % (PROBES + 1) == 0).alias("home"), "cell")
    key = ["label", "t", "cell"]
    sizes = spots.groupBy(*key).agg(F.count("*").alias("n"), F.count_if("home").alias("h")).where("n > 1 and h > 0")
    dealt = spots.join(sizes, key).withColumns({"bi": F.ceil(F.col("h") / MEET), "bj": F.ceil(F.col("n") / MEET)})
    dealt = dealt.withColumns({"i0": F.pmod(F.xxhash64("rep", "t"), F.col("bi")), "j0": F.pmod(F.xxhash64("rep", "t", F.lit(1)), F.col("bj"))})
    row = lambda i, j, asks, answers: F.struct(i.alias("i"), j.alias("j"), asks.alias("asks"), answers.alias("answers"))
    zero = F.lit(0).cast("long")
    answers = F.transform(F.sequence(zero, F.col("bi") - 1), lambda i: row(i, F.col("j0"), F.col("home") & (i == F.col("i0")), F.lit(True)))
    asks = F.filter(F.transform(F.sequence(zero, F.col("bj") - 1), lambda j: row(F.col("i0"), j, F.lit(True), F.lit(False))), lambda x: F.col("home") & (x["j"] != F.col("j0")))
    cells_ = dealt.select("rep", *key, F.explode(F.concat(answers, asks)).alias("x")).select("rep", *key, "x.*").join(hashed.select("rep", "copies", "v", "look"), "rep")
    order = [*key, "i", "j"]
    met = materialize(cells_.repartition(*order).sortWithinPartitions(*order).mapInArrow(_met(least), "a long, b long, n long"), "met")
    beside = met.where("b is null").groupBy("a").agg(F.sum("n").alias("others"))
    found = connected_components(met.where("b is not null").select("a", "b"))
    known = reps.select("label", "k1", "k2", "rep", "copies").join(beside, F.col("rep") == F.col("a"), "left").join(found, F.col("rep") == F.col("node"), "left")
    known = known.select("k1", "k2", F.col("label").alias("l"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c"))
    same = F.col("good") & (rows["k1"] == known["k1"]) & (rows["k2"] == known["k2"]) & (F.col("label") == F.col("l"))
    out = rows.join(known, same, "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
