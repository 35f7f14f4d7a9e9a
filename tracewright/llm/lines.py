"""Line deduplication by sharded minimal perfect hashes.

Texts are split at \\n. A line's key is the line without the ASCII white space around it, A-Z lower-cased; keys of at least
LEAST code points count. Blocks of documents are taken apart once and written as packed arrays of 128-bit line hashes.
Hashes are dealt to shards by their own bits, and each shard gets a minimal perfect hash over its distinct line hashes (levels
of bit arrays: a key settles in the first level where no other key shares its bit, and its index is that bit's rank) that
indexes three compact arrays: a 32-bit fingerprint, the number of rows that hold the line, and its owner, the smallest doc_id.

Documents then probe these arrays: a block sends each shard its own hashes as one packed row and gets back the owners of those
lines that other documents hold too, so no line is a row and no lines are joined. A shard that gets very many probes (a
line of nearly every block) answers them in several tasks. A line of a document with a larger doc_id than its owner goes.

The number of shards follows the number of lines, so a shard holds about SHARD of them at any corpus size; hot lines are
summed within a task before they are sent on. 128 bits of a hash stand for a key.

Defined cases: a null or empty text is one empty line, which stays; rows that share a doc_id are one document, and lines
repeated within a document stay; rows with a null doc_id are one document that comes after all others; repeated rows each get
their row; a very long text is a block of its own; an empty table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, materialize, release, slices

LEAST = 10
#: Line hashes of a shard, as a mean; hashes that one task of a shard answers.
SHARD = 1 << 18
PROBES = 1 << 20
BLOCK = 4 << 20
EDGE = SPACES.encode()
#: The place of documents without an id in the order of ids.
LAST = (1 << 63) - 1
WIDE = np.dtype([("hi", np.uint64), ("lo", np.uint64)])


def line_keys(text: str) -> list[bytes]:
    return [line.strip(EDGE).lower() for line in text.encode().split(b"\n")]  # bytes.lower() knows A-Z only


def counts_as_line(key: bytes) -> bool:
    return len(key) >= LEAST and (len(key) >= 4 * LEAST or len(key.decode()) >= LEAST)


def _spread(hi: np.ndarray, lo: np.ndarray, level: int) -> np.ndarray:
    x = (lo ^ (hi >> np.uint64(29))) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash over distinct 128-bit keys: sizes of the levels, and their bits."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.rank = np.concatenate([[0], np.cumsum(bits)])

    @classmethod
    def over(cls, hi: np.ndarray, lo: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        while len(hi):
            size = max(64, 2 * len(hi))
            at = (_spread(hi, lo, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = ~alone[at]
            hi, lo = hi[left], lo[left]
        return cls(np.array(sizes, np.int64), np.concatenate(levels) if levels else np.zeros(0, bool))

    def index(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The index of each key; -1, or some key's index, for a key that is not in the set."""
        out, open_, base = np.full(len(hi), -1, np.int64), np.arange(len(hi)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = base + (_spread(hi[open_], lo[open_], level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[at]
            out[open_[hit]] = self.rank[at[hit]]
            open_, base = open_[~hit], base + size
        return out


def _distinct(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the keys by value, and where each distinct key starts in it."""
    order = np.lexsort((lo, hi))
    h, m = hi[order], lo[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (m[1:] != m[:-1])
    return order, np.flatnonzero(new)


def blocks(docs: DataFrame) -> DataFrame:
    """One row for each block of documents (doc_id, text, k1, k2): their packed numbers, names and counts of lines that
    count, and those lines' hashes and places in their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in slices(batches, "text", BLOCK):
            hashes, at, counts = [], [], []
            for t in b.column("text").to_pylist():
                before = len(at)
                for i, key in enumerate(line_keys(t or "")):
                    if counts_as_line(key):
                        hashes.append(xxhash.xxh128_digest(key))
                        at.append(i)
                counts.append(len(at) - before)
            ids = b.column("doc_id").fill_null(LAST).to_numpy(zero_copy_only=False)
            names = [b.column(k).to_numpy(zero_copy_only=False) for k in ("k1", "k2")]
            packed = [ids.astype(np.int64), *(n.astype(np.int64) for n in names), np.array(counts, np.int64), np.array(at, np.int64)]
            row = [[number], [len(at)], *([p.tobytes()] for p in packed), [b"".join(hashes)]]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if i < 2 else pa.binary()) for i, x in enumerate(row)], ["block", "n", "ids", "k1", "k2", "counts", "places", "hashes"])
            number += 1

    return docs.mapInArrow(run, "block long, n long, ids binary, k1 binary, k2 binary, counts binary, places binary, hashes binary")


def _keys(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(packed, WIDE)
    return both["hi"], both["lo"]


def line_counts(cut: DataFrame, shards: int) -> DataFrame:
    """shard, hi, lo (the hash), first and last (doc_ids), n (rows that hold the line), summed within each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for packed, ids, counts in zip(b.column("hashes").to_pylist(), b.column("ids").to_pylist(), b.column("counts").to_pylist(), strict=True):
                hi, lo = _keys(packed)
                if not len(hi):
                    continue
                counts = np.frombuffer(counts, np.int64)
                row = np.repeat(np.arange(len(counts)), counts)
                doc = np.frombuffer(ids, np.int64)[row]
                order, starts = _distinct(hi, lo)
                first, last = np.minimum.reduceat(doc[order], starts), np.maximum.reduceat(doc[order], starts)
                # a row counts once for a line that it repeats: rows of equal keys keep their order
                twice = np.zeros(len(order), bool)
                twice[1:] = row[order][1:] == row[order][:-1]
                twice[starts] = False
                n = np.add.reduceat((~twice).astype(np.int64), starts)
                hi, lo = hi[order][starts], lo[order][starts]
                shard = (hi % np.uint64(shards)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shard, hi.view(np.int64), lo.view(np.int64), first, last, n)], ["shard", "hi", "lo", "first", "last", "n"])

    rows = cut.select("hashes", "ids", "counts").mapInArrow(run, "shard long, hi long, lo long, first long, last long, n long")
    return rows.repartition(shards, "shard").groupBy("shard", "hi", "lo").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))


def line_index(counted: DataFrame) -> DataFrame:
    """For each shard its perfect hash (sizes, bits) and the arrays that it indexes (prints, counts, owners)."""

    def build(t: pa.Table) -> pa.Table:
        column = lambda c: t.column(c).to_numpy()
        hi, lo = column("hi").view(np.uint64), column("lo").view(np.uint64)
        found = PerfectHash.over(hi, lo)
        order = np.argsort(found.index(hi, lo))
        # lines of one document count once, however many rows share its doc_id
        n = np.where(column("first") == column("last"), 1, np.maximum(2, column("n")))[order]
        arrays = [found.sizes, np.packbits(found.bits), lo[order].astype(np.uint32), np.minimum(n, 0xFFFFFFFF).astype(np.uint32), column("first")[order]]
        return pa.table([t.column("shard").slice(0, 1), *(pa.array([a.tobytes()], pa.binary()) for a in arrays)], ["shard", "sizes", "bits", "prints", "counts", "owners"])

    return counted.groupBy("shard").applyInArrow(build, "shard long, sizes binary, bits binary, prints binary, counts binary, owners binary")


def _block_keys(packed: bytes, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct hashes by shard and value: hi, lo, shard; the order of its lines and where each hash starts in it."""
    hi, lo = _keys(packed)
    shard = hi % np.uint64(shards)
    order, starts = _distinct(hi, lo)
    by = np.argsort(shard[order[starts]], kind="stable")
    spots = order[starts[by]]
    lengths = np.diff(np.append(starts, len(order)))[by]
    lines = np.concatenate([order[s : s + n] for s, n in zip(starts[by].tolist(), lengths.tolist(), strict=True)]) if len(by) else order
    return hi[spots], lo[spots], shard[spots].astype(np.int64), lines, np.repeat(np.arange(len(by)), lengths)


def probes(cut: DataFrame, shards: int) -> DataFrame:
    """shard, block, n, hashes: a block's distinct hashes of one shard as one packed row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, packed in zip(b.column("block").to_pylist(), b.column("hashes").to_pylist(), strict=True):
                hi, lo, shard, _, _ = _block_keys(packed, shards)
                both = np.empty(len(hi), WIDE)
                both["hi"], both["lo"] = hi, lo
                which, start, n = np.unique(shard, return_index=True, return_counts=True)
                parts = [both[s : s + k].tobytes() for s, k in zip(start.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), pa.array([block] * len(which), pa.int64()), pa.array(n, pa.int64()), pa.array(parts, pa.binary())], ["shard", "block", "n", "hashes"])

    return cut.select("block", "hashes").mapInArrow(run, "shard long, block long, n long, hashes binary")


def answers(asked: DataFrame, index: DataFrame) -> DataFrame:
    """shard, block, which (places among the hashes asked), counts, owners: of those lines that several documents hold."""

    def probe(asks: pa.Table, arrays: pa.Table) -> pa.Table:
        read = lambda c, kind: np.frombuffer(arrays.column(c)[0].as_py(), kind)
        rows = {"shard": [], "block": [], "which": [], "counts": [], "owners": []}
        if arrays.num_rows and asks.num_rows:
            sizes = read("sizes", np.int64)
            found = PerfectHash(sizes, np.unpackbits(read("bits", np.uint8), count=int(sizes.sum())).astype(bool))
            prints, counts, owners = read("prints", np.uint32), read("counts", np.uint32), read("owners", np.int64)
            for block, packed in zip(asks.column("block").to_pylist(), asks.column("hashes"), strict=True):
                hi, lo = _keys(packed.as_py())
                at = found.index(hi, lo)
                which = np.flatnonzero((at >= 0) & (prints[at] == lo.astype(np.uint32)) & (counts[at] > 1))
                if len(which):
                    for name, x in zip(rows, (asks.column("shard")[0].as_py(), block, which.astype(np.int64).tobytes(), counts[at[which]].tobytes(), owners[at[which]].tobytes()), strict=True):
                        rows[name].append(x)
        return pa.table([pa.array(x, pa.int64() if i < 2 else pa.binary()) for i, x in enumerate(rows.values())], list(rows))

    tasks = asked.groupBy(F.col("shard").alias("s")).agg(F.ceil(F.sum("n") / PROBES).alias("parts"))
    mine = asked.join(tasks, F.col("shard") == F.col("s")).withColumn("part", F.pmod(F.xxhash64("block"), "parts")).drop("s", "parts")
    copies = index.join(tasks, F.col("shard") == F.col("s")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("s", "parts")
    return mine.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInArrow(probe, "shard long, block long, which binary, counts binary, owners binary")


def dropped_lines(cut: DataFrame, answered: DataFrame, shards: int) -> DataFrame:
    """k1, k2 (the document), drops (packed places of the lines that go), n_shared (its lines that other documents hold too)."""

    def settle(own: pa.Table, given: pa.Table) -> pa.Table:
        out = {"k1": [], "k2": [], "drops": [], "n_shared": []}
        if own.num_rows and given.num_rows:
            read = lambda c: np.frombuffer(own.column(c)[0].as_py(), np.int64)
            hi, _, shard, lines, key = _block_keys(own.column("hashes")[0].as_py(), shards)
            owner = np.full(len(hi), LAST, np.int64)
            shared = np.zeros(len(hi), bool)
            for s, which, owners in zip(given.column("shard").to_pylist(), given.column("which").to_pylist(), given.column("owners").to_pylist(), strict=True):
                spots = np.searchsorted(shard, s) + np.frombuffer(which, np.int64)
                owner[spots], shared[spots] = np.frombuffer(owners, np.int64), True
            counts = read("counts")
            row = np.repeat(np.arange(len(counts)), counts)
            of_line = np.empty(len(row), np.int64)
            of_line[lines] = key
            gone = owner[of_line] < read("ids")[row]
            places, n = read("places"), np.bincount(row[shared[of_line]], minlength=len(counts))
            ends = np.cumsum(counts)
            for r in np.flatnonzero(n):
                own_lines = slice(ends[r] - counts[r], ends[r])
                for name, x in zip(out, (int(read("k1")[r]), int(read("k2")[r]), places[own_lines][gone[own_lines]].tobytes(), int(n[r])), strict=True):
                    out[name].append(x)
        return pa.table([pa.array(x, pa.binary() if c == "drops" else pa.int64()) for c, x in out.items()], list(out))

    return cut.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(settle, "k1 long, k2 long, drops binary, n_shared long")


def drop_lines(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, text (what is left of it), n_lines (before dropping), n_dropped, n_shared (lines of the row
    that other documents hold too, dropped or not)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # two 64-bit hashes name a document by its id and text, so that equal rows share their answer
    rows = rows.withColumn("k1", F.xxhash64("doc_id", "text")).withColumn("k2", F.xxhash64(F.lit("lines"), "text", "doc_id"))
    cut = materialize(blocks(rows), "blocks")
    shards = max(1, -(-(cut.agg(F.sum("n")).first()[0] or 0) // SHARD))
    index = materialize(line_index(line_counts(cut, shards)), "line-index")
    asked = materialize(probes(cut, shards), "probes")
    drops = materialize(dropped_lines(cut, answers(asked, index), shards).dropDuplicates(["k1", "k2"]), "drops")
    release(cut, index, asked)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", BLOCK):
            kept, lines, dropped = [], [], []
            for t, d in zip(b.column("text").to_pylist(), b.column("drops").to_pylist(), strict=True):
                gone = set(np.frombuffer(d, np.int64).tolist()) if d else ()
                lines.append((t or "").count("\n") + 1)
                dropped.append(len(gone))
                kept.append("\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone) if gone else t or "")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), b.column("n_shared").fill_null(0)], ["doc_id", "text", "n_lines", "n_dropped", "n_shared"])

    return rows.join(drops, ["k1", "k2"], "left").select("doc_id", "text", "drops", "n_shared").mapInArrow(finish, "doc_id long, text string, n_lines long, n_dropped long, n_shared long")


def line_report(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_lines, n_dropped, n_shared, kept_sha256 (of what is left, as UTF-8)."""
    return drop_lines(docs).select("doc_id", "n_lines", "n_dropped", "n_shared", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
