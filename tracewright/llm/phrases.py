"""Phrase collocations by hash-filtered passes (PCY, with the trimming of DHP).

Every pass reads all texts. While it counts its own n-grams exactly, it also counts the next length's n-grams in a fixed
number of hash buckets (2 ** BITS of one byte, which stop at the least count: enough to tell whether a bucket can hold a
frequent phrase). The buckets of all tasks are summed slice by slice and become a bitmap of one bit each, which is
broadcast; its size is a parameter and does not grow with the data. The next pass counts an n-gram exactly only if its
bucket's bit is set and its parts are frequent (Apriori, by a bitmap of the frequent (n-1)-grams under the same hash):

    pass 1   words exactly                                          two-word buckets
    pass 2   two words: both frequent, bucket set                   three-word buckets of what passes
    pass 3   three words: both pairs frequent, bucket set

Bits that are set by other n-grams only let more be counted; counts are exact and are cut at the least count afterwards.

A candidate's cuts are joined with the counts of their parts. A phrase is dropped if a longer one that holds it has at least
half its count.

Defined cases: a null lang is `und` and a null text is empty; repeated rows count again; a text of any length is taken apart
between pieces, a longer piece alone; ties fall by score, count and phrase as UTF-8 bytes; an empty table gives no rows;
extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, release, slices

LEAST = 10
TOP = 2000
#: Parts of a lang that are ranked apart first, so that the last ranking reads TOP rows of each at most.
RANKED = 16
#: Buckets of a pass: 2 ** BITS bytes in each task, an eighth of that in the bitmap that is broadcast.
BITS = 25
#: Buckets of one row on the way between tasks.
SLICE = 1 << 16
BLOCK = 2 << 20
#: Words, or phrases, that a task remembers before it passes their counts on.
MANY = 400_000
#: The characters that end a piece become line ends, a tab a blank; A-Z lower-cased.
TABLE = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
NONE, END = 0, 1
#: Words whose numbers fit three into one.
NUMBERS = 1 << 21


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slots(bits: int, lang: str, *words: np.ndarray) -> np.ndarray:
    """The buckets of n-grams given by their words' hashes."""
    x = np.full(1, xxhash.xxh64_intdigest(lang), np.uint64)
    for h in words:
        x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + h)
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def _cut(texts: list[str], block: int) -> Iterator[bytes]:
    """The texts' pieces on lines of their own, in runs of about `block` bytes."""
    data = "\n".join(texts).encode().translate(TABLE)
    start = 0
    while len(data) - start > 2 * block and (end := data.find(b"\n", start + block)) >= 0:
        yield data[start:end]
        start = end + 1
    yield data[start:] if start else data


class Words(dict):
    """Words by number, in order of first sight, with their hashes."""

    def __init__(self):
        super().__init__({b"": NONE, b"\n": END})
        self.hashes = np.zeros(2, np.uint64)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def numbers(self, data: bytes) -> np.ndarray:
        parts = data.replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(self.__getitem__, parts), np.int64, len(parts))
        if len(self) > len(self.hashes):
            fresh = list(self)[len(self.hashes) :]
            self.hashes = np.append(self.hashes, np.array([xxhash.xxh64_intdigest(w) for w in fresh], np.uint64))
        return ids[ids != NONE]


class Tally:
    """Counts of packed keys, summed up whenever many have come together."""

    def __init__(self):
        self.keys, self.counts, self.waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), []

    def add(self, keys: np.ndarray) -> None:
        if len(keys):
            self.waiting.append(np.unique(keys, return_counts=True))
            if sum(len(k) for k, _ in self.waiting) > max(MANY, len(self.keys)):
                self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if self.waiting:
            keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
            counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
            self.keys, at = np.unique(keys, return_inverse=True)
            self.counts, self.waiting = np.bincount(at, counts, len(self.keys)).astype(np.int64), []
        return self.keys, self.counts


class Buckets:
    """Counts by bucket that stop at the least count, so that sums of several tasks' counts reach it if and only if the whole does."""

    def __init__(self, bits: int):
        self.size, self.n = 1 << bits, None

    def add(self, slots: np.ndarray, least: int) -> None:
        if len(slots):
            if self.n is None:
                self.n = np.zeros(self.size, np.uint8)
            at, n = np.unique(slots, return_counts=True)
            self.n[at] = np.minimum(self.n[at] + np.minimum(n, least), least)

    def rows(self) -> Iterator[tuple[int, bytes]]:
        if self.n is not None:
            press = zstandard.ZstdCompressor(level=1)
            for i in range(0, self.size, SLICE):
                part = self.n[i : i + SLICE]
                if part.any():
                    yield i // SLICE, press.compress(part.tobytes())


SCHEMA = "lang string, phrase string, n long, slice long, data binary"


def _batch(langs: list, phrases: list, counts: list, slot: list = (), data: list = ()) -> pa.RecordBatch:
    none = [None] * len(slot)
    columns = [pa.array([*langs, *none], pa.string()), pa.array([*phrases, *none], pa.string()), pa.array([*counts, *none], pa.int64()), pa.array([None] * len(langs) + list(slot), pa.int64()), pa.array([None] * len(langs) + list(data), pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "n", "slice", "data"])


def counted(rows: DataFrame, size: int, least: int = LEAST, buckets: np.ndarray | None = None, parts: np.ndarray | None = None, bits: int = BITS) -> DataFrame:
    """Pass `size` over texts (lang, text): rows of counts (lang, phrase, n), summed within a task, and rows of buckets
    (slice, data) of the next length. buckets and parts are the bitmaps that let an n-gram of more than one word be counted."""
    given = rows.sparkSession.sparkContext.broadcast((buckets, parts))  # 2 ** (bits - 3) bytes each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, after, tallies, wide = Words(), Buckets(bits), {}, []
        allowed, frequent = given.value

        def has(marks: np.ndarray, slots: np.ndarray) -> np.ndarray:
            return (marks[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8) & 1).astype(bool)

        def take(lang: str, ids: np.ndarray) -> None:
            tally = tallies.setdefault(lang, Tally())
            h = known.hashes
            if size == 1:
                tally.add(ids[ids != END])
                two = np.flatnonzero((ids[:-1] != END) & (ids[1:] != END))
                after.add(_slots(bits, lang, h[ids[two]], h[ids[two + 1]]), least)
                return
            if size == 2:
                word = (ids != END) & has(frequent, _slots(bits, lang, h[ids]))
                two = np.flatnonzero(word[:-1] & word[1:])
                two = two[has(allowed, _slots(bits, lang, h[ids[two]], h[ids[two + 1]]))]
                tally.add(ids[two] << 32 | ids[two + 1])
                three = two[:-1][np.diff(two) == 1]
                after.add(_slots(bits, lang, h[ids[three]], h[ids[three + 1]], h[ids[three + 2]]), least)
                return
            two = np.flatnonzero((ids[:-1] != END) & (ids[1:] != END))
            two = two[has(frequent, _slots(bits, lang, h[ids[two]], h[ids[two + 1]]))]
            three = two[:-1][np.diff(two) == 1]
            three = three[has(allowed, _slots(bits, lang, h[ids[three]], h[ids[three + 1]], h[ids[three + 2]]))]
            if len(known) <= NUMBERS:
                tally.add(ids[three] << 42 | ids[three + 1] << 21 | ids[three + 2])
            else:  # a piece of millions of words: too many for three numbers in one
                wide.append((lang, *np.unique(np.stack([ids[three + j] for j in range(3)], axis=1), axis=0, return_counts=True)))

        def flush() -> Iterator[pa.RecordBatch]:
            words = list(known)
            shift = 32 if size == 2 else 21
            for lang, tally in tallies.items():
                keys, n = tally.total()
                for i in range(0, len(keys), 100_000):
                    own = keys[i : i + 100_000]
                    spelled = [[words[k] for k in (own >> shift * (size - 1 - j) & (1 << shift) - 1 if size > 1 else own).tolist()] for j in range(size)]
                    yield _batch([lang] * len(own), [b" ".join(w).decode() for w in zip(*spelled, strict=True)], n[i : i + 100_000].tolist())
            for lang, keys, n in wide:
                yield _batch([lang] * len(keys), [b" ".join(words[k] for k in row).decode() for row in keys.tolist()], n.tolist())
            tallies.clear()
            wide.clear()

        for b in batches:
            for part in slices([b], "text", BLOCK):
                by_lang: dict[str, list[str]] = {}
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                    by_lang.setdefault(lang, []).append(text)
                for lang, texts in by_lang.items():
                    for data in _cut(texts, BLOCK):
                        take(lang, known.numbers(data))
                        if len(known) > MANY or sum(len(t.keys) for t in tallies.values()) > MANY:
                            yield from flush()
                            known = Words() if len(known) > MANY else known
        yield from flush()
        for i, data in after.rows():
            yield _batch([], [], [], [i], [data])

    return rows.mapInArrow(run, SCHEMA)


def _gathered(rows: DataFrame, least: int, bits: int = BITS) -> np.ndarray:
    """The bitmap of the buckets that reach the least count, from rows (slice, data) of any number of tasks."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # of this task's share of the slices
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for i, data in zip(b.column("slice").to_pylist(), b.column("data"), strict=True):
                n = np.frombuffer(unpack.decompress(data.as_py()), np.uint8)
                sums[i] = np.minimum(sums[i] + n, least).astype(np.uint8) if i in sums else n
        packed = {i: np.packbits(n >= least).tobytes() for i, n in sums.items() if n.max() >= least}
        yield pa.RecordBatch.from_arrays([pa.array(list(packed), pa.int64()), pa.array(list(packed.values()), pa.binary())], ["slice", "data"])

    out = np.zeros(1 << bits >> 3, np.uint8)
    own = rows.repartition(partitions(rows.sparkSession), "slice").mapInArrow(merge, "slice long, data binary")
    for row in own.collect():  # one bit a bucket in all
        out[row["slice"] * SLICE // 8 : (row["slice"] + 1) * SLICE // 8] = np.frombuffer(row["data"], np.uint8)
    return out


def _frequent(grams: DataFrame, bits: int = BITS) -> np.ndarray:
    """The bitmap of n-grams (lang, phrase) under the buckets' hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Buckets(bits)
        for b in batches:
            by_lang: dict[str, list[str]] = {}
            for lang, phrase in zip(b.column("lang").to_pylist(), b.column("phrase").to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(phrase)
            for lang, phrases in by_lang.items():
                words = zip(*(p.encode().split(b" ") for p in phrases), strict=True)
                marks.add(_slots(bits, lang, *(np.array([xxhash.xxh64_intdigest(w) for w in at], np.uint64) for at in words)), 1)
        for i, data in marks.rows():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([data], pa.binary())], ["slice", "data"])

    return _gathered(grams.select("lang", "phrase").mapInArrow(run, "slice long, data binary"), 1, bits)


def frequent_phrases(docs: DataFrame, least: int = LEAST, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """Phrases of one to three words found at least `least` times in their lang (lang, phrase, words, n), and all word
    occurrences by lang (lang, n)."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found, totals, allowed, parts = None, None, None, None
    for size in (1, 2, 3):
        # each pass is written, as its counts and its buckets are read apart
        one = materialize(counted(rows, size, least, allowed, parts, bits), f"phrases{size}")
        counts = one.where("slice is null").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        if size == 1:
            totals = materialize(one.where("slice is null").groupBy("lang").agg(F.sum("n").alias("n")), "words")
        own = materialize(counts.where(F.col("n") >= least), f"frequent{size}")
        if size < 3:
            allowed, parts = _gathered(one.where("slice is not null").select("slice", "data"), least, bits), _frequent(own, bits)
        release(one)
        own = own.withColumn("words", F.lit(size))
        found = own if found is None else found.unionByName(own)
    return found, totals


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a (its count), l and r (the counts of its weakest cut's parts), n (the lang's words), score."""
    grams, totals = frequent_phrases(docs, least, bits)
    word = F.split("phrase", " ")
    join = lambda first, size: F.array_join(F.slice(word, first, size), " ")
    many = grams.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))
    cuts = many.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "words", "k", join(F.lit(1), F.col("k")).alias("left"), join(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    for side, count in (("left", "l"), ("right", "r")):
        cuts = cuts.join(grams.select("lang", F.col("phrase").alias(side), F.col("n").alias(count)), ["lang", side])
    exact = lambda c: f"cast({c} as decimal(15, 0))"  # noqa: E731  (a million times two counts of 15 digits has 36)
    score = F.expr(f"cast(cast(1000000 as decimal(7, 0)) * {exact('a')} * {exact('a')} div ({exact('l')} * {exact('r')}) as bigint)")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "words").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # of the phrases that hold another one, the most frequent decides
    longer = many.where("words = 3").select("lang", "a", F.explode(F.array(join(F.lit(1), F.lit(2)), join(F.lit(2), F.lit(2)))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("above"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(~F.coalesce(100 * F.col("above") >= 50 * F.col("a"), F.lit(False)))
    best = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANKED)))
    place = lambda *keys: F.row_number().over(Window.partitionBy("lang", *keys).orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))).cast("long")
    best = best.withColumn("rank", place("part")).where(F.col("rank") <= top)
    best = best.withColumn("rank", place()).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
