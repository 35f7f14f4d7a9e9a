"""Language identification by rank order.

Each language's profile lists its most frequent character n-grams (one to three letters, words padded with a blank) in
order of frequency, counted over all training documents. A document's own n-grams are ranked the same way; its distance
to a profile is the sum over them of how far each is out of place, and n-grams that a profile lacks cost the most.

Defined cases: `und` with score 0 for a null text, a text without a letter, or where nothing was learned; equal
distances go to the first language in code-point order, equal frequencies to the smaller n-gram; repeated rows each
count and each get their row; extra columns never clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices

#: A word: letters and the marks on them; numbers that are no digits (as in fractions) are no letters.
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*+")
TOP = 300
BLOCK = 4 << 20
SALTS = 16
#: Distinct words that a task counts before it hands on their n-grams.
HELD = 400_000


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the words as integers that order like their strings, and the word each comes from."""
    text = np.array([ord(c) for w in words for c in f" {w} "], np.int64)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = np.repeat(sizes, sizes) - place  # code points up to the word's end
    one = text != 32
    keys, owners = [text[one] << 42], [owner[one]]
    two = np.flatnonzero(left >= 2)
    keys.append(text[two] << 42 | text[two + 1] << 21)
    owners.append(owner[two])
    three = np.flatnonzero(left >= 3)
    keys.append(text[three] << 42 | text[three + 1] << 21 | text[three + 2])
    owners.append(owner[three])
    return np.concatenate(keys), np.concatenate(owners)


def count_grams(rows: DataFrame) -> DataFrame:
    """lang, gram, n over rows (lang, text); each task counts words first and takes their n-grams apart once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, words in held.items():
                if words:
                    key, owner = grams(list(words))
                    weight = np.fromiter(words.values(), np.int64, len(words))[owner]
                    found, at = np.unique(key, return_inverse=True)
                    n = np.bincount(at, weights=weight, minlength=len(found)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(n)], ["lang", "gram", "n"])
            held.clear()

        for b in slices(batches, "text", BLOCK):
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                held.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
            if sum(map(len, held.values())) > HELD:
                yield from flush()
        yield from flush()

    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(rows: DataFrame, top: int = TOP) -> dict[str, list[int]]:
    """The profiles: at most `top` n-grams for each language, the only data that goes to the driver and to every task."""
    order = [F.desc("n"), F.asc("gram")]
    first = Window.partitionBy("lang", F.pmod("gram", F.lit(SALTS))).orderBy(*order)
    second = Window.partitionBy("lang").orderBy(*order)
    best = count_grams(rows).withColumn("k", F.row_number().over(first)).where(F.col("k") <= top)
    best = best.withColumn("k", F.row_number().over(second)).where(F.col("k") <= top)
    out: dict[str, list[int]] = {}
    for r in sorted(best.select("lang", "k", "gram").collect()):
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


def predict(texts: list[str | None], profiles: dict[str, list[int]], top: int = TOP) -> list[tuple[str, float]]:
    langs = sorted(profiles)
    split = [LETTERS.findall(t.lower()) if t else [] for t in texts]
    known: dict[str, int] = {}
    words = [np.fromiter((known.setdefault(w, len(known)) for w in s), np.int64, len(s)) for s in split]
    if not known or not langs:
        return [("und", 0.0)] * len(texts)
    key, owner = grams(list(known))
    vocabulary, gram = np.unique(key, return_inverse=True)
    sort = np.argsort(owner, kind="stable")
    gram, size = gram[sort], np.bincount(owner, minlength=len(known))
    start = np.cumsum(size) - size
    place = np.full((len(langs), len(vocabulary)), top, np.int64)
    for row, lang in enumerate(langs):
        at = np.searchsorted(vocabulary, profiles[lang])
        for rank, (i, g) in enumerate(zip(at.tolist(), profiles[lang], strict=True)):
            if i < len(vocabulary) and vocabulary[i] == g:
                place[row, i] = rank
    out = []
    for ids in words:
        if not len(ids):
            out.append(("und", 0.0))
            continue
        own, times = np.unique(ids, return_counts=True)
        n = size[own]
        steps = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[own], n)
        counts = np.bincount(gram[steps], weights=np.repeat(times, n), minlength=len(vocabulary))
        found = np.flatnonzero(counts)
        if len(found) > top:  # all that may tie with the last place stay
            bar = np.partition(counts[found], len(found) - top)[len(found) - top]
            found = found[counts[found] >= bar]
        ranked = found[np.argsort(-counts[found], kind="stable")][:top]
        far = np.where(place[:, ranked] == top, top, np.abs(place[:, ranked] - np.arange(len(ranked)))).sum(1)
        best = int(far.argmin())
        out.append((langs[best], 1 - float(far[best]) / (top * len(ranked))))
    return out


def identify(docs: DataFrame, top: int = TOP) -> DataFrame:
    """Per row of docs: doc_id, held_out (crc32 of doc_id as text leaves 2 by 4), lang_pred, score.

    Profiles come from the text and lang of rows that are not held out; a prediction sees text alone."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.coalesce(held, F.lit(False)).alias("held_out"))
    profiles = learn(rows.where("not held_out and text is not null and lang is not null").select("lang", "text"), top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", BLOCK):
            got = predict(b.column("text").to_pylist(), profiles, top)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.select("doc_id", "text", "held_out").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
