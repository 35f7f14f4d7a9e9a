"""Quality rules: an isolation forest over rule statistics, its threshold calibrated on labelled rows.

Random trees split all labelled documents on the rule statistics. A document whose mean path is short is unusual; the
score at which documents are rejected is the one that best separates all rows of the labelled classes. Statistics,
scores and verdicts cover every whole text.

Defined cases: a null or empty text has no words and is rejected (base_failed); without labelled rows of both classes
only the base rule decides; repeated rows each get their row; labels that are null or point nowhere are ignored; extra
columns never clash, as only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release, slices

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What the forest splits on, see statistics().
RATIOS = ["word_length", "symbol_share", "dup_share", "repeat_share", "upper_share", "mark_share"]
TREES, SEED = 128, 7
#: Trees grow as deep as one on this many rows would; what a leaf holds beyond that lengthens its path.
GROWN = 256
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
PUNCTUATION = b"!?#*$%&|<>@^~=+_/\\{}[]"
BLOCK = 8 << 20


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    first = ids[:-2] * len(known) + ids[1:-1]
    if len(known) > 1_000_000:  # keep the combined key inside 64 bits
        first = np.unique(first, return_inverse=True)[1]
    _, at, count = np.unique(first * len(known) + ids[2:], return_inverse=True, return_counts=True)
    twice = count[at] > 1
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift : shift + len(twice)] |= twice
    return int(covered.sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The contract's counts, and the ratios that the forest splits on."""
    data = (text or "").encode()
    words = data.split()  # on bytes: exactly the six ASCII white-space characters
    n = len(words)
    chars = len(text or "") - sum(data.count(s) for s in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    lines = dups = 0
    for line in data.split(b"\n"):
        if line.strip():
            lines += 1
            dups += line in seen
            seen.add(line)
    repeats = repeated_words(words)
    upper, marks = (len(data) - len(data.translate(None, x)) for x in (UPPER, PUNCTUATION))
    c, w = max(chars, 1), max(n, 1)
    ratios = [chars / w, symbols / c, dups / max(lines, 1), repeats / w, upper / c, marks / c]
    # the square root spreads small ratios, where ordinary and unusual texts differ
    return [n, chars, symbols, dups, repeats], [math.sqrt(x) for x in ratios]


def _average_path(n: float) -> float:
    """Mean path of an unsuccessful search in a binary tree of n points, the usual normaliser of isolation forests."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _split(key: tuple[int, int, int], n: int, low: np.ndarray, high: np.ndarray, open_: bool) -> tuple[int, float] | None:
    """Feature and cut of a node (seed, tree, place: the root 1, the children of p 2p and 2p + 1), None for a leaf. It depends on
    its rows by their number and ranges alone, so any way of counting them grows the same tree."""
    usable = np.flatnonzero(high > low)
    if not open_ or n < 2 or not len(usable):
        return None
    rng = np.random.default_rng(key)
    f = int(rng.choice(usable))
    cut = float(rng.uniform(low[f], high[f]))
    return f, cut if cut < high[f] else float(low[f])


def _limit(n: int) -> int:
    """The deepest level of a forest on n rows."""
    return math.ceil(math.log2(max(min(n, GROWN), 2))) + 2


def _arrays(nodes: dict[int, tuple[int, float, float]]) -> tuple[np.ndarray, ...]:
    """A tree from its nodes by place, the root first."""
    at = {place: i for i, place in enumerate(sorted(nodes))}
    rows = [(f, cut, at.get(2 * place, 0), at.get(2 * place + 1, 0), path) for place, (f, cut, path) in sorted(nodes.items())]
    f, cut, left, right, path = np.array(rows, float).T
    return f.astype(int), cut, left.astype(int), right.astype(int), path


def fit_forest(rows: np.ndarray, trees: int = TREES, sample: int = 256, seed: int = SEED) -> list[tuple[np.ndarray, ...]]:
    """Trees as arrays (feature or -1, threshold, left, right, path length at the leaf), from rows in memory; each takes `sample`
    of them, or all. grow_forest grows the same trees on all rows of a table."""
    forest = []
    for tree in range(trees):
        start = rows if len(rows) <= sample else rows[np.random.default_rng((seed, tree)).permutation(len(rows))[:sample]]
        nodes: dict[int, tuple[int, float, float]] = {}

        def grow(x: np.ndarray, place: int, depth: int) -> None:
            split = _split((seed, tree, place), len(x), x.min(0), x.max(0), depth < _limit(len(start)))
            nodes[place] = (*(split or (-1, 0.0)), depth + _average_path(len(x)))
            if split:
                low = x[:, split[0]] <= split[1]
                grow(x[low], 2 * place, depth + 1)
                grow(x[~low], 2 * place + 1, depth + 1)

        grow(start, 1, 0)
        forest.append(_arrays(nodes))
    return forest


def _places(splits: list[dict[int, tuple[int, float]]], depth: int, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """tree, rows, places: the rows that are in a node of this depth."""
    for tree, known in enumerate(splits):
        f, cut = np.full(1 << depth, -1), np.zeros(1 << depth)
        for place, (a, b) in known.items():
            f[place], cut[place] = a, b
        rows, place = np.arange(len(x)), np.ones(len(x), np.int64)
        for _ in range(depth):
            inner = f[place] >= 0
            rows, place = rows[inner], place[inner]
            place = 2 * place + (x[rows, f[place]] > cut[place])
        if len(rows):
            yield tree, rows, place


def grow_forest(rows: DataFrame, trees: int = TREES, seed: int = SEED) -> list[tuple[np.ndarray, ...]]:
    """The forest on all rows of a table (ratios), level by level: tasks count their rows in each open node and find their ranges,
    Spark adds those up, and the driver draws the splits. It sees the nodes, 2^11 a tree at most, and no row."""
    width = len(RATIOS)
    splits: list[dict[int, tuple[int, float]]] = [{} for _ in range(trees)]
    nodes: list[dict[int, tuple[int, float, float]]] = [{} for _ in range(trees)]
    depth, limit = 0, 1
    columns = [f"low{k}" for k in range(width)] + [f"high{k}" for k in range(width)]
    while depth <= limit:
        known, level = splits, depth

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shape = (trees, 1 << level)
            n, low, high = np.zeros(shape, np.int64), np.full((*shape, width), np.inf), np.full((*shape, width), -np.inf)
            for b in batches:
                x = _matrix(b)
                for tree, held, place in _places(known, level, x):
                    order = np.argsort(place, kind="stable")
                    at, starts, many = np.unique(place[order], return_index=True, return_counts=True)
                    at, inside = at - (1 << level), x[held[order]]
                    n[tree, at] += many
                    low[tree, at] = np.minimum(low[tree, at], np.minimum.reduceat(inside, starts))
                    high[tree, at] = np.maximum(high[tree, at], np.maximum.reduceat(inside, starts))
            tree, at = np.nonzero(n)
            data = [tree, at + (1 << level), n[tree, at], *low[tree, at].T, *high[tree, at].T]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in data], ["tree", "place", "n", *columns])

        found = rows.mapInArrow(count, "tree long, place long, n long, " + ", ".join(f"{c} double" for c in columns))
        sums = [F.sum("n").alias("n"), *[(F.min if c.startswith("low") else F.max)(c).alias(c) for c in columns]]
        got = found.groupBy("tree", "place").agg(*sums).collect()
        if depth == 0:
            limit = _limit(got[0]["n"])
        grown = 0
        for r in got:
            ranges = np.array(r[3:], float)
            split = _split((seed, r["tree"], r["place"]), r["n"], ranges[:width], ranges[width:], depth < limit)
            nodes[r["tree"]][r["place"]] = (*(split or (-1, 0.0)), depth + _average_path(r["n"]))
            if split:
                splits[r["tree"]][r["place"]] = split
                grown += 1
        if not grown:
            break
        depth += 1
    return [_arrays(x) for x in nodes]


def forest_scores(forest: list[tuple[np.ndarray, ...]], rows: np.ndarray, sample: int) -> np.ndarray:
    """Anomaly score 2^(-mean path / normal path), in 0..1; high is unusual."""
    total = np.zeros(len(rows))
    lane = np.arange(len(rows))
    for f, cut, left, right, path in forest:
        at = np.zeros(len(rows), int)
        while (inner := f[at] >= 0).any():
            step = np.where(rows[lane, np.maximum(f[at], 0)] <= cut[at], left[at], right[at])
            at = np.where(inner, step, at)
        total += path[at]
    return np.exp2(-total / len(forest) / max(_average_path(sample), 1e-9))


def calibrate(scores: np.ndarray, good: np.ndarray) -> float:
    """The score above which a document goes: best mean of the share of good rows kept and of bad rows caught; of
    equal cuts the highest, taken midway to the next score."""
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], good[order]
    kept = np.cumsum(g) / max(g.sum(), 1)
    caught = 1 - np.cumsum(~g) / max((~g).sum(), 1)
    value = np.where(np.append(s[1:] > s[:-1], True), kept + caught, -1.0)
    best = int(np.flatnonzero(value >= value.max() - 1e-12)[-1])
    return float((s[best] + s[min(best + 1, len(s) - 1)]) / 2)


def fit_cut(scored: DataFrame) -> float:
    """calibrate() for a table (score, good): each score's rows are counted, scores are dealt by ranges, and each range starts from
    the sums of those before it. Shares are compared as whole numbers. Only the ranges' sums reach the driver."""
    by = scored.groupBy("score").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    dealt = materialize(by.repartitionByRange("score").withColumn("p", F.spark_partition_id()), "scores")
    good = bad = 0
    starts = []
    for r in sorted(dealt.groupBy("p").agg(F.sum("g").alias("g"), F.sum("b").alias("b")).collect()):
        starts.append((r["p"], good, bad))
        good, bad = good + r["g"], bad + r["b"]
    before = dealt.sparkSession.createDataFrame(starts, "p int, _g long, _b long")
    upto = Window.partitionBy("p").orderBy("score").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value = (F.col("_g") + F.sum("g").over(upto)) * F.lit(bad) - (F.col("_b") + F.sum("b").over(upto)) * F.lit(good)
    best = dealt.join(F.broadcast(before), "p").select("score", value.alias("value")).agg(F.max(F.struct("value", "score"))).first()[0]["score"]
    after = dealt.where(F.col("score") > best).agg(F.min("score")).first()[0]
    release(dealt)
    return (best + (best if after is None else after)) / 2


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the five counts and the six ratios of every row of docs, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", BLOCK):
            found = [statistics(t) for t in b.column("text").to_pylist()]
            columns = [pa.array([c[k] for c, _ in found], pa.int64()) for k in range(len(STATS))] + [pa.array([r[k] for _, r in found], pa.float64()) for k in range(len(RATIOS))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", *STATS, *RATIOS])

    schema = "doc_id long, " + ", ".join(f"{s} long" for s in STATS) + ", " + ", ".join(f"{r} double" for r in RATIOS)
    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema), "measured")


def fit_quality(stats: DataFrame, labels: DataFrame) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Fit the forest and its cut on every labelled row of stats (measured)."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("_q")).where("doc_id is not null and _q in (0, 1)")
    picked = own.groupBy("doc_id").agg((F.min("_q") == 1).alias("good"))
    rows = materialize(stats.select("doc_id", *RATIOS).join(picked, "doc_id").select(*RATIOS, "good"), "labelled")
    if rows.agg(F.count_distinct("good")).first()[0] < 2:
        release(rows)
        return lambda x: (np.zeros(len(x)), np.ones(len(x), bool))
    size, forest = rows.count(), grow_forest(rows.select(*RATIOS))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(forest_scores(forest, _matrix(b), size)), b.column("good")], ["score", "good"])

    cut = fit_cut(rows.mapInArrow(score, "score double, good boolean"))
    release(rows)

    def verdict(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = forest_scores(forest, x, size)
        return s, s <= cut

    return verdict


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([b.column(r).to_numpy() for r in RATIOS]) if b.num_rows else np.zeros((0, len(RATIOS)))


def _failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, the five counts, base_failed, kept, and the forest's score."""
    stats = measured(docs)
    verdict = fit_quality(stats, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score, fine = verdict(_matrix(b))
            failed = _failed(b.column("n_words").to_numpy(), b.column("n_repeat_words").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[b.column(s) for s in STATS], pa.array(failed), pa.array(fine & ~failed), pa.array(score)], ["doc_id", *STATS, "base_failed", "kept", "score"])

    schema = "doc_id long, " + ", ".join(f"{s} long" for s in STATS) + ", base_failed boolean, kept boolean, score double"
    return stats.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns; texts are read once to fit and once to filter."""
    stats = measured(docs)
    verdict = fit_quality(stats, labels)
    release(stats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", BLOCK):
            found = [statistics(t) for t in b.column("text").to_pylist()]
            counts = np.array([c for c, _ in found]).reshape(len(found), -1)
            fine = verdict(np.array([r for _, r in found]).reshape(len(found), -1))[1]
            yield b.filter(pa.array(fine & ~_failed(counts[:, 0], counts[:, 4])))

    return docs.mapInArrow(run, docs.schema)
