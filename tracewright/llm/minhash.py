"""Near-duplicate documents by improved consistent weighted sampling.

A document is the weighted set of its five-word shingles. A shingle weighs its count in the document times the mean
inverse document frequency of its words, in place of its own. Word frequencies count every document; all words that at
least one document in FLOOR holds get their own value, and all rarer words that of the floor. So the table that every task
needs has at most FLOOR times the mean number of distinct words of a document, and means the same at any corpus size.

Consistent weighted sampling draws for each hash k and shingle with weight w the variables r, c ~ Gamma(2, 1) and
b ~ U(0, 1), all functions of (k, shingle) alone, and keeps the shingle and level t = floor(ln w / r + b) that minimise
c / exp(r (t - b + 1)). Two documents keep the same with a probability equal to their weighted Jaccard similarity.
ROWS samples form a band; documents that agree in a band are compared, and a pair links if its weighted Jaccard
similarity, from whole texts, is at least the threshold.

Within a band's bucket, up to SMALL texts are all compared. In a larger one each is compared with two centres, and
again with two centres in each finer bucket of two bands that are both large; so work grows in step with the bucket. One
centre is the text with the largest buckets, which stands nearest to the middle of a group of copies, so that a large
group hangs together through it; the other is drawn by hash. Equal texts are compared once. Classes are connected components.
What the centres leave apart is then compared in full: in a large bucket whose texts lie in several classes, each text
outside the bucket's largest class meets every text of another class, block by block. So the classes are those of
comparing every two texts that share a bucket, and a bucket that hangs together costs nothing more.

Defined cases: a null text or one without words is a class of its own; a text of fewer than five words is one shingle;
rows that share a doc_id are one document to components; repeated rows each get their row; an empty table gives no
rows; extra columns never clash. A class is named by its smallest doc_id, which is kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices
from .components import connected_components

SHINGLE, BANDS, ROWS = 5, 10, 3
FLOOR = 10_000
SMALL = 24
#: Texts near the middle with which all others of a large bucket are compared.
MIDDLES = 8
BLOCK = 3 << 20
#: Texts of a large bucket that meet as many others in one task.
MEET = 256
#: Shingles worked on at a time, so that all arrays stay in the processor's cache.
PIECE = 1 << 15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_counts(docs: DataFrame) -> DataFrame:
    """word (64-bit hash), n: how many documents hold it; and under word null the number of documents with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        n = 0

        def flush() -> pa.RecordBatch:
            words = pa.array([xxhash.xxh64_intdigest(w) - (1 << 63) for w in counts] + [None], pa.int64())
            return pa.RecordBatch.from_arrays([words, pa.array([*counts.values(), n], pa.int64())], ["word", "n"])

        for b in slices(batches, "text", BLOCK):
            for t in b.column("text").to_pylist():
                if t and (words := t.encode().split()):
                    counts.update(set(words))
                    n += 1
            if len(counts) > 400_000:
                yield flush()
                counts.clear()
                n = 0
        yield flush()

    return docs.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def word_weights(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted hashes of the common words, their inverse document frequencies 1 + ln(N / n), and that of all others."""
    counts = materialize(word_counts(docs), "words")
    total = counts.where("word is null").agg(F.sum("n")).first()[0] or 0
    least = max(1, -(-total // FLOOR))
    rows = counts.where(f"word is not null and n >= {least}").select("word", "n").toArrow()
    if not rows.num_rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.float32), 1.0
    words = rows.column("word").to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
    order = np.argsort(words)
    idf = 1 + np.log(total / rows.column("n").to_numpy().astype(np.float64))
    return words[order], idf[order].astype(np.float32), float(1 + np.log(total / least))


class Weigher:
    """Turns texts into sorted distinct shingle hashes with weights; words are hashed once while they are remembered."""

    def __init__(self, weights: tuple[np.ndarray, np.ndarray, float]):
        self.words, self.idf, self.rare = weights
        self.known: dict[bytes, int] = {}
        self.hashes = np.zeros(0, np.uint64)
        self.weights = np.zeros(0, np.float32)

    def shingles(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        if len(self.known) > 400_000:
            self.__init__((self.words, self.idf, self.rare))
        known, before = self.known, len(self.known)
        ids = [np.fromiter((known.setdefault(w, len(known)) for w in s), np.int64, len(s)) for s in (t.encode().split() for t in texts)]
        if len(known) > before:
            fresh = list(known)[before:]
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in fresh], np.uint64)
            idf = np.full(len(fresh), self.rare, np.float32)
            if len(self.words):
                at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
                idf = np.where(self.words[at] == hashes, self.idf[at], idf).astype(np.float32)
            self.hashes, self.weights = np.append(self.hashes, hashes), np.append(self.weights, idf)
        out = []
        for own in ids:
            h, w = self.hashes[own], self.weights[own]
            size = min(SHINGLE, len(h))
            n = len(h) - size + 1
            key, weight = np.zeros(n, np.uint64), np.zeros(n, np.float32)
            for k in range(size):
                key = key * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
                weight += w[k : k + n]
            found, first, times = np.unique(_mix(key), return_index=True, return_counts=True)
            out.append((found, (weight[first] / size * times).astype(np.float32)))
        return out


def _gamma_table() -> np.ndarray:
    """Gamma(2, 1) at the middles of 65536 equal shares, by bisection of its distribution function."""
    share = (np.arange(1 << 16) + 0.5) / (1 << 16)
    low, high = np.zeros(len(share)), np.full(len(share), 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        under = 1 - (1 + mid) * np.exp(-mid) < share
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return mid.astype(np.float32)


GAMMA = _gamma_table()


def samples(shingles: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """BANDS * ROWS samples of each weighted set, as 32-bit names of (shingle, level)."""
    out = np.zeros((len(shingles), BANDS * ROWS), np.uint64)
    low32, unit = np.uint64(0xFFFFFFFF), np.float32(1 / (1 << 24))
    start = 0
    while start < len(shingles):
        stop, n = start, 0
        while stop < len(shingles) and (n == 0 or n + len(shingles[stop][0]) <= PIECE):
            n += len(shingles[stop][0])
            stop += 1
        h = np.concatenate([s[0] for s in shingles[start:stop]])
        log_w = np.log(np.concatenate([s[1] for s in shingles[start:stop]]))
        cuts = np.cumsum([0] + [len(s[0]) for s in shingles[start : stop - 1]])
        for k in range(BANDS * ROWS):
            one = _mix(h + np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            two = _mix(one ^ np.uint64(0xD6E8FEB86659FD93))
            r = GAMMA[(one >> np.uint64(48)).astype(np.int64)]
            b = ((one >> np.uint64(24)) & np.uint64(0xFFFFFF)).astype(np.float32) * unit
            u = ((two >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * unit
            v = (((two >> np.uint64(16)) & np.uint64(0xFFFFFF)).astype(np.float32) + np.float32(0.5)) * unit
            t = np.floor(log_w / r + b)
            a = -np.log(u * v) * np.exp(-r * (t - b + 1))
            name = (h + t.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B1)) & low32
            # a positive float orders like its bits, so the least of these carries its own name
            packed = a.view(np.uint32).astype(np.uint64) << np.uint64(32) | name
            out[start:stop, k] = np.minimum.reduceat(packed, cuts) & low32
        start = stop
    return out


def band_keys(drawn: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(drawn), BANDS), np.uint64)
    for k in range(ROWS):
        keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + drawn[:, k::ROWS][:, :BANDS] + np.uint64(k + 1))
    return keys.view(np.int64)


def signatures(rows: DataFrame, weights) -> DataFrame:
    """doc_id, key (128-bit digest of the text), bands (empty where there are no words)."""
    given = rows.sparkSession.sparkContext.broadcast(weights)  # bounded by FLOOR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigher = Weigher(given.value)
        for b in slices(batches, "text", BLOCK):
            texts = b.column("text").to_pylist()
            new = list({t for t in texts if t and t.strip(" \t\n\x0b\x0c\r")})
            keys = band_keys(samples(weigher.shingles(new))).tolist() if new else []
            found = dict(zip(new, keys, strict=True))
            digests = [xxhash.xxh128_digest(t) if t is not None else None for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(digests, pa.binary()), pa.array([found.get(t, []) for t in texts], pa.list_(pa.int64()))], ["doc_id", "key", "bands"])

    return rows.mapInArrow(run, "doc_id long, key binary, bands array<long>")


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    total = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64))
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    return shared / (total - shared)


def candidates(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs a < b of rep ids worth comparing, from texts (rep, bands); and the centres of large buckets (rep)."""
    bucket = ["band", "name"]
    rows = texts.select("rep", F.posexplode("bands").alias("band", "name"))
    sizes = rows.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1")
    rows = materialize(rows.join(sizes, bucket), "buckets")
    small = rows.where(f"n <= {SMALL}").select("rep", *bucket)
    every = small.join(small.withColumnRenamed("rep", "other"), bucket).where("rep < other").select(F.col("rep").alias("a"), F.col("other").alias("b"))
    # the text that shares most with its buckets stands nearest to the middle of its group
    weighed = rows.groupBy("rep").agg(F.sum("n").alias("weight"), F.array_sort(F.collect_list(F.when(F.col("n") > SMALL, F.struct(*bucket)))).alias("large")).where(F.size("large") > 0)
    weighed = materialize(weighed, "large")
    one = F.transform("large", lambda x: F.struct(x["band"].alias("band"), F.lit(-1).alias("band2"), x["name"].alias("name"), F.lit(0).cast("long").alias("name2")))
    two = F.flatten(F.transform("large", lambda x: F.transform(F.filter("large", lambda y: y["band"] > x["band"]), lambda y: F.struct(x["band"].alias("band"), y["band"].alias("band2"), x["name"].alias("name"), y["name"].alias("name2")))))
    grouped = weighed.select("rep", "weight", F.explode(F.concat(one, two)).alias("g")).select("rep", "weight", "g.*")
    key = ["band", "band2", "name", "name2"]
    by = F.xxhash64("rep", "band", "band2")
    drawn = grouped.groupBy(*key).agg(F.min_by("rep", by).alias("centre"), F.count("*").alias("m")).where("m > 1").drop("m")
    # a limit on row numbers is taken in each task before rows are shuffled
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("weight"), by))
    middle = grouped.withColumn("place", place).where(F.col("place") <= MIDDLES).where("band2 < 0 or place = 1").select(F.col("rep").alias("centre"), *key)
    stars = materialize(drawn.unionByName(middle).groupBy(*key).agg(F.collect_set("centre").alias("centres")), "centres")  # MIDDLES + 1 at most
    own = grouped.select("rep", *key).join(stars, key).groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("centres"))).alias("centres"))  # of one text
    star = own.select("rep", F.explode("centres").alias("centre")).where("rep <> centre")
    pairs = every.union(star.select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b"))).distinct()
    return pairs, stars.select(F.explode("centres").alias("rep")).distinct()


def classes(links: DataFrame, centres: DataFrame) -> DataFrame:
    """node, component of links: the centres' own components first, so that a text that links to many centres of one group
    keeps one link to it when the others are joined."""
    links = materialize(links, "verified")
    a, b = centres.select(F.col("rep").alias("a")), centres.select(F.col("rep").alias("b"))
    inner = links.join(a, "a", "left_semi").join(b, "b", "left_semi")
    known = materialize(connected_components(inner), "known")
    for end in ("a", "b"):
        named = known.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        links = links.join(named, F.col(end) == F.col("_n"), "left").withColumn(end, F.coalesce("_c", end)).drop("_n", "_c").where("a <> b").distinct()
    outer = connected_components(links)
    whole = known.join(outer.select(F.col("node").alias("_n"), F.col("component").alias("_c")), F.col("component") == F.col("_n"), "left").select("node", F.coalesce("_c", "component").alias("component"))
    return outer.join(known.select("node"), "node", "left_anti").unionByName(whole)


def verified(pairs: DataFrame, rows: DataFrame, weights, least: float) -> DataFrame:
    """The pairs whose whole texts are at least that similar."""
    given = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigher = Weigher(given.value)
        for batch in batches:
            for b in (c for c in slices([batch], "ta", BLOCK) for c in slices([c], "tb", BLOCK)):
                one, two = b.column("ta").to_pylist(), b.column("tb").to_pylist()
                texts = list({*one, *two})
                known = dict(zip(texts, weigher.shingles(texts), strict=True))
                fine = [weighted_jaccard(known[x], known[y]) >= least for x, y in zip(one, two, strict=True)]
                yield b.select(["a", "b"]).filter(pa.array(fine, pa.bool_()))

    own = rows.where("text is not null")
    one, two = own.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), own.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _links(left: pa.Table, right: pa.Table, weigher: Weigher, least: float) -> tuple[list[int], list[int]]:
    """Pairs of different classes that similar texts of both sides hold; of a pair that shares several buckets, in the first."""
    column = lambda t, name: t.column(name).to_numpy()
    bands = [np.array(t.column("bands").to_pylist(), np.int64) for t in (left, right)]
    same = bands[0][:, None, :] == bands[1][None, :, :]
    ask = ~same[:, :, : left.column("band")[0].as_py()].any(axis=2)
    lc, rc = column(left, "c"), column(right, "c")
    ask &= lc[:, None] != rc[None, :]
    # two texts outside the largest class meet on either side
    ask &= (rc == column(right, "main"))[None, :] | (column(left, "rep")[:, None] < column(right, "rep")[None, :])
    if not ask.any():
        return [], []
    mine, others = weigher.shingles(left.column("text").to_pylist()), weigher.shingles(right.column("text").to_pylist())
    total = [np.array([w.sum(dtype=np.float64) for _, w in s]) for s in (mine, others)]
    # the similarity is at most the lighter text's share of the heavier one
    ask &= np.minimum(total[0][:, None], total[1][None, :]) >= (least - 1e-6) * np.maximum(total[0][:, None], total[1][None, :])
    keys, weights = np.concatenate([h for h, _ in others]), np.concatenate([w for _, w in others])
    owner = np.repeat(np.arange(len(others)), [len(h) for h, _ in others])
    found = set()
    for i in np.flatnonzero(ask.any(axis=1)):
        h, w = mine[i]
        at = np.minimum(np.searchsorted(h, keys), len(h) - 1)
        hit = h[at] == keys
        shared = np.bincount(owner[hit], np.minimum(w[at[hit]], weights[hit]), len(others))
        near = shared / (total[0][i] + total[1] - shared)
        for j in np.flatnonzero(ask[i] & (near >= least - 1e-6)):
            pair = (int(min(lc[i], rc[j])), int(max(lc[i], rc[j])))
            if pair not in found and (near[j] > least + 1e-6 or weighted_jaccard(mine[i], others[j]) >= least):
                found.add(pair)
    return [a for a, _ in found], [b for _, b in found]


def leftovers(placed: DataFrame, rows: DataFrame, weights, least: float) -> DataFrame:
    """Links (a, b) between classes that the centres left apart, from texts (rep, bands, c: their class).

    A bucket's texts outside its largest class are dealt to blocks, and so are all its texts; each two blocks meet in a
    task of their own, so no task sees a bucket and no pair is a row."""
    given = rows.sparkSession.sparkContext.broadcast(weights)
    bucket = ["band", "name"]
    spots = placed.where("rep is not null").select("rep", "c", F.posexplode("bands").alias("band", "name"))
    sizes = spots.groupBy(*bucket, "c").agg(F.count("*").alias("k")).groupBy(*bucket).agg(F.sum("k").alias("m"), F.max(F.struct("k", "c")).alias("top"))
    apart = sizes.where(f"m > {SMALL} and top.k < m").select(*bucket, F.col("top.c").alias("main"))
    members = materialize(spots.join(apart, bucket), "apart")
    texts = rows.where("text is not null").join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    lengths = texts.groupBy(F.col("doc_id").alias("rep")).agg(F.max(F.octet_length("text")).alias("size"))
    minor = F.col("c") != F.col("main")
    blocks = lambda n, size: F.ceil(F.greatest(F.sum(n) / MEET, F.sum(size) / BLOCK))
    dealt = members.join(lengths, "rep").groupBy(*bucket).agg(blocks(minor.cast("long"), F.when(minor, F.col("size"))).alias("few"), blocks(F.lit(1), F.col("size")).alias("all"))
    # one row of a text for each of its buckets, then for each block that it meets
    spread = members.join(dealt, bucket)
    place = lambda n: F.pmod(F.xxhash64("rep", *bucket), n)
    near = spread.where(minor).select("rep", "c", "main", *bucket, place("few").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("all") - 1)).alias("j"), F.lit(True).alias("asks"))
    far = spread.select("rep", "c", "main", *bucket, F.explode(F.sequence(F.lit(0).cast("long"), F.col("few") - 1)).alias("i"), place("all").alias("j"), F.lit(False).alias("asks"))
    signs = placed.select("rep", "bands")
    cells = near.unionByName(far).join(signs, "rep").join(texts.select(F.col("doc_id").alias("rep"), "text"), "rep")

    def run(cell: pa.Table) -> pa.Table:
        asks = cell.column("asks")
        left, right = cell.filter(asks), cell.filter(pa.compute.invert(asks))
        a, b = _links(left, right, Weigher(given.value), least) if left.num_rows and right.num_rows else ([], [])
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return cells.groupBy(*bucket, "i", "j").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """Per row of docs: doc_id, component_id (its class), kept."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    weights = word_weights(rows.select("text"))
    signed = materialize(signatures(rows, weights), "signatures")
    texts = signed.where(F.size("bands") > 0).groupBy("key").agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands"))
    texts = materialize(texts, "texts")
    pairs, centres = candidates(texts.where("rep is not null").select("rep", "bands"))
    found = classes(verified(materialize(pairs, "pairs"), rows, weights, least), centres)
    placed = materialize(texts.join(found, F.col("rep") == F.col("node"), "left").select("key", "rep", "bands", F.coalesce("component", "rep").alias("c")), "placed")
    joined = connected_components(leftovers(placed, rows, weights, least))
    named = placed.join(joined, F.col("c") == F.col("node"), "left").select(F.col("key").alias("k"), F.coalesce("component", "c").alias("c"))
    out = signed.join(named, (F.size("bands") > 0) & (F.col("key") == F.col("k")), "left").select("doc_id", F.coalesce("c", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """docs with one document of each class; of rows that share its doc_id, one."""
    names = docs.columns
    # the row as one column, so that no name of its own meets the ones here
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    ident = F.col("_row.doc_id").cast("long")
    known = materialize(near_duplicates(docs.select("doc_id", "text"), least), "classes")
    gone = known.where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    twice = known.where("kept and doc_id is not null").groupBy(F.col("doc_id").alias("_gone")).count().where("count > 1").select("_gone")
    twice = materialize(twice, "twice")
    # joined alike at every size: the ids grow with the corpus, so a broadcast would only be a small input's plan
    kept = packed.join(gone.hint("merge"), ident == F.col("_gone"), "left_anti")
    single = kept.join(twice, ident == F.col("_gone"), "left_anti")
    rest = kept.join(twice, ident == F.col("_gone"), "left_semi")
    order = F.struct(*[F.col(f"_row.`{c}`").cast("string") for c in names])
    rest = rest.groupBy(ident.alias("_id")).agg(F.min_by("_row", order).alias("_row")).select("_row")
    return single.unionByName(rest).select("_row.*")
