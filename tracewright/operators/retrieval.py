"""Ranked retrieval: BM25 over chunks, dense vectors, and fusion of ranked lists."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import folded, words
from ..sources.index import BETWEEN, Index, words_of
from ..sources.scratch import written

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Vectors, and queries, that meet in one matrix product.
BLOCK_ROWS = 2048
#: Blocks of an index, and queries, that meet in one task at a time; postings that are added up at once.
LOT_BLOCKS, GROUP_QUERIES, MEETINGS = 8, 512, 1 << 21
#: Chunks of a lot where texts are scanned, and words that a scan packs at once.
LOT_CHUNKS, PACK_WORDS = 8192, 1 << 20
HIT_WINDOW, CHUNKS_SHOWN, RRF_K, SCORE_DIGITS = 100, 3, 60, 12


def _said(chunks: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """doc_id, ordinal, w: the words of the fields, one field after the other with an empty word between."""
    # the runs that words() finds, by what lies between them: one pass without a match object for each
    each = [F.array_remove(F.split(folded(F.coalesce(F.col(f), F.lit(""))), BETWEEN), "") for f in fields]
    gap = F.array(F.lit(""))
    return chunks.select("doc_id", "ordinal", reduce(lambda a, b: F.concat(a, gap, b), each).alias("w"))


def postings(chunks: DataFrame, only: DataFrame, fields: tuple[str, ...] = ("text",)) -> DataFrame:
    """doc_id, ordinal, term, dl (the chunk's words), f (occurrences) for each of the wanted terms (term) that a chunk holds,
    and one row with an empty term for the chunk itself. Texts are taken apart once, and terms are picked before anything
    is shuffled."""
    said = _said(chunks, fields)
    dl = F.size("w") - (len(fields) - 1)
    each = said.select("doc_id", "ordinal", dl.alias("dl"), F.explode(F.array_append(F.array_remove("w", "") if len(fields) > 1 else F.col("w"), "")).alias("term"))
    wanted = only.select("term").union(only.sparkSession.createDataFrame([("",)], "term string"))
    return each.join(wanted, "term", "left_semi").groupBy("doc_id", "ordinal", "term", "dl").agg(F.count("*").alias("f"))


def phrase_hits(chunks: DataFrame, phrases: DataFrame, fields: tuple[str, ...] = ("text",)) -> DataFrame:
    """Occurrences of whole phrases (term, several words with blanks) in chunks: doc_id, ordinal, term, dl, f.

    Each word of a phrase meets its occurrences, moved back by its place in the phrase; where all words meet, the phrase
    starts. Rows hold positions only, never a chunk's other words; no phrase goes from one field into the next."""
    said = _said(chunks, fields).select("doc_id", "ordinal", (F.size("w") - (len(fields) - 1)).alias("dl"), F.posexplode("w").alias("pos", "word"))
    asked = phrases.select(folded(F.col("term")).alias("term")).distinct().select("term", F.size(F.split("term", " ")).alias("n"), F.posexplode(F.split("term", " ")).alias("k", "word"))
    starts = said.join(asked, "word").groupBy("doc_id", "ordinal", "dl", "term", "n", (F.col("pos") - F.col("k")).alias("start")).agg(F.count("*").alias("met")).where("met = n")
    return starts.groupBy("doc_id", "ordinal", "term", "dl").agg(F.count("*").alias("f"))


def bm25_hits(chunks: DataFrame, queries: DataFrame, fields: tuple[str, ...] = ("text",)) -> DataFrame:
    """query_id, doc_id, ordinal, score of all chunks that hold a term of a query (query_id, term).

    The postings of the queries' terms and a row for each chunk are written once; counts of chunks, mean length and term
    statistics come from them, so texts are scanned once (twice if a query asks for a phrase). Scores are rounded to 9
    digits, so that equal texts tie whatever order they were summed in."""
    terms = queries.select("query_id", folded(F.col("term")).alias("term")).distinct()
    posted = postings(chunks, terms.where("not contains(term, ' ')").select("term").distinct(), fields)
    several = terms.where("contains(term, ' ')")
    if several.limit(1).count():
        posted = posted.unionByName(phrase_hits(chunks, several, fields))
    posted = written(posted, "postings")
    size = posted.where("term = ''").agg(F.count("*").alias("N"), F.avg("dl").alias("avgdl"))
    posted = posted.where("term <> ''")
    df = posted.groupBy("term").agg(F.count("*").alias("df"))
    known = df.join(F.broadcast(size)).select("term", _idf(F.col("N"), F.col("df")).alias("idf"), "avgdl")  # the totals are one row
    weight = F.col("idf") * _saturated(F.col("f"), F.col("dl"), F.col("avgdl"))
    scored = posted.join(known, "term").select("term", "doc_id", "ordinal", weight.alias("s"))
    return terms.join(scored, "term").groupBy("query_id", "doc_id", "ordinal").agg(F.round(F.sum("s"), 9).alias("score"))


def _idf(n: Column, df: Column) -> Column:
    idf = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(idf > 0, idf).otherwise(F.lit(LEAST_IDF))


def _saturated(f: Column, dl: Column, avgdl: Column) -> Column:
    return f * (K1 + 1) / (f + K1 * (1 - B + B * dl / avgdl))


def phrase_postings(index: Index, phrases: DataFrame) -> DataFrame:
    """The rows of whole phrases (term, several words with blanks) as an index would hold them: each word's places, moved
    back by its place in the phrase, meet where the phrase starts. No phrase goes from one field into the next."""
    asked = phrases.select("term", F.size(F.split("term", " ")).alias("words"), F.posexplode(F.split("term", " ")).alias("k", "word"))
    held = index.postings(asked.select(F.col("word").alias("term"))).select(F.col("term").alias("word"), "block", F.inline("entries"))
    each = held.select("word", "block", "doc_id", "ordinal", "dl", F.explode("at").alias("pos")).join(asked, "word")
    starts = each.groupBy("block", "doc_id", "ordinal", "dl", "term", "words", (F.col("pos") - F.col("k")).alias("start")).agg(F.count("*").alias("met")).where("met = words")
    found = starts.groupBy("term", "block", "doc_id", "ordinal", "dl").agg(F.count("*").cast("int").alias("f"), F.array_sort(F.collect_list("start")).alias("at"))
    entry = F.struct("doc_id", "ordinal", "dl", "f", "at")
    return found.groupBy("term", "block").agg(F.count("*").cast("int").alias("n"), F.max("f").alias("top_f"), F.min("dl").alias("least_dl"), F.collect_list(entry).alias("entries"))


def index_hits(index: Index, queries: DataFrame, limit: int | None = HIT_WINDOW) -> DataFrame:
    """query_id, doc_id, ordinal, score: the chunks that bm25_hits would find, from a stored index. With a limit, each lot of
    blocks gives a query's `limit` best chunks there and those that tie with them, so hit_window takes the same.

    Postings of the asked terms meet the queries' terms in lots of blocks, one lot and one group of queries at a time: a pair of
    query and chunk is a number in a table of LOT_BLOCKS blocks by GROUP_QUERIES queries, and only those that are kept are rows."""
    terms = written(queries.select("query_id", folded(F.col("term")).alias("term")).distinct(), "terms")
    posted = index.postings(terms.where("not contains(term, ' ')"))
    several = terms.where("contains(term, ' ')").select("term").distinct()
    if several.limit(1).count():
        posted = posted.unionByName(written(phrase_postings(index, several), "phrases"))
    known = posted.groupBy("term").agg(F.sum("n").alias("df")).select("term", _idf(F.lit(index.chunks), F.col("df")).alias("idf"))
    lots, groups = -(-index.blocks // LOT_BLOCKS), -(-terms.select("query_id").distinct().count() // GROUP_QUERIES) or 1
    spark = index.spark
    asked = terms.join(known, "term").withColumn("g", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))
    asked = asked.crossJoin(spark.range(lots).select(F.col("id").cast("int").alias("lot")))
    held = posted.select("term", F.pmod("block", F.lit(lots)).alias("lot"), *[F.col(f"entries.{c}").alias(c) for c in ("doc_id", "ordinal", "dl", "f")])
    held = held.crossJoin(spark.range(groups).select(F.col("id").cast("int").alias("g")))
    avgdl = index.words / index.chunks if index.chunks else 1.0

    def score(held: pa.Table, asked: pa.Table) -> pa.Table:
        return _lot_scores(held, asked, avgdl, limit)

    kind = terms.schema["query_id"].dataType.simpleString()
    found = held.groupBy("lot", "g").cogroup(asked.groupBy("lot", "g")).applyInArrow(score, f"query_id {kind}, doc_id {index.kind}, ordinal int, score double")
    return found.withColumn("score", F.round("score", 9))


def _lot_scores(held: pa.Table, asked: pa.Table, avgdl: float, limit: int | None) -> pa.Table:
    """query_id, doc_id, ordinal, score of one lot's postings (term, lists of doc_id, ordinal, dl, f) under queries (query_id, term, idf)."""
    column = lambda t, c: t.column(c).combine_chunks()
    lists = column(held, "ordinal")
    rows = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = {c: column(held, c).flatten() for c in ("doc_id", "ordinal", "dl", "f")}
    docs = flat["doc_id"].dictionary_encode()
    place = docs.indices.to_numpy().astype(np.int64) << 32 | flat["ordinal"].to_numpy().astype(np.int64)
    chunks, first, chunk = np.unique(place, return_index=True, return_inverse=True)
    f, dl = (flat[c].to_numpy().astype(np.float64) for c in ("f", "dl"))
    weight = f * (K1 + 1) / (f + K1 * (1 - B + B * dl / avgdl))
    found = _best(column(held, "term"), rows, chunk, weight, len(chunks), asked, limit)
    at = pa.array(first[found.column("chunk").to_numpy()])
    return pa.table({"query_id": found.column("query_id"), "doc_id": flat["doc_id"].take(at), "ordinal": flat["ordinal"].take(at), "score": found.column("score")})


def _best(terms: pa.Array, rows: np.ndarray, chunk: np.ndarray, weight: np.ndarray, chunks: int, asked: pa.Table, limit: int | None) -> pa.Table:
    """query_id, chunk (a number below chunks), score under queries (query_id, term, idf). Each of the terms has a run of so many
    rows of chunk and weight; with a limit, the best chunks of a query are kept and those that tie with them."""
    column = lambda t, c: t.column(c).combine_chunks()
    # each query's term meets the rows of the term, each row's entries are one run
    codes = pa.concat_arrays([terms, column(asked, "term")]).dictionary_encode().indices.to_numpy()
    term, wanted = codes[: len(rows)], codes[len(rows) :]
    order = np.argsort(term, kind="stable")
    left, right = (np.searchsorted(term[order], wanted, side) for side in ("left", "right"))
    names = column(asked, "query_id").dictionary_encode()
    pair = np.repeat(np.arange(len(wanted)), right - left)
    row = order[np.arange(len(pair)) - np.repeat(np.cumsum(right - left) - (right - left), right - left) + np.repeat(left, right - left)]
    query, idf = names.indices.to_numpy().astype(np.int64)[pair], column(asked, "idf").to_numpy()[pair]
    start, size = (np.cumsum(rows) - rows)[row], rows[row]
    total = np.zeros(len(names.dictionary) * chunks)
    cut = np.searchsorted(np.cumsum(size), np.arange(0, size.sum(), MEETINGS), "right") if len(size) else []
    for lo, hi in zip(cut, [*cut[1:], len(size)], strict=True):
        n = size[lo:hi]
        entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[lo:hi], n)
        np.add.at(total, np.repeat(query[lo:hi], n) * chunks + chunk[entry], np.repeat(idf[lo:hi], n) * weight[entry])
    total = total.reshape(len(names.dictionary), chunks)
    kept = total > 0
    if limit is not None and chunks > limit:
        kept &= total >= np.partition(total, chunks - limit, axis=1)[:, chunks - limit, None] - 1e-8  # scores are rounded later
    q, c = np.nonzero(kept)
    return pa.table({"query_id": names.dictionary.take(pa.array(q)), "chunk": c, "score": total[q, c]})


def scan_hits(chunks: DataFrame, queries: DataFrame, fields: tuple[str, ...] = ("text",), limit: int | None = HIT_WINDOW) -> DataFrame:
    """query_id, doc_id, ordinal, score: the chunks that bm25_hits would find, for one set of queries without an index. With a
    limit, each lot of chunks gives a query's `limit` best and those that tie with them, so hit_window takes the same.

    Texts are taken apart once, and only the queries' terms go on, as numbers: a lot of LOT_CHUNKS chunks becomes one row, so
    neither texts nor other words are shuffled or written. Lots then meet GROUP_QUERIES queries at a time."""
    kind = chunks.schema["doc_id"].dataType.simpleString()
    said = queries.select("query_id", folded(F.col("term")).alias("term")).distinct()
    dealt, slot = F.row_number().over(Window.partitionBy("slot").orderBy("term")), F.pmod(F.xxhash64("term"), F.lit(64))
    numbers = said.select("term").distinct().withColumn("slot", slot)  # a number is a place in one of 64 slots
    numbers = written(numbers.select("term", (dealt * 64 + F.col("slot")).cast("int").alias("n")), "numbers")
    terms = written(said.join(numbers, "term").select("query_id", F.col("n").alias("term")), "terms")
    lots = _lots(_asked_words(chunks, numbers, fields), -(-chunks.count() // LOT_CHUNKS) or 1, kind)
    size = lots.agg(F.sum(F.size("doc_id")).alias("chunks"), F.sum("words").alias("words")).first()
    avgdl = size["words"] / size["chunks"] if size["words"] else 1.0
    df = lots.select(F.explode(F.arrays_zip("term", "n")).alias("t")).groupBy("t.term").agg(F.sum("t.n").alias("df"))
    known = df.select("term", _idf(F.lit(size["chunks"] or 0), F.col("df")).alias("idf"))
    groups = -(-terms.select("query_id").distinct().count() // GROUP_QUERIES) or 1
    asked = terms.join(known, "term").groupBy(F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("g")).agg(F.collect_list(F.struct("query_id", "term", "idf")).alias("a"))  # of one group
    asked = written(asked.select(*[F.col(f"a.{c}").alias(f"a_{c}") for c in ("query_id", "term", "idf")]), "asked")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                own = {c: b.column(c)[k].values for c in b.schema.names}
                rows, chunk, dl, f = (own[c].to_numpy().astype(np.int64) for c in ("n", "chunk", "dl", "f"))
                weight = f * (K1 + 1) / (f + K1 * (1 - B + B * dl[chunk] / avgdl))
                found = _best(own["term"], rows, chunk, weight, len(dl), pa.table({c: own[f"a_{c}"] for c in ("query_id", "term", "idf")}), limit)
                at = found.column("chunk").combine_chunks()
                cols = [found.column("query_id").combine_chunks(), own["doc_id"].take(at), own["ordinal"].take(at), found.column("score").combine_chunks()]
                yield pa.RecordBatch.from_arrays(cols, ["query_id", "doc_id", "ordinal", "score"])

    met = lots.drop("lot", "words").crossJoin(asked)  # groups of queries, all of which every lot answers
    found = met.mapInArrow(score, f"query_id {terms.schema['query_id'].dataType.simpleString()}, doc_id {kind}, ordinal int, score double")
    return found.withColumn("score", F.round("score", 9))


def _asked_words(chunks: DataFrame, numbers: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """doc_id, ordinal, dl, term, f: a row for each time that a chunk holds a word of the terms (term, n from 1) with its number (f
    is 1), one for each phrase of theirs in it, and one with the number 0 for the chunk itself."""
    said = words_of(chunks, fields)
    each = said.select("doc_id", "ordinal", "dl", F.explode(F.array_append(F.array_remove("w", "") if len(fields) > 1 else F.col("w"), "")).alias("term"))
    wanted = numbers.where("not contains(term, ' ')").unionByName(numbers.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(0).alias("n")))
    held = each.join(wanted, "term").withColumn("f", F.lit(1))
    several = numbers.where("contains(term, ' ')")
    if several.limit(1).count():
        held = held.unionByName(phrase_hits(chunks, several, fields).join(several, "term").withColumn("f", F.col("f").cast("int")))
    return held.select("doc_id", F.col("ordinal").cast("int").alias("ordinal"), "dl", F.col("n").alias("term"), "f")


def _lots(held: DataFrame, lots: int, kind: str) -> DataFrame:
    """Rows of _asked_words as one row for each lot of chunks: words (of all its chunks), doc_id, ordinal, dl by chunk; term and
    n (chunks that hold it) by term; chunk (its number) and f term by term. Tasks pack what they read by lot, then a
    lot's parts meet; a chunk whose rows came to several tasks is one chunk again, its counts added up."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, n = [], 0
        for b in batches:
            open_.append(b)
            n += b.num_rows
            if n >= PACK_WORDS:
                yield from _packs(pa.Table.from_batches(open_).combine_chunks())
                open_, n = [], 0
        if n:
            yield from _packs(pa.Table.from_batches(open_).combine_chunks())

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[pa.RecordBatch] = []
        for b in batches:
            at = b.column("lot").to_numpy()
            edges = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if hi > lo:
                    if open_ and open_[0].column("lot")[0].as_py() != at[lo]:
                        yield _one_lot(pa.Table.from_batches(open_))
                        open_.clear()
                    open_.append(b.slice(lo, hi - lo))
        if open_:
            yield _one_lot(pa.Table.from_batches(open_))

    schema = f"lot int, words long, doc_id array<{kind}>, ordinal array<int>, dl array<int>, term array<int>, n array<int>, chunk array<int>, f array<int>"
    parts = held.withColumn("lot", F.pmod(F.xxhash64("doc_id", "ordinal"), F.lit(lots)).cast("int")).mapInArrow(packed, schema)
    tasks = min(lots, max(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), lots // 8))
    return written(parts.repartition(tasks, "lot").sortWithinPartitions("lot").mapInArrow(merged, schema), "lots")


def _packs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """One row for each lot of _asked_words' rows."""
    rows = rows.sort_by("lot")
    at = rows.column("lot").to_numpy()
    edges = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
    for lo, hi in zip(edges, edges[1:], strict=False):
        own = {c: rows.column(c).slice(lo, hi - lo).combine_chunks() for c in ("doc_id", "ordinal", "dl", "term", "f")}
        real = np.flatnonzero(own["term"].to_numpy())
        yield _packed(int(at[lo]), own["doc_id"], own["ordinal"], own["dl"], real, own["term"], real, own["f"].to_numpy()[real])


def _one_lot(parts: pa.Table) -> pa.RecordBatch:
    """The parts of a lot as one row."""
    own = {c: parts.column(c).combine_chunks() for c in parts.column_names}
    sizes = {c: pa.compute.list_value_length(own[c]).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "chunk")}
    flat = {c: own[c].flatten() for c in ("doc_id", "ordinal", "dl", "term", "n", "chunk", "f")}
    row = flat["chunk"].to_numpy() + np.repeat(np.cumsum(sizes["doc_id"]) - sizes["doc_id"], sizes["chunk"])
    run = np.repeat(np.arange(len(flat["term"])), flat["n"].to_numpy())
    return _packed(own["lot"][0].as_py(), flat["doc_id"], flat["ordinal"], flat["dl"], row, flat["term"], run, flat["f"].to_numpy())


def _packed(lot: int, doc_id: pa.Array, ordinal: pa.Array, dl: pa.Array, row: np.ndarray, term: pa.Array, run: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
    """One row of a lot. Each f stands for a chunk (its place in doc_id, ordinal and dl, where chunks may repeat) and a term (its
    place in term, likewise)."""
    docs = doc_id.dictionary_encode().indices
    _, first, chunk = np.unique(docs.to_numpy().astype(np.int64) << 32 | ordinal.to_numpy().astype(np.int64), return_index=True, return_inverse=True)
    pair, at = np.unique(term.to_numpy().astype(np.int64)[run] * len(first) + chunk[row], return_inverse=True)
    code, held = np.divmod(pair, len(first))
    codes, n = np.unique(code, return_counts=True)
    by_chunk = [c.take(pa.array(first)) for c in (doc_id, ordinal, dl)]
    by_term = [pa.array(x.astype(np.int32)) for x in (codes, n, held, np.bincount(at, f, len(pair)))]
    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (*by_chunk, *by_term)]
    words = pa.compute.sum(by_chunk[2]).as_py()
    return pa.RecordBatch.from_arrays([pa.array([lot], pa.int32()), pa.array([words], pa.int64()), *lists], ["lot", "words", "doc_id", "ordinal", "dl", "term", "n", "chunk", "f"])


def hit_window(hits: DataFrame, limit: int = HIT_WINDOW) -> DataFrame:
    """The best chunks of each query, ties by document and place. Filters by kind of document come after this."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id", "ordinal")
    return hits.withColumn("hit", F.row_number().over(w)).where(F.col("hit") <= limit)


def fold(hits: DataFrame, how: str = "best_chunk") -> DataFrame:
    """Documents from chunks: query_id, doc_id, score (the best chunk, or the sum of the two best), n_chunks, best ordinal."""
    if how not in ("best_chunk", "top2_sum"):
        raise ValueError(f"how must be best_chunk or top2_sum, got {how!r}")
    w = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), "ordinal")
    top = hits.withColumn("k", F.row_number().over(w))
    score = F.sum(F.when(F.col("k") <= (1 if how == "best_chunk" else 2), F.col("score")))
    return top.groupBy("query_id", "doc_id").agg(score.alias("score"), F.count("*").alias("n_chunks"), F.min_by("ordinal", "k").alias("best_ordinal"))


def ranked(scores: DataFrame, limit: int, *ties: str | Column) -> DataFrame:
    """The best `limit` documents of each query with their rank; ties by document."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), *(ties or ("doc_id",)))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def search(chunks: DataFrame | Index, queries: DataFrame, limit: int = 10, how: str = "best_chunk", allowed: Column | None = None, fields: tuple[str, ...] = ("text",)) -> DataFrame:
    """Ranked documents for each query, from a stored index, or over the words of the fields (title and text, say) of chunks."""
    hits = hit_window(index_hits(chunks, queries) if isinstance(chunks, Index) else scan_hits(chunks, queries, fields))
    return ranked(fold(hits if allowed is None else hits.where(allowed), how), limit)


def unit(vector: Column) -> Column:
    """A vector as unit length in doubles; null where it is empty, zero or not finite."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when((norm > 0) & (norm < F.lit(float("inf"))), F.transform(v, lambda x: x / norm))


def vector_issue(vector: Column, size: int, slack: float = 1e-4) -> Column:
    """Why a vector may not be stored, or null: its shape, values that are not finite, zero, or not of unit length."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(vector.isNull() | (F.size(vector) != size), "shape").when(bad, "not_finite").when(norm == 0, "zero").when(F.abs(norm - 1) > slack, "not_unit")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _blocks(rows: DataFrame, names: list[str], vector: str) -> DataFrame:
    """Rows of one vector length packed as they come: names as arrays, vectors as one matrix of doubles."""
    kinds = ", ".join(f"{n} array<{rows.schema[n].dataType.simpleString()}>" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                b = whole.slice(at, BLOCK_ROWS)
                sizes = pa.compute.list_value_length(b.column(vector)).to_numpy()
                for size in np.unique(sizes).tolist():
                    own = b.filter(pa.array(sizes == size))
                    flat = own.column(vector).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    lists = [pa.array([own.column(n).to_pylist()], pa.list_(own.column(n).type)) for n in names]
                    yield pa.RecordBatch.from_arrays([*lists, pa.array([size], pa.int32()), pa.array([flat.tobytes()], pa.binary())], [*names, "size", "matrix"])

    return rows.select(*names, vector).mapInArrow(run, f"{kinds}, size int, matrix binary")


def dense_search(vectors: DataFrame, queries: DataFrame, limit: int = 10, chunks: int = CHUNKS_SHOWN, digits: int = 9) -> DataFrame:
    """Documents by their best chunk's cosine with each query (query_id, q) over vectors (doc_id, ordinal, v): a stated set of
    queries against all rows, block by block.

    Blocks of vectors are dealt into lots, to each of which every block of queries goes, so that vectors of one length are no
    hot key. A block of queries meets a block of vectors in one matrix product, which passes on the block's best documents of each
    query only. The chunks to show are then looked up for the documents that are left."""
    own = vectors.select("doc_id", "ordinal", unit(F.col("v")).alias("v")).where("v is not null")
    asked = queries.select("query_id", unit(F.col("q")).alias("q")).where("q is not null")
    lots = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = _blocks(asked, ["query_id"], "q").withColumnRenamed("matrix", "qm").withColumnRenamed("size", "qs")
    left = left.withColumn("ql", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(lots))
    met = _blocks(own, ["doc_id"], "v").join(left, (F.col("size") == F.col("qs")) & (lot == F.col("ql")))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = {n: b.column(n)[k].as_py() for n in ("doc_id", "query_id", "size", "matrix", "qm")}
                v, q = (np.frombuffer(row[m]).reshape(-1, row["size"]) for m in ("matrix", "qm"))
                score = np.round(q @ v.T, digits)
                docs = np.array(row["doc_id"], dtype=object) if isinstance(row["doc_id"][0], str) else np.array(row["doc_id"])
                order = np.argsort(docs, kind="stable")
                docs, score = docs[order], score[:, order]
                first = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
                score, docs = np.maximum.reduceat(score, first, axis=1), docs[first]
                top = np.argsort(-score, axis=1, kind="stable")[:, :limit]  # ties by document
                names = np.repeat(np.arange(len(top)), top.shape[1])
                cols = [pa.array([row["query_id"][i] for i in names], b.schema.field("query_id").type.value_type), pa.array(docs[top.ravel()].tolist(), b.schema.field("doc_id").type.value_type), pa.array(np.take_along_axis(score, top, 1).ravel())]
                yield pa.RecordBatch.from_arrays(cols, ["query_id", "doc_id", "score"])

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    near = met.mapInArrow(best, f"query_id {kind(asked, 'query_id')}, doc_id {kind(own, 'doc_id')}, score double")
    found = written(ranked(near.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), limit), "nearest")
    seen = found.select("query_id", "doc_id").join(own, "doc_id").join(asked, "query_id").where(F.size("v") == F.size("q"))
    shown = seen.select("query_id", "doc_id", F.struct((-F.round(dot(F.col("v"), F.col("q")), digits)).alias("s"), "ordinal").alias("c"))
    shown = shown.groupBy("query_id", "doc_id").agg(F.transform(F.slice(F.array_sort(F.collect_list("c")), 1, chunks), lambda c: c["ordinal"]).alias("ordinals"))  # of one document
    return found.join(shown, ["query_id", "doc_id"])


def fuse(lanes: list[tuple[str, DataFrame]], limit: int = 10, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, doc_id, rank): sum of 1 / (k + rank) over the lanes, ties by best lane
    rank, order of lanes, document. A document counts once in a lane, where it is best."""
    rows = reduce(lambda a, b: a.unionByName(b), [d.select("query_id", "doc_id", "rank", F.lit(i).alias("lane")) for i, (_, d) in enumerate(lanes)])
    once = rows.groupBy("query_id", "doc_id", "lane").agg(F.min("rank").alias("rank"))
    fused = once.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"), F.min(F.struct("rank", "lane")).alias("best"), F.count("*").alias("n_lanes"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", SCORE_DIGITS)), "best.rank", "best.lane", "doc_id")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", "doc_id", "rank", "score", F.element_at(F.array(*[F.lit(n) for n, _ in lanes]), F.col("best.lane") + 1).alias("best_lane"), "n_lanes")


def hash_embedding(text: Column, size: int = 64) -> Column:
    """Signed hashing of words into `size` slots at unit length, for tests without a model: the first four bytes of a word's
    SHA-256 choose the slot, the last bit of the fifth the sign. A text whose words cancel out points along the first axis."""
    number = lambda w, at, n: F.conv(F.substring(F.sha2(w, 256), at, n), 16, 10).cast("long")
    slots = F.transform(words(text), lambda w: F.struct((number(w, 1, 8) % size).cast("int").alias("slot"), F.when(number(w, 9, 2) % 2 == 1, 1.0).otherwise(-1.0).alias("sign")))
    zeros = F.array_repeat(F.lit(0.0), size)
    summed = F.aggregate(slots, zeros, lambda a, w: F.transform(a, lambda x, i: x + F.when(i == w["slot"], w["sign"]).otherwise(0.0)))
    first = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i == 0, 1.0).otherwise(0.0))
    return F.coalesce(unit(summed), first)
