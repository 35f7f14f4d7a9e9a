"""An inverted index kept as Parquet: built once, changed by document, read by bucket.

    postings/v=N/bucket=b   term, block, n, top_f, least_dl, entries (doc_id, ordinal, dl, f, at): the chunks of one block of
                            documents that hold the term, with the places where they hold it
    chunks/v=N/bucket=b     doc_id, ordinal, dl, block, buckets (the postings that hold its terms)
    manifests/v=N           table, bucket, version, and the number of chunks and of their words

Terms are dealt to buckets, documents to blocks, both by hash; the numbers of both are fixed when the index is built. So the
blocks of all terms align, and a block's highest frequency and shortest chunk bound what any of its chunks can score.

A change writes the buckets that it touches under the next version, then a manifest that points to them; all other buckets
stay where they are, and a reader of the version before still finds its own. A manifest without its success marker does not
count, so a change that was cut off never happened. Only bucket numbers and versions reach the driver."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import folded

#: What lies between two words; an empty word keeps fields apart.
BETWEEN = r"[^\p{L}\p{N}]+"
ENTRIES = "array<struct<doc_id: {0}, ordinal: int, dl: int, f: int, at: array<int>>>"


def words_of(chunks: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """doc_id, ordinal, dl (words of the chunk), w: the words of the fields, folded, an empty one between two fields; block where
    chunks have it."""
    each = [F.array_remove(F.split(folded(F.coalesce(F.col(f), F.lit(""))), BETWEEN), "") for f in fields]
    known = [c for c in ("block",) if c in chunks.columns]
    said = chunks.select("doc_id", F.col("ordinal").cast("int").alias("ordinal"), *known, reduce(lambda a, b: F.concat(a, F.array(F.lit("")), b), each).alias("w"))
    return said.select("doc_id", "ordinal", (F.size("w") - (len(fields) - 1)).alias("dl"), *known, "w")


def _spread(chunks: DataFrame) -> DataFrame:
    """Few large files are dealt out first, so that all tasks take texts apart."""
    spread = chunks.sparkSession.sparkContext.defaultParallelism
    return chunks.repartition(spread) if chunks.rdd.getNumPartitions() < spread else chunks


def _postings(rows: pa.RecordBatch) -> pa.RecordBatch:
    """The postings of chunks (doc_id, ordinal, dl, block, w): words become numbers, and runs of equal numbers lists, all by columns."""
    w = rows.column("w")
    coded = w.flatten().dictionary_encode()
    term = coded.indices.to_numpy().astype(np.int64)
    sizes = pa.compute.list_value_length(w).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    pos = np.arange(len(term)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    block = rows.column("block").to_numpy()
    order = np.lexsort((pos, row, block[row], term))
    gap = pa.compute.index(coded.dictionary, "").as_py() if len(term) else -1
    order = order[term[order] != gap]
    term, row, pos = term[order], row[order], pos[order]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (row[1:] != row[:-1])
    starts = np.flatnonzero(new)
    f = np.diff(np.append(starts, len(term)))
    of, held = term[starts], row[starts]
    head = np.ones(len(starts), bool)
    head[1:] = (of[1:] != of[:-1]) | (block[held[1:]] != block[held[:-1]])
    heads = np.flatnonzero(head)
    ends = lambda x, n: pa.array(np.append(x, n).astype(np.int32))
    take = lambda c: rows.column(c).take(pa.array(held))
    at = pa.ListArray.from_arrays(ends(starts, len(term)), pa.array(pos.astype(np.int32)))
    entries = [take("doc_id"), take("ordinal"), take("dl"), pa.array(f.astype(np.int32)), at]
    n = np.diff(np.append(heads, len(starts))).astype(np.int32)
    top, least = (how.reduceat(x, heads) if len(heads) else np.zeros(0, np.int32) for how, x in ((np.maximum, f.astype(np.int32)), (np.minimum, rows.column("dl").to_numpy()[held].astype(np.int32))))
    columns = [coded.dictionary.take(pa.array(of[heads])), pa.array(block[held[heads]].astype(np.int32)), pa.array(n), pa.array(top), pa.array(least), *[pa.ListArray.from_arrays(ends(heads, len(starts)), e) for e in entries]]
    return pa.RecordBatch.from_arrays(columns, ["term", "block", "n", "top_f", "least_dl", "doc_id", "ordinal", "dl", "f", "at"])


@dataclass(frozen=True)
class Index:
    """One version of an index: where each bucket of a table was written last, chunks and their words in all."""

    spark: SparkSession
    path: str
    version: int
    buckets: int
    blocks: int
    fields: tuple[str, ...]
    kind: str
    where: dict[tuple[str, int], int]
    chunks: int
    words: int

    def _block(self, doc_id: Column) -> Column:
        return F.pmod(F.xxhash64(doc_id), F.lit(self.blocks)).cast("int")

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit("bucket")), F.lit(self.buckets)).cast("int")

    def schema(self, table: str) -> str:
        if table == "chunks":
            return f"doc_id {self.kind}, ordinal int, dl int, block int, buckets array<int>"
        return f"term string, block int, n int, top_f int, least_dl int, entries {ENTRIES.format(self.kind)}"

    def read(self, table: str, only: list[int] | None = None) -> DataFrame:
        """The rows of a table, or of some of its buckets; no other file is opened."""
        paths = [f"{self.path}/{table}/v={v}/bucket={b}" for (t, b), v in sorted(self.where.items()) if t == table and (only is None or b in only)]
        if not paths:
            return self.spark.createDataFrame([], self.schema(table))
        return self.spark.read.schema(self.schema(table)).parquet(*paths)

    def postings(self, terms: DataFrame) -> DataFrame:
        """The rows of the terms (term): their buckets are known by hash, so only those are read."""
        wanted = terms.select("term").distinct()
        only = [r["b"] for r in wanted.select(self._bucket(F.col("term")).alias("b")).distinct().collect()]  # buckets at most
        return self.read("postings", only).join(wanted, "term", "left_semi")

    def _grouped(self, chunks: DataFrame) -> DataFrame:
        """Chunks as rows of postings with their bucket, one for each term of a block. Texts are dealt by block and sorted by it, so a
        task packs one whole block after the other and holds no more than one and a batch; lists go on as arrays of
        numbers. A frequent term is many blocks, and with more partitions than buckets several tasks share a bucket."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            open_: list[pa.RecordBatch] = []

            def packed() -> Iterator[pa.RecordBatch]:
                if open_:
                    yield _postings(pa.Table.from_batches(open_).combine_chunks().to_batches()[0])
                    open_.clear()

            for b in batches:
                at = b.column("block").to_numpy()
                edges = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
                for lo, hi in zip(edges, edges[1:], strict=False):
                    if hi > lo:
                        if open_ and open_[0].column("block")[0].as_py() != at[lo]:
                            yield from packed()
                        open_.append(b.slice(lo, hi - lo))
            yield from packed()

        dealt = chunks.withColumn("block", self._block(F.col("doc_id"))).repartition("block").sortWithinPartitions("block")
        schema = f"term string, block int, n int, top_f int, least_dl int, doc_id array<{self.kind}>, ordinal array<int>, dl array<int>, f array<int>, at array<array<int>>"
        rows = words_of(dealt, self.fields).mapInArrow(run, schema)
        parts = 1 + int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets
        rows = rows.withColumn("bucket", self._bucket(F.col("term"))).withColumn("part", F.pmod("block", F.lit(parts))).repartition("bucket", "part")
        entries = F.arrays_zip("doc_id", "ordinal", "dl", "f", "at").cast(ENTRIES.format(self.kind))
        return rows.select("bucket", "term", "block", "n", "top_f", "least_dl", entries.alias("entries"))

    def _merged(self, rows: DataFrame, *keys: str) -> DataFrame:
        sums = [F.sum("n").cast("int").alias("n"), F.max("top_f").alias("top_f"), F.min("least_dl").alias("least_dl")]
        return rows.groupBy("bucket", *keys, "term", "block").agg(*sums, F.flatten(F.collect_list("entries")).alias("entries"))  # of one block

    def _chunk_rows(self, said: DataFrame) -> DataFrame:
        held = F.array_distinct(F.transform(F.array_remove("w", ""), lambda w: self._bucket(w)))
        return said.select("doc_id", "ordinal", "dl", self._block(F.col("doc_id")).alias("block"), self._bucket(F.col("doc_id")).alias("bucket"), held.alias("buckets"))

    def _put(self, table: str, rows: DataFrame, version: int, touched: set[int] | None) -> dict[tuple[str, int], int]:
        """Write rows as the buckets of a version; touched buckets without a row are gone. Returns where buckets are now."""
        names = [c.split()[0] for c in self.schema(table).replace(ENTRIES.format(self.kind), "e").split(", ")]
        out = f"{self.path}/{table}/v={version}"
        rows.select("bucket", *names).write.partitionBy("bucket").mode("overwrite").parquet(out)
        at = self.spark._jvm.org.apache.hadoop.fs.Path(out)
        found = {int(f.getPath().getName().split("=")[1]) for f in at.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(at) if f.getPath().getName().startswith("bucket=")}
        kept = {k: v for k, v in self.where.items() if k[0] == table and touched is not None and k[1] not in touched}
        return kept | {(table, b): version for b in found}

    def _commit(self, version: int, where: dict[tuple[str, int], int], chunks: int, words: int) -> Index:
        rows = [(t, b, v, self.buckets, self.blocks, chunks, words, ",".join(self.fields), self.kind) for (t, b), v in where.items()]
        rows.append(("", 0, version, self.buckets, self.blocks, chunks, words, ",".join(self.fields), self.kind))
        schema = "t string, bucket int, v int, buckets int, blocks int, chunks long, words long, fields string, kind string"
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifests/v={version}")
        return replace(self, version=version, where=where, chunks=chunks, words=words)

    def changed(self, new: DataFrame | None = None, gone: DataFrame | None = None) -> Index:
        """The index after documents came, changed or went: new holds all chunks of new and changed ones, gone doc_ids.

        The chunks of these documents name the buckets of their old terms, their texts those of the new ones; no other bucket
        is read. Within a bucket, rows of blocks without such a document pass as they are."""
        if new is None:
            new = self.spark.createDataFrame([], f"doc_id {self.kind}, ordinal int, " + ", ".join(f"{f} string" for f in self.fields))
        said = words_of(_spread(new), self.fields)
        ids = said.select("doc_id")
        ids = (ids if gone is None else ids.union(gone.select("doc_id"))).distinct()
        parts = {r["b"] for r in ids.select(self._bucket(F.col("doc_id")).alias("b")).distinct().collect()}
        held = self.read("chunks", list(parts))
        old = held.join(ids, "doc_id", "left_semi")
        rows = self._chunk_rows(said)
        left, came = (df.agg(F.count("*"), F.sum("dl")).first() for df in (old, rows))
        touched = {r["b"] for df in (old, rows) for r in df.select(F.explode("buckets").alias("b")).distinct().collect()}
        version = self.version + 1
        kept = held.join(ids, "doc_id", "left_anti").withColumn("bucket", self._bucket(F.col("doc_id")))
        where = self._put("chunks", kept.unionByName(rows), version, parts)
        before = self.read("postings", list(touched)).withColumn("bucket", self._bucket(F.col("term")))
        blocks = ids.select(self._block(F.col("doc_id")).alias("block")).distinct()
        still = before.join(blocks, "block", "left_anti")
        opened = before.join(blocks, "block", "left_semi").select("bucket", "term", "block", F.inline("entries")).join(ids, "doc_id", "left_anti")
        single = opened.select("bucket", "term", "block", F.lit(1).alias("n"), F.col("f").alias("top_f"), F.col("dl").alias("least_dl"), F.array(F.struct("doc_id", "ordinal", "dl", "f", "at")).alias("entries"))
        fresh = self._grouped(new)
        where |= self._put("postings", still.unionByName(self._merged(single.unionByName(fresh))), version, touched)
        return self._commit(version, where, self.chunks - left[0] + came[0], self.words - (left[1] or 0) + (came[1] or 0))


def build(chunks: DataFrame, path: str, fields: tuple[str, ...] = ("text",), buckets: int = 64, block_chunks: int = 1024) -> Index:
    """An index over chunks (doc_id, ordinal, fields) under path, in place of what is there."""
    spark = chunks.sparkSession
    n = chunks.count()
    empty = Index(spark, path.rstrip("/"), 0, buckets, max(1, -(-n // block_chunks)), fields, chunks.schema["doc_id"].dataType.simpleString(), {}, 0, 0)
    where = empty._put("postings", empty._grouped(chunks), 1, None)
    where |= empty._put("chunks", empty._chunk_rows(words_of(_spread(chunks), fields)), 1, None)
    rows = replace(empty, where=where).read("chunks").agg(F.count("*"), F.sum("dl")).first()
    return empty._commit(1, where, rows[0], rows[1] or 0)


def opened(spark: SparkSession, path: str, version: int | None = None) -> Index | None:
    """The newest complete version of the index under path, or a given one; None where there is none."""
    path = path.rstrip("/")
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    found = [int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(at) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    if version is None and not found:
        return None
    rows = spark.read.parquet(f"{path}/manifests/v={max(found) if version is None else version}").collect()  # a row for each bucket
    one = rows[0]
    where = {(r["t"], r["bucket"]): r["v"] for r in rows if r["t"]}
    return Index(spark, path, max(found) if version is None else version, one["buckets"], one["blocks"], tuple(one["fields"].split(",")), one["kind"], where, one["chunks"], one["words"])
