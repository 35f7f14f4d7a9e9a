"""A document store on Parquet: change classes, idempotent upsert, deletion, integrity, and reuse of vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .events import sorted_json


def digest(*columns: str) -> Column:
    """SHA-256 of a row's canonical JSON."""
    return F.sha2(sorted_json(*columns), 256)


def change_classes(old: DataFrame, new: DataFrame, key: str, content: list[str], metadata: list[str]) -> DataFrame:
    """key, change (created, updated, unchanged, absent) and which part changed. Null content or metadata is a value."""
    a = old.select(F.col(key).alias("_key"), digest(*content).alias("c"), digest(*metadata).alias("m"))
    b = new.select(F.col(key), digest(*content).alias("c2"), digest(*metadata).alias("m2"))
    changed = (F.col("c") != F.col("c2")) | (F.col("m") != F.col("m2"))
    change = F.when(F.col("c").isNull(), "created").when(F.col("c2").isNull(), "absent").when(changed, "updated").otherwise("unchanged")
    both = F.col("c").isNotNull() & F.col("c2").isNotNull()
    return a.join(b, F.col("_key") == F.col(key), "full").select(F.coalesce(key, "_key").alias(key), change.alias("change"), (both & (F.col("c") != F.col("c2"))).alias("content_changed"), (both & (F.col("m") != F.col("m2"))).alias("metadata_changed"))


def ingest_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id, change and its flags for documents with their chunks' state: content_sha256, document_sha256 (content and
    metadata), provenance, config, chunks_sha256, chunk_count. A change of metadata alone is metadata_changed; chunks are
    replaced where they differ in any way."""
    names = ["content_sha256", "document_sha256", "provenance", "config", "chunks_sha256", "chunk_count"]
    before = old.select(F.col("doc_id").alias("_id"), *[F.col(c).alias("_" + c) for c in names])
    rows = new.select("doc_id", *names).join(before, F.col("doc_id") == F.col("_id"), "left")
    differ = lambda c: ~F.col(c).eqNullSafe(F.col("_" + c))
    known = F.col("_id").isNotNull()
    flags = {
        "content_changed": known & differ("content_sha256"),
        "metadata_changed": known & differ("document_sha256") & ~differ("content_sha256"),
        "provenance_changed": known & ~differ("document_sha256") & differ("provenance"),
        "config_changed": known & differ("config"),
        "chunks_replaced": known & (differ("chunks_sha256") | differ("chunk_count")),
    }
    rows = rows.withColumns(flags)
    some = F.col("chunks_replaced") | F.col("config_changed") | F.col("provenance_changed") | (known & differ("document_sha256"))
    return rows.select("doc_id", F.when(~known, "created").when(some, "updated").otherwise("unchanged").alias("change"), *flags)


def cascade(gone: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """Documents, chunks, postings and vectors without those of the doc_ids in gone."""
    return [delete(t, gone, "doc_id") for t in tables]


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new put in their place; rows that are the same stay as they were."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def write_store(table: DataFrame, path: str, version: int) -> str:
    """Write a version beside the others; readers take the newest one that has its success marker."""
    out = f"{path}/version={version:08d}"
    table.write.parquet(out)
    return out


def delete(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return table.join(gone.select(key).distinct(), key, "left_anti")


def duplicates(table: DataFrame, key: str, *columns: str) -> DataFrame:
    """Repeated keys: n rows, n_kinds different ones; identical rows may be skipped, others conflict."""
    return table.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(digest(*columns)).alias("n_kinds")).where("n > 1").withColumn("conflict", F.col("n_kinds") > 1)


def chunk_digests(chunks: DataFrame) -> DataFrame:
    """doc_id, n_chunks, digest of its chunks in order; valid if ordinals run from 0 without gaps."""
    listed = F.array_sort(F.collect_list(F.struct("ordinal", F.sha2("text", 256).alias("sha"))))  # of one document
    lines = F.transform("l", lambda x: F.concat_ws("\t", x["ordinal"].cast("string"), x["sha"]))
    out = chunks.groupBy("doc_id").agg(listed.alias("l"), F.count("*").alias("n_chunks"), F.max("ordinal").alias("top"), F.count_distinct("ordinal").alias("d"))
    return out.select("doc_id", "n_chunks", F.sha2(F.array_join(lines, "\n"), 256).alias("digest"), ((F.col("top") == F.col("n_chunks") - 1) & (F.col("d") == F.col("n_chunks"))).alias("valid"))


def _lines(documents: DataFrame) -> Column:
    return F.concat_ws("\t", "doc_id", F.sha2("text", 256))


def corpus_fingerprint(documents: DataFrame) -> DataFrame:
    """n_documents and the SHA-256 of a corpus's sorted `doc_id<tab>sha` lines, as stored fingerprints have it. The lines come
    together in one row, which suits a reference corpus; a large one is compared by corpus_checksum."""
    lines = documents.select(_lines(documents).alias("line"))
    return lines.agg(F.count("*").alias("n_documents"), F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("fingerprint"))


def corpus_checksum(documents: DataFrame, parts: int = 256) -> DataFrame:
    """n_documents and a checksum of a corpus of any size: its lines' digests are summed by hash bucket, in any order, then the
    buckets' sums are digested."""
    rows = documents.select(F.pmod(F.xxhash64("doc_id"), F.lit(parts)).alias("bucket"), _lines(documents).alias("line"))
    sums = rows.groupBy("bucket").agg(F.count("*").alias("n"), *[F.sum(F.conv(F.substring(F.sha2("line", 256), 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")).alias(f"s{k}") for k in range(8)])
    whole = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "bucket", "n", *[f"s{k}" for k in range(8)]))), "\n")  # of the buckets
    return sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_documents"), F.sha2(whole, 256).alias("checksum"))


def integrity(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """chunk_id, issue for chunks that are not what their document holds at their place."""
    own = documents.select(F.col("doc_id").alias("d"), F.col("content").alias("whole"))
    cut = F.expr("substring(whole, int(char_start + 1), int(char_end - char_start))")
    issue = F.when(F.col("whole").isNull(), "unknown_document").when(cut != F.col("text"), "not_a_slice")
    return chunks.join(own, F.col("doc_id") == F.col("d"), "left").select("chunk_id", issue.alias("issue")).where("issue is not null")


def reuse_vectors(chunks: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks whose key (digest of text and configuration) is cached, with their vectors, and those still to embed."""
    known = cache.select("entry_key", "vector")
    return chunks.join(known, "entry_key"), chunks.join(known.select("entry_key"), "entry_key", "left_anti")
