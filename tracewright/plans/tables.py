"""The driver's tables in the shapes that the operators take."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fixed_chunks, search_words, within_budget
from ..schema import event_columns
from ..sources import index
from ..sources.scratch import scratch_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of `events` as evidence events: the user acts on the kind of event; purchases are requests, errors alarms."""
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    held = F.create_map(F.lit("method"), F.when(F.col("event_type") != "view", "get"), F.lit("query"), F.col("user_id").cast("string"), F.lit("path"), F.concat(F.lit("/"), "event_type"))
    return table(spark, sf_dir, "events").select(*event_columns(event_id=F.col("event_id"), seq=F.col("event_id"), ts_text=text, ts=F.col("ts"), source=F.col("event_type"), event_type=F.lit("http_request"), source_entity=F.col("user_id"), destination_entity=F.col("event_type"), action=F.col("event_type"), attributes=held))


def document_chunks(spark: SparkSession, sf_dir: str, size: int | None = None) -> DataFrame:
    """Documents as chunks: whole, or in windows of `size` characters."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return fixed_chunks(docs, size) if size else docs.select("doc_id", F.lit(0).alias("ordinal"), "text")


def document_index(spark: SparkSession, sf_dir: str, size: int | None = None) -> index.Index:
    """The index of document_chunks, built where the files of `documents` have none yet: it is kept under the shared folder by
    their names, lengths and times, and all queries over them read it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(at))
    path = f"{scratch_dir(spark)}/index-{hashlib.sha256(repr((files, size)).encode()).hexdigest()[:32]}"
    return index.opened(spark, path) or index.build(document_chunks(spark, sf_dir, size), path)


def benchmark_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, term for each item of `benchmark`."""
    terms = within_budget(search_words(F.col("text")))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(terms).alias("term"))


def geography(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of regions, nations and suppliers."""
    r, n, s = (table(spark, sf_dir, x) for x in ("region", "nation", "supplier"))
    name = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    nodes = r.select(name("region", "r_regionkey").alias("node_id")).union(n.select(name("nation", "n_nationkey"))).union(s.select(name("supplier", "s_suppkey")))
    up = n.select(name("region", "n_regionkey").alias("source"), name("nation", "n_nationkey").alias("target"), F.lit("connects_to").alias("edge_type"), F.lit("configured").alias("basis"))
    down = s.select(name("nation", "s_nationkey").alias("source"), name("supplier", "s_suppkey").alias("target"), F.lit("forwards").alias("edge_type"), F.lit("observed").alias("basis"))
    side = s.select(name("nation", "s_nationkey").alias("source"), name("supplier", "s_suppkey").alias("target"), F.lit("hosts").alias("edge_type"), F.lit("configured").alias("basis"))
    return nodes, up.union(down).union(side)
