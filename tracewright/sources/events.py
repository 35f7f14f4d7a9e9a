"""Event tables: JSON-lines in and out, and the union of all sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EVENT, SOURCE_ORDER, parse_time

JSON_EVENT = "event_id string, timestamp string, source string, event_type string, source_entity string, destination_entity string, action string, attributes map<string,string>"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines events; a line that does not parse is an error that names the file. Attribute values that are records stay as JSON text."""
    rows = spark.read.schema(JSON_EVENT).option("mode", "FAILFAST").json(path)
    return rows.select("event_id", F.lit(None).cast("long").alias("seq"), F.col("timestamp").alias("ts_text"), parse_time(F.col("timestamp")).alias("ts"), *[c.split()[0] for c in JSON_EVENT.split(", ")[2:]])


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """file and text of the lines that are no events, for reports that must not stop at the first."""
    rows = spark.read.schema(JSON_EVENT + ", broken string").option("columnNameOfCorruptRecord", "broken").json(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), "broken", "event_id").where("broken is not null or event_id is null")


def sorted_json(*columns: str) -> Column:
    """A row as JSON with keys in order, so that equal rows give equal text."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def write_events(events: DataFrame, path: str) -> None:
    """JSON lines with keys in order."""
    out = events.select(F.col("ts_text").alias("timestamp"), "event_id", "source", "event_type", "source_entity", "destination_entity", "action", F.map_from_entries(F.array_sort(F.map_entries("attributes"))).alias("attributes"))
    out.select(sorted_json(*out.columns).alias("value")).write.mode("overwrite").text(path)


def union_sources(spark: SparkSession, *sources: DataFrame | None) -> DataFrame:
    """All rows of the sources that exist, numbered by source in arrival order and place in the source; sources
    that are not known come last."""
    there = [s for s in sources if s is not None]
    if not there:
        return spark.createDataFrame([], EVENT)
    order = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in SOURCE_ORDER]), F.col("source")), F.lit(0).cast("long")), F.lit(len(SOURCE_ORDER) + 1))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), there).withColumn("seq", order.cast("long") * F.lit(1 << 48) + F.coalesce("seq", F.lit(0)))
