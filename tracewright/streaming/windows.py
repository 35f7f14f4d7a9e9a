"""Event-time windows, batch or streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def used_tokens(requests: DataFrame, account: str, at: str, tokens: str, seconds: int = 60) -> DataFrame:
    """Tokens in the window (at - seconds, at] of each request's account, the request's own included; released requests are
    filtered before. Batch form."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    w = Window.partitionBy(account).orderBy("_at").rangeBetween(-(seconds * 1_000_000) + 1, 0)
    return requests.withColumn("_at", micros).withColumn("used", F.sum(tokens).over(w)).drop("_at")


def activity(events: DataFrame, at: str, keys: list[str], length: str = "1 minute", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by key and tumbling or sliding window; on a stream, rows later than the watermark are dropped and windows close."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    window = F.window(at, length, slide) if slide else F.window(at, length)
    return rows.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def sessions(events: DataFrame, at: str, key: str, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions by key: runs of events with less than `gap` between them."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def first_seen(events: DataFrame, keys: list[str], at: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each observation, by its time (rows without one come last). A stream gives each observation once, as it
    arrives: repeats inside the watermark are dropped."""
    if events.isStreaming:
        return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
    rest = [c for c in events.columns if c not in (*keys, at)]
    if not rest:
        return events.groupBy(*keys).agg(F.min(at).alias(at)).select(*events.columns)
    row = F.min_by(F.struct(at, *rest), F.struct(F.col(at).isNull(), at))
    return events.groupBy(*keys).agg(row.alias("_r")).select(*[c if c in keys else F.col(f"_r.{c}").alias(c) for c in events.columns])


def latest(rows: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """The last row of each key, for the result of a stream that is read as a table."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")
