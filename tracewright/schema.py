"""The columns of the fact tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every evidence source yields these columns; `seq` is the place in arrival order that first- and last-writer rules follow.
EVENT = "event_id string, seq long, ts_text string, ts timestamp, source string, event_type string, source_entity string, destination_entity string, action string, attributes map<string,string>"
EVENT_COLUMNS = [c.split()[0] for c in EVENT.split(", ")]

NODE = "node_id string, node_type string, name string, basis string, attributes map<string,string>, evidence_ids array<string>, source_artifacts array<string>, seq long"
EDGE = "source string, target string, edge_type string, basis string, attributes map<string,string>, evidence_ids array<string>, source_artifacts array<string>, seq long"

#: Order in which sources arrive.
SOURCE_ORDER = ["docker", "nginx", "application", "linux_auth", "packet_capture"]


def event_columns(**columns: Column) -> list[Column]:
    """Select list of an event in schema order, typed; a missing column is null."""
    kinds = dict(c.split() for c in EVENT.split(", "))
    return [columns.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in EVENT_COLUMNS]


def attributes(**columns: Column) -> Column:
    """Open attributes as text; what is null is unknown and stays null."""
    return F.map_from_arrays(F.array(*[F.lit(k) for k in columns]), F.array(*[c.cast("string") for c in columns.values()]))


def parse_time(text: Column) -> Column:
    """ISO timestamps with any fraction (beyond microseconds cut); without a zone they are UTC, what does not parse is null."""
    short = F.regexp_replace(text, r"(\.\d{6})\d+", "$1")
    return F.try_to_timestamp(F.when(short.rlike(r"(?i)(z|utc|[+-]\d{2}:?\d{2})$"), short).otherwise(F.concat(short, F.lit("Z"))))


def utc_text(ts: Column, fraction: bool = False) -> Column:
    """A timestamp as ISO text in UTC, whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss" + (".SSSSSS" if fraction else "") + "'Z'")
