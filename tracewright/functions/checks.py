"""Checks of single values: each column is null where the value may be stored, else why it may not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_LABEL, MOST_ID, MOST_TARGET = 300, 200, 300
HIDDEN = r"[\p{Cc}\p{Cf}]"
ORIGIN = r"^http://(\[[0-9A-Fa-f:.]+\]|[^\s/?#@:\[\]]+):([0-9]{1,5})/?$"


def first_issue(*cases: tuple[Column, str]) -> Column:
    out = F.lit(None).cast("string")
    for condition, issue in reversed(cases):
        out = F.when(F.coalesce(condition, F.lit(False)), issue).otherwise(out)
    return out


def url_issue(c: Column) -> Column:
    return first_issue((c.isNull(), "missing"), (c.rlike(r"\s"), "white_space"), (~c.rlike(r"^(?i:https?):"), "scheme"), (~c.rlike(r"^(?i:https?)://(?:[^/?#@]*@)?(?:\[[0-9A-Fa-f:.]+\]|[^/?#:@]+)(?::[0-9]*)?(?:[/?#]|$)"), "host"))


def utc_time_issue(c: Column) -> Column:
    """Only YYYY-MM-DDTHH:MM:SSZ, zero-padded, of a real time."""
    shape = c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$")
    return first_issue((c.isNull(), "missing"), (~shape, "form"), (F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ssX")).isNull(), "no_such_time"))


def sha256_issue(c: Column) -> Column:
    return first_issue((c.isNull(), "missing"), (~c.rlike(r"\A[0-9a-f]{64}\z"), "form"))


def label_issue(c: Column) -> Column:
    blank = r"[\s\p{Z}]"
    return first_issue((c.isNull(), "missing"), (c.rlike(rf"\A{blank}*\z"), "empty"), (c.rlike(rf"\A{blank}|{blank}\z"), "outer_white_space"), (F.length(c) > MOST_LABEL, "too_long"), (c.rlike(HIDDEN), "control_character"))


def source_id_issue(c: Column) -> Column:
    return first_issue((c.isNull() | (c == ""), "empty"), (F.length(c) > MOST_ID, "too_long"), (c.rlike(r"[\s\p{Z}\p{Cc}\p{Cf}]"), "white_space_or_control"), (F.contains(c, F.lit("#")), "reserved_character"))


def relative_path_issue(c: Column) -> Column:
    return first_issue((c.isNull() | (F.trim(c) == ""), "empty"), (F.contains(c, F.lit("\\")), "backslash"), (c.rlike(r"^(?:/|[A-Za-z]:)"), "absolute"), (F.array_contains(F.split(c, "/"), F.lit("..")), "parent_segment"))


def query_issue(text: Column, phrases: Column, limit: Column, doc_types: Column, known: list[str]) -> Column:
    """Why a retrieval request is refused."""
    return first_issue((text.isNull() | (F.trim(text) == ""), "empty_text"), (F.length(text) > 4000, "text_too_long"), (F.size(phrases) > 16, "too_many_phrases"), (~limit.between(1, 100), "limit"), (F.size(F.array_except(doc_types, F.array(*[F.lit(k) for k in known]))) > 0, "unknown_doc_type"))


def target_origin(c: Column) -> Column:
    """A plain http://host:port origin with lower-case host, or null for anything else."""
    host, port = F.lower(F.regexp_extract(c, ORIGIN, 1)), F.regexp_extract(c, ORIGIN, 2)
    fine = (F.length(c) <= MOST_TARGET) & c.rlike(ORIGIN) & ~c.rlike(r"[\\%\s\x00-\x1f\x7f]") & (port.try_cast("int") <= 65535)
    return F.when(fine, F.concat(F.lit("http://"), F.regexp_replace(host, r"[\[\]]", ""), F.lit(":"), port.try_cast("int").cast("string")))


def freshness_issue(at: Column, now: Column, most_seconds: int, skew_seconds: int = 5) -> Column:
    """Whether an observation is too old, or further in the future than clocks may differ."""
    age = (F.unix_micros(now) - F.unix_micros(at)) / 1e6
    return first_issue((at.isNull(), "missing"), (age < -skew_seconds, "in_future"), (age > most_seconds, "stale"))
