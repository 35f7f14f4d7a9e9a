"""Timeline, correlations, claims and the root-cause rule of an incident."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.requests import attribute, interpretation, stage, suspicious
from ..functions.text import decoded_twice
from ..sources.scratch import numbered

NEAR_SECONDS = 5.0


def timeline(events: DataFrame) -> DataFrame:
    """Events with their stage, ordered by time as text and then id; position counts inside an incident where there is one."""
    found = suspicious()
    rows = events.withColumn("suspicious", found).withColumn("stage_label", stage(F.col("suspicious"))).withColumn("interpretation_status", interpretation(F.col("stage_label")))
    return rows.orderBy("ts_text", "event_id")


def numbered_ids(rows: DataFrame, prefix: str, name: str, *order: Column | str, by: tuple[str, ...] = ()) -> DataFrame:
    """Sequential ids in an order, `prefix_001` on; by: columns of the group that is numbered, such as the incident. Without
    one, all rows are numbered range by range."""
    if by:
        rows, n = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))), F.col("_n")
    else:
        rows, n = numbered(rows, "_n", *order), F.col("_n")
    return rows.withColumn(name, F.concat(F.lit(prefix + "_"), F.lpad(n.cast("string"), F.greatest(F.lit(3), F.length(n.cast("string"))), F.lit("0")))).drop("_n")


def requests(events: DataFrame) -> DataFrame:
    """The events that are requests, with what correlation compares."""
    asked = (F.lower("event_type") == "http_request") | (F.coalesce(attribute("method"), attribute("path"), F.lit("")) != "")
    query = F.trim(decoded_twice(F.coalesce(attribute("query"), F.lit(""))))
    return events.where(asked).select("event_id", "ts_text", "ts", F.coalesce("source", F.lit("")).alias("source"), F.upper(F.coalesce(attribute("method"), F.lit(""))).alias("method"), query.alias("query"), attribute("path").alias("path"), F.nullif(attribute("request_id"), F.lit("")).alias("request_id"), suspicious().alias("suspicious"))


def correlate(asked: DataFrame, near: float = NEAR_SECONDS) -> DataFrame:
    """Pairs of requests from different sources, one of them suspicious, that share a request id, or the decoded query and
    method within `near` seconds.

    The two rules are equi joins. Time is cut in slices of `near` seconds, and a request meets those of its own and the
    neighbouring slices, so that no query or method gathers more than a few seconds of rows."""
    names = ["event_id", "ts_text", "ts", "source", "path", "suspicious", "method", "query", "request_id"]
    left, right = (asked.select(*[F.col(c).alias(f"{side}_{c}") for c in names]) for side in "ab")
    after = F.struct("b_ts_text", "b_event_id") > F.struct("a_ts_text", "a_event_id")
    pair = after & (F.col("a_source") != F.col("b_source")) & (F.col("a_suspicious") | F.col("b_suspicious"))
    by_id = left.join(right, (F.col("a_request_id") == F.col("b_request_id")) & pair)
    cut = lambda c: F.floor(F.unix_micros(c) / (near * 1e6))
    close = F.abs(F.unix_micros("a_ts") - F.unix_micros("b_ts")) <= near * 1e6
    sliced = right.where("b_query <> '' and b_method <> '' and b_ts is not null").withColumn("slice", F.explode(F.array(*[cut(F.col("b_ts")) + k for k in (-1, 0, 1)])))
    by_query = left.where("a_ts is not null").withColumn("at", cut(F.col("a_ts"))).join(sliced, (F.col("a_query") == F.col("b_query")) & (F.col("a_method") == F.col("b_method")) & (F.col("at") == F.col("slice")) & close & pair).drop("at", "slice")
    other = ~F.coalesce(F.col("a_request_id") == F.col("b_request_id"), F.lit(False))
    pairs = by_id.unionByName(by_query.where(other))
    shared = F.coalesce(F.col("a_request_id") == F.col("b_request_id"), F.lit(False))
    delta = F.abs(F.unix_micros("a_ts") - F.unix_micros("b_ts")) / 1e6
    signals = F.array_compact(
        F.array(
            F.when(shared, "request_id_matches"),
            F.when((F.col("a_query") != "") & (F.col("a_query") == F.col("b_query")), "decoded_query_matches_exactly"),
            F.when((F.col("a_method") != "") & (F.col("a_method") == F.col("b_method")), "http_method_matches"),
            F.when(delta <= near, "timestamps_within_5_seconds"),
            F.when(~F.col("a_path").eqNullSafe(F.col("b_path")), "paths_differ_possible_proxy_rewrite_not_assumed"),
        )
    )
    return pairs.select(
        F.col("a_event_id").alias("left_id"),
        F.col("b_event_id").alias("right_id"),
        F.when(shared, "shared_request_id_candidate").otherwise("candidate_not_confirmed").alias("status"),
        F.when(shared, "stronger_candidate").otherwise("strong_candidate").alias("strength"),
        signals.alias("signals"),
        F.round(delta, 6).alias("timestamp_delta_seconds"),
        F.col("a_ts_text").alias("left_ts_text"),
        F.col("b_ts_text").alias("right_ts_text"),
    )


def claims(line: DataFrame) -> DataFrame:
    """One claim for each suspicious event."""
    where = F.coalesce(F.nullif(attribute("path"), F.lit("")), F.nullif(attribute("url"), F.lit("")), F.lit("request data"))
    said = F.concat(F.lit("Event "), "event_id", F.lit(" contains SQL-injection-like syntax in "), where, F.lit("."))
    return line.where("suspicious").select(said.alias("statement"), F.lit("observed_indicator").alias("status"), F.array("event_id").alias("evidence_ids"), F.col("ts_text").alias("observed_at"), "source", F.lit(0.65).alias("confidence"), "event_id")


def relationships(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the names of both ends; an end that is no node keeps its id."""
    named = nodes.groupBy("node_id").agg(F.first("name").alias("name"))
    a, b = named.select(F.col("node_id").alias("_a"), F.col("name").alias("_an")), named.select(F.col("node_id").alias("_b"), F.col("name").alias("_bn"))
    joined = edges.join(a, F.col("source") == F.col("_a"), "left").join(b, F.col("target") == F.col("_b"), "left")
    return joined.select("source", F.coalesce("_an", "source").alias("source_name"), "target", F.coalesce("_bn", "target").alias("target_name"), F.col("edge_type").alias("relationship"), F.lower("basis").alias("basis"), F.col("source").alias("source_id"), F.col("target").alias("target_id"))


def request_relationships(line: DataFrame, related: DataFrame, cited: DataFrame) -> DataFrame:
    """Suspicious events with the observed edges that cite them: cited (source, target, edge_type, id) are the edges' ids."""
    ids = cited.select(F.col("source").alias("source_id"), F.col("target").alias("target_id"), F.col("edge_type").alias("relationship"), F.col("id").alias("event_id"))
    cited = related.where("basis = 'observed'").join(ids, ["source_id", "target_id", "relationship"])
    return line.where("suspicious").select("event_id", "ts_text").join(cited, "event_id")


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(F.coalesce("event_type", F.lit("unknown")).alias("event_type")).agg(F.count("*").alias("n"))


def root_cause(line: DataFrame, *by: str) -> DataFrame:
    """One finding for each incident (by): a hypothesis where there is an indicator, else insufficient evidence. Its events are
    those of line that are suspicious, n_supporting of them."""
    some = F.count_if("suspicious") > 0
    return line.groupBy(*by).agg(
        F.when(some, "hypothesis_not_confirmed").otherwise("insufficient_evidence").alias("status"),
        F.when(some, "potential_sql_injection (CWE-89 hypothesis)").otherwise("unknown").alias("vulnerability_type"),
        F.when(some, 0.55).otherwise(0.0).alias("confidence"),
        F.count_distinct(F.when(F.col("suspicious"), F.col("event_id"))).alias("n_supporting"),
    )


def unknown_references(cited: DataFrame, ids: str, known: DataFrame, key: str) -> DataFrame:
    """Ids in the array column `ids` that known does not have: nothing may be claimed without evidence."""
    each = cited.select(F.explode(ids).alias("missing_id")).distinct()
    return each.join(known.select(F.col(key).alias("missing_id")).distinct(), "missing_id", "left_anti")


def unioned(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
