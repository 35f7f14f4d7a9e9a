"""Text log sources. A physical line's number names its event, so lines are numbered without gathering a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import attributes, event_columns, parse_time, utc_text

#: Fixed patterns: the formats of the log lines.
ACCESS = r'^(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+"([A-Z]+)\s+(\S+)\s+HTTP/([^"]+)"\s+(\d{3})\s+(\d+)\s+"([^"]*)"\s+"([^"]*)"\s+upstream=(\S+)\s+upstream_status=(\S+)\s+request_time=(\S+)$'
APPLICATION = r'^(\S+)\s+INFO:\s+([^:]+):(\d+)\s+-\s+"([A-Z]+)\s+(\S+)\s+HTTP/([^"]+)"\s+(\d{3})\s+(.*)$'
AUTH = r"^(\S+)\s+(\S+)\s+sshd:\s+pam_unix\(sshd:auth\):\s+(.*)$"
PAIR = r"([A-Za-z_]+)=(\S*)"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, n (1-based line number), value, for files of any size.

    Spark keeps line order inside a split. Lines are counted by split, and a running sum over a file's splits, of which
    there are few, gives each split's first number."""
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lines = spark.read.text(path).select("value", *where).withColumn("_at", F.monotonically_increasing_id())
    splits = lines.groupBy("file", "block").agg(F.count("*").alias("lines"), F.min("_at").alias("_from"))
    before = F.sum("lines").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.withColumn("_before", F.coalesce(before, F.lit(0))).drop("lines")
    return lines.join(splits, ["file", "block"]).select("file", (F.col("_before") + F.col("_at") - F.col("_from") + 1).alias("n"), "value")


def split_target(target: Column) -> tuple[Column, Column]:
    """Path and query of a request target; a fragment is neither."""
    plain = F.regexp_replace(F.substring_index(target, "#", 1), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", "")
    return F.substring_index(plain, "?", 1), F.when(F.contains(plain, F.lit("?")), F.regexp_replace(plain, r"^[^?]*\?", "")).otherwise("")


def _groups(line: Column, pattern: str, n: int) -> list[Column]:
    return [F.regexp_extract(line, pattern, k) for k in range(1, n + 1)]


def access_events(lines: DataFrame, prefix_time: bool = False) -> DataFrame:
    """Access-log lines (n, value) as events. A line that fits only without its first word (a container prefix) counts;
    others are skipped. prefix_time takes that first word for the event's time instead of the bracketed one."""
    rest = F.regexp_replace("value", r"^[^ ]* ", "")
    fits = F.col("value").rlike(ACCESS)
    line = F.when(fits, F.col("value")).when(F.contains("value", F.lit(" ")) & rest.rlike(ACCESS), rest)
    rows = lines.select("n", "value", fits.alias("whole"), line.alias("line")).where("line is not null")
    ip, at, method, target, version, status, size, referer, agent, upstream, upstream_status, seconds = _groups(F.col("line"), ACCESS, 12)
    path, query = split_target(target)
    own = utc_text(F.try_to_timestamp(at, F.lit("dd/MMM/yyyy:HH:mm:ss Z")))
    text = F.when(~F.col("whole"), F.substring_index("value", " ", 1)).otherwise(own) if prefix_time else own
    known = attributes(method=method, path=path, query=query, http_version=version, status=status, upstream=upstream, upstream_status=upstream_status, body_bytes=size, request_time=F.when(seconds.rlike(r"^[0-9.eE+-]+$"), seconds), referer=referer, user_agent=agent, nginx_timestamp=at)
    to = F.when(upstream != "-", F.when(F.contains(upstream, F.lit(":")), F.regexp_replace(upstream, r":[^:]*$", "")).otherwise(upstream))
    return rows.select(*event_columns(event_id=F.concat(F.lit("nginx-"), "n"), seq=F.col("n"), ts_text=text, ts=parse_time(text), source=F.lit("nginx"), event_type=F.lit("http_request"), source_entity=ip, destination_entity=to, action=F.concat_ws(" ", method, path), attributes=known))


def application_events(lines: DataFrame) -> DataFrame:
    """Application-server request lines as events."""
    at, ip, port, method, target, version, status, said = _groups(F.col("value"), APPLICATION, 8)
    path, query = split_target(target)
    known = attributes(client_port=port, method=method, path=path, query=query, http_version=version, status=status, status_text=said)
    rows = lines.where(F.col("value").rlike(APPLICATION))
    return rows.select(*event_columns(event_id=F.concat(F.lit("application-"), "n"), seq=F.col("n"), ts_text=at, ts=parse_time(at), source=F.lit("application"), event_type=F.lit("http_request"), source_entity=ip, action=F.concat_ws(" ", method, path), attributes=known))


def key_values(text: Column) -> Column:
    """key=value words as a map; of a repeated key the last value counts."""
    keys, values = F.regexp_extract_all(text, F.lit(PAIR), 1), F.regexp_extract_all(text, F.lit(PAIR), 2)
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), p["k"]))
    return F.map_from_entries(last)


def auth_events(lines: DataFrame) -> DataFrame:
    """Authentication lines as events; the kind is the first of failure, opened, closed that the message names."""
    at, container, message = _groups(F.col("value"), AUTH, 3)
    rows = lines.where(F.col("value").rlike(AUTH)).select("n", at.alias("at"), container.alias("container"), message.alias("message"))
    m = F.col("message")

    def kind(failed: str) -> Column:
        return F.when(F.contains(m, F.lit("authentication failure")), failed).when(F.contains(m, F.lit("session opened")), "session_opened").when(F.contains(m, F.lit("session closed")), "session_closed").otherwise("authentication_event")

    pairs = rows.withColumn("kv", key_values(m))
    got = {k: F.element_at("kv", F.lit(k)) for k in ("user", "rhost", "tty", "logname")}
    known = attributes(container_id=F.col("container"), **got, raw_message=m)
    return pairs.select(*event_columns(event_id=F.concat(F.lit("linux-auth-"), "n"), seq=F.col("n"), ts_text=F.col("at"), ts=parse_time(F.col("at")), source=F.lit("linux_auth"), event_type=kind("authentication_failure"), source_entity=got["rhost"], action=kind("authentication_failed"), attributes=known))


def header_lines(lines: DataFrame) -> DataFrame:
    """`Key: value` files: file, n, key, value; lines without a colon are skipped."""
    key, value = F.trim(F.substring_index("value", ":", 1)), F.trim(F.regexp_replace("value", r"^[^:]*:", ""))
    return lines.where(F.contains("value", F.lit(":")) & (key != "")).select("file", "n", key.alias("key"), value.alias("value"))


def request_results(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated request results with a header line, all as text."""
    return spark.read.option("sep", "\t").option("header", True).csv(path)
