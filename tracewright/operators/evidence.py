"""Entity resolution, deduplication and views of evidence events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.requests import attribute

IPV4 = r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?!$)|$)){4}$"
IPV6 = r"(?i)^(?=.*:.*:)[0-9a-f:]+(?:\d{1,3}(?:\.\d{1,3}){3})?(?:%\w+)?$"
#: Attributes that only an answer key has.
WITHHELD = ["ground_truth", "attack_path", "is_attack", "label", "root_cause"]
FORBIDDEN = "^expected_"


def is_ip(name: Column) -> Column:
    return name.rlike(IPV4) | name.rlike(IPV6)


def entity_keys(events: DataFrame) -> DataFrame:
    """kind (ip or name), key, canonical: the last observation of a key in arrival order names its entity."""
    seen = events.where("source = 'docker' and event_type = 'network_membership' and source_entity <> ''")
    own = seen.select("seq", F.col("source_entity").alias("name"), attribute("ip_address").alias("ip"), *[F.from_json(attribute(k), "array<string>").alias(k) for k in ("aliases", "dns_names")])
    none = F.array().cast("array<string>")
    places = F.concat(F.transform(F.coalesce("aliases", none), lambda x: F.struct(F.lit(0).alias("o"), x.alias("key"))), F.transform(F.coalesce("dns_names", none), lambda x: F.struct(F.lit(1).alias("o"), x.alias("key"))), F.array(F.struct(F.lit(2).alias("o"), F.col("name").alias("key"))))
    names = own.select("seq", "name", F.explode(places).alias("p")).select(F.lit("name").alias("kind"), F.col("p.key").alias("key"), "name", F.struct("seq", "p.o").alias("at"))
    ips = own.where("ip <> ''").select(F.lit("ip").alias("kind"), F.col("ip").alias("key"), "name", F.struct("seq", F.lit(0).alias("o")).alias("at"))
    return names.unionByName(ips).groupBy("kind", "key").agg(F.concat(F.lit("container:"), F.max_by("name", "at")).alias("canonical"))


def entities(events: DataFrame) -> DataFrame:
    """One row for each entity with its last container id and the sets of its addresses and names."""
    seen = events.where("source = 'docker' and event_type = 'network_membership' and source_entity <> ''")
    sets = lambda k: F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(F.from_json(attribute(k), "array<string>"), F.array().cast("array<string>"))))))
    return seen.groupBy(F.concat(F.lit("container:"), "source_entity").alias("canonical"), F.col("source_entity").alias("name")).agg(F.max_by(F.nullif(attribute("container_id"), F.lit("")), F.when(attribute("container_id") != "", F.col("seq"))).alias("container_id"), F.array_sort(F.collect_set(F.nullif(attribute("ip_address"), F.lit("")))).alias("ip_addresses"), sets("aliases").alias("aliases"), sets("dns_names").alias("dns_names"))


def resolve(events: DataFrame, keys: DataFrame, columns: tuple[str, ...] = ("source_entity", "destination_entity")) -> DataFrame:
    """For each column c: c_canonical (by address, else by name) and c_type (ip, or name where a name is known).

    Spark picks the join by the size of keys."""
    out = events
    for c in columns:
        ips = keys.where("kind = 'ip'").select(F.col("key").alias("_i"), F.col("canonical").alias("_ic"))
        names = keys.where("kind = 'name'").select(F.col("key").alias("_n"), F.col("canonical").alias("_nc"))
        out = out.join(ips, F.col(c) == F.col("_i"), "left").join(names, F.col(c) == F.col("_n"), "left")
        kind = F.when(is_ip(F.col(c)), "ip").when(F.col("_nc").isNotNull(), "name")
        out = out.withColumns({f"{c}_canonical": F.coalesce("_ic", "_nc"), f"{c}_type": kind}).drop("_i", "_ic", "_n", "_nc")
    return out


def merge_observations(events: DataFrame) -> DataFrame:
    """One event for each observation: network memberships by their seven identifying parts, others by identity. The first
    row stays, with the sources of all in arrival order (there are few kinds) and n_observations; observations lists the ids."""
    names = events.columns
    rows = _keyed(events)
    keys = [c for c in rows.columns if c.startswith("_k")]
    merged = rows.groupBy(*keys).agg(F.min_by(F.struct(*names), "seq").alias("_row"), F.count_distinct("event_id").alias("n_observations"))
    sources = rows.groupBy(*keys, "source").agg(F.min("seq").alias("seq")).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "source"))), lambda x: x["source"]).alias("evidence_sources"))
    same = [F.col(k).eqNullSafe(F.col(k + "s")) for k in keys]
    named = sources.select(*[F.col(k).alias(k + "s") for k in keys], "evidence_sources")
    out = merged.join(named, reduce(lambda a, b: a & b, same))
    return out.select("_row.*", "evidence_sources", "n_observations")


def observations(events: DataFrame) -> DataFrame:
    """first_id, event_id, source, seq: every event beside the one that stays for its observation."""
    rows = _keyed(events)
    w = Window.partitionBy(*[c for c in rows.columns if c.startswith("_k")]).orderBy("seq")
    return rows.select(F.first("event_id").over(w).alias("first_id"), "event_id", "source", "seq")


def _keyed(events: DataFrame) -> DataFrame:
    """Events with the parts that identify their observation."""
    member = F.col("event_type") == "network_membership"
    shared = [F.col(c) for c in ("event_type", "source_entity", "destination_entity", "action")]
    own = [F.when(member, attribute(k)) for k in ("ip_address", "container_id", "network_id")] + [F.when(~member, F.col(c)) for c in ("source", "ts_text", "event_id")]
    key = [c.alias(f"_k{i}") for i, c in enumerate([*shared, *own])]
    return events.select(*key, *events.columns)


def without_answers(events: DataFrame) -> DataFrame:
    """Events without columns and attributes that only answer keys have."""
    gone = [c for c in events.columns if c in WITHHELD or c.startswith("expected_")]
    keep = F.map_filter("attributes", lambda k, _: ~k.isin(WITHHELD) & ~k.rlike(FORBIDDEN))
    return events.drop(*gone).withColumn("attributes", keep)


def refuse_answers(rows: DataFrame, attributes: str = "attributes") -> DataFrame:
    """The same rows; running them fails if an attribute of an answer key is there."""
    bad = F.filter(F.map_keys(attributes), lambda k: k.isin(WITHHELD) | k.rlike(FORBIDDEN))
    return rows.withColumn(attributes, F.when(F.size(bad) > 0, F.raise_error(F.concat(F.lit("answer-key fields: "), F.array_join(bad, ", ")))).otherwise(F.col(attributes)))


def text_view(events: DataFrame) -> DataFrame:
    """event_id and one line of key=value words of the kinds that a reader is shown; null is a dash, packets are left out."""
    show = {"container_state": ["image", "network_mode", "running", "privileged"], "network_membership": ["ip_address", "mac_address", "network_id"], "http_request": ["method", "path", "query", "status", "upstream"]}
    word = lambda k, v: F.concat(F.lit(f"{k}="), F.coalesce(v, F.lit("-")))
    head = [word("id", F.col("event_id")), word("time", F.col("ts_text")), word("source", F.col("source")), word("from", F.col("source_entity")), word("to", F.col("destination_entity")), word("action", F.col("action"))]
    line = F.lit(None).cast("string")
    for kind, keys in show.items():
        line = F.when(F.col("event_type") == kind, F.concat_ws(" ", *head, *[word(k, attribute(k)) for k in keys])).otherwise(line)
    return events.where(F.col("event_type").isin(list(show))).select("event_id", line.alias("line"))
