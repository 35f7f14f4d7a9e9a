"""Container and network snapshots (JSON arrays) as events."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import attributes, event_columns, parse_time

#: Places in arrival order: room for a record's parts, and network files after container files.
STEP, NETWORKS_AFTER = 1 << 16, 1 << 44
PORTS = "map<string,array<struct<HostIp:string,HostPort:string>>>"
CONTAINER = f"""
    Id string, Name string, Created string, RestartCount long,
    State struct<StartedAt:string,Status:string,Running:boolean,Paused:boolean,Restarting:boolean,OOMKilled:boolean,Dead:boolean,ExitCode:long>,
    HostConfig struct<NetworkMode:string,Privileged:boolean,ReadonlyRootfs:boolean>,
    Config struct<Image:string,ExposedPorts:map<string,string>,Env:array<string>>,
    Path string, Args array<string>,
    NetworkSettings struct<Ports:{PORTS},Networks:map<string,struct<NetworkID:string,EndpointID:string,IPAddress:string,Gateway:string,MacAddress:string,Aliases:array<string>,DNSNames:array<string>>>>
"""
NETWORK = "Name string, Id string, Created string, Scope string, Driver string, Containers map<string,struct<Name:string,EndpointID:string,MacAddress:string,IPv4Address:string,IPv6Address:string>>"


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file, index, item of JSON files that hold one array of records; a file that does not parse is an error."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    fields = " ".join(schema.split())
    items = F.from_json("value", f"array<struct<{_as_struct(fields)}>>", {"mode": "FAILFAST"})
    return whole.select("file", F.posexplode(items).alias("index", "item"))


def _as_struct(fields: str) -> str:
    """Column list `a int, b string` as struct fields `a:int,b:string`, at depth 0 only."""
    out, depth = [], 0
    for part in fields.split(", "):
        if depth == 0:
            name, kind = part.split(" ", 1)
            out.append(f"{name}:{kind}")
        else:
            out[-1] += "," + part
        depth += part.count("<") - part.count(">")
    return ",".join(out)


def published_ports(ports: Column) -> Column:
    """Flat list of (container_port, host_ip, host_port)."""
    each = F.transform(F.map_entries(F.coalesce(ports, F.create_map().cast(PORTS))), lambda e: F.transform(F.coalesce(e["value"], F.array().cast("array<struct<HostIp:string,HostPort:string>>")), lambda b: F.struct(e["key"].alias("container_port"), b["HostIp"].alias("host_ip"), b["HostPort"].alias("host_port"))))
    return F.flatten(each)


def _joined(names: Column) -> Column:
    return F.to_json(F.coalesce(names, F.array().cast("array<string>")))


def container_events(containers: DataFrame) -> DataFrame:
    """One container_state for each container and one network_membership for each of its networks; null aliases are none."""
    c, s, h, g = (F.col(x) for x in ("item", "item.State", "item.HostConfig", "item.Config"))
    rows = containers.select("index", "item", F.regexp_replace("item.Name", "^/+", "").alias("name"), F.coalesce("item.State.StartedAt", "item.Created").alias("at"))
    known = attributes(container_id=c["Id"], image=g["Image"], network_mode=h["NetworkMode"], running=s["Running"], paused=s["Paused"], restarting=s["Restarting"], oom_killed=s["OOMKilled"], dead=s["Dead"], restart_count=c["RestartCount"], exit_code=s["ExitCode"], privileged=h["Privileged"], readonly_rootfs=h["ReadonlyRootfs"], exposed_ports=_joined(F.array_sort(F.map_keys(g["ExposedPorts"]))), published_ports=F.to_json(published_ports(c["NetworkSettings"]["Ports"])))
    states = rows.select(*event_columns(event_id=F.concat(F.lit("docker-container-"), "index"), seq=F.col("index").cast("long") * STEP, ts_text=F.col("at"), ts=parse_time(F.col("at")), source=F.lit("docker"), event_type=F.lit("container_state"), source_entity=F.col("name"), action=F.coalesce(s["Status"], F.lit("unknown")), attributes=known))
    nets = rows.select("index", "item", "name", "at", F.posexplode("item.NetworkSettings.Networks").alias("k", "network", "net"))
    n = F.col("net")
    known = attributes(container_id=c["Id"], network_id=n["NetworkID"], endpoint_id=n["EndpointID"], ip_address=n["IPAddress"], gateway=n["Gateway"], mac_address=n["MacAddress"], aliases=_joined(n["Aliases"]), dns_names=_joined(n["DNSNames"]))
    member = nets.select(*event_columns(event_id=F.concat_ws("-", F.lit("docker-container-network"), "index", "network"), seq=F.col("index").cast("long") * STEP + F.col("k") + 1, ts_text=F.col("at"), ts=parse_time(F.col("at")), source=F.lit("docker"), event_type=F.lit("network_membership"), source_entity=F.col("name"), destination_entity=F.col("network"), action=F.lit("attached_to_network"), attributes=known))
    return states.unionByName(member)


def network_events(networks: DataFrame) -> DataFrame:
    """One network_membership for each container that a network lists; addresses lose their prefix length."""
    rows = networks.select("index", "item", F.posexplode("item.Containers").alias("k", "container_id", "c"))
    c, n = F.col("c"), F.col("item")
    known = attributes(container_id=F.col("container_id"), endpoint_id=c["EndpointID"], ip_address=F.substring_index(c["IPv4Address"], "/", 1), ipv6_address=c["IPv6Address"], mac_address=c["MacAddress"], network_id=n["Id"], driver=n["Driver"], scope=n["Scope"])
    return rows.select(*event_columns(event_id=F.concat_ws("-", F.lit("docker-network"), "index", F.substring("container_id", 1, 12)), seq=F.lit(NETWORKS_AFTER) + F.col("index").cast("long") * STEP + F.col("k"), ts_text=n["Created"], ts=parse_time(n["Created"]), source=F.lit("docker"), event_type=F.lit("network_membership"), source_entity=c["Name"], destination_entity=n["Name"], action=F.lit("attached_to_network"), attributes=known))


def docker_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of one snapshot file, by its name."""
    name = posixpath.basename(path)
    if name.startswith("network"):
        return network_events(read_array(spark, path, NETWORK))
    if name.startswith("container") or name.startswith("docker"):
        return container_events(read_array(spark, path, CONTAINER))
    raise ValueError(f"no snapshot reader for {name}")


def environment(containers: DataFrame) -> DataFrame:
    """name, key, value of each container's KEY=VALUE settings."""
    item = containers.select(F.regexp_replace("item.Name", "^/+", "").alias("name"), F.explode("item.Config.Env").alias("e")).where(F.contains("e", F.lit("=")))
    return item.select("name", F.substring_index("e", "=", 1).alias("key"), F.regexp_replace("e", "^[^=]*=", "").alias("value"))
