"""The attack graph: construction, merging, path search and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.requests import attribute
from ..sources.scratch import written

#: Weights that rank candidate paths, and the factor of edges that are only configured.
WEIGHTS = {"accesses": 1.0, "forwards": 1.0, "communicates_with": 0.9, "authenticates_to": 0.9, "connects_to": 0.5, "depends_on": 0.6, "hosts": 0.3, "executes": 0.2}
OTHER_WEIGHT, CONFIGURED = 0.1, 0.25


def evidence_of(rows: DataFrame, *key: str, ids: str = "evidence_ids") -> DataFrame:
    """The key's columns and id: every id behind a node or an edge, once, as rows. An edge of a busy service has as many as it
    has requests, so they are never gathered in one row; exported does that for a graph that is small."""
    return rows.select(*key, F.explode(ids).alias("id")).where("id <> ''").distinct()


def exported(merged: DataFrame, evidence: DataFrame, *key: str) -> DataFrame:
    """Merged nodes or edges with their ids as sorted arrays, for the files of a graph that is small enough."""
    listed = evidence.groupBy(*key).agg(F.array_sort(F.collect_list("id")).alias("evidence_ids"))
    return merged.join(listed, list(key), "left").withColumn("evidence_ids", F.coalesce("evidence_ids", F.array().cast("array<string>")))


def merge_nodes(rows: DataFrame) -> DataFrame:
    """One row for each node: the first value wins and later ones fill nulls, ids are counted (evidence_of lists them),
    observed beats configured. conflict marks nodes of several types or names."""
    pairs = rows.select("node_id", "seq", F.explode("attributes").alias("k", "v")).where("v is not null").groupBy("node_id", "k").agg(F.min_by("v", "seq").alias("v"))
    known = pairs.groupBy("node_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("attributes"))  # of one node
    counts = evidence_of(rows, "node_id").groupBy("node_id").agg(F.count("*").alias("n_evidence"))
    merged = rows.groupBy("node_id").agg(
        F.min_by("node_type", "seq").alias("node_type"),
        F.min_by("name", "seq").alias("name"),
        F.when(F.bool_or(F.col("basis") == "observed"), "observed").otherwise("configured").alias("basis"),
        ((F.count_distinct("node_type") > 1) | (F.count_distinct("name") > 1)).alias("conflict"),
    )
    return merged.join(known, "node_id", "left").join(counts, "node_id", "left").withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0).cast("long")))


def merge_edges(rows: DataFrame) -> DataFrame:
    """One row for each (source, target, edge_type): attributes and basis of the first, ids counted (evidence_of lists them)."""
    key = ["source", "target", "edge_type"]
    counts = evidence_of(rows, *key).groupBy(*key).agg(F.count("*").alias("n_evidence"))
    merged = rows.groupBy(*key).agg(F.min_by("basis", "seq").alias("basis"), F.min_by("attributes", "seq").alias("attributes"))
    return merged.join(counts, key, "left").withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0).cast("long")))


def _node(kind: str, name: Column, basis: str, **known: Column) -> list[Column]:
    held = F.create_map(*[x for k, v in known.items() for x in (F.lit(k), v.cast("string"))]) if known else F.create_map().cast("map<string,string>")
    return [F.concat(F.lit(kind + ":"), name).alias("node_id"), F.lit(kind).alias("node_type"), name.alias("name"), F.lit(basis).alias("basis"), held.alias("attributes"), F.array("event_id").alias("evidence_ids"), F.array("source").alias("source_artifacts"), "seq"]


def _edge(source: Column, target: Column, kind: str, basis: str) -> list[Column]:
    return [source.alias("source"), target.alias("target"), F.lit(kind).alias("edge_type"), F.lit(basis).alias("basis"), F.col("attributes"), F.array("event_id").alias("evidence_ids"), F.array("source").alias("source_artifacts"), "seq"]


def build_graph(events: DataFrame, environment: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges from normalized events, and from container settings (name, key, value) where given.

    Containers host services of their name and connect to their addresses; requests access the front service, which
    forwards to the service behind an upstream address; a *_HOST setting that names a service is a dependency; packets
    connect addresses that are both known. A rule is a select; merging follows arrival order."""
    nodes, edges = graph_rows(events, environment)
    return merge_nodes(nodes), merge_edges(edges)


def graph_rows(events: DataFrame, environment: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What build_graph merges: a node or an edge for each event that speaks of it."""
    id_of = lambda kind, name: F.concat(F.lit(kind + ":"), name)
    states = events.where("event_type = 'container_state'")
    member = events.where("event_type = 'network_membership'").withColumn("ip", attribute("ip_address"))
    asked = events.where("event_type = 'http_request'")
    packets = events.where("event_type = 'network_packet'")
    linked = member.where("ip <> ''")
    places = linked.select(F.col("ip").alias("p_ip"), F.col("source_entity").alias("p_name"), "seq").groupBy("p_ip").agg(F.min_by("p_name", "seq").alias("p_name"))
    front = F.when(F.col("source") == "nginx", "nginx").otherwise("api")
    nodes = [
        states.select(*_node("container", F.col("source_entity"), "observed", container_id=attribute("container_id"), image=attribute("image"))),
        states.select(*_node("service", F.col("source_entity"), "configured")),
        linked.select(*_node("ip", F.col("ip"), "observed", container=F.col("source_entity"))),
        asked.where("source_entity is not null").select(*_node("ip", F.col("source_entity"), "observed")),
        asked.select(*_node("service", front, "observed")),
        states.select("event_id", "source", "seq", F.explode(F.from_json(attribute("exposed_ports"), "array<string>")).alias("port")).select(*_node("port", F.col("port"), "configured")),
    ]
    settings = [] if environment is None else [environment.where(F.col("key").endswith("_HOST")).select(F.col("name"), F.col("value"))]
    forward = asked.where("destination_entity is not null").join(places, F.col("destination_entity") == F.col("p_ip"))
    known = linked.select(F.col("ip").alias("k")).union(asked.where("source_entity is not null").select(F.col("source_entity").alias("k"))).distinct()
    talk = packets.join(known.select(F.col("k").alias("ka")), F.col("source_entity") == F.col("ka"), "left_semi").join(known.select(F.col("k").alias("kb")), F.col("destination_entity") == F.col("kb"), "left_semi")
    edges = [
        states.select(*_edge(id_of("container", F.col("source_entity")), id_of("service", F.col("source_entity")), "hosts", "configured")),
        linked.select(*_edge(id_of("container", F.col("source_entity")), id_of("ip", F.col("ip")), "connects_to", "configured")),
        asked.where("source_entity is not null").select(*_edge(id_of("ip", F.col("source_entity")), id_of("service", front), "accesses", "observed")),
        forward.select(*_edge(id_of("service", front), id_of("service", F.col("p_name")), "forwards", "observed")),
        talk.select(*_edge(id_of("ip", F.col("source_entity")), id_of("ip", F.col("destination_entity")), "communicates_with", "observed")),
    ]
    for s in settings:
        there = states.select(F.col("source_entity").alias("t")).distinct()
        empty = F.array().cast("array<string>")
        edges.append(s.join(there, F.col("value") == F.col("t")).select(id_of("service", F.col("name")).alias("source"), id_of("service", F.col("t")).alias("target"), F.lit("depends_on").alias("edge_type"), F.lit("configured").alias("basis"), F.create_map().cast("map<string,string>").alias("attributes"), empty.alias("evidence_ids"), F.array(F.lit("docker")).alias("source_artifacts"), F.lit(1 << 60).alias("seq")))
    union = lambda parts: reduce(lambda a, b: a.unionByName(b), parts)
    return union(nodes), union(edges)


def ordered(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A graph in the order of its files: nodes by id, edges by source, target and type."""
    return nodes.orderBy("node_id"), edges.orderBy("source", "target", "edge_type")


def mapped_labels(labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """labels (…, label) with the node_id each stands for: the container of that name, else the only node that has the name;
    null where neither is, and for the attacker, who is outside the graph."""
    ids = nodes.select(F.col("node_id").alias("_c")).distinct()
    single = nodes.groupBy(F.col("name").alias("_n")).agg(F.min("node_id").alias("_id"), F.count("*").alias("_k")).where("_k = 1")
    rows = labels.join(ids, F.concat(F.lit("container:"), "label") == F.col("_c"), "left").join(single, F.col("label") == F.col("_n"), "left")
    return rows.withColumn("node_id", F.when(F.col("label") != "attacker", F.coalesce("_c", "_id"))).drop("_c", "_n", "_id", "_k")


#: Names under which the services of a true path appear in a graph.
SERVICES = {"nginx": ["nginx"], "api": ["service api", " api"], "postgres": ["postgres", "postgresql"]}


def service_nodes(nodes: DataFrame, services: dict[str, list[str]] = SERVICES) -> DataFrame:
    """service, node_id: the only service node that says one of the service's names, else the first node (by position) whose id
    holds it. A deployment gives the names of its own containers beside the usual ones."""
    said = F.lower(F.concat_ws(" ", "name", F.map_values("attributes")))
    rows = None
    for service, names in services.items():
        named = reduce(lambda a, b: a | b, [F.contains(said, F.lit(n)) for n in names])
        in_id = reduce(lambda a, b: a | b, [F.contains(F.lower("node_id"), F.lit(n)) for n in names])
        kind = (F.lower("node_type") == "service") | F.lower("node_id").startswith("service:") | F.lower("node_id").startswith("svc:")
        own = nodes.select(F.lit(service).alias("service"), "node_id", "position", (named & kind).alias("sure"), (F.contains(F.lower("node_id"), F.lit(service)) & (named | in_id)).alias("maybe"))
        rows = own if rows is None else rows.union(own)
    sums = rows.groupBy("service").agg(F.count_if("sure").alias("n"), F.min(F.when(F.col("sure"), F.col("node_id"))).alias("one"), F.min_by("node_id", F.when(F.col("maybe"), F.col("position"))).alias("other"), F.bool_or("maybe").alias("any"))
    return sums.select("service", F.when(F.col("n") == 1, F.col("one")).when(F.col("any"), F.col("other")).alias("node_id")).where("node_id is not null")


def service_path(labels: DataFrame, services: DataFrame, api: str = "api") -> DataFrame:
    """case_id, nodes: true paths (case_id, position, label) as service nodes, in order, without the attacker, labels of no
    service, and repeats in a row. A label is the api's if it is `api` or holds the container's name."""
    text = F.lower("label")
    named = F.when(text == "attacker", None).when(F.contains(text, F.lit("nginx")), "nginx").when(F.contains(text, F.lit("postgres")) | F.contains(text, F.lit("database")), "postgres").when((text == "api") | (F.contains(text, F.lit(api)) & F.lit(api != "api")), "api")
    rows = labels.withColumn("service", named).join(services, "service")
    before = F.lag("node_id").over(Window.partitionBy("case_id").orderBy("position"))
    kept = rows.withColumn("_before", before).where("_before is null or _before <> node_id")
    return kept.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "node_id"))), lambda x: x["node_id"]).alias("nodes"))  # of one path


def edge_weight(edge_type: Column, basis: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    return F.coalesce(F.element_at(table, edge_type), F.lit(OTHER_WEIGHT)) * F.when(basis == "observed", 1.0).otherwise(CONFIGURED)


def distances(steps: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """target, node, d: the hops from each node to each target (t) within `most`, over steps (s, t). Searches run backwards from
    all targets at once, a join a hop; a node is labelled once for a target."""
    steps = steps.select("s", F.col("t").alias("_t")).distinct()
    labels = edge = written(targets.select(F.col("t").alias("target"), F.col("t").alias("node"), F.lit(0).alias("d")).distinct(), "labels")
    for d in range(1, most + 1):
        met = edge.join(steps, F.col("node") == F.col("_t")).select("target", F.col("s").alias("node")).distinct()
        edge = written(met.join(labels, ["target", "node"], "left_anti").select("target", "node", F.lit(d).alias("d")), "labels")
        if edge.limit(1).count() == 0:
            break
        labels = labels.unionByName(edge)
    return labels


def ways_to(steps: DataFrame, ahead: DataFrame) -> DataFrame:
    """The steps (s, t, …) that come nearer to a target, or could: those into a node of ahead (target, node, d), with the target as
    _end and the hops left behind the step as d. Paths that grow by these join on target and node, so they never meet the
    other targets' steps from a node that many of them share."""
    return written(steps.join(ahead.select(F.col("target").alias("_end"), F.col("node").alias("_node"), "d"), F.col("t") == F.col("_node")).drop("_node"), "ways")


def candidate_paths(nodes: DataFrame, edges: DataFrame, ends: DataFrame, max_hops: int = 6, max_paths: int = 10, observed_only: bool = False) -> DataFrame:
    """Simple directed paths for each (source, target) of ends: nodes, edge types, score, position.

    Paths grow by one join a hop, for all pairs at once, and only through nodes from which the target is within the hops that
    are left: distances to each target, found backwards first, prune what leads nowhere. `found` orders them as a breadth-first search meets them: by hops,
    then by the places of their edges in the order of target and type. A search stops expanding once max_paths are found,
    so the paths of the expansion that reaches the bound stay, and later expansions go. Each hop is written once; pairs that
    have enough paths drop out before the next, and the search ends when no pair is open."""
    if max_hops < 1 or max_paths < 1:
        raise ValueError("max_hops and max_paths must be positive")
    known = nodes.select("node_id").distinct()
    for c in ("source", "target"):
        ends = ends.join(known, F.col(c) == F.col("node_id"), "left_semi")
        edges = edges.join(known, F.col(c) == F.col("node_id"), "left_semi")
    if observed_only:
        edges = edges.where("basis = 'observed'")
    place = F.row_number().over(Window.partitionBy("source").orderBy("target", "edge_type"))
    steps = edges.select(F.col("source").alias("s"), F.col("target").alias("t"), F.col("edge_type").alias("e"), edge_weight(F.col("edge_type"), F.col("basis")).alias("w"), place.alias("place"))
    steps = written(steps, "steps")
    ahead = distances(steps, ends.select(F.col("target").alias("t")), max_hops)
    ways = ways_to(steps, ahead)
    strings, numbers, doubles = (F.array().cast(f"array<{k}>") for k in ("string", "int", "double"))
    open_ = ends.select("source", "target", F.array("source").alias("nodes"), strings.alias("edge_types"), doubles.alias("weights"), numbers.alias("places"), F.col("source").alias("at"))
    same = open_.where("source = target").drop("at").withColumn("score", F.lit(1.0))
    open_, found = open_.where("source <> target"), []
    for hop in range(max_hops):
        grown = open_.join(ways, (F.col("target") == F.col("_end")) & (F.col("at") == F.col("s")) & (F.col("d") < max_hops - hop) & ~F.array_contains("nodes", F.col("t")))
        grown = grown.select("source", "target", F.concat("nodes", F.array("t")).alias("nodes"), F.concat("edge_types", F.array("e")).alias("edge_types"), F.concat("weights", F.array("w")).alias("weights"), F.concat("places", F.array("place")).alias("places"), F.col("t").alias("at"))
        grown = written(grown, "hop")
        found.append(grown.where("at = target").drop("at"))
        if hop + 1 == max_hops:
            break
        enough = reduce(lambda a, b: a.unionByName(b), found).groupBy("source", "target").agg(F.count("*").alias("n")).where(F.col("n") >= max_paths)
        open_ = grown.where("at <> target").join(enough, ["source", "target"], "left_anti")
        if open_.limit(1).count() == 0:
            break
    score = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x) / F.size("weights")
    every = reduce(lambda a, b: a.unionByName(b), found).withColumn("score", score)
    pair = Window.partitionBy("source", "target")
    before = every.withColumn("hops", F.size("edge_types")).withColumn("from", F.slice("places", 1, F.size("places") - 1))
    earlier = F.count("*").over(pair.orderBy("hops", "from").rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.count("*").over(Window.partitionBy("source", "target", "hops", "from"))
    kept = before.withColumn("earlier", earlier).where(F.col("earlier") < max_paths).drop("earlier", "from")
    out = kept.unionByName(same.withColumn("hops", F.lit(0)))
    return out.withColumn("rank", F.row_number().over(pair.orderBy(F.desc("score"), "hops", "nodes", "edge_types"))).drop("weights", "places")


def adjusted_score(raw: Column, observed_share: Column) -> Column:
    """A path's score weighed down by the share of its edges that were only configured."""
    return raw * (0.25 + 0.75 * observed_share)


def path_coverage(expected: DataFrame, predicted: DataFrame, key: str, path: str = "path") -> DataFrame:
    """key, expected and covered nodes and transitions, from arrays of node ids."""
    pairs = lambda p: F.when(F.size(p) > 1, F.array_distinct(F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.concat_ws("→", a.cast("string"), b.cast("string"))))).otherwise(F.array().cast("array<string>"))
    a = expected.select(key, F.col(path).alias("want"))
    b = predicted.select(F.col(key).alias("_k"), F.col(path).alias("got"))
    both = a.join(b, F.col(key) == F.col("_k"), "left").withColumn("got", F.coalesce("got", F.array().cast(expected.schema[path].dataType)))
    nodes, steps = F.array_distinct("want"), pairs(F.col("want"))
    return both.select(key, F.size(nodes).alias("n_nodes"), F.size(F.array_intersect(nodes, F.col("got"))).alias("n_nodes_covered"), F.size(steps).alias("n_transitions"), F.size(F.array_intersect(steps, pairs(F.col("got")))).alias("n_transitions_covered"), (F.col("want") == F.col("got")).alias("exact"))


def degrees(edges: DataFrame) -> DataFrame:
    """node, n_in, n_out."""
    ends = edges.select(F.col("source").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select(F.col("target"), F.lit(1), F.lit(0)))
    return ends.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def pooled_features(edges: DataFrame, features: Column) -> DataFrame:
    """Element-wise maximum of the request features of observed `accesses` edges at both ends: node_id, features."""
    seen = edges.where("edge_type = 'accesses' and basis = 'observed'").select("source", "target", features.alias("f"))
    ends = seen.select(F.explode(F.array("source", "target")).alias("node_id"), "f").select("node_id", F.posexplode("f").alias("k", "v"))
    best = ends.groupBy("node_id", "k").agg(F.max("v").alias("v"))
    return best.groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("features"))


def graph_issues(nodes: DataFrame, edges: DataFrame, assessed: DataFrame | None = None) -> DataFrame:
    """issue, item: edges whose end is no node, repeated nodes and edges, and edges without an assessment (source, target,
    edge_type) where assessments are given."""
    known = nodes.select("node_id").distinct()
    ends = edges.select(F.explode(F.array("source", "target")).alias("node_id")).distinct()
    dangling = ends.join(known, "node_id", "left_anti").select(F.lit("dangling").alias("issue"), F.col("node_id").alias("item"))
    twice = nodes.groupBy("node_id").count().where("count > 1").select(F.lit("duplicate_node").alias("issue"), F.col("node_id").alias("item"))
    again = edges.groupBy("source", "target", "edge_type").count().where("count > 1").select(F.lit("duplicate_edge").alias("issue"), F.concat_ws("→", "source", "target", "edge_type").alias("item"))
    out = dangling.union(twice).union(again)
    if assessed is not None:
        open_ = edges.select("source", "target", "edge_type").distinct().join(assessed, ["source", "target", "edge_type"], "left_anti")
        out = out.union(open_.select(F.lit("unassessed_edge").alias("issue"), F.concat_ws("→", "source", "target", "edge_type").alias("item")))
    return out


def positive_edges(paths: DataFrame, edges: DataFrame, key: str, path: str = "path") -> DataFrame:
    """Observed edges with label true where both ends follow each other on the verified path of their graph (key)."""
    steps = paths.select(key, F.explode(F.zip_with(F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0))), F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p")).select(F.col(key).alias("_k"), F.col("p.a").alias("_a"), F.col("p.b").alias("_b")).distinct().withColumn("_hit", F.lit(True))
    seen = edges.where("basis = 'observed'")
    return seen.join(steps, (F.col(key) == F.col("_k")) & (F.col("source") == F.col("_a")) & (F.col("target") == F.col("_b")), "left").withColumn("label", F.coalesce("_hit", F.lit(False))).drop("_k", "_a", "_b", "_hit")
