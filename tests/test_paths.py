"""Path search: against plain searches on random graphs, the limit's effect, and growth with the results."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import graph, paths


def random_graph(seed, nodes, edges):
    rng = random.Random(seed)
    return list(dict.fromkeys((rng.randrange(nodes), rng.randrange(nodes), rng.choice(["accesses", "hosts"])) for _ in range(edges)))


def deep(edges, source, target, hops):
    """All simple paths of a depth-first search that takes edges by their place: (nodes, positions)."""
    out = []

    def go(path, places):
        if path[-1] == target:
            out.append((list(path), list(places)))
        elif len(places) < hops:
            for i, (s, t, _) in enumerate(edges):
                if s == path[-1] and t not in path:
                    go([*path, t], [*places, i])

    go([source], [])
    return out


def broad(edges, source, target, hops, most):
    """Paths of a breadth-first search over edges by target and type that stops expanding at `most` found ones."""
    if source == target:
        return [([source], [])]
    found, queue = [], [([source], [])]
    while queue and len(found) < most:
        nodes, kinds = queue.pop(0)
        if len(kinds) == hops:
            continue
        for s, t, e in sorted(edges, key=lambda x: (str(x[1]), x[2])):
            if s == nodes[-1] and t not in nodes:
                (found if t == target else queue).append(([*nodes, t], [*kinds, e]))
    return found


ENDS = [(0, 5), (5, 0), (1, 1), (2, 7), (3, 99)]


@pytest.mark.parametrize(("seed", "limit", "hops"), [(1, 4, 5), (2, 1, 6), (3, 50, 4), (4, 9, 8)])
def test_depth_first(spark, seed, limit, hops):
    edges = random_graph(seed, 9, 26)
    rows = spark.createDataFrame([(s, t, i) for i, (s, t, _) in enumerate(edges)], "source long, target long, position int")
    got = paths.depth_first_paths(rows, spark.createDataFrame(ENDS, "source long, target long"), hops, limit).collect()
    want = [(s, t, nodes, places, k) for s, t in ENDS for k, (nodes, places) in enumerate(deep(edges, s, t, hops)[:limit], 1)]
    assert sorted((r["source"], r["target"], r["nodes"], r["positions"], r["place"]) for r in got) == sorted(want)


@pytest.mark.parametrize(("seed", "most", "hops"), [(1, 3, 5), (3, 10, 4)])
def test_breadth_first(spark, seed, most, hops):
    edges = random_graph(seed, 9, 26)
    nodes = spark.createDataFrame([(str(i),) for i in range(9)], "node_id string")
    rows = spark.createDataFrame([(str(s), str(t), e, "observed") for s, t, e in edges], "source string, target string, edge_type string, basis string")
    got = graph.candidate_paths(nodes, rows, spark.createDataFrame([(str(s), str(t)) for s, t in ENDS], "source string, target string"), hops, most).collect()
    want = [(str(s), str(t), [str(x) for x in n], k) for s, t in ENDS if t < 9 for n, k in broad(edges, s, t, hops, most)]
    assert sorted((r["source"], r["target"], r["nodes"], r["edge_types"]) for r in got) == sorted(want)


def test_rows_grow_with_the_results(spark, monkeypatch):
    """One root, five middles, S leaves, all pairs of root and leaf: S results, and no hop writes many more rows."""
    counts = []
    for module in (graph, paths):
        monkeypatch.setattr(module, "written", lambda df, name, keep=module.written: (out := keep(df, name), counts.append((name, out.count())))[0])
    most = {}
    for size in (200, 400, 800):
        edges = [("root", f"m{i}") for i in range(5)] + [(f"m{i % 5}", f"leaf{i}") for i in range(size)]
        rows = spark.createDataFrame([(s, t, i) for i, (s, t) in enumerate(edges)], "source string, target string, position long")
        ends = spark.createDataFrame([("root", f"leaf{i}") for i in range(size)], "source string, target string")
        nodes = rows.select(F.explode(F.array("source", "target")).alias("node_id")).distinct()
        for search in (lambda: paths.depth_first_paths(rows, ends), lambda: graph.candidate_paths(nodes, rows.select("source", "target", F.lit("hosts").alias("edge_type"), F.lit("observed").alias("basis")), ends)):
            counts.clear()
            assert search().count() == size
            most[size] = max(most.get(size, 0), *(n for _, n in counts))
    assert all(most[size] <= 2 * size + 10 for size in most)


def test_the_limit_acts_before_enumeration(spark, monkeypatch):
    """Six layers of six nodes, each joined to all of the next: 46,656 paths, of which a hop writes a few times the limit."""
    counts = []
    monkeypatch.setattr(paths, "written", lambda df, name, keep=paths.written: (out := keep(df, name), counts.append(out.count()))[0])
    layers = [["s"], *[[f"{k}.{i}" for i in range(6)] for k in range(6)], ["t"]]
    edges = [(a, b) for one, two in zip(layers, layers[1:]) for a in one for b in two]
    rows = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(edges)], "source string, target string, position long")
    got = paths.depth_first_paths(rows, spark.createDataFrame([("s", "t")], "source string, target string"), 8, 20)
    assert [r["nodes"][-3:-1] for r in got.orderBy("place").collect()][:7] == [["4.0", f"5.{i}"] for i in range(6)] + [["4.1", "5.0"]]
    assert got.count() == 20 and max(counts) <= len(edges)


def test_rows_do_not_meet_the_steps_of_other_targets(spark, monkeypatch):
    """A hub in front of many targets: the steps that paths grow by are as many as targets, not their square."""
    made = {}
    keep = graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: made.setdefault(name, keep(df, name)) if name == "ways" else keep(df, name))
    n = 300
    edges = spark.createDataFrame([("r", "hub", "accesses", "observed"), *[("hub", f"t{i}", "hosts", "observed") for i in range(n)]], "source string, target string, edge_type string, basis string")
    nodes = edges.select("source").union(edges.select("target")).distinct().toDF("node_id")
    ends = spark.createDataFrame([("r", f"t{i}") for i in range(n)], "source string, target string")
    got = graph.candidate_paths(nodes, edges, ends).collect()
    assert sorted((r["target"], tuple(r["nodes"])) for r in got) == sorted((f"t{i}", ("r", "hub", f"t{i}")) for i in range(n))
    assert made["ways"].count() == 2 * n
