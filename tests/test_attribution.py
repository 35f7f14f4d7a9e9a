"""Contributions to an edge's logit against a dense forward pass and all coalitions."""

from itertools import combinations
from math import comb

import numpy as np
import pytest

from tracewright.operators import attribution, gnn
from tracewright.operators.risk import EDGE_TYPES

RNG = np.random.default_rng(4)
NAMES = ["a", "b", "c", "d", "e", "f"]
FEATURES = {n: np.concatenate([np.eye(6)[i % 6], np.eye(2)[i % 2], RNG.uniform(0, 2, gnn.HTTP)]) for i, n in enumerate(NAMES)}
EDGES = [("a", "b", "hosts", "observed"), ("b", "a", "forwards", "observed"), ("c", "a", "hosts", "observed"), ("a", "c", "accesses", "configured"), ("c", "b", "hosts", "observed"), ("d", "b", "hosts", "observed"), ("e", "d", "forwards", "observed"), ("a", "c", "accesses", "configured"), ("b", "c", "accesses", "configured"), ("ghost", "b", "hosts", "observed")]


def dense(features, w, source, target, kind):
    """The logit, node by node."""

    def layer(h, own, rel):
        out = {n: h[n] @ own for n in h}
        for n in h:
            for r in range(attribution.RELATIONS):
                sent = [h[s] for s, t, k, b in EDGES if t == n and s in h and EDGE_TYPES.index(k) * 2 + gnn.BASES.index(b) == r]
                if sent:
                    out[n] = out[n] + np.mean(sent, 0) @ rel[r]
        return out

    h = layer(features, w["own1"], w["rel1"])
    h = layer({n: np.maximum(v, 0) for n, v in h.items()}, w["own2"], w["rel2"])
    return gnn.edge_logits(gnn.edge_inputs(h[source][None], h[target][None], np.array([EDGE_TYPES.index(kind)]), w), w)[0]


@pytest.fixture(scope="module")
def graph(spark):
    rows = [("g", n, v.tolist()) for n, v in FEATURES.items()] + [("other", "a", FEATURES["a"].tolist())]
    nodes = spark.createDataFrame(rows, "graph_id string, node_id string, features array<double>").repartition(3)
    edges = spark.createDataFrame([("g", *e) for e in EDGES], "graph_id string, source string, target string, edge_type string, basis string")
    return nodes, edges, gnn.initial_weights()


def test_all_coalitions(spark, graph):
    nodes, edges, w = graph
    varying = [0, 5, 22, 23, 40]
    got = {r["feature"]: r for r in attribution.explain_edge(nodes, edges, w, "g", "a", "b", "accesses", varying=varying, background=7).collect()}
    drawn = attribution._background(nodes.where("graph_id = 'g'"), 7, 7)
    own = np.concatenate([FEATURES["a"][-gnn.HTTP :], FEATURES["b"][-gnn.HTTP :]])

    def value(held):
        out = []
        for b in drawn:
            z = own.copy()
            for f in set(varying) - set(held):
                z[f] = b[f]
            moved = FEATURES | {n: np.concatenate([FEATURES[n][: -gnn.HTTP], part]) for n, part in (("a", z[: gnn.HTTP]), ("b", z[gnn.HTTP :]))}
            out.append(dense(moved, w, "a", "b", "accesses"))
        return np.mean(out)

    values = {s: value(s) for k in range(6) for s in combinations(varying, k)}
    for f in varying:
        want = sum((values[tuple(sorted((*s, f)))] - values[s]) / (5 * comb(4, len(s))) for s in values if f not in s)
        assert abs(got[attribution.NAMES[f]]["contribution"] - want) < 1e-9
    assert abs(got["source_http_feature_0"]["score"] - dense(FEATURES, w, "a", "b", "accesses")) < 1e-9
    assert abs(got["source_http_feature_0"]["baseline"] - values[()]) < 1e-9
    assert len(got) == 46 and got["source_http_feature_1"]["direction"] == "no_change"


def test_permutations_add_up(spark, graph):
    nodes, edges, w = graph
    rows = attribution.explain_edge(nodes, edges, w, "g", "d", "b", "hosts", background=20).collect()
    assert abs(sum(r["contribution"] for r in rows) - (rows[0]["score"] - rows[0]["baseline"])) < 1e-9
    assert abs(rows[0]["score"] - dense(FEATURES, w, "d", "b", "hosts")) < 1e-9
    assert {r["direction"] for r in rows} >= {"increases", "decreases"}
    score = gnn.score_edges(nodes, edges, w).where("graph_id = 'g' and source = 'd' and target = 'b'").first()["logit"]
    assert abs(score - rows[0]["score"]) < 1e-9


def test_refusals(spark, graph):
    nodes, edges, w = graph
    for bad in (("g", "a", "a", "hosts"), ("g", "a", "gone", "hosts"), ("g", "a", "b", "likes"), ("none", "a", "b", "hosts")):
        with pytest.raises(ValueError):
            attribution.explain_edge(nodes, edges, w, *bad)
