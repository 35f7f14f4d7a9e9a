"""Gradients of the whole network against differences of a dense forward pass; refusals; falling loss."""

import numpy as np
import pytest

from tracewright.operators import gnn, gnn_training

from .test_attribution import EDGES, FEATURES, dense

LABELS = [("a", "b", "hosts", 1), ("b", "c", "accesses", 0), ("d", "b", "hosts", 0), ("c", "a", "hosts", 1)]


@pytest.fixture(scope="module")
def graphs(spark):
    nodes = spark.createDataFrame([(g, n, v.tolist()) for g in "gh" for n, v in FEATURES.items()], "graph_id string, node_id string, features array<double>")
    edges = spark.createDataFrame([(g, *e) for g in "gh" for e in EDGES], "graph_id string, source string, target string, edge_type string, basis string")
    rows = [(g, s, t, k, "observed", y, split) for g, split in (("g", "train"), ("h", "validation")) for s, t, k, y in LABELS]
    labelled = spark.createDataFrame(rows, "graph_id string, source string, target string, edge_type string, basis string, label int, split string")
    return nodes, edges, labelled


def loss(w):
    z = np.array([dense(FEATURES, w, s, t, k) for s, t, k, _ in LABELS])
    return np.mean(np.logaddexp(0, z) - np.array([y for *_, y in LABELS]) * z)


def test_gradients(spark, graphs):
    w = gnn.initial_weights(3)
    got, told, validation = gnn_training.gradients(gnn_training.prepare(*graphs), w)
    assert abs(told - loss(w)) < 1e-9 and abs(validation - told) < 1e-9 and set(got) == set(w)
    rng = np.random.default_rng(1)
    for k, g in got.items():
        assert g.shape == w[k].shape and np.abs(g).max() > 0
        spots = [np.unravel_index(np.abs(g).argmax(), g.shape)] + [tuple(rng.integers(0, s) for s in g.shape) for _ in range(8)]
        for at in spots:
            up, down = (w | {k: w[k].copy()} for _ in range(2))
            up[k][at] += 1e-6
            down[k][at] -= 1e-6
            assert abs(g[at] - (loss(up) - loss(down)) / 2e-6) < 1e-6, (k, at)


def test_loss_falls(spark, graphs):
    got = gnn_training.train(*graphs, epochs=4)
    assert len(got.train_losses) == 4 and list(got.train_losses) == sorted(got.train_losses, reverse=True)
    assert np.allclose(got.train_losses, got.validation_losses)  # both graphs are the same
    assert loss(got.weights) < got.train_losses[-1]


def test_refusals(spark, graphs):
    nodes, edges, labelled = graphs
    for bad, why in ((labelled.withColumn("label", labelled.label + 1), "not known"), (labelled.replace("a", "gone", "source"), "no node"), (labelled.replace("h", "g", "graph_id"), "both splits"), (labelled.where("label = 1"), "both labels"), (labelled.where("false"), "both labels")):
        with pytest.raises(ValueError, match=why):
            gnn_training.prepare(nodes, edges, bad)
