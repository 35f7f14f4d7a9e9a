"""Near vectors against brute force, and the lattice against its definition."""

import numpy as np
from pyspark.sql import functions as F

from tracewright.llm import lattice


def brute(rows, least=0.98):
    ids = [r[0] for r in rows]
    links, up = {i: 0 for i in ids}, {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    def good(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    for k, (i, v, a) in enumerate(rows):
        for j, w, b in rows[k + 1 :]:
            if good(v, a) and good(w, b) and a == b and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    links[i] += 1
                    links[j] += 1
                    up[max(root(i), root(j))] = min(root(i), root(j))
    return {i: (links[i], root(i), root(i) == i) for i in ids}


def test_decoding_is_nearest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8)) * 2
    got = lattice.decode(x)
    steps = lattice.shortest()
    assert len(steps) == 240 and np.allclose((steps**2).sum(1), 2)
    away = ((x - got) ** 2).sum(1)
    for s in steps:
        assert (((x - got - s) ** 2).sum(1) >= away - 1e-9).all()
    twice = np.rint(got * 2).astype(int)
    assert ((twice % 2 == twice[:, :1] % 2).all(1)).all() and (got.sum(1) % 2 == 0).all()


def test_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    rows, i = [], 0
    for _ in range(40):
        base = rng.normal(size=64)
        for _ in range(int(rng.integers(1, 8))):
            rows.append((i, [float(np.float32(x)) for x in base + rng.normal(size=64) * rng.choice([0, 0.05, 0.13, 0.2])], int(rng.integers(0, 2))))
            i += 1
    rows += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 64, 1), (1003, [1.0] + [float("nan")] * 63, 1), (1004, [1.0, None] * 32, 1), (1005, rows[0][1], None), (1006, rows[0][1], rows[0][2]), (1007, [2 * x for x in rows[0][1]], rows[0][2]), (1008, [1.0, 2.0], 0), (1009, [2.0, 4.0], 0)]
    df = spark.createDataFrame([(*r, "x", 2) for r in rows], "vec_id long, embedding array<float>, label int, rep string, a int").repartition(4)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in lattice.link_vectors(df).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    missed = sum(want[i][0] - got[i][0] for i in want)
    assert missed >= 0 and missed <= 0.02 * sum(w[0] for w in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)
    assert all(got[i] == want[i] for i in range(1000, 1010))


def test_recall_on_table(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"]) if r["embedding"] is not None else None, r["label"]) for r in df.collect()]
    got = {r["vec_id"]: r["n_links"] for r in lattice.link_vectors(df).collect()}
    total = 0
    for label in {a for _, v, a in rows if a is not None and v}:
        x = np.array([v for _, v, a in rows if a == label and v], float)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        total += int((x @ x.T >= 0.98).sum()) - len(x)
    assert 0.9 * total <= sum(got.values()) <= total
    assert lattice.link_vectors(df.where(F.lit(False))).count() == 0


def test_blocks_of_a_large_group_and_many_copies(spark, monkeypatch):
    """Cells that are dealt to many blocks, and many copies of one vector, give the links of comparing all."""
    monkeypatch.setattr(lattice, "MEET", 16)
    rng = np.random.default_rng(8)
    base = rng.normal(size=32)
    rows = [(i, [float(np.float32(x)) for x in base + rng.normal(size=32) * rng.choice([0.02, 0.1, 0.14])], 1) for i in range(150)]
    rows += [(500 + i, rows[3][1], 1) for i in range(60)] + [(600 + i, rows[3][1], 2) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in lattice.link_vectors(df).collect()}
    want = brute(rows)
    assert sum(w[0] - got[i][0] for i, w in want.items()) <= 0.02 * sum(w[0] for w in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)
    assert all(got[i] == want[i] for i in want if i >= 600)


def test_roots():
    rng = np.random.default_rng(3)
    for n, m in ((1, 0), (5, 3), (60, 40), (60, 200)):
        p, q = rng.integers(0, n, m), rng.integers(0, n, m)
        up = list(range(n))

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in zip(p.tolist(), q.tolist(), strict=True):
            up[max(root(a), root(b))] = min(root(a), root(b))
        assert lattice._roots(n, p, q).tolist() == [root(x) for x in range(n)]
