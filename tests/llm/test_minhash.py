"""Near duplicates against brute force over weighted Jaccard similarity."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tracewright.llm import minhash


def say(rng, n):
    return [f"{rng.choice('abcdefghijklmnop')}{rng.randrange(400)}" for _ in range(n)]


def corpus(seed=3):
    rng = random.Random(seed)
    docs, i = {}, 0
    for _ in range(60):
        base = say(rng, rng.randrange(30, 200))
        for _ in range(rng.choice([1, 1, 2, 3, 12])):
            words = list(base)
            for _ in range(rng.randrange(0, max(1, len(words) // 60) + 1)):
                words[rng.randrange(len(words))] = "changed"
            docs[i] = " ".join(words)
            i += 1
    docs |= {900: None, 901: "", 902: "one two", 903: "one two", 904: " \n", 905: docs[0]}
    return docs


def brute(docs, least=0.8):
    """Components of all pairs at least that similar, by plain sets."""
    words = {i: (t or "").split() for i, t in docs.items()}
    n = sum(bool(w) for w in words.values())
    df = {}
    for w in words.values():
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    floor = max(1, -(-n // minhash.FLOOR))
    idf = lambda x: 1 + math.log(n / max(df[x], floor))
    sets = {}
    for i, w in words.items():
        if w:
            size, own = min(minhash.SHINGLE, len(w)), {}
            for k in range(len(w) - size + 1):
                g = tuple(w[k : k + size])
                own[g] = own.get(g, 0) + sum(map(idf, g)) / size
            sets[i] = own
    up = {i: i for i in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            same = sum(min(v, b[g]) for g, v in a.items() if g in b)
            if same / (sum(a.values()) + sum(b.values()) - same) >= least:
                up[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i in docs}


def test_matches_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs.items()], "doc_id long, text string, key string, rep long").repartition(6)
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()}
    want = brute(docs)
    assert {i: c for i, (c, _) in got.items()} == want
    assert all(kept == (i == c) for i, (c, kept) in got.items())


def test_samples_estimate_similarity():
    rng = np.random.default_rng(1)
    keys = rng.integers(1, 1 << 63, 600).astype(np.uint64)
    a = (np.sort(keys[:500]), rng.uniform(0.5, 3, 500).astype(np.float32))
    b = (np.sort(keys[50:550]), rng.uniform(0.5, 3, 500).astype(np.float32))
    true = minhash.weighted_jaccard(a, b)
    old = minhash.BANDS
    minhash.BANDS = 400
    try:
        drawn = minhash.samples([a, b])
    finally:
        minhash.BANDS = old
    assert abs((drawn[0] == drawn[1]).mean() - true) < 0.06


def test_keep_one(spark):
    docs = corpus(8)
    df = spark.createDataFrame([(i, t, "x") for i, t in docs.items()], "doc_id long, text string, kept string")
    twice = df.union(df.where("doc_id < 5"))
    kept = minhash.keep_one(twice)
    want = brute(docs)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, c in want.items() if i == c)


def test_large_groups_and_empty(spark):
    rng = random.Random(9)
    base = say(rng, 300)
    rows = []
    for i in range(200):
        words = list(base)
        words[rng.randrange(300)] = f"own{i}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert {r["component_id"] for r in minhash.near_duplicates(df).collect()} == {0}
    assert minhash.near_duplicates(df.where(F.lit(False))).count() == 0
    none = spark.createDataFrame([(None, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert minhash.near_duplicates(none).count() == 2


def test_borderline_group(spark):
    """Copies of a text that is not there, whose pairs lie around the threshold: nearly all hang together as they should."""
    rng = random.Random(12)
    base, docs = say(rng, 320), {}
    for i in range(160):
        words = list(base)
        for _ in range(2):
            words[rng.randrange(320)] = f"{rng.choice('abcdefghijklmnop')}{rng.randrange(400)}"
        docs[i] = " ".join(words)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()}
    want = brute(docs)
    assert sum(got[i] != want[i] for i in docs) <= 0.02 * len(docs)


def test_links_past_the_centres(spark):
    """Texts of one large bucket that are similar to each other and not to its centres are linked all the same."""
    rng = random.Random(21)
    base, docs = say(rng, 320), {}
    for i in range(160):
        words = list(base)
        for _ in range(3):
            words[rng.randrange(320)] = f"{rng.choice('abcdefghijklmnop')}{rng.randrange(400)}"
        docs[i] = " ".join(words)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()} == brute(docs)


def test_all_words_above_the_floor_keep_their_weight(spark):
    rows = [(2 * i + k, " ".join(f"w{i}x{j}" for j in range(10_000))) for i in range(7) for k in (0, 1)]
    words, idf, rare = minhash.word_weights(spark.createDataFrame(rows, "doc_id long, text string").select("text"))
    assert len(words) == 70_000 and (words[1:] > words[:-1]).all()
    assert np.allclose(idf, 1 + math.log(7)) and rare > idf.max()


def matrix_brute(docs, spark, least=0.8):
    """Links of all pairs, from one row of shingle weights a text."""
    ids = sorted(docs)
    weights = minhash.word_weights(spark.createDataFrame(list(docs.items()), "doc_id long, text string").select("text"))
    sets = minhash.Weigher(weights).shingles([docs[i] for i in ids])
    names = {x: k for k, x in enumerate(sorted({x for keys, _ in sets for x in keys.tolist()}))}
    rows = np.zeros((len(ids), len(names)))
    for k, (keys, w) in enumerate(sets):
        rows[k, [names[x] for x in keys.tolist()]] = w
    total = rows.sum(1)
    links = []
    for k in range(len(ids)):
        same = np.minimum(rows[k], rows[k + 1 :]).sum(1)
        links += [(ids[k], ids[k + 1 + int(j)]) for j in np.flatnonzero(same / (total[k] + total[k + 1 :] - same) >= least)]
    return links


def test_no_link_is_lost_in_a_loose_group(spark):
    """Six hundred altered copies, half of all pairs under 0.7: every link of 0.8 lies inside a class."""
    rng = random.Random(31)
    base, docs = say(rng, 320), {}
    for i in range(600):
        words = list(base)
        for _ in range(rng.randrange(3, 6)):
            words[rng.randrange(320)] = f"{rng.choice('abcdefghijklmnop')}{rng.randrange(400)}"
        docs[i] = " ".join(words)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()}
    links = matrix_brute(docs, spark)
    assert len(links) > 100 and all(got[a] == got[b] for a, b in links)
    assert len(set(got.values())) > 400


def test_very_long_text(spark):
    rng = random.Random(5)
    long = say(rng, 200_000)
    near = list(long)
    near[77] = "changed"
    docs = {1: " ".join(long), 2: " ".join(near), 3: " ".join(long[:50]), 4: " ".join(long[:50])}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 3}


def test_keep_one_with_clashing_columns(spark):
    names = ["_gone", "_id", "_row", "component_id", "kept", "count", "a.b"]
    text = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(1, text, *"abcdefg"), (2, text, *"abcdefg"), (3, "another text of some words here", *"abcdefg"), (3, "another text of some words here", *"bbcdefg")], ["doc_id", "text", *names])
    got = minhash.keep_one(df)
    assert got.columns == df.columns
    assert sorted(tuple(r)[:3] for r in got.collect()) == [(1, text, "a"), (3, "another text of some words here", "a")]
