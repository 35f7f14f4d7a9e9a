"""The stored index: against a full-text engine, changes by bucket, versions, phrases and the blocks that a limit spares."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from tracewright.operators import retrieval
from tracewright.sources import index

VOCABULARY = ["café", "Cafe", "naïve", "attack", "log", "nginx", "straße", "Ångström", "x1", "of", "the", *(f"w{i}" for i in range(60))]


def texts(n, seed):
    rng = random.Random(seed)
    return [(i, 0, " ".join(rng.choices(VOCABULARY, k=3)), " ".join(rng.choice(VOCABULARY[: rng.choice([12, 70])]) for _ in range(rng.randrange(5, 40)))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, ordinal int, title string, text string")


def full_text(rows, asked):
    """(query, doc): score by SQLite's index over both columns."""
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(title, text)")
    con.executemany("insert into f(rowid, title, text) values (?, ?, ?)", [(r[0] + 1, r[2], r[3]) for r in rows])
    out = {}
    for q in {q for q, _ in asked}:
        match = " OR ".join(f'"{t}"' for k, t in sorted(asked) if k == q)
        out |= {(q, i - 1): -s for i, s in con.execute("select rowid, bm25(f) from f where f match ?", (match,))}
    return out


ASKED = [("a", "Café"), ("a", "nginx"), ("b", "angstrom"), ("b", "of the"), ("c", "w7"), ("c", "w8"), ("d", "missing"), ("e", "cafe attack log")]


def same(got, want):
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in got.collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_equals_full_text_index_through_changes(spark, tmp_path):
    rows = texts(150, 1)
    asked = spark.createDataFrame(ASKED, "query_id string, term string")
    one = index.build(frame(spark, rows), f"file://{tmp_path}/i", ("title", "text"), buckets=16, block_chunks=20)
    same(retrieval.index_hits(one, asked, None), full_text(rows, ASKED))
    new = [(3, 0, "nginx café", "w7 of the attack"), (500, 0, "", "cafe attack log"), (501, 0, "of the", None)]
    two = one.changed(frame(spark, new), spark.createDataFrame([(7,), (9,), (999,)], "doc_id long"))
    now = [r for r in rows if r[0] not in (3, 7, 9)] + [(*r[:3], r[3] or "") for r in new]
    same(retrieval.index_hits(two, asked, None), full_text(now, ASKED))
    assert (two.chunks, two.words) == (len(now), sum(len((r[2] + " " + r[3]).split()) for r in now))
    # the version before is still there, and the newest complete one is what a reader opens
    same(retrieval.index_hits(index.opened(spark, one.path, 1), asked, None), full_text(rows, ASKED))
    again = index.opened(spark, f"file://{tmp_path}/i")
    assert again.version == 2 and again.where == two.where and again.fields == ("title", "text")
    # a change that was cut off has no success marker
    (tmp_path / "i/manifests/v=3").mkdir()
    assert index.opened(spark, one.path).version == 2
    gone = two.changed(None, spark.createDataFrame([(r[0],) for r in now], "doc_id long"))
    assert (gone.chunks, gone.words, gone.where) == (0, 0, {})
    assert retrieval.index_hits(gone, asked).count() == 0


def test_a_change_writes_only_its_buckets(spark, tmp_path):
    rows = [(i, 0, "", f"only{i} word{i}") for i in range(60)]
    one = index.build(frame(spark, rows), f"file://{tmp_path}/i", ("title", "text"), buckets=64, block_chunks=8)
    two = one.changed(frame(spark, [(5, 0, "", "fresh")]))
    words = spark.createDataFrame([(w,) for w in ("only5", "word5", "fresh")], "w string")
    touched = {r[0] for r in words.select(one._bucket(F.col("w"))).collect()}
    moved = {b for (t, b), v in two.where.items() if t == "postings" and v == 2}
    assert moved <= touched and {b for (t, b), v in two.where.items() if t == "postings" and v == 1}.isdisjoint(touched)
    assert sum(1 for (t, _), v in two.where.items() if t == "chunks" and v == 2) == 1
    left = {r["term"] for r in two.read("postings").collect()}
    assert left == {w for i, _, _, t in rows if i != 5 for w in t.split()} | {"fresh"}


def test_only_the_terms_buckets_are_read(spark, tmp_path):
    one = index.build(frame(spark, texts(40, 2)), f"file://{tmp_path}/i", buckets=16)
    files = one.postings(spark.createDataFrame([("w7",)], "term string")).inputFiles()
    assert len({f.rsplit("/", 2)[1] for f in files}) == 1


def test_limit_spares_blocks_and_changes_nothing(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, 0, "", " ".join(rng.choices(VOCABULARY[11:], k=60)) + (" rare rare" if i % 97 == 0 else "")) for i in range(800)]
    rows += [(1000 + i, 0, "", "rare w1") for i in range(12)]
    one = index.build(frame(spark, rows), f"file://{tmp_path}/i", buckets=8, block_chunks=10)
    asked = spark.createDataFrame([("q", "rare"), ("q", "w1"), ("r", "w2"), ("s", "none"), ("t", "w3 w4"), ("t", "w5")], "query_id string, term string")
    key = lambda df: sorted(map(tuple, retrieval.hit_window(df, 5).select("query_id", "doc_id", "hit", "score").collect()))
    every, best = retrieval.index_hits(one, asked, None), retrieval.index_hits(one, asked, 5)
    assert key(every) == key(best)
    n = lambda df, q: df.where(F.col("query_id") == q).count()
    assert n(best, "q") < n(every, "q") / 2  # blocks with w1 alone cannot reach those with the rare word
    plain = retrieval.bm25_hits(frame(spark, rows), asked)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, every.select(plain.columns).collect()))


def test_empty_and_null_texts(spark, tmp_path):
    none = index.build(frame(spark, []), f"file://{tmp_path}/none")
    assert none.chunks == 0 and retrieval.index_hits(none, spark.createDataFrame([("q", "a")], "query_id string, term string")).count() == 0
    one = none.changed(frame(spark, [(1, 0, None, None), (2, 0, None, "A b")]))
    assert (one.chunks, one.words) == (2, 2)
    assert [r["doc_id"] for r in retrieval.index_hits(one, spark.createDataFrame([("q", "a")], "query_id string, term string")).collect()] == [2]


def test_a_lot_gives_only_its_best(spark, tmp_path):
    """One word in all chunks, of different lengths: pairs of query and chunk never become rows but for the best of a lot."""
    rows = [(i, 0, "", "w1" + " x" * i if i < 600 else "y") for i in range(2000)]
    one = index.build(frame(spark, rows), f"file://{tmp_path}/i", buckets=4, block_chunks=300)
    asked = spark.createDataFrame([("q", "w1"), ("r", "x"), ("r", "w1")], "query_id string, term string")
    best, plain = retrieval.index_hits(one, asked, 5), retrieval.bm25_hits(frame(spark, rows), asked)
    assert best.count() == 10
    key = lambda df: sorted(map(tuple, retrieval.hit_window(df, 5).select("query_id", "doc_id", "hit", "score").collect()))
    assert key(best) == key(plain)
    assert one.read("postings").groupBy("term", "block").count().where("count > 1").count() == 0
