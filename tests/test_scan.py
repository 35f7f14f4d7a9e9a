"""Search by a scan, without an index: against the plain scores, and what it leaves on disk."""

import random
import shutil
from pathlib import Path

import pytest

from tracewright.operators import retrieval
from tracewright.plans.registry import QUERIES, _judged
from tracewright.sources.scratch import scratch_dir

WORDS = ["café", "Cafe", "naïve", "attack", "log", "of", "the", *(f"w{i}" for i in range(40))]
ASKED = [("a", "Café"), ("a", "log"), ("b", "of the"), ("b", "w3"), ("c", "w7"), ("c", "w8"), ("c", "w9"), ("d", "missing")]


def frame(spark, n, name):
    rng = random.Random(3)
    rows = [(name(i), k, " ".join(rng.choices(WORDS, k=3)), None if i % 50 == 0 else " ".join(rng.choice(WORDS[: rng.choice([9, 46])]) for _ in range(rng.randrange(1, 40)))) for i in range(n) for k in range(i % 3)]
    kind = "string" if isinstance(rows[0][0], str) else "long"
    return spark.createDataFrame(rows, f"doc_id {kind}, ordinal int, title string, text string")


def keys(df):
    return sorted((r["query_id"], r["doc_id"], r["ordinal"], round(r["score"], 8)) for r in df.collect())


@pytest.mark.parametrize(("fields", "name"), [(("text",), int), (("title", "text"), "d{}".format)])
def test_scan_equals_plain(spark, monkeypatch, fields, name):
    """Lots, packs and groups of queries far smaller than usual; with a limit, a lot gives its best."""
    for what, n in (("LOT_CHUNKS", 60), ("PACK_WORDS", 500), ("GROUP_QUERIES", 2), ("MEETINGS", 64)):
        monkeypatch.setattr(retrieval, what, n)
    chunks = frame(spark, 300, name)
    asked = spark.createDataFrame(ASKED, "query_id string, term string")
    plain = retrieval.bm25_hits(chunks, asked, fields)
    assert keys(retrieval.scan_hits(chunks, asked, fields, None)) == keys(plain)
    best = retrieval.scan_hits(chunks, asked, fields, 4)
    assert keys(retrieval.hit_window(best, 4)) == keys(retrieval.hit_window(plain, 4))
    assert best.count() < plain.count()


def test_scan_of_shuffled_words(spark, monkeypatch):
    """Where words meet the terms in a shuffle, a chunk's rows come from several tasks; it stays one chunk."""
    monkeypatch.setattr(retrieval, "LOT_CHUNKS", 60)
    chunks, asked = frame(spark, 120, int), spark.createDataFrame(ASKED, "query_id string, term string")
    want = keys(retrieval.bm25_hits(chunks, asked))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert keys(retrieval.scan_hits(chunks, asked, limit=None)) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scan_of_nothing(spark):
    none, asked = frame(spark, 6, int).where("false"), spark.createDataFrame(ASKED, "query_id string, term string")
    assert retrieval.scan_hits(none, asked).count() == 0
    assert retrieval.scan_hits(frame(spark, 6, int), asked.where("false")).count() == 0
    assert retrieval.scan_hits(frame(spark, 6, int), asked.where("term = 'missing'")).count() == 0


@pytest.mark.parametrize("name", ["q_rrf", "q_paired_change"])
def test_two_rankings_build_no_index(spark, small, tmp_path, name):
    """Two indexes of all words take several times the input; the queries' words alone take a part of it."""
    for t in ("documents", "benchmark"):
        shutil.copy(f"{small}/{t}.parquet", tmp_path)
    shared = Path(scratch_dir(spark).removeprefix("file://"))
    before = {f for f in shared.rglob("*.parquet")}
    assert QUERIES[name](spark, str(tmp_path)).count()
    left = {f for f in shared.rglob("*.parquet")} - before
    assert not [f for f in left if "/index-" in str(f)]
    assert sum(f.stat().st_size for f in left) < (tmp_path / "documents.parquet").stat().st_size


def test_judging_shuffles_no_text(spark, small):
    """Documents larger than a broadcast meet the few pairs that were found, where they are read."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        pairs = _judged(spark, small)
        assert pairs.count()
        assert "hashpartitioning(doc_id" not in pairs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
