"""The pipeline against a plain composition, and its stages' contracts."""

import hashlib
from collections import Counter

import numpy as np

import corpus_pipeline
from tracewright.llm import pii, quality

from . import test_bpe, test_minhash, test_mixing


def test_matches_plain_composition(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r for r in docs.collect()}
    good = {r["doc_id"] for r in quality.quality_rules(docs, labels).where("kept").collect()}
    classes = test_minhash.brute({i: rows[i]["text"] for i in good})
    single = [i for i in good if classes[i] == i]
    texts = {i: pii.redact(rows[i]["text"]) for i in single}
    mix = test_mixing.plain([(i, texts[i], rows[i]["source"]) for i in single])
    t = test_bpe.library()
    want = Counter()
    for i in single:
        ids = t.encode_ordinary(texts[i] or "")
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()] += mix[i][3] // mix[i][0] if mix[i][0] else 0
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, small).collect())
    assert got == +want


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "source_mix", "byte_bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns and 0 < out.count()
        empty = stage(spark, docs.where("false"), small)
        assert empty.columns == docs.columns and empty.count() == 0
