"""Byte-level BPE against the reference library and exact round trips."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

from tracewright.llm import bpe


def library():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [None, "", " ", "hello world", "don't  stop\n\n", "naïve Ünïcode 漢字 🎉", "aaaaaaaaaaaaaaaaaaaa", "<|endoftext|>", "x" * 5000, "tab\tand\r\nbreaks  ", "1234567 89.01", "hello world"]


def test_matches_library(spark):
    t = library()
    rng = random.Random(1)
    texts = [*TEXTS, *["".join(rng.choice("abcdeé .,'\n0漢ßtheingr") for _ in range(rng.randrange(300))) for _ in range(300)]]
    df = spark.createDataFrame([(i, x, 5) for i, x in enumerate(texts)], "doc_id long, text string, n_tokens int").repartition(3)
    for r in bpe.encode_bpe(df).collect():
        want = t.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


def test_round_trip(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    back = {r["doc_id"]: r["text"] for r in bpe.decode_bpe(bpe.encode_bpe(df, with_ids=True)).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert bpe.encode_bpe(df.where("false")).count() == 0


def test_whole_corpus(spark, small):
    t = library()
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = {r["doc_id"]: hashlib.sha256(np.array(t.encode_ordinary(r["text"] or ""), "<u4").tobytes()).hexdigest() for r in docs.collect()}
    assert {r["doc_id"]: r["ids_sha256"] for r in bpe.encode_bpe(docs).collect()} == want
