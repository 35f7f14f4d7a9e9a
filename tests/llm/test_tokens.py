"""Token files against the library, and reading of single documents."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tracewright.llm import queries, tokens


def library():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return t


def expected(rows):
    t, out, start = library(), {}, 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    return out


TEXTS = [None, "", "Hello World!", "l'été — déjà vu", "a—b — c", "İstanbul ﬁne ①", "<|endoftext|> x", "don't 'tis '90s", "x.y,z;(q)", "漢字 kana", "...!!!", "word" * 400, "  spaced\tout\n", "é combining"]


def test_matches_library(spark):
    rows = [(i * 7, t) for i, t in enumerate(TEXTS)]
    got = tokens.token_files(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, start string").repartition(4))
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in got.collect()} == expected(rows)


def test_whole_corpus(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = expected([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokens.token_files(docs).collect()} == want


def test_single_documents_and_dictionary(spark, tmp_path):
    rows = [(i, f"some words number {i} here " * 5) for i in range(300)]
    out = "file://" + str(tmp_path / "t")
    tokens.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), out)
    raw = bytes(spark.read.parquet(f"{out}/dictionary").first()["dictionary"])
    shard = spark.read.parquet(f"{out}/shards").first()
    ids = tokens.frame(shard, 1, raw)
    assert ids.tolist() == [*library().encode(rows[shard["doc_ids"][1]][1], add_special_tokens=False).ids, 1]
    with pytest.raises(ValueError):
        tokens.frame(shard, 0, b"another")


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    got = sorted(r["start"] for r in tokens.token_files(df).collect())
    assert got == [0, 2, 5]
    assert tokens.token_files(df.where("false")).count() == 0


def test_added_tokens_in_texts(spark, tmp_path):
    """The registered query against the library as it is, without a switch set."""
    texts = [*TEXTS, "a <|endoftext|> b", "A<|endoftext|>B", "<|ENDOFTEXT|> c", "x<|startoftext|><|endoftext|>1.", "<|endoftext|", "e<|endoftext|>\u0301 DÉJÀ"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    t, want, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}, 0
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    got = queries.QUERIES["op4_token_files"](spark, f"file://{tmp_path}").collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in got} == want
