"""Repeats by suffix arrays against plain versions."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import suffix


def plain(docs):
    """doc_id -> (n_bytes, n_removed, n_spans, digest), from all strings in a dictionary."""
    seen, out = set(), {}
    for i, text in sorted(docs.items()):
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for s in range(len(data) - suffix.LENGTH + 1):
            w = data[s : s + suffix.LENGTH]
            if w in seen:
                gone[s : s + suffix.LENGTH] = True
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone, strict=False) if not g)
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out[i] = (len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest())
    return out


def rows_of(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


def test_suffix_arrays_match_sorting():
    rng = random.Random(4)
    texts = [[rng.choice(range(1, k + 1)) for _ in range(n)] for k in (1, 2, 3, 9) for n in (0, 1, 2, 3, 7, 30, 120) for _ in range(4)]
    texts += [[2, 1] * 20, [1, 2] * 20, [3, 2, 1, 3, 2, 1, 3], list(range(30, 0, -1))]
    flat = np.concatenate([np.array([*t, 0]) for t in texts])
    starts = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
    got = suffix.suffix_arrays(flat, starts)
    for t, s in zip(texts, starts, strict=True):
        whole = [*t, 0]
        assert (got[s : s + len(whole)] - s).tolist() == sorted(range(len(whole)), key=lambda i: whole[i:])


def test_removal_matches_plain(spark):
    rng = random.Random(5)
    words = ["alpha", "béta", "gamma", "delta", "x", "yz", "omega"]
    say = lambda n: " ".join(rng.choice(words) + str(rng.randrange(60)) for _ in range(n))
    shared = [say(40) for _ in range(4)]
    docs = {i: say(rng.randrange(60)) for i in range(40)}
    for i in range(40, 140):
        docs[i] = " ".join(rng.choice([say(9), rng.choice(shared), rng.choice(shared)[rng.randrange(150) :]]) for _ in range(rng.randrange(1, 7)))
    docs |= {200: None, 201: "", 202: "a" * 99, 203: "a" * 300, 204: "ab" * 400, 205: docs[60], 206: docs[61] + "!", 207: "é" * 60 + shared[0]}
    df = spark.createDataFrame([(i, t, 1, "y") for i, t in docs.items()], "doc_id long, text string, begin int, anchor string").repartition(5)
    assert rows_of(suffix.remove_repeats(df)) == plain(docs)


def test_many_contexts_of_one_anchor(spark):
    rng = random.Random(6)
    core = "the same passage of a hundred and more bytes that everyone quotes between texts of their own " * 2
    docs = {i: "".join(rng.choice("abcdefgh") for _ in range(150)) + core + "".join(rng.choice("stuvwxyz") for _ in range(150)) for i in range(150)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    assert rows_of(suffix.remove_repeats(df)) == plain(docs)


def test_parting_keeps_all_repeats(spark):
    """Texts of one anchor, parted down to whole strings, give the repeats that sorting them together gives."""
    rng = random.Random(8)
    core = "".join(rng.choice("abc") for _ in range(32))
    rows, starts = [], {}
    for i in range(90):
        left = "".join(rng.choice("ab") for _ in range(3)) * rng.choice([2, 9, 22])
        right = "".join(rng.choice("ab") for _ in range(3)) * rng.choice([2, 9, 22])
        text = (left[-68:].rjust(68, "x") + core + right[:68].ljust(68, "y")).encode()
        a, b = rng.randrange(69), rng.randrange(69)
        a, b = min(a, b), max(a, b)
        cut = text[a : b + 100]
        rows.append((5, i, a, 68 - a, 100 - a, bytearray(cut)))
        for k in range(len(cut) - 99):
            starts.setdefault(cut[k : k + 100], []).append((i, a + k))
    want = {p for places in starts.values() for p in sorted(places)[1:]}
    df = spark.createDataFrame(rows, suffix.TEXTS).repartition(3)
    for many in (1, 4, 1000):
        got = {(r["doc_id"], p) for r in suffix.sorted_repeats(df, many).collect() for p in range(r["begin"], r["stop"] - 99)}
        assert got == want and want


def test_parts_that_became_the_same_go_on_as_one(spark, monkeypatch):
    """Near copies of one passage, each with one place changed: parts that do not hold the place are one text, and are parted once."""
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefgh") for _ in range(168))
    rows, want, seen = [], set(), set()
    for i in range(600):
        at = rng.choice([*range(60), *range(108, 168)])
        text = (base[:at] + rng.choice("stuvwxyz") * 8 + base[at + 8 :])[:168] if not 52 < at < 100 else base
        rows.append((5, i, 0, 68, 100, bytearray(text.encode())))
        for k in range(69):
            want |= {(i, k)} if text[k : k + 100] in seen else set()
            seen.add(text[k : k + 100])
    made = []

    def counted(df, name, kept=suffix.materialize):
        out = kept(df, name)
        made.append(out.count() if name == "parted" else 0)
        return out

    monkeypatch.setattr(suffix, "materialize", counted)
    found = suffix.sorted_repeats(spark.createDataFrame(rows, suffix.TEXTS).repartition(3)).collect()
    got = {(r["doc_id"], p) for r in found for p in range(r["begin"], r["stop"] - 99)}
    assert got == want and want
    assert 0 < sum(made) < 6 * len(rows)


def test_texts_that_share_no_string_are_not_sorted(spark, monkeypatch):
    """Texts around one anchor whose other bytes differ are not taken; those that share a string are, cut to where they may share it."""
    rng = random.Random(10)
    say = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    core = "00000000000000000000000000000000000000000000000000"  # too short to be a whole string
    docs = {i: say(110) + core + say(110) for i in range(60)}
    docs |= {60: say(110) + docs[3][60:], 61: docs[7][:215] + say(55)}
    taken = []

    def counted(df, name, kept=suffix.materialize):
        out = kept(df, name)
        if name == "taken":
            taken.extend(r["doc_id"] for r in out.where(f"kind = {suffix.TEXT}").collect())
        return out

    monkeypatch.setattr(suffix, "materialize", counted)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    assert rows_of(suffix.remove_repeats(df)) == plain(docs)
    assert {3, 7, 60, 61} >= set(taken) and taken


def test_an_anchor_of_many_chunks_keeps_what_may_be_shared():
    """Two texts of one anchor far apart in its rows share a class: neither is dropped, as a chunk does not show both."""
    import pyarrow as pa

    n = 130_000
    k = np.arange(n)
    marks = [(k * m) % 65521 for m in (1, 7, 11)]  # some of them meet, and so do these two
    for m in marks:
        m[-1] = m[0]
    shape = 68 | marks[0] << 14 | marks[1] << 30 | marks[2] << 46
    columns = [np.full(n, 5), k, k, np.full(n, 1000), shape]
    none = pa.nulls(n, pa.int64())
    whole = pa.RecordBatch.from_arrays([*map(pa.array, columns), none, none], [c.split()[0] for c in suffix.CONTEXTS.split(", ")])
    out = pa.Table.from_batches(list(suffix._settle(whole.slice(i, 10_000) for i in range(0, n, 10_000))))
    got = {r["doc_id"]: (r["begin"], r["stop"], r["at"]) for r in out.to_pylist()}
    assert got[0] == got[n - 1] == (932, 1100, 68)
    few = whole.take(pa.array([0, 1, 2, n - 1]))
    out = pa.Table.from_batches(list(suffix._settle(iter([few]))))
    assert sorted(out.column("doc_id").to_pylist()) == [0, n - 1]


def test_copies_are_checked_by_their_bytes(spark):
    """A copy that a hash takes for its source, and is not, stops the job."""
    base = b"q" * 120
    rows = [(suffix.SOURCE, 1, 0, 1, 0, bytearray(base)), (suffix.COPY, 2, 7, 1, 0, bytearray(base))]
    assert suffix.differing(spark.createDataFrame(rows, suffix.TAKEN)).count() == 0
    for other in (bytearray(base[:-1] + b"r"), bytearray(base[:-1])):
        wrong = [*rows, (suffix.COPY, 3, 0, 1, 0, other)]
        with pytest.raises(Exception, match="two different strings"):
            suffix.differing(spark.createDataFrame(wrong, suffix.TAKEN)).collect()


def test_each_removed_byte_is_sorted_or_compared(spark, small):
    """Nothing is removed but what the suffix order or a comparison of bytes says."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    gone = suffix.repeated(rows).collect()
    assert gone and all(0 <= r["begin"] < r["stop"] <= len(texts[r["doc_id"]]) for r in gone)
    whole = rows_of(suffix.remove_repeats(docs))
    assert whole == plain({i: t.decode() for i, t in texts.items()})


def test_long_documents_in_pieces(spark, monkeypatch):
    rng = random.Random(7)
    base = "".join(rng.choice("abcdef ") for _ in range(3000))
    docs = {1: base, 2: base[500:2500] + "tail", 3: "head" + base}
    whole = [(i, 0, t.encode()) for i, t in docs.items()]
    monkeypatch.setattr(suffix, "BLOCK", 700)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": list(docs), "text": [t for _, _, t in whole]})
    starts = [(int(i), int(o) + int(s)) for data, at, ids, offs in suffix._blocks(iter([batch])) for i, o, a, e in zip(ids, offs, at, [*at[1:], len(data)], strict=True) for s in range(e - a - suffix.LENGTH + 1)]
    assert sorted(starts) == sorted((i, s) for i, t in docs.items() for s in range(len(t) - suffix.LENGTH + 1))


def test_shared_and_missing_ids(spark):
    text = "one two three four five six seven eight nine ten " * 4
    df = spark.createDataFrame([(None, text), (7, text), (7, text), (7, "other"), (9, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], r["n_removed"]) for r in suffix.remove_repeats(df).collect())
    first = plain({0: text})[0][1]
    assert got == sorted([(-1, len(text), first), (7, len(text), len(text)), (7, len(text), len(text)), (7, 5, 0), (9, 0, 0)])
    empty = suffix.remove_repeats(df.where(F.lit(False)))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
