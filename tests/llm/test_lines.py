"""Line deduplication: the perfect hash, brute force, hot lines and defined cases."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from tracewright.llm import lines

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def plain(rows):
    """doc_id, text -> the contract's columns and n_shared, by dictionaries."""
    order = lambda i: float("inf") if i is None else i
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(order(i))
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        shared = [len(holders.get(key(x), ())) > 1 for x in own]
        kept = [x for x, s in zip(own, shared) if not s or min(holders[key(x)]) == order(i)]
        out.append((i, len(own), len(own) - len(kept), sum(shared), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def check(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    if extra:
        df = df.selectExpr("*", "1 as k1", "2 as k2", "3 as drops", "4 as n_shared", "5 as block")
    got = lines.line_report(df)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "n_shared", "kept_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain(rows)))


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000, 100_000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    hi, lo = rng.integers(0, 1 << 63, n, np.uint64), rng.integers(0, 1 << 63, n, np.uint64)
    found = lines.PerfectHash.over(hi, lo)
    assert sorted(found.index(hi, lo).tolist()) == list(range(n))
    assert len(found.bits) <= max(64, 6 * n) + 64 * 8
    assert (found.index(hi + np.uint64(1), lo) < max(n, 1)).all()


def test_defined_cases(spark):
    shared = "A line that several texts hold"
    rows = [
        (3, f"first\n  {shared} \t\nlast"), (1, f"{shared.upper()}\nown line of one"), (2, None), (4, ""), (5, "\n\n"), (5, f"\r{shared}\x0b\nshort\nshort"),
        (6, f"{shared}\n{shared}\n{shared}"), (6, f"{shared}\n{shared}\n{shared}"), (None, f"{shared}\nnull id line"), (None, "null id line\nnull id line"), (7, "null id line"),
        (8, "éééééééééé\néééééééé"), (9, "ÉÉÉÉÉÉÉÉÉÉ\néééééééééé\néééééééé"), (10, " abcdefghij\nabcdefghij"), (11, "abcdefghij\x1c\nabcdefghij"), (12, "x\x00yzabcdefgh"), (13, "X\x00YZabcdefgh"),
        (14, "repeated in one text\nrepeated in one text"), (-5, "negative id line"), (0, "Negative ID line"),
    ]
    check(spark, rows, extra=True)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lines.line_report(empty).count() == 0
    check(spark, [(1, None), (None, None), (2, "")])


def test_random_texts_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(lines, "SHARD", 40)
    monkeypatch.setattr(lines, "PROBES", 25)
    monkeypatch.setattr(lines, "BLOCK", 300)
    rng = random.Random(13)
    pool = [f"line number {i} of the pool" for i in range(80)] + ["tiny", "", "  Line Number 1 of the POOL"]
    rows = [(rng.choice([None, *range(60)]), "\n".join(rng.choices([pool[0], *pool], k=rng.randrange(1, 9)))) for _ in range(150)]
    check(spark, rows)


def test_hot_line_and_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(lines, "PROBES", 20)
    monkeypatch.setattr(lines, "BLOCK", 200)
    rows = [(i, f"every text holds this line\nbut this one is of text {i} only") for i in range(300)]
    rows.append((1000, "\n".join(f"row {i % 5000} of a long table" for i in range(20_000)) + "\nevery text holds this line"))
    rows.append((1001, "\n".join(f"row {i} of a long table" for i in range(0, 9000, 3))))
    check(spark, rows)
