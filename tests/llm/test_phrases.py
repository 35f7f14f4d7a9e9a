"""Phrase mining: brute force over counters, exact arithmetic, pruning and defined cases."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tracewright.llm import phrases


def plain(rows, least=10, top=2000):
    """lang, text -> the contract's rows by counting every n-gram."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                f[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        ranked = []
        for p, a in counts.items():
            if len(p) == 1 or a < least:
                continue
            if any(len(q) > len(p) and b >= least and 100 * b >= 50 * a and p in (q[:2], q[1:]) for q, b in counts.items()):
                continue
            score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def check(spark, rows, bits=phrases.BITS, **kw):
    df = spark.createDataFrame([(i, lang, text, "x") for i, (lang, text) in enumerate(rows)], "n long, lang string, text string, phrase string").repartition(3)
    got = phrases.collocations(df, bits=bits, **kw)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain(rows, **kw)


def test_random_texts(spark, monkeypatch):
    monkeypatch.setattr(phrases, "MANY", 30)
    monkeypatch.setattr(phrases, "BLOCK", 500)
    rng = random.Random(12)
    words = ["The", "of", "a", "new", "york", "city", "É", "naïve", "x\x1cy", "x y", *(f"w{i}" for i in range(40))]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]
    rows = []
    for _ in range(120):
        text = "".join(rng.choice(words[: rng.choice([4, 8, 50])]) + rng.choice(ends) for _ in range(rng.randrange(60)))
        rows.append((rng.choice(["en", "de", None, "und"]), text + rng.choice(["", "New York city ", "new york City\t"])))
    check(spark, rows)
    monkeypatch.setattr(phrases, "NUMBERS", 20)
    check(spark, rows, least=3, top=7)


def test_few_buckets_change_nothing(spark):
    rng = random.Random(3)
    check(spark, [("en", " ".join(rng.choices("abcdefgh", k=30))) for _ in range(60)], bits=4)


def test_defined_cases(spark):
    check(spark, [("en", None), (None, ""), ("en", "..,;\n")])
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    # overlaps count: ten of the pair, nine of the triple; ties fall by bytes
    check(spark, [("en", "a a a a a a a a a a a"), ("de", "z y. " * 10 + "é b. " * 10), (None, "A B " * 10), ("und", "a b " * 10)])


def test_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", 1000)
    check(spark, [("en", "one two three. " * 3000), ("en", "four five " * 2000)])
    assert b"\n".join(phrases._cut(["a b. c", "d " * 50 + ".e", "f"], 10)) == "a b\n c\n{}\ne\nf".format("d " * 50).encode()


def test_scores_past_64_bits(spark, monkeypatch):
    many = [("en", "p q", 2, 9_000_000_000_000), ("en", "p", 1, 9_500_000_000_001), ("en", "q", 1, 9_100_000_000_003)]
    grams = spark.createDataFrame(many, "lang string, phrase string, words int, n long")
    monkeypatch.setattr(phrases, "frequent_phrases", lambda docs, least, bits: (grams, spark.createDataFrame([("en", 10**14)], "lang string, n long")))
    row = phrases.collocations(grams).first()
    assert row["score"] == 1_000_000 * 9_000_000_000_000**2 // (9_500_000_000_001 * 9_100_000_000_003)


def test_only_what_can_be_frequent_is_counted(spark):
    """The second pass gets the bitmaps' word for it: pairs of a bucket below the least count are not counted at all."""
    rows = [("en", " ".join(f"v{i * 7 + j}" for j in range(7)) + ". common pair") for i in range(200)]
    df = spark.createDataFrame(rows, "lang string, text string")
    one = phrases.counted(df, 1)
    allowed = phrases._gathered(one.where("slice is not null").select("slice", "data"), 10)
    words = one.where("slice is null").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where("n >= 10")
    two = phrases.counted(df, 2, 10, allowed, phrases._frequent(words)).where("slice is null").groupBy("phrase").agg(F.sum("n")).collect()
    assert [tuple(r) for r in two] == [("common pair", 200)]
    assert pytest.approx(int(sum(bin(b).count("1") for b in allowed)), abs=2) == 1
