"""Quality rules: counts against plain code, the forest on labelled rows, defined cases."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from tracewright.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    lines, dups, before = text.split("\n"), 0, set()
    for line in lines:
        if WORD.search(line):
            dups += line in before
            before.add(line)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(covered)]


def test_counts_match_plain():
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice(["a", "b", "é", " ", " ", "\n", "#", "\x0b", "\x85", " ", "word ", "\r\n"]) for _ in range(rng.randrange(80)))
        assert quality.statistics(text)[0] == plain(text), repr(text)
    assert quality.statistics(None)[0] == [0, 0, 0, 0, 0]


def test_forest_separates_outliers():
    rng = np.random.default_rng(0)
    usual, odd = rng.normal(0, 1, (400, 4)), rng.normal(9, 1, (20, 4))
    x = np.vstack([usual, odd])
    s = quality.forest_scores(quality.fit_forest(x), x, 256)
    assert s[400:].min() > np.median(s[:400])
    cut = quality.calibrate(s, np.arange(420) < 400)
    assert (s[:400] <= cut).mean() > 0.9 and (s[400:] > cut).mean() > 0.9


def test_query(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in quality.quality_rules(docs, labels).collect()}
    again = {r["doc_id"]: r for r in quality.quality_rules(docs.repartition(7), labels).collect()}
    assert got == again
    good = bad = kept_good = kept_bad = 0
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    for r in docs.collect():
        own, want = got[r["doc_id"]], plain(r["text"])
        assert [own[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == want
        assert own["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (own["base_failed"] and own["kept"])
        if r["doc_id"] in truth and not own["base_failed"]:
            if truth[r["doc_id"]]:
                good, kept_good = good + 1, kept_good + own["kept"]
            else:
                bad, kept_bad = bad + 1, kept_bad + own["kept"]
    assert kept_good / good > 0.85
    assert bad and kept_bad / bad < 0.1


def test_defined_cases(spark, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    text = " ".join(f"word{i}" for i in range(80))
    df = spark.createDataFrame([(1, text, 1), (1, text, 1), (None, text, 2), (2, None, 3), (3, "", 4)], "doc_id long, text string, score int")
    none = quality.quality_rules(df, labels.where("false"))
    assert sorted((r["doc_id"] or 0, r["kept"]) for r in none.collect()) == [(0, True), (1, True), (1, True), (2, False), (3, False)]
    kept = quality.keep_good(df, labels.where("false"))
    assert kept.columns == df.columns and kept.count() == 3
    assert quality.quality_rules(df.where(F.lit(False)), labels).count() == 0


def plain_score(forest, x, normal):
    """A row's score, walking each tree node by node."""
    total = 0.0
    for feature, cut, left, right, path in forest:
        at = 0
        while feature[at] >= 0:
            at = left[at] if x[feature[at]] <= cut[at] else right[at]
        total += path[at]
    return 2.0 ** (-total / len(forest) / normal)


def plain_cut(scores, good):
    """Of all places between scores the one that best keeps good rows and drops bad ones; of equal ones the last."""
    best, value = None, -1.0
    known = sorted(set(scores))
    for k, cut in enumerate(known):
        v = sum(s <= cut for s, g in zip(scores, good) if g) / max(sum(good), 1) + sum(s > cut for s, g in zip(scores, good) if not g) / max(len(good) - sum(good), 1)
        if v >= value - 1e-12:
            best, value = (cut + known[min(k + 1, len(known) - 1)]) / 2, max(value, v)
    return best


def test_verdict_against_plain_version(spark, small):
    """The forest's paths, the cut and each verdict, node by node."""
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = sorted((i, quality.statistics(t)[1]) for i, t in texts if i in truth)
    x, good = np.array([r for _, r in rows]), [truth[i] == 1 for i, _ in rows]
    size = min(256, len(x))
    forest = quality.fit_forest(x, sample=size)
    normal = 2 * (np.log(size - 1) + 0.5772156649015329) - 2 * (size - 1) / size
    cut = plain_cut([round(plain_score(forest, r, normal), 12) for r in x.tolist()], good)
    got = {r["doc_id"]: r for r in quality.quality_rules(docs, labels).collect()}
    for i, t in texts:
        score, failed = plain_score(forest, quality.statistics(t)[1], normal), got[i]["base_failed"]
        assert abs(got[i]["score"] - score) < 1e-9
        assert abs(score - cut) < 1e-9 or got[i]["kept"] == (not failed and score <= cut)
    assert len({r["kept"] for r in got.values()}) == 2


def test_ties_and_very_long_texts(spark, small):
    """Equal texts get equal verdicts, also where all labelled rows tie; a very long text is measured whole."""
    long = " ".join(f"word{i % 7919}" for i in range(400_000))
    text = " ".join(f"word{i}" for i in range(80))
    df = spark.createDataFrame([(i, text) for i in range(6)] + [(9, long), (9, long)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int")
    got = quality.quality_rules(df, labels).collect()
    assert len({(r["kept"], r["score"]) for r in got if r["doc_id"] < 6}) == 1
    assert [r["n_words"] for r in got if r["doc_id"] == 9] == [400_000] * 2
    assert all(r["base_failed"] for r in got if r["doc_id"] == 9)


def test_all_labelled_rows_count(spark):
    """The forest and the cut on a table are those on all of its rows in memory: 5,000 good rows and 300 bad, of which a bounded
    sample of a class would leave most out."""
    rng = np.random.default_rng(3)
    x = np.vstack([rng.random((5000, 6)), rng.random((300, 6)) + 0.7])
    good = np.arange(5300) < 5000
    rows = spark.createDataFrame([(*map(float, r), bool(g)) for r, g in zip(x, good)], ", ".join(f"{r} double" for r in quality.RATIOS) + ", good boolean").repartition(5)
    forest, plain = quality.grow_forest(rows, trees=16), quality.fit_forest(x, trees=16, sample=len(x))
    assert all(np.array_equal(a, b) for one, two in zip(forest, plain, strict=True) for a, b in zip(one, two, strict=True))
    s = np.round(quality.forest_scores(forest, x, len(x)), 3)  # many ties
    scored = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(s, good)], "score double, good boolean")
    assert quality.fit_cut(scored.repartition(3)) == quality.calibrate(s, good)
