"""Language identification: defined cases, order and held-out accuracy."""

import random
import unicodedata
import zlib
from collections import Counter

from tracewright.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert len(got) == docs.count()
    rows = [(r["doc_id"], r["lang"]) for r in docs.collect() if r["lang"] and r["text"] and len(r["text"]) >= 40]
    held = [(i, lang) for i, lang in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] for i, _ in held)
    assert sum(got[i]["lang_pred"] == lang for i, lang in held) / len(held) > 0.9
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_defined_cases(spark):
    rows = [(i, "the cat sat on the mat and the dog", "en") for i in range(8)] + [(10 + i, "der hund und die katze sind hier", "de") for i in range(8)]
    rows += [(50, None, "en"), (51, "", None), (52, "123 !!", "de"), (53, "the dog and the cat", None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(df).collect()}
    assert got[50] == got[51] == got[52] == ("und", 0.0)
    assert got[53][0] == "en"
    nothing = langid.identify(df.where("lang is null"))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}
    assert langid.identify(df.where("false")).count() == 0


def test_profiles_count_all_rows(spark):
    df = spark.createDataFrame([("en", "abc abc"), ("en", "b")], "lang string, text string")
    n = {r["gram"]: r["n"] for r in langid.count_grams(df).collect()}
    assert n[ord("b") << 42] == 3 and n[ord(" ") << 42 | ord("a") << 21 | ord("b")] == 2


def plain_words(text):
    """Runs of letters and the marks after a letter."""
    out, now = [], ""
    for c in text.lower():
        kind = unicodedata.category(c)[0]
        if kind == "L" or (kind == "M" and now):
            now += c
        elif now:
            out.append(now)
            now = ""
    return out + [now] * bool(now)


def plain_ranks(texts, top):
    counts = Counter()
    for t in texts:
        for w in plain_words(t):
            padded = f" {w} "
            counts.update(padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1) if padded[i : i + n] != " ")
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:top]]


def test_against_plain_version(spark):
    """Profiles, distances, ties and scores are those of plain counting."""
    rng, top = random.Random(2), 40
    alphabets = {"aa": "abcdeé", "bb": "cdefgñ", "cc": "xyzабв", "dd": "abcdeé"}
    say = lambda x: " ".join("".join(rng.choice(x) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 30)))
    rows = [(i, say(alphabets[lang]), lang) for i, lang in enumerate(rng.choice(sorted(alphabets)) for _ in range(120))]
    rows += [(200, "½ ² ① Ⅷ 42", None), (201, "e\u0301te\u0301", None), (202, None, None), (203, "日本", None), (204, rows[3][1] * 400, None), (205, "\u0301", None)]
    rows.append(rows[0])
    trained = [(t, lang) for i, t, lang in rows if t and lang and zlib.crc32(str(i).encode()) % 4 != 2]
    profiles = {lang: plain_ranks([t for t, x in trained if x == lang], top) for lang in {x for _, x in trained}}
    want = {}
    for i, t, _ in rows:
        own = plain_ranks([t or ""], top)
        if not own:
            want[i] = ("und", 0.0)
            continue
        far = {lang: sum(abs(p.index(g) - k) if g in p else top for k, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        want[i] = (best, round(1 - far[best] / (top * len(own)), 9))
    got = langid.identify(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, held_out int").repartition(5), top).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in got} == want
    assert want[200] == want[205] == ("und", 0.0) and want[201][0] != "und"


def test_equal_profiles_go_to_the_first_language(spark):
    rows = [(i, "abc abc abd", lang) for i in range(8) for lang in ("zz", "mm")] + [(90, "abc", None)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in got.collect()} == {"mm"}
