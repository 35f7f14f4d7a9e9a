"""Source divergence: every term and group by plain integers, totals past 64 bits and defined cases."""

import random
import re
from collections import Counter, defaultdict

from tracewright.llm import divergence


def plain(rows, least=10, first=10):
    """(lang, source, text) -> the contract's rows over the full grid of terms and sources."""
    rows = [tuple(x if x is not None else "" for x in r) for r in rows]
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups[lang].add(source)
        counts[lang, source].update(terms)
        held[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, d in held[lang].items() if d >= least]
        p = {}
        for s in [*sources, None]:
            own = {t: counts[lang, s][t] if s is not None else sum(counts[lang, x][t] for x in sources) for t in kept}
            whole = sum(own.values()) + 2 * len(kept)
            p[s] = {t: 1 + 1_000_000_000 * (c + 2) // whole for t, c in own.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-f(p[s][t], p[None][t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > p[None][t])[:first]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -v, rank) for rank, (v, item) in enumerate(found, 1)]
    return sorted(out)


def check(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, n long, term string").repartition(3)
    got = divergence.audit(df, **kw)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"
    assert sorted(map(tuple, got.collect())) == plain(rows, **kw)


def test_random_texts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "MANY", 50)
    monkeypatch.setattr(divergence, "BLOCK", 400)
    monkeypatch.setattr(divergence, "GROWN", 60)
    rng = random.Random(11)
    words = ["The", "of", "É", "naïve", "éÉ", "x1y", "a-b", *(f"w{'abcdefghij'[i % 10]}{'klmno'[i // 10]}" for i in range(50))]
    rows = []
    for _ in range(200):
        s = rng.randrange(7)
        text = rng.choice([" ", "_", "\n"]).join(rng.choices(words[: 10 + 7 * s], k=rng.randrange(40)))
        rows.append((rng.choice(["en", "en", "de", None, ""]), rng.choice([f"src{s}", "hot", None]), text))
    check(spark, rows)
    check(spark, rows, least=3, first=2)


def test_defined_cases(spark):
    check(spark, [("en", "a", None), ("en", "b", ""), (None, None, None), ("de", "only", "12 34"), ("fr", "a", "mot"), ("fr", "b", "mot")])
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0
    # a group without any terms in a lang that has kept ones; ties by bytes; repeated rows
    check(spark, [("en", "a", "zz aa é")] * 12 + [("en", "b", "12")] + [("en", "c", "aa")] * 3 + [("en", "d", None)])


def test_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 2000)
    check(spark, [("en", "a", "one two " * 20_000)] + [("en", "b", "two three")] * 15)


def test_exact_past_64_bits():
    con = divergence._database()
    con.execute(divergence.MACROS)
    n, whole, terms = 10**14 + 7, 10**15 + 3, 10**9 + 1
    assert con.execute("select share(?, ?, ?)", [n, whole, terms]).fetchone()[0] == 1 + 10**9 * (n + 2) // (whole + 2 * terms)
    assert con.execute("select apart(1000000001::bigint, 1::bigint)").fetchone()[0] == (10**9) ** 2 // (10**9 + 2)
