"""Personal data against plain regular expressions."""

import hashlib
import random
import re

import pytest

from tracewright.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def plain(text):
    text = text or ""
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    n = lambda s: sum(c in "0123456789" for c in s)
    out += [("card", *m.span()) for m in CARD.finditer(text) if 12 <= n(m.group()) <= 19 and luhn(m.group())]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= n(m.group()) <= 15]
    order = ["email", "ip", "card", "phone"]
    return sorted(out, key=lambda s: (s[1], order.index(s[0])))


CASES = [
    None, "", "a@b.c", "x@@y.zz a@b@c.de", "me.you+tag@ex-ample.co.uk, next", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 01.02.003.0004", "4111 1111 1111 1111 and 4111-1111-1111-1111",
    "+49 (30) 1234-5678 +1.2", "call +1 555 010 9999 or +44 20 7946 0958.", "4111111111111111.1.2.3", "é4111 1111 1111 1111é", "a@b.c@d.e", "+123456789+123456789", "1.1.1.1.1.1.1", "0.0.0.0", "@x.y", "..@x.y.", "a@x..y",
    "4111  1111", "++1 234 567 89", "+1(2)3.4-5 6 7 8 9", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 1",
]


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert [s for s in pii.spans(text) if s[0] in pii.BASE] == plain(text)


def test_random_texts():
    rng = random.Random(3)
    for _ in range(6000):
        text = "".join(rng.choice("a.@+-0123456789 ()4é") for _ in range(rng.randrange(60)))
        assert [s for s in pii.spans(text) if s[0] in pii.BASE] == plain(text), text


def test_digit_runs_are_linear():
    assert pii.spans("7" * 300_000) is not None
    assert pii.spans("a" * 300_000 + "@") == []


def test_query(spark):
    rows = [(i, t, 1) for i, t in enumerate([*CASES, "iban DE89 3704 0044 0532 0130 00", "https://u:pw@host.org/x"])]
    got = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string, spans int"))
    for r in got.collect():
        want = plain(rows[r["doc_id"]][1])
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[0] == k for s in want) for k in ("email", "ip", "card", "phone")]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
    assert "account:5:" in got.where(f"doc_id = {len(CASES)}").first()["spans"]
    assert got.where("false").count() == 0


def test_redaction():
    assert pii.redact("mail a@b.co now") == "mail <EMAIL> now"
    assert pii.redact(None) is None and pii.redact("plain") == "plain"
