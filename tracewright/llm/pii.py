"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, plus signs, digits, URL schemes and identifier cues.
From each anchor a small local parser expands to the span's boundaries and validates it. Every parser remembers where
its last span ended, so each kind's spans are leftmost and do not overlap, and no text is scanned twice.

Defined cases: a null or empty text has no spans; repeated rows each get their row; offsets are code points, end
exclusive; extra columns never clash, as only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Kinds in the order in which spans of equal start are listed; the first four are the contract's base kinds.
KINDS = ["email", "ip", "card", "phone", "url", "account", "secret"]
BASE = set(KINDS[:4])
ORDER = {k: i for i, k in enumerate(KINDS)}
BLOCK = 8 << 20

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
USERINFO = re.compile(r"://[^\s/@:]+:[^\s/@]+@[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\s\"'<>]*)?")
IBAN = re.compile(r"[^A-Za-z0-9]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
NUMBER = re.compile(r"(?: ?(?:number|no\.?|nr\.?|#))?[ :=#]{1,3}([0-9](?:[ -]?[0-9]){7,16})(?![0-9])")
ASSIGNED = re.compile(r"[ ]?[=:][ ]?([^\s,;\"']{8,})")
KEY_ID = re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])")


@lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for key, kind in {"@": "at", "+": "plus", "://": "scheme", "AKIA": "key", **dict.fromkeys("0123456789", "digit")}.items():
        found.add_word(key, (kind, len(key)))
    for word in ("iban", "account", "acct"):
        for form in (word, word.upper(), word.capitalize()):
            found.add_word(form, ("account", len(form)))
    for word in ("password", "passwd", "token", "secret", "api_key", "apikey"):
        for form in (word, word.upper(), word.capitalize()):
            found.add_word(form, ("assign", len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def octets(dotted: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in dotted.split("."))


def mod97(iban: str) -> bool:
    plain = iban.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all personal data, by start and then kind."""
    if not text:
        return []
    out: list[tuple[str, int, int]] = []
    mail = ip = card = 0  # where the last match of each kind ended, kept or dropped
    for last, (kind, width) in anchors().iter(text):
        if kind == "digit":
            if last >= card and (m := DIGITS.match(text, last)):
                card = m.end()
                number = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(number) <= 19 and luhn(number):
                    out.append(("card", last, card))
            if last >= ip and (last == 0 or last == ip or not "0" <= text[last - 1] <= "9") and (m := DOTTED.match(text, last)):
                ip = m.end()
                if octets(m.group()):
                    out.append(("ip", last, ip))
        elif kind == "at":
            start = last
            while start > mail and text[start - 1] in LOCAL:
                start -= 1
            if start < last and (m := DOMAIN.match(text, last + 1)):
                mail = m.end()
                out.append(("email", start, mail))
        elif kind == "plus":
            if (m := PHONE.match(text, last)) and 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", last, m.end()))
        elif kind == "scheme":
            start = last - 2
            while start and text[start - 1].isascii() and text[start - 1].isalpha() and last - start < 12:
                start -= 1
            if start < last - 2 and (m := USERINFO.match(text, last - 2)):
                out.append(("url", start, m.end()))
        elif kind == "account":
            if last + 1 == width or not text[last - width].isalnum():
                if (m := IBAN.match(text, last + 1)) and mod97(m.group(1)) or (m := NUMBER.match(text, last + 1)):
                    out.append(("account", m.start(1), m.end(1)))
        elif kind == "key":
            if (last < 4 or not text[last - 4].isalnum()) and (m := KEY_ID.match(text, last - 3)):
                out.append(("secret", last - 3, m.end()))
        elif m := ASSIGNED.match(text, last + 1):
            out.append(("secret", m.start(1), m.end(1)))
    return sorted(set(out), key=lambda s: (s[1], ORDER[s[0]], s[2]))


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def redact(text: str | None) -> str | None:
    """Each span, or run of overlapping spans, becomes its first kind in angle brackets."""
    found = spans(text)
    if not found:
        return text
    out, end = [], 0
    for kind, a, b in found:
        if a >= end:
            out += [text[end:a], f"<{kind.upper()}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def find_pii(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, counts of the base kinds, digest of the base spans, all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", BLOCK):
            found = [spans(t) for t in b.column("text").to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in f) for f in found], pa.int64()) for k in KINDS[:4]]
            base = [hashlib.sha256(joined([s for s in f if s[0] in BASE]).encode()).hexdigest() for f in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, pa.array(base), pa.array([joined(f) for f in found], pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS[:4]), "base_sha256", "spans"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def redact_pii(docs: DataFrame) -> DataFrame:
    """docs with every span replaced in text; n_chars, where there is one, follows the new text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", BLOCK):
            at = b.schema.get_field_index("text")
            yield b.set_column(at, b.schema.field(at), pa.array([redact(t) for t in b.column(at).to_pylist()], b.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
