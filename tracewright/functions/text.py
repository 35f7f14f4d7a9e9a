"""Text functions as columns; Python only where no column function has the semantics."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that carry no content in a query.
STOPWORDS = """
    a about above after again all also am an and any are as at be because been before being
    below between both but by can could did do does doing down during each few for from
    further had has have having he her here hers him his how i if in into is it its itself
    just may me might more most must my no nor not now of off on once one only or other our
    out over own same she should so some such than that the their them then there these they
    this those through to too under until up upon us very was we were what when where which
    while who whom why will with within without would you your
    potential potentially possible possibly likely probable suspected hypothesis hypotheses
    event events normalized available observed indicator indicators
""".split()
WORD = r"[\p{L}\p{N}]+"
IDENTIFIER = r"(?i)\b(?:CWE|CAPEC|CVE)-[0-9]+(?:-[0-9]+)?\b"
LOOSE_IDENTIFIER = r"(?i)\b(?:CWE|CAPEC|CVE)[-_ ][0-9]+(?:-[0-9]+)?\b"


def percent_decode(text: Column) -> Column:
    """%xx escapes decoded; a plus stays a plus, and what is no escape stays as it is."""
    safe = F.regexp_replace(F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    return F.try_url_decode(safe)


def decoded_twice(text: Column) -> Column:
    return percent_decode(percent_decode(text))


def percent_encode(text: Column) -> Column:
    return F.regexp_replace(F.url_encode(text), r"\+", "%20")


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def _folding() -> tuple[str, str]:
    """Letters that are an ASCII letter with one mark, and those marks; the letters without it."""
    once = {}
    for c in map(chr, range(0xC0, 0x1F00)):
        parts = unicodedata.decomposition(c).split()
        if c == c.lower() and len(parts) == 2 and (base := chr(int(parts[0], 16) if "<" not in parts[0] else 0)).isalpha() and base.isascii():
            once[c] = (base, chr(int(parts[1], 16)))
    return "".join(once) + "".join(sorted({m for _, m in once.values()})), "".join(b for b, _ in once.values())


FOLDED = _folding()


def folded(text: Column) -> Column:
    """Lower case without diacritics, as a full-text index matches words: `Café` is `cafe`. Marks of their own go; letters with
    more than one mark keep them."""
    return F.translate(F.lower(text), *FOLDED)


def search_words(text: Column) -> Column:
    """Distinct words of a query that carry content: no stop words, numbers or single characters."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    plain = F.regexp_replace(text, IDENTIFIER, " ")
    kept = F.filter(words(plain), lambda w: (F.length(w) >= 2) & ~w.rlike(r"^\p{Nd}+$"))
    return F.array_distinct(F.array_except(kept, stop))


def identifiers(text: Column) -> Column:
    """Weakness, pattern and vulnerability identifiers in first-seen order, upper case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(IDENTIFIER), 0), lambda x: F.upper(x)))


def loose_identifiers(text: Column) -> Column:
    """As identifiers, where an underscore or a blank may stand for the first hyphen."""
    found = F.regexp_extract_all(text, F.lit(LOOSE_IDENTIFIER), 0)
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(F.upper(x), r"^([A-Z]+)[-_ ]", "$1-")))


def query_terms(text: Column, phrases: Column | None = None) -> Column:
    """Terms of a query, most important first: identifiers, phrases, words."""
    said = F.array().cast("array<string>") if phrases is None else F.filter(F.transform(phrases, lambda p: F.array_join(words(p), " ")), lambda p: p != "")
    return F.array_distinct(F.concat(identifiers(text), said, search_words(text)))


def within_budget(terms: Column, most: int = 1000) -> Column:
    """The leading terms whose quoted forms, joined by ` OR `, stay within `most` characters; the first that does not fit
    ends the list."""
    state = F.struct(F.lit(0).alias("n"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("kept"))

    def step(a: Column, t: Column) -> Column:
        added = F.length(t) + 2 + F.when(F.size(a["kept"]) > 0, 4).otherwise(0)
        full = a["full"] | (a["n"] + added > most)
        return F.struct(F.when(full, a["n"]).otherwise(a["n"] + added).alias("n"), full.alias("full"), F.when(full, a["kept"]).otherwise(F.concat(a["kept"], F.array(t))).alias("kept"))

    return F.aggregate(terms, state, step, lambda a: a["kept"])


def shortened(text: Column, most: int, mark: str = " […]") -> Column:
    """Text cut at the last blank before `most` characters, with a mark; a shorter text as it is."""
    head = F.substring(text, 1, most)
    cut = F.regexp_replace(head, r"[ \t\n\x0B\f\r]+[^ \t\n\x0B\f\r]*\z", "")
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.when(cut == "", head).otherwise(cut), F.lit(mark)))


def redact_credentials(text: Column) -> Column:
    """Values of credential-like settings replaced."""
    return F.regexp_replace(text, r"(?i)\b(password|passwd|pwd|secret|token|api[_-]?key)(\s*[=:]\s*)(\"[^\"]*\"|'[^']*'|[^\s,;]+)", "$1$2[REDACTED]")


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 3.0).cast("long")


def lane(doc_id: Column) -> Column:
    return F.substring_index(doc_id, ":", 1)


def strip_identifiers(text: Column) -> Column:
    """Text without identifiers and parentheses that they leave empty, blanks squashed."""
    plain = F.regexp_replace(F.regexp_replace(text, IDENTIFIER, " "), r"\(\s*\)|\[\s*\]", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


# What stands for "not known" in a finding, quoted spans, and path-like tokens.
PLACEHOLDER = r"(?i)^\s*(?:unknown|undetermined|not confirmed|unconfirmed|none|n/?a|tbd)\b"
LITERAL = r"`([^`\n]{1,200})`"
PATH = r"(?<![A-Za-z0-9/])(/[A-Za-z0-9._~!$&'()*+,;=:@%/-]*)"
# End of fixed values


def is_placeholder(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "") | text.rlike(PLACEHOLDER)


def paths_in(text: Column) -> Column:
    """Path-like tokens without the marks of a sentence after them; bare slashes are none."""
    found = F.transform(F.regexp_extract_all(text, F.lit(PATH), 1), lambda x: F.regexp_replace(x, r"[.,;:)]+$", ""))
    return F.array_distinct(F.filter(found, lambda x: ~x.isin("", "/", "//")))


def literals(text: Column) -> Column:
    """What a text could make up and present as real: its quoted spans, then its paths."""
    quoted = F.transform(F.regexp_extract_all(text, F.lit(LITERAL), 1), lambda x: F.trim(x))
    return F.array_distinct(F.filter(F.concat(quoted, paths_in(text)), lambda x: x != ""))


def ungrounded_literals(text: Column, corpus: Column) -> Column:
    """Literals of a text that its corpus does not contain as they are."""
    return F.filter(literals(text), lambda x: ~F.contains(corpus, x))


# What counts as a line's end, and the marks that open and close code.
LINE_ENDS = "\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
CODE_OPENS = r"[ \t]*(?:(`{3,})[^`\n]*|(~{3,}).*)"
CODE_CLOSES = r"[ \t]*(`{3,}|~{3,})[ \t]*"
# End of fixed values


def _code_lines(lines: list[str]) -> Iterator[str]:
    """For each line its part: `mark` opens or closes code, `code` lies inside, `text` outside. Code that is not closed goes on."""
    mark = ""
    for line in lines:
        if mark:
            m = re.fullmatch(CODE_CLOSES, line)
            closes = m and m[1].startswith(mark)
            yield "mark" if closes else "code"
            mark = "" if closes else mark
        else:
            m = re.fullmatch(CODE_OPENS, line)
            mark = (m[1] or m[2]) if m else ""
            yield "mark" if m else "text"


def normalize_text(text: str | None) -> str | None:
    """One form of a text: every kind of line end as \\n, other controls gone (unit separators as blanks), NFC, no empty lines
    or byte-order marks before the first line. Outside code, blanks at line ends go, but for two before another line
    with text (a hard break), and empty lines in a row become one. No white space at the end."""
    if text is None:
        return None
    text = re.sub(LINE_ENDS, "\n", text).replace("\x1f", " ")
    text = unicodedata.normalize("NFC", re.sub(r"[\x00-\x08\x0e-\x1f\x7f-\x9f]", "", text))
    lines = re.sub(r"\A(?:\ufeff*\s*\n)*\ufeff*", "", text).split("\n")
    out: list[str] = []
    for line, part, after in zip(lines, _code_lines(lines), [*lines[1:], ""], strict=True):
        cut = line.rstrip()
        if part == "code":
            out.append(line)
        elif part == "mark":
            out.append(cut)
        elif cut:
            out.append(cut + "  " if re.fullmatch("  +", line[len(cut) :]) and after.strip() else cut)
        elif not out or out[-1]:
            out.append("")
    return "\n".join(out).rstrip()


def chunk_bounds(text: str, most: int = 1200, overlap: int = 120) -> list[tuple[int, int]]:
    """Start and end of each chunk. One that is not the last ends after the last empty line in its window, else after the last
    line end, else after the last white space, else anywhere but before a combining mark; it is longer than `overlap`
    and not blank. The next starts exactly `overlap` before its end. Windows of white space give no chunk."""
    if not 0 <= overlap < most:
        raise ValueError("overlap must be at least 0 and less than the longest chunk")
    ends = [[m.start() + k for m in re.finditer(p, text)] for p, k in ((r"(?=\n\n)", 2), (r"\n", 1), (r"\s", 1))]
    mark = lambda i: unicodedata.category(text[i]).startswith("M")
    out, start, n = [], 0, len(text)
    while start < n:
        limit = min(start + most, n)
        said = re.compile(r"\S").search(text, start, limit)
        if not said:
            start = limit
            continue
        if limit == n:
            return [*out, (start, n)]
        low = max(start + overlap, said.start())
        last = (places[k - 1] for places in ends if (k := bisect_right(places, limit)) and places[k - 1] > low)
        end = next(last, None)
        if end is None:
            free = next((i for i in range(limit, low, -1) if not mark(i)), limit)
            end = free
        out.append((start, end))
        start = end - overlap
    return out


CHUNK = "doc_id {kind}, ordinal int, char_start int, char_end int, text string"


def chunks(docs: DataFrame, most: int = 1200, overlap: int = 120) -> DataFrame:
    """doc_id, ordinal, char_start, char_end, text of the chunks of normalized texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i, raw in zip(frame["doc_id"], frame["text"], strict=True):
                text = normalize_text(raw) or ""
                rows += [(i, k, a, b, text[a:b]) for k, (a, b) in enumerate(chunk_bounds(text, most, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "ordinal", "char_start", "char_end", "text"])

    return docs.select("doc_id", "text").where("text is not null").mapInPandas(run, CHUNK.format(kind=docs.schema["doc_id"].dataType.simpleString()))


def fixed_chunks(docs: DataFrame, size: int = 1200) -> DataFrame:
    """doc_id, ordinal, text in windows of `size` characters, in columns only."""
    n = F.ceil(F.length("text") / F.lit(float(size))).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return docs.select("doc_id", "text", F.explode(at).alias("ordinal")).select("doc_id", "ordinal", F.expr(f"substring(text, ordinal * {size} + 1, {size})").alias("text"))


class _Plain(HTMLParser):
    BREAKS = {"p", "div", "br", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "nav", "header", "footer", "title"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag in self.BREAKS:
            self.parts.append("\n- " if tag == "li" else "\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        if tag in self.BREAKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def plain_html(html: str | None) -> str | None:
    """Markup as plain text: block elements on lines of their own, list items with a dash, blanks squashed, no scripts."""
    if html is None:
        return None
    parser = _Plain()
    parser.feed(html)
    parser.close()
    lines = (re.sub(r"\s+", " ", x).strip() for x in "".join(parser.parts).split("\n"))
    return "\n".join(x for x in lines if x and x != "-")


def html_text(html: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(plain_html)

    return run(html)
