"""Catalogs in XML: weaknesses and attack patterns as documents.

A catalog is cut at the end tags of its records, so a plain XML file is read in splits like a log; a ZIP archive holds one
member of bounded size and is cut in the task that unpacks it. Each record is then parsed against a declared schema by from_xml,
and its sections are put together by column functions. A record that is not well-formed, a catalog that is cut short and a
document type or CDATA declaration fail the read. Records without sections, lists without entries and blank entries give no
lines; text of any length stays whole; repeated records stay repeated until select_records reports them."""

from __future__ import annotations

import hashlib
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 64 << 20
PIECE = "file string, root string, record string, closed boolean"


@dataclass(frozen=True)
class Pinned:
    """What a catalog must say of itself; its file name counts for nothing."""

    namespace: str
    root: str
    name: str
    version: str
    date: str


# Text ---------------------------------------------------------------------------------------------------------------

#: Stand-ins: a noncharacter for an escaped "<", characters that XML refuses for a list item and a paragraph's edge.
_LESS, _ITEM, _EDGE = "\ufdd0", "\u0001", "\u0002"
#: XHTML elements that stand apart as paragraphs.
BLOCKS = ["p", "div", "ul", "ol", "table", "pre"]


def collapsed(text: Column) -> Column:
    """Runs of whitespace as one blank, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def flat_text(inner: Column) -> Column:
    """Mixed XHTML (an element's inner XML) as plain text: paragraphs with a blank line between, list items with a dash, br as a
    line end, blanks collapsed, all other tags gone. Null is empty."""
    tag = r"<{}(?:\s(?:[^>\"']|\"[^\"]*\"|'[^']*')*)?/?>"
    out = F.regexp_replace(F.coalesce(inner, F.lit("")), r"(?U)\s+", " ")
    for pattern, put in (
        (tag.format(rf"/?\w+:(?:{'|'.join(BLOCKS)})"), _EDGE),
        (tag.format(r"\w+:li"), "\n" + _ITEM),
        (tag.format(r"\w+:br"), "\n"),
        (tag.format(r"/?[\w:.-]+"), ""),
        (f"{_ITEM}(?=[ \n{_EDGE}]*{_ITEM})", ""),
        (f"{_ITEM}([ \n{_EDGE}]+)", f"$1{_ITEM}"),  # the dash waits for text
        (f"{_ITEM}$", ""),
        (r"[ \n]*\n[ \n]*", "\n"),
        (f"[ \n]*{_EDGE}[ \n{_EDGE}]*", "\n\n"),
        (" +", " "),
        (_ITEM, "- "),
        (_LESS, "<"),
    ):
        out = F.regexp_replace(out, pattern, put)
    return F.btrim(out, F.lit(" \n"))


def one_line(inner: Column) -> Column:
    return collapsed(flat_text(inner))


# Records ------------------------------------------------------------------------------------------------------------

_SHARED = """_ID string, _Name string, _Status string, _Abstraction string, _Structure string, Description string, Extended_Description string,
    Alternate_Terms struct<Alternate_Term: array<struct<Term: string, Description: string>>>,
    Related_Weaknesses struct<Related_Weakness: array<struct<_Nature: string, _CWE_ID: string, _View_ID: string, _Ordinal: string>>>,
    Related_Attack_Patterns struct<Related_Attack_Pattern: array<struct<_Nature: string, _CAPEC_ID: string>>>,
    Taxonomy_Mappings struct<Taxonomy_Mapping: array<struct<_Taxonomy_Name: string, Entry_ID: string, Entry_Name: string, Mapping_Fit: string>>>,
    Notes struct<Note: array<string>>, References struct<Reference: array<struct<_External_Reference_ID: string, _Section: string>>>,
    Content_History struct<Modification: array<struct<Modification_Date: string>>>"""
_CONSEQUENCES = "struct<Consequence: array<struct<Scope: array<string>, Impact: array<string>, Note: string>>>"
_PLATFORMS = ["Language", "Operating_System", "Architecture", "Paradigm", "Technology"]
_WEAKNESS = f"""{_SHARED}, Background_Details struct<Background_Detail: array<string>>, Likelihood_Of_Exploit string, Common_Consequences {_CONSEQUENCES},
    Modes_Of_Introduction struct<Introduction: array<struct<Phase: array<string>, Note: string>>>,
    Applicable_Platforms struct<{", ".join(f"{p}: array<struct<_Name: string, _Class: string, _Prevalence: string>>" for p in _PLATFORMS)}>,
    Detection_Methods struct<Detection_Method: array<struct<Method: string, Description: string, Effectiveness: string, Effectiveness_Notes: string>>>,
    Potential_Mitigations struct<Mitigation: array<struct<Phase: array<string>, Strategy: string, Description: string, Effectiveness: string, Effectiveness_Notes: string>>>"""
_PATTERN = f"""{_SHARED}, Likelihood_Of_Attack string, Typical_Severity string, Consequences {_CONSEQUENCES},
    Prerequisites struct<Prerequisite: array<string>>, Resources_Required struct<Resource: array<string>>, Indicators struct<Indicator: array<string>>,
    Mitigations struct<Mitigation: array<string>>, Skills_Required struct<Skill: array<string>>,
    Execution_Flow struct<Attack_Step: array<struct<Step: string, Phase: string, Description: string, Technique: array<string>>>>"""
_CITED = "_Reference_ID string, Title string, Author array<string>, URL string"
#: Attributes of elements whose text is mixed: read a second time, as from_xml gives an element's inner XML or its attributes.
_MARKS = "Notes struct<Note: array<struct<_Type: string>>>, Skills_Required struct<Skill: array<struct<_Level: string>>>"


@dataclass(frozen=True)
class Catalog:
    """How one kind of record is called and what it holds."""

    tag: str
    root: str
    kind: str
    source: str
    schema: str

    @property
    def prefix(self) -> str:
        return self.source.upper() + "-"


WEAKNESSES = Catalog("Weakness", "Weakness_Catalog", "weakness", "cwe", _WEAKNESS)
PATTERNS = Catalog("Attack_Pattern", "Attack_Pattern_Catalog", "attack_pattern", "capec", _PATTERN)


def member(data: bytes, digest: str | None) -> bytes:
    """The single XML member of an archive whose SHA-256 is the pinned one."""
    if digest and hashlib.sha256(data).hexdigest() != digest:
        raise ValueError("the archive's SHA-256 is not the pinned one")
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        inside = [i for i in z.infolist() if not i.is_dir()]
        if len(inside) != 1 or not inside[0].filename.endswith(".xml"):
            raise ValueError("the archive must hold one XML member")
        if inside[0].file_size > MOST_BYTES:
            raise ValueError("the XML member is too large")
        return z.read(inside[0])


def _archive_pieces(spark: SparkSession, path: str, tag: str, root: str, digest: str | None) -> DataFrame:
    end, close = f"</{tag}>".encode(), re.compile(rb"</" + root.encode() + rb"\s*>")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, data in zip(frame["path"], frame["content"], strict=True):
                at, text = 0, member(bytes(data), digest)
                if b"<!DOCTYPE" in text or b"<!ENTITY" in text:
                    raise ValueError("document type and entity declarations are refused")
                while at < len(text):
                    upto = text.find(end, at)
                    upto = len(text) if upto < 0 else upto
                    piece = text[at:upto].decode()
                    found = re.search(rf"<{root}\b[^>]*>", piece) if at == 0 else None
                    yield pd.DataFrame([(file, found and found.group(), piece, bool(close.search(text, at, upto)))], columns=["file", "root", "record", "closed"])
                    at = upto + len(end)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, PIECE)


def _file_pieces(spark: SparkSession, path: str, tag: str, root: str) -> DataFrame:
    cut = spark.read.option("lineSep", f"</{tag}>").text(path)
    head = F.nullif(F.regexp_extract("value", rf"<{root}\b[^>]*>", 0), F.lit(""))
    return cut.select(F.col("_metadata.file_path").alias("file"), head.alias("root"), F.col("value").alias("record"), F.col("value").rlike(rf"</{root}\s*>").alias("closed"))


def _said(root: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(root, rf"\s{name}\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit(""))


def _checked_roots(pieces: DataFrame, pinned: Pinned | None) -> DataFrame:
    """file, catalog_version of each catalog; running it fails where one is cut short, has no such root or is not the pinned one."""
    one = pieces.groupBy("file").agg(F.max("root").alias("root"), F.max("closed").alias("closed"))
    wrong = F.when(F.col("root").isNull(), "the catalog has another root element").when(~F.col("closed"), "the catalog is cut short")
    if pinned is not None:
        for name, value in (("xmlns", pinned.namespace), ("Name", pinned.name), ("Version", pinned.version), ("Date", pinned.date)):
            says = _said(F.col("root"), name)
            told = F.concat(F.lit(f"the catalog's {name} is "), F.coalesce(says, F.lit("missing")), F.lit(f", not {value}"))
            wrong = F.coalesce(wrong, F.when(~says.eqNullSafe(value), told))
    version = F.when(wrong.isNotNull(), F.raise_error(F.concat_ws(": ", "file", wrong))).otherwise(_said(F.col("root"), "Version"))
    return one.select("file", version.alias("catalog_version"))


def _parsed(spark: SparkSession, path: str, what: Catalog, element: str, schemas: list[str], digest: str | None, pinned: Pinned | None) -> DataFrame:
    """file, catalog_version and a struct for each schema of the elements of a name: the records, or what stands between them."""
    if pinned is not None and pinned.root != what.root:
        raise ValueError(f"the catalog's root is {what.root}, not {pinned.root}")
    zipped = path.lower().endswith(".zip")
    if digest and not zipped:
        raise ValueError("a digest is for archives")
    pieces = _archive_pieces(spark, path, what.tag, what.root, digest) if zipped else _file_pieces(spark, path, what.tag, what.root)
    refused = F.col("record").contains("<!DOCTYPE") | F.col("record").contains("<!ENTITY") | F.col("record").contains("<![CDATA[")
    attributes = r"""[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*"""
    start = rf"<{element}(?=[\s>])(?!{attributes}/>)"
    if element == what.tag:  # records do not nest: the last start before an end tag is the one that it closes
        last = F.regexp_extract("record", rf"(?s).*({start}.*)", 1)
        texts = F.filter(F.array(F.concat(F.nullif(last, F.lit("")), F.lit(f"</{element}>"))), lambda x: x.isNotNull())
    else:
        texts = F.regexp_extract_all("record", F.lit(rf"(?s){start}.*?</{element}>"), F.lit(0))
    texts = F.when(refused, F.raise_error(F.lit("document type, entity and CDATA declarations are refused")).cast("array<string>")).otherwise(texts)
    whole = F.regexp_replace("e", "&(?:lt|#0*60|#[xX]0*3[cC]);", _LESS)
    found = pieces.select("file", F.explode(texts).alias("e")).select("file", *[F.from_xml(whole, s, {"mode": "FAILFAST"}).alias(f"r{i}") for i, s in enumerate(schemas)])
    return found.join(_checked_roots(pieces, pinned), "file")


# Sections -----------------------------------------------------------------------------------------------------------


def _entries(path: str) -> Column:
    return F.coalesce(F.col(path), F.array())


def _lines(path: str, line: Callable[[Column], Column]) -> Column:
    """A line for each entry of a list; entries for which `line` is null give none."""
    return F.array_join(F.array_compact(F.transform(F.col(path), line)), "\n")


def _some(text: Column, before: str = "", after: str = "") -> Column:
    """The text between its marks, or nothing where it is blank."""
    return F.when(text != "", F.concat(F.lit(before), text, F.lit(after))).otherwise("")


def _joined(values: Column, by: str) -> Column:
    return F.coalesce(F.array_join(F.transform(values, one_line), by), F.lit(""))


def _listed(path: str) -> Column:
    return _lines(path, lambda e: F.nullif(_some(one_line(e), "- "), F.lit("")))


def _marked(texts: str, marks: str, line: Callable[[Column, Column], Column]) -> Column:
    """Lines of mixed texts and of the attribute that stands at each."""
    both = F.zip_with(F.col(texts), F.col(marks), lambda t, m: F.when(one_line(t) != "", line(one_line(t), collapsed(m))))
    return F.array_join(F.array_compact(both), "\n")


def _term(e: Column) -> Column:
    return F.when(one_line(e["Term"]) != "", F.concat(F.lit("- "), one_line(e["Term"]), _some(one_line(e["Description"]), ": ")))


def _introduction(e: Column) -> Column:
    said = F.filter(F.array(_joined(e["Phase"], ", "), one_line(e["Note"])), lambda x: x != "")
    return F.when(F.size(said) > 0, F.concat(F.lit("- "), F.array_join(said, ": ")))


def _platforms() -> Column:
    def of(kind: str) -> Column:
        def line(e: Column) -> Column:
            name = F.coalesce(F.nullif(collapsed(e["_Name"]), F.lit("")), F.nullif(collapsed(e["_Class"]), F.lit("")))
            return F.concat(F.lit(f"- {kind.replace('_', ' ')}: "), name, _some(collapsed(e["_Prevalence"]), " (", ")"))

        return F.array_compact(F.transform(_entries(f"r0.Applicable_Platforms.{kind}"), line))

    return F.array_join(F.concat(*[of(k) for k in _PLATFORMS]), "\n")


def _consequence(e: Column) -> Column:
    said = F.array(_some(_joined(e["Scope"], ", "), "Scope: "), _some(_joined(e["Impact"], "; "), "Impact: "), _some(one_line(e["Note"]), "Note: "))
    said = F.filter(said, lambda x: x != "")
    return F.when(F.size(said) > 0, F.concat(F.lit("- "), F.array_join(said, " | ")))


def _effect(e: Column) -> tuple[Column, Column]:
    return _some(one_line(e["Effectiveness"]), " (effectiveness: ", ")"), _some(one_line(e["Effectiveness_Notes"]), " Effectiveness notes: ")


def _detection(e: Column) -> Column:
    method, text = one_line(e["Method"]), one_line(e["Description"])
    how, notes = _effect(e)
    return F.when((method != "") | (text != ""), F.concat(F.lit("- "), F.coalesce(F.nullif(method, F.lit("")), F.lit("Detection method")), how, _some(text, ": "), notes))


def _mitigation(e: Column) -> Column:
    tags = F.array_join(F.filter(F.array(_joined(e["Phase"], ", "), one_line(e["Strategy"])), lambda x: x != ""), "; ")
    text = flat_text(e["Description"])
    return F.when(text != "", F.concat(F.lit("- "), _some(tags, "[", "] "), collapsed(text), *_effect(e)))


def _step(e: Column) -> Column:
    head = F.concat(F.lit("- Step"), _some(one_line(e["Step"]), " "), _some(one_line(e["Phase"]), " [", "]"), _some(one_line(e["Description"]), ": "))
    below = F.transform(F.coalesce(e["Technique"], F.array()), lambda t: _some(one_line(t), "  - Technique: "))
    return F.array_join(F.filter(F.concat(F.array(head), below), lambda x: x != ""), "\n")


def _mapping(e: Column) -> Column:
    return F.concat(F.lit("- "), collapsed(e["_Taxonomy_Name"]), _some(one_line(e["Entry_ID"]), " "), _some(one_line(e["Entry_Name"]), ": "), _some(one_line(e["Mapping_Fit"]), " (fit: ", ")"))


def _weakness(nature: bool) -> Callable[[Column], Column]:
    def line(e: Column) -> Column:
        view = F.filter(F.array(_some(collapsed(e["_View_ID"]), "view "), _some(collapsed(e["_Ordinal"]), "ordinal ")), lambda x: x != "")
        named = F.concat(F.lit("CWE-"), collapsed(e["_CWE_ID"]))
        return F.concat(F.lit("- "), collapsed(e["_Nature"]), F.lit(" "), named, _some(F.array_join(view, ", "), " (", ")")) if nature else F.concat(F.lit("- "), named)

    return line


def _pattern(nature: bool) -> Callable[[Column], Column]:
    return lambda e: F.concat(F.lit("- "), F.concat(collapsed(e["_Nature"]), F.lit(" ")) if nature else F.lit(""), F.lit("CAPEC-"), collapsed(e["_CAPEC_ID"]))


def _sections(what: Catalog) -> list[tuple[str, Column]]:
    """Titles and texts in a document's order."""
    weak = what is WEAKNESSES
    own, notes = (lambda name: one_line(F.col(f"r0.{name}"))), _marked("r0.Notes.Note", "r1.Notes.Note._Type", lambda t, m: F.concat(F.lit("- "), _some(m, "", ": "), t))
    first = [("Description", flat_text(F.col("r0.Description"))), ("Extended Description", flat_text(F.col("r0.Extended_Description")))]
    terms = ("Alternate Terms", _lines("r0.Alternate_Terms.Alternate_Term", _term))
    last = [("Taxonomy Mappings", _lines("r0.Taxonomy_Mappings.Taxonomy_Mapping", _mapping)), ("Notes", notes)]
    if weak:
        return [
            *first,
            ("Background Details", F.array_join(F.transform(F.col("r0.Background_Details.Background_Detail"), flat_text), "\n\n")),
            terms,
            ("Modes of Introduction", _lines("r0.Modes_Of_Introduction.Introduction", _introduction)),
            ("Applicable Platforms", _platforms()),
            ("Likelihood of Exploit", own("Likelihood_Of_Exploit")),
            ("Common Consequences", _lines("r0.Common_Consequences.Consequence", _consequence)),
            ("Detection Methods", _lines("r0.Detection_Methods.Detection_Method", _detection)),
            ("Potential Mitigations", _lines("r0.Potential_Mitigations.Mitigation", _mitigation)),
            ("Relationships", _lines("r0.Related_Weaknesses.Related_Weakness", _weakness(True))),
            ("Related Attack Patterns", _lines("r0.Related_Attack_Patterns.Related_Attack_Pattern", _pattern(False))),
            *last,
        ]
    skills = _marked("r0.Skills_Required.Skill", "r1.Skills_Required.Skill._Level", lambda t, m: F.concat(F.lit("- "), _some(m, "(", ") "), t))
    return [
        *first,
        terms,
        ("Likelihood of Attack", own("Likelihood_Of_Attack")),
        ("Typical Severity", own("Typical_Severity")),
        ("Prerequisites", _listed("r0.Prerequisites.Prerequisite")),
        ("Skills Required", skills),
        ("Resources Required", _listed("r0.Resources_Required.Resource")),
        ("Indicators", _listed("r0.Indicators.Indicator")),
        ("Execution Flow", _lines("r0.Execution_Flow.Attack_Step", _step)),
        ("Consequences", _lines("r0.Consequences.Consequence", _consequence)),
        ("Mitigations", _listed("r0.Mitigations.Mitigation")),
        ("Related Attack Patterns", _lines("r0.Related_Attack_Patterns.Related_Attack_Pattern", _pattern(True))),
        ("Related Weaknesses", _lines("r0.Related_Weaknesses.Related_Weakness", _weakness(False))),
        *last,
    ]


def read_catalog(spark: SparkSession, path: str, what: Catalog = WEAKNESSES, digest: str | None = None, pinned: Pinned | None = None) -> DataFrame:
    """The records of catalogs (XML files, or archives by their .zip), each of which must be the pinned one where that is given.

    sections holds title and text in a document's order; cited the references with their sections, in order."""
    rows = _parsed(spark, path, what, what.tag, [what.schema, _MARKS], digest, pinned)
    header = [_some(collapsed(F.col(f"r0._{n}")), f"{n}: ") for n in ("Status", "Abstraction", *(["Structure"] if what is WEAKNESSES else []))]
    sections = F.array(*[F.struct(F.lit(t).alias("title"), F.coalesce(b, F.lit("")).alias("body")) for t, b in _sections(what)])
    nature = lambda e, other: F.coalesce(e["_Nature"], F.lit(other))
    related = F.concat(
        F.transform(_entries("r0.Related_Weaknesses.Related_Weakness"), lambda e: F.struct(nature(e, "RelatedWeakness").alias("nature"), F.concat(F.lit("CWE-"), F.trim(e["_CWE_ID"])).alias("target"))),
        F.transform(_entries("r0.Related_Attack_Patterns.Related_Attack_Pattern"), lambda e: F.struct(nature(e, "RelatedAttackPattern").alias("nature"), F.concat(F.lit("CAPEC-"), F.trim(e["_CAPEC_ID"])).alias("target"))),
    )
    entry = lambda e: F.coalesce(F.nullif(one_line(e["Entry_ID"]), F.lit("")), F.nullif(one_line(e["Entry_Name"]), F.lit("")))
    return rows.select(
        "file",
        "catalog_version",
        F.lit(what.kind).alias("kind"),
        F.concat(F.lit(what.prefix), "r0._ID").alias("label"),
        F.col("r0._ID").alias("id"),
        collapsed(F.col("r0._Name")).alias("name"),
        F.col("r0._Status").alias("status"),
        F.filter(F.array(*header), lambda x: x != "").alias("header"),
        F.filter(sections, lambda s: s["body"] != "").alias("sections"),
        F.array_compact(F.transform(_entries("r0.Content_History.Modification.Modification_Date"), lambda d: F.nullif(F.trim(d), F.lit("")))).alias("modified"),
        related.alias("related"),
        F.transform(_entries("r0.Taxonomy_Mappings.Taxonomy_Mapping"), lambda e: F.struct(collapsed(e["_Taxonomy_Name"]).alias("taxonomy"), entry(e).alias("entry"))).alias("taxonomy"),
        F.transform(_entries("r0.References.Reference"), lambda e: F.struct(e["_External_Reference_ID"].alias("reference_id"), collapsed(e["_Section"]).alias("section"))).alias("cited"),
    )


def read_references(spark: SparkSession, path: str, what: Catalog = WEAKNESSES, digest: str | None = None, pinned: Pinned | None = None) -> DataFrame:
    """The catalog's table of external references: file, reference_id, title, authors, url."""
    rows = _parsed(spark, path, what, "External_Reference", [_CITED], digest, pinned)
    authors = F.filter(F.transform(_entries("r0.Author"), one_line), lambda a: a != "")
    return rows.select("file", F.col("r0._Reference_ID").alias("reference_id"), F.nullif(one_line(F.col("r0.Title")), F.lit("")).alias("title"), authors.alias("authors"), F.nullif(flat_text(F.col("r0.URL")), F.lit("")).alias("url"))


# Joins --------------------------------------------------------------------------------------------------------------


def select_records(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (id, name) with its record and status: selected, missing, duplicate or renamed."""
    found = records.groupBy(F.col("id").alias("i")).agg(F.count("*").alias("n"), F.min("name").alias("now"))
    n = F.coalesce("n", F.lit(0))
    status = F.when(n == 0, "missing").when(n > 1, "duplicate").when(F.col("name") != F.col("now"), "renamed").otherwise("selected")
    return wanted.join(found, F.col("id") == F.col("i"), "left").select("id", "name", status.alias("status"))


def _cited(records: DataFrame, references: DataFrame) -> DataFrame:
    cited = records.select("file", "kind", "id", F.posexplode("cited").alias("k", "c")).select("file", "kind", "id", "k", "c.*")
    table = references.select("file", "reference_id", "title", "authors", "url", F.lit(True).alias("known"))
    return cited.join(table, ["file", "reference_id"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


def citations(records: DataFrame, references: DataFrame) -> DataFrame:
    """file, id, reference_id, title, url for each reference that a record cites, once; known is false where the table has none."""
    return _cited(records, references).select("file", "id", "reference_id", "title", "url", "known").distinct()


def relationship_edges(records: DataFrame) -> DataFrame:
    """Document graph: doc_id, nature, target; targets may lie outside the corpus."""
    return records.select(doc_id().alias("doc_id"), F.explode("related").alias("r")).select("doc_id", "r.nature", "r.target").distinct()


def taxonomy_entries(records: DataFrame) -> DataFrame:
    return records.select(doc_id().alias("doc_id"), F.explode("taxonomy").alias("t")).select("doc_id", "t.taxonomy", "t.entry")


def doc_id() -> Column:
    return F.concat(F.when(F.col("kind") == WEAKNESSES.kind, WEAKNESSES.source).otherwise(PATTERNS.source), F.lit(":"), "label")


def documents(records: DataFrame, references: DataFrame) -> DataFrame:
    """Records as documents: heading, header lines, each section that has text, and what is cited.

    Running it fails where a record cites what its catalog's table does not hold. reference_ids keeps each id's first place."""
    line = F.concat(
        F.lit("- "),
        F.col("reference_id"),
        F.lit(": "),
        F.coalesce("title", F.lit("(no title)")),
        _some(F.coalesce(F.array_join("authors", "; "), F.lit("")), " (", ")"),
        _some(F.col("section"), ", "),
    )
    line = F.when(F.col("known"), line).otherwise(F.raise_error(F.concat(F.col("id"), F.lit(" cites the unknown "), F.coalesce("reference_id", F.lit("null")))))
    entry = F.struct("k", line.alias("line"))
    lines = _cited(records, references).groupBy("file", "kind", "id").agg(F.array_sort(F.collect_list(entry)).alias("lines"))
    rows = records.join(lines, ["file", "kind", "id"], "left")
    said = F.transform("sections", lambda s: F.concat(F.lit("## "), s["title"], F.lit("\n"), s["body"]))
    cites = F.concat(F.lit("## References\n"), F.array_join("lines.line", "\n"))
    header = F.nullif(F.array_join("header", "\n"), F.lit(""))
    content = F.concat_ws("\n\n", F.concat(F.lit("# "), "label", F.lit(": "), "name"), header, F.nullif(F.array_join(said, "\n\n"), F.lit("")), cites)
    ids = F.array_distinct(F.transform("cited", lambda c: c["reference_id"]))
    return rows.select(doc_id().alias("doc_id"), F.col("kind").alias("doc_type"), F.col("name").alias("title"), content.alias("content"), F.array_max("modified").alias("source_modified"), F.col("catalog_version").alias("source_version"), ids.alias("reference_ids"))
