"""Query compilation, queries from findings, strict JSON documents."""

import json

import pytest
from pyspark.sql import functions as F

from tracewright.operators import querying
from tracewright.sources import documents


def compile_all(spark, *queries):
    rows = spark.createDataFrame([(i, *q) for i, q in enumerate(queries)], "i int, t string, p array<string>")
    return [r["compiled"] for r in querying.compiled(rows, "t", "p").orderBy("i").collect()]


def test_compile(spark):
    long = " ".join(f"word{i:04d}" for i in range(200))
    q, single, hidden, many, none, open_, spans, numbers = compile_all(
        spark,
        ('CWE_89 “union select” cross‑site scripting the 2024 "x"', ["SQL Injection"]),
        ("token", None),
        ("a\u200bb c\u00adde", None),
        (long, None),
        (None, None),
        ('say "x', None),
        (" ".join(f'"q{i}"' for i in range(18)) + ' "--"', None),
        ("CVE-2024-1234 12-34 ab-12 the", ["CVE 2024 1234"]),
    )
    assert q["terms"] == ["cwe 89", "sql injection", "union select", "x", "cross site", "union", "select", "cross", "site", "scripting"]
    assert q["notes"] == ["unicode_normalized", "dashes_folded"] and not q["low_information"]
    assert single["low_information"] and single["terms"] == ["token"]
    assert hidden["notes"] == ["invisible_removed"] and hidden["terms"] == ["cde"]
    assert len(many["terms"]) + len(many["dropped"]) == 200 and sum(len(t) + 6 for t in many["terms"]) - 4 <= 1000
    assert none["terms"] == [] and not none["low_information"]
    assert "unbalanced_quote" in open_["notes"] and "empty_quoted_span" in spans["notes"] and "quoted_spans_ignored" in spans["notes"]
    assert numbers["terms"] == ["cve 2024 1234", "ab 12", "ab"] and not numbers["low_information"]


def test_finding_queries(spark):
    s = "incident_id string, index int, status string, vulnerability_type string, root_cause string, affected_component string, rationale string, supporting_evidence_ids array<string>, evidence_needed_to_confirm array<string>"
    rows = [
        ("i", 0, "hypothesis_not_confirmed", "potential_sql_injection (CWE-89 hypothesis)", "Not confirmed from evidence.", "search  api", "see e-1 and e-10 now", ["e-1", "e-10"], ["db  logs"]),
        ("i", 1, "insufficient_evidence", "unknown", None, "n/a", None, [], []),
        ("i", 2, "confirmed", "x" * 5000, None, None, "why", ["gone"], []),
    ]
    line = spark.createDataFrame([("e-1", "GET /x"), ("e-10", "GET /y")], "event_id string, action string")
    claims = spark.createDataFrame([(["e-1"], "Event e-1 is odd.")], "evidence_ids array<string>, statement string")
    got = {r["index"]: r for r in querying.finding_queries(spark.createDataFrame(rows, s), line, claims).collect()}
    assert got[0]["text"] == "potential sql injection (CWE-89 hypothesis)\nsearch api\nEvent e-1 is odd.\nGET /y\nsee and now\ndb logs"
    assert got[0]["phrases"] == ["sql injection"] and [c["basis"] for c in got[0]["components"]][-1] == "evidence_gap"
    assert got[1]["skipped"] == "no_informative_subject" and got[1]["text"] is None
    assert len(got[2]["text"]) == 4000 and got[2]["omitted"] == ["vulnerability_type (truncated)", "rationale"]
    asked = spark.createDataFrame([("what is CWE-89",), ("sql",)], "question string")
    assert querying.leaked_identifiers(asked).count() == 1


def test_strict_documents(spark, tmp_path):
    doc = {"source": "s", "source_id": "A-1", "source_version": "1", "doc_type": "weakness", "title": "T", "content": "c"}
    put = lambda name, text: (tmp_path / name).write_text(text)
    put("a.json", json.dumps({"format": "f1", "documents": [doc, doc | {"source_id": "A-2", "title": " "}, 3]}))
    put("b.json", '{"format": "f1", "documents": [], "documents": []}')
    put("c.json", json.dumps({"format": "f2", "documents": []}))
    rows = documents.read_documents(spark, "file://" + str(tmp_path), "f1")
    issues = sorted(str(r["issue"]) for r in rows.collect())
    assert issues == sorted(["None", "missing:title", "not_an_object", "file:a key is repeated", "file:the format is not f1"])
    assert [r["doc_id"] for r in documents.accepted(rows).collect()] == ["s:A-1"]
    put("d.json", json.dumps({"format": "f1", "documents": [doc | {"content": "other"}]}))
    with pytest.raises(Exception, match="different records share"):
        documents.accepted(documents.read_documents(spark, "file://" + str(tmp_path), "f1")).collect()


ODD_FILES = {
    " ": "file:not one JSON value",
    "{": "file:not one JSON value",
    "[]": "file:the envelope needs a format and a list of documents, and nothing else",
    '{"format": "f1", "documents": []} {"a": 1}': "file:not one JSON value",
    '{"format": "f1", "documents": []}, {"a": 1}': "file:not one JSON value",
    '{"format": "f1", "documents": [], "more": 1}': "file:the envelope needs a format and a list of documents, and nothing else",
    '{"format": "f1", "documents": {}}': "file:the envelope needs a format and a list of documents, and nothing else",
    '{"format": 1, "documents": []}': "file:the format is not f1",
    '{"format": "f1", "documents": [], "description": 2}': "file:the description is not a text",
    '{"format": "f1", "documents": [{"source": "s", "x": {"b": 1, "b": 2}}]}': "file:a key is repeated",
    '{"format": "f1", "documents": [null]}': "not_an_object",
    '{"format": "f1", "documents": [{"source": 3}]}': "missing:source",
    '\ufeff{"format": "f1", "description": "d", "documents": []}': None,
}


def test_odd_document_files(spark, tmp_path):
    for i, text in enumerate(ODD_FILES):
        (tmp_path / f"{i:02}.json").write_text(text)
    got = {r["file"][-7:-5]: r["issue"] for r in documents.read_documents(spark, "file://" + str(tmp_path), "f1").collect()}
    assert got == {f"{i:02}": issue for i, issue in enumerate(ODD_FILES.values()) if issue}
    long = {"source": "s", "source_id": "1", "source_version": "1", "doc_type": "d", "title": "T", "content": "word " * 400_000, "z": {"b": 1, "a": [1.5, None]}}
    (tmp_path / "long").mkdir()
    (tmp_path / "long" / "a.json").write_text(json.dumps({"documents": [long, long], "format": "f1"}))
    one = documents.accepted(documents.read_documents(spark, "file://" + str(tmp_path / "long"), "f1")).collect()
    assert len(one) == 1 and one[0]["content"] == long["content"] and json.loads(one[0]["record"]) == long
