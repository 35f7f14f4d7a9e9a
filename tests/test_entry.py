"""The driver's contract, with and without the optional parts."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

HERE = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "doc_id", "rank", "score"] and df.count() > 0


def test_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 40


def test_import_without_optional_parts(tmp_path):
    import shutil

    shutil.copy(HERE / "__spark_entry__.py", tmp_path)
    shutil.copytree(HERE / "tracewright", tmp_path / "tracewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), sum(q.startswith('op') for q in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    n, ops = map(int, said.stdout.split())
    assert n >= 40 and ops == 0
