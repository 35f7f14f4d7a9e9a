"""Every registered query against its SQL in another engine, on the smallest tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from tracewright.plans import catalogs, files, graphs, more, streams, validators  # noqa: F401  (they register their queries)
from tracewright.plans.registry import ORACLE, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 5) + 0.0
        return v

    return sorted(([plain(r[i]) for i in order] for r in rows), key=lambda r: [(x is not None, str(x)) for x in r])


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}{'/*.parquet' if f.is_dir() else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLE:
        assert df.columns
        return
    cur = duck.execute(ORACLE[name])
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, got) == rows_of(names, want)
    assert want
