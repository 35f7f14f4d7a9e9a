"""Windows over event time: the batch forms."""

import datetime as dt

from tracewright.streaming import windows


def test_first_seen_is_the_earliest_row(spark):
    """Later rows stand first in the table, one has no time, and the other columns come from the earliest row."""
    at = lambda m: dt.datetime(2026, 1, 1, 0, m)
    rows = [("u", "a", at(9), 1), ("u", "a", at(5), 2), ("u", "a", None, 3), ("u", "b", at(7), 4), (None, "a", at(8), 5), (None, "a", at(6), 6), ("v", "a", None, 7)]
    df = spark.createDataFrame(rows, "user string, kind string, at timestamp, n int").coalesce(1)
    want = {("u", "a", at(5), 2), ("u", "b", at(7), 4), (None, "a", at(6), 6), ("v", "a", None, 7)}
    assert {tuple(r) for r in windows.first_seen(df, ["user", "kind"], "at").collect()} == want
    short = windows.first_seen(df.drop("n"), ["user", "kind"], "at")
    assert {tuple(r) for r in short.collect()} == {r[:3] for r in want}
