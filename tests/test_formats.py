"""Logs as a data source: ranges, line numbers, filters at the reader, streams."""

import gzip

import pytest
from pyspark.sql import functions as F

from tracewright.sources import formats, logs


def line(i, status=200):
    return f'10.0.0.{i % 7} - - [05/Mar/2026:10:00:01 +0200] "GET /p{i}?q=é HTTP/1.1" {status} {i} "-" "a" upstream=- upstream_status=- request_time=0.004'


TEXT = "\n".join([*(line(i, 500 if i % 10 == 0 else 200) for i in range(1, 301)), "", "noise", "c1 " + line(303), line(304) + "\r", "x" * 3000, line(306)])


@pytest.fixture
def folder(spark, tmp_path):
    formats.register(spark)
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_bytes(TEXT.encode())
    (tmp_path / "logs" / "b.log").write_bytes(b"")
    (tmp_path / "logs" / "_hidden.log").write_bytes(b"hidden\n")
    with gzip.open(tmp_path / "logs" / "c.log.gz", "wb") as f:
        f.write(TEXT.encode() + b"\n")
    return tmp_path / "logs"


def read(spark, path, size=700, kind="access"):
    return spark.read.format(formats.NAME).option("kind", kind).option("rangeBytes", size).load(f"file://{path}")


@pytest.mark.parametrize("size", [1, 97, 700, 1 << 20])
def test_ranges_cut_lines_once(spark, folder, size):
    data = TEXT.encode()
    parts = formats.ranges(str(folder / "a.log"), 0, len(data), size)
    got = [x for p in parts for x in formats.range_lines(p)]
    want, at = [], 0
    for x in data.split(b"\n"):
        want.append((at, x))
        at += len(x) + 1
    assert got == want


def test_numbers_and_events_equal_the_text_reader(spark, folder):
    path = f"file://{folder}/a.log"
    got = logs.access_events(formats.log_lines(spark, path, "access", 700)).orderBy("seq").collect()
    assert got == logs.access_events(logs.numbered_lines(spark, path)).orderBy("seq").collect() and len(got) == 303
    assert read(spark, folder / "a.log").rdd.getNumPartitions() > 40
    numbered = formats.log_lines(spark, f"file://{folder}", "access", 700)
    assert sorted(r[0] for r in numbered.where("status = '500' and file like '%.gz'").select("n").collect()) == list(range(10, 301, 10))


def test_filters_reach_the_reader(spark, folder):
    rows = formats.log_lines(spark, f"file://{folder}", "access", 700).where((F.col("status") == "500") & F.col("target").startswith("/p1") & F.col("address").isNotNull())
    plan = rows._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.split("\n") if "BatchScan" in x and "status" in x)
    assert "EqualTo(status,500)" in plan.replace(" ", "") or "status" in scan.split("PushedFilters")[-1]
    assert "(status" not in "".join(x for x in plan.split("\n") if x.strip(" :+-*()0123456789").startswith("Filter"))
    want = sum(1 for i in range(10, 301, 10) if f"/p{i}".startswith("/p1"))
    assert rows.count() == 2 * want
    all_rows = read(spark, folder)
    assert all_rows.where("status is null").count() == 2 * 3 and all_rows.count() == 2 * 306
    for c, n in ((F.col("bytes").isin("5", "6"), 4), (F.col("bytes") >= "98", 4), (F.col("target").contains("/p29") & F.col("target").endswith("é"), 22), (~(F.col("status") == "200"), 60)):
        assert all_rows.where(c).count() == n, c


def test_file_filters_spare_ranges(folder):
    reader = formats.LogReader(None, {"path": f"file://{folder}", "rangebytes": "700"})
    every = reader.partitions()
    assert list(reader.pushFilters([formats.ds.EqualTo(("file",), f"file://{folder}/a.log"), formats.ds.GreaterThan(("block",), 1400), formats.ds.StringContains(("value",), "x")])) == []
    few = reader.partitions()
    assert {r.file for r in few} == {f"file://{folder}/a.log"} and len(few) == sum(1 for r in every if r.file.endswith("a.log")) - 3


def test_empty_and_wrong(spark, tmp_path):
    formats.register(spark)
    (tmp_path / "none").mkdir()
    assert read(spark, tmp_path / "none").collect() == [] and formats.log_lines(spark, f"file://{tmp_path}/none", "auth").collect() == []
    with pytest.raises(Exception, match="kind must be"):
        read(spark, tmp_path / "none", kind="other").collect()
    (tmp_path / "bad.log").write_bytes(b"\xff\xfe bad\n")
    assert [r["value"] for r in read(spark, tmp_path / "bad.log").collect()] == ["�� bad"]


def test_stream_follows_files(spark, tmp_path):
    formats.register(spark)
    src, at = tmp_path / "grow", f"file://{tmp_path}/grow"
    src.mkdir()

    def step():
        rows = spark.readStream.format(formats.NAME).option("rangeBytes", 300).load(at)
        q = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r["file"].rsplit("/", 1)[1], r["position"], r["value"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = line(1) + "\n" + line(2) + "\n" + line(3)[:20]
    (src / "a.log").write_text(first)
    assert [v for _, _, v in step()] == [line(1), line(2)]
    (src / "a.log").write_text(first + line(3)[20:] + "\n")
    (src / "b.log").write_text(line(4) + "\n")
    got = step()
    assert sorted(v for _, _, v in got) == sorted(line(i) for i in (1, 2, 3, 4))
    assert got == sorted((r["file"].rsplit("/", 1)[1], r["position"], r["value"]) for r in read(spark, src).collect())
    (src / "a.log").write_text("short\n")
    with pytest.raises(Exception, match="shorter"):
        step()
