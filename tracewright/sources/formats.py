"""Log files as Spark data sources, in batches and as streams: `spark.read.format("evidence_log")` and
`spark.readStream.format("evidence_log")`.

A file is planned as byte ranges; a line belongs to the range that holds its first byte, and ends at a line feed (a carriage
return before it is dropped). Filters on what a line says are applied where the line is read, filters on `file` and `block`
spare whole ranges. Files whose name ends in .gz are one range each. Empty folders give no rows, bytes that are no UTF-8
become U+FFFD, and a line that does not fit the kind's pattern has null fields.

Paths are opened by pyarrow's file systems (local, s3, gs, abfs, hdfs)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import logs
from .scratch import written

NAME = "evidence_log"
#: Bytes of a range, and of the text that becomes one Arrow batch.
RANGE, BATCH = 64 << 20, 4 << 20
PLACE = "file string, block long, k long, position long, value string"
#: What the groups of each kind's pattern are called.
FIELDS = {
    "access": (logs.ACCESS, "address time method target version status bytes referer agent upstream upstream_status seconds".split()),
    "application": (logs.APPLICATION, "time address port method target version status said".split()),
    "auth": (logs.AUTH, "time container message".split()),
}


@dataclass
class ByteRange(ds.InputPartition):
    """Bytes start to end of a file; no end: all of them, unpacked."""

    file: str
    start: int
    end: int | None


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if local := re.match(r"file:(//)?(?=/)", path):
        return fs.LocalFileSystem(), path[local.end() :]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int]]:
    """Files under path with their sizes, in order; names that begin with . or _ are not read."""
    system, at = opened(path.rstrip("/"))
    head = path.rstrip("/").removesuffix(at)
    found = system.get_file_info(at)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    inside = [found] if found.is_file else system.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted((head + f.path, f.size) for f in inside if f.is_file and not re.search(r"/[._]", f.path[len(at) :]))


def ranges(file: str, start: int, end: int, size: int) -> list[ByteRange]:
    if file.endswith(".gz"):
        return [ByteRange(file, 0, None)]
    return [ByteRange(file, at, min(at + size, end)) for at in range(start, end, size)]


def range_lines(part: ByteRange) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of the lines that begin in the range."""
    system, path = opened(part.file)
    if part.end is None:
        at = 0
        with system.open_input_stream(path, compression="gzip") as f:
            for line in _cut(f.read):
                yield at, line.removesuffix(b"\n")
                at += len(line)
        return
    with system.open_input_file(path) as f:
        at = max(part.start - 1, 0)
        f.seek(at)
        lines = _cut(f.read)
        if part.start:
            at += len(next(lines, b""))  # ends the line that an earlier range holds
        for line in lines if at < part.end else ():
            yield at, line.removesuffix(b"\n")
            at += len(line)
            if at >= part.end:
                return


def _cut(read: Callable[[int], bytes]) -> Iterator[bytes]:
    """Lines with their line feeds from a reader of blocks."""
    parts: list[bytes] = []
    while block := read(1 << 20):
        first, *more = block.split(b"\n")
        parts.append(first)
        for line in more:
            yield b"".join(parts) + b"\n"
            parts = [line]
    if rest := b"".join(parts):
        yield rest


def condition(column: pa.Array, f: ds.Filter) -> pa.Array | None:
    """The rows that a filter keeps; None where it is none of the kinds that are known here."""
    if isinstance(f, ds.IsNotNull):
        return pc.is_valid(column)
    if isinstance(f, ds.In):
        return pc.is_in(column, pa.array([v for v in f.value if v is not None], column.type))
    if isinstance(f, ds.StringStartsWith):
        return pc.starts_with(column, f.value)
    if isinstance(f, ds.StringEndsWith):
        return pc.ends_with(column, f.value)
    if isinstance(f, ds.StringContains):
        return pc.match_substring(column, f.value)
    kinds = {ds.EqualTo: pc.equal, ds.GreaterThan: pc.greater, ds.GreaterThanOrEqual: pc.greater_equal, ds.LessThan: pc.less, ds.LessThanOrEqual: pc.less_equal}
    if type(f) in kinds and f.value is not None:
        return kinds[type(f)](column, pa.scalar(f.value, column.type))
    return None


def keeps(table: pa.RecordBatch, filters: Iterable[ds.Filter]) -> pa.RecordBatch:
    for f in filters:
        table = table.filter(pc.fill_null(condition(table.column(f.attribute[0]), f), False))
    return table


class _Lines:
    """What batches and streams share: ranges into Arrow batches."""

    def __init__(self, schema: StructType, options: dict):
        self.path, self.kind, self.size = options.get("path"), options.get("kind", "access"), int(options.get("rangebytes", RANGE))
        if not self.path or self.size < 1:
            raise ValueError(f"{NAME} needs a path and ranges of one byte or more")
        self.filters: list[ds.Filter] = []

    def read(self, part: ByteRange | None) -> Iterator[pa.RecordBatch]:
        if part is None or not hasattr(part, "file"):  # Spark's stand-in where nothing was planned
            return
        if self.kind == "count":
            yield pa.RecordBatch.from_arrays([pa.array([part.file]), pa.array([part.start]), pa.array([sum(1 for _ in range_lines(part))])], ["file", "block", "lines"])
            return
        held: list[tuple[int, str]] = []
        size = k = 0
        for at, line in range_lines(part):
            held.append((at, line.removesuffix(b"\r").decode(errors="replace")))
            size += len(line)
            if size >= BATCH:
                yield self._batch(part, k, held)
                k, size, held = k + len(held), 0, []
        if held:
            yield self._batch(part, k, held)

    def _batch(self, part: ByteRange, k: int, held: list[tuple[int, str]]) -> pa.RecordBatch:
        pattern, names = FIELDS[self.kind]
        fits = re.compile(pattern, re.ASCII).match
        found = []
        for _, line in held:
            m = fits(line)
            if not m and self.kind == "access" and " " in line:  # a container's prefix
                m = fits(line.split(" ", 1)[1])
            found.append(m.groups() if m else (None,) * len(names))
        n = len(held)
        columns = [pa.array([part.file] * n), pa.array([part.start] * n), pa.array(range(k, k + n), pa.int64()), pa.array([a for a, _ in held], pa.int64()), pa.array([v for _, v in held], pa.string())]
        columns += [pa.array([g[i] for g in found], pa.string()) for i in range(len(names))]
        return keeps(pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PLACE.split(", ")] + names), self.filters)


class LogReader(_Lines, ds.DataSourceReader):
    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        """Filters of known kinds stay here; the others go back to Spark."""
        sample = {c.split()[0]: pa.array([], pa.int64() if c.endswith("long") else pa.string()) for c in PLACE.split(", ")}
        sample |= {c: pa.array([], pa.string()) for c in FIELDS.get(self.kind, ("", []))[1]}
        for f in filters:
            name = getattr(f, "attribute", ())
            if self.kind == "count" or len(name) != 1 or condition(sample[name[0]], f) is None:
                yield f
            else:
                self.filters.append(f)

    def partitions(self) -> list[ByteRange]:
        found = [r for file, size in listed(self.path) for r in ranges(file, 0, size, self.size)]
        places = [f for f in self.filters if f.attribute[0] in ("file", "block")]
        if not found or not places:
            return found
        at = pa.RecordBatch.from_arrays([pa.array([r.file for r in found]), pa.array([r.start for r in found]), pa.array(range(len(found)))], ["file", "block", "i"])
        return [found[i] for i in keeps(at, places).column("i").to_pylist()]


class LogStream(_Lines, ds.DataSourceStreamReader):
    """Follows files that grow and files that come. An offset names each file with the bytes read of it, which end at a line
    feed, so a line that is still being written waits. A file that becomes shorter, or goes away before it is read, is an error.
    A packed file counts as whole once it is there."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {file: 1 if file.endswith(".gz") else whole_lines(file, size) for file, size in listed(self.path)}

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        for file, n in end.items():
            if n < start.get(file, 0):
                raise ValueError(f"{file} has become shorter")
        return [r for file, n in end.items() if n > start.get(file, 0) for r in ranges(file, start.get(file, 0), n, self.size)]


def whole_lines(file: str, size: int) -> int:
    """Bytes up to the last line feed, looked for from the end."""
    system, path = opened(file)
    with system.open_input_file(path) as f:
        while size > 0:
            at = max(size - (1 << 16), 0)
            f.seek(at)
            here = f.read(size - at).rfind(b"\n")
            if here >= 0:
                return at + here + 1
            size = at
    return 0


class LogSource(ds.DataSource):
    """Options: path; kind (access, application, auth; count: lines of each range); rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        kind = self.options.get("kind", "access")
        if kind == "count":
            return "file string, block long, lines long"
        if kind not in FIELDS:
            raise ValueError(f"kind must be one of {', '.join(FIELDS)}, count")
        return PLACE + "".join(f", {name} string" for name in FIELDS[kind][1])

    def reader(self, schema: StructType) -> LogReader:
        return LogReader(schema, self.options)

    def streamReader(self, schema: StructType) -> LogStream:
        return LogStream(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters given to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LogSource)


def log_lines(spark: SparkSession, path: str, kind: str, range_bytes: int = RANGE) -> DataFrame:
    """The rows of `evidence_log` with n, the 1-based number of a line in its file, whatever filters follow.

    The lines of each range are counted by a pass of its own, and a running sum over a file's ranges gives each range's first
    number. The counts are a written table, one row for each range, so Spark knows its size when it picks the join."""
    register(spark)
    read = lambda what: spark.read.format(NAME).option("kind", what).option("rangeBytes", range_bytes).load(path)
    before = F.sum("lines").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    counts = written(read("count").select("file", "block", F.coalesce(before, F.lit(0)).alias("_before")), "line-counts")
    return read(kind).join(counts, ["file", "block"]).withColumn("n", F.col("_before") + F.col("k") + 1).drop("_before")
