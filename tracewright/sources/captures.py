"""Binary packet captures of any size. A file is read and decoded in chunks by many tasks: each chunk guesses where its records
begin, pointer doubling over (record, first record behind the chunk) keeps what the file's first record leads to, and each chunk
is then decoded from its own first record."""

from __future__ import annotations

import ipaddress
import struct
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import attributes, event_columns, utc_text
from .scratch import written

PACKET = "file string, position long, micros long, protocol string, src string, dst string, sport int, dport int, size int"
#: Link types, EtherTypes and protocol numbers of the capture formats.
NULL_LINK, ETHERNET, COOKED, COOKED2 = 0, 1, 113, 276
PROTOCOLS = {1: "ICMP", 6: "TCP", 17: "UDP", 58: "ICMPv6"}
IPV4, IPV6, ARP, VLAN = 0x0800, 0x86DD, 0x0806, {0x8100, 0x88A8}
#: A section's head, the marks of classic files (byte order, parts of a microsecond), the types of blocks.
SECTION = b"\x0a\x0d\x0d\x0a"
MARKS = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}
BLOCKS = [0x0A0D0D0A, 1, 2, 3, 4, 5, 6, 9, 10, 0xBAD, 0x40000BAD]
#: Bytes decoded together; bytes behind a chunk that it holds too, for the heads of its last record; bytes of a piece.
CHUNK, LAP, PIECE = 1 << 20, 1 << 12, 1 << 18
#: The longest packet that a guess takes for likely.
SNAP = 1 << 18


def decode_ip(data: bytes) -> tuple[str, str | None, str | None, int | None, int | None]:
    """protocol, addresses and ports of an IP packet; what is cut off is null."""
    if not data:
        return "EMPTY", None, None, None, None
    if data[0] >> 4 == 4 and len(data) >= 20:
        head, number, a, b = (data[0] & 15) * 4, data[9], data[12:16], data[16:20]
    elif data[0] >> 4 == 6 and len(data) >= 40:
        head, number, a, b = 40, data[6], data[8:24], data[24:40]
    else:
        return "UNKNOWN", None, None, None, None
    name = PROTOCOLS.get(number, f"IP_{number}")
    ports = struct.unpack(">HH", data[head : head + 4]) if number in (6, 17) and len(data) >= head + 4 else (None, None)
    return name, str(ipaddress.ip_address(a)), str(ipaddress.ip_address(b)), *ports


def decode_link(link: int, data: bytes, order: str) -> tuple[str, str | None, str | None, int | None, int | None]:
    if link == NULL_LINK:
        return decode_ip(data[4:])
    at, kind = {ETHERNET: (14, 12), COOKED: (16, 14), COOKED2: (20, 0)}.get(link, (None, None))
    if at is None or len(data) < at:
        return "UNKNOWN", None, None, None, None
    ether = struct.unpack(">H", data[kind : kind + 2])[0]
    while ether in VLAN and len(data) >= at + 4:
        ether, at = struct.unpack(">H", data[at + 2 : at + 4])[0], at + 4
    if ether == ARP and len(data) >= at + 28:
        return "ARP", str(ipaddress.ip_address(data[at + 14 : at + 18])), str(ipaddress.ip_address(data[at + 24 : at + 28])), None, None
    return decode_ip(data[at:]) if ether in (IPV4, IPV6) else ("UNKNOWN", None, None, None, None)


def _runs(b: pa.RecordBatch) -> list[int]:
    """Where the rows of each split begin, and the end of the last."""
    file, block = b.column("file"), b.column("block").to_numpy()
    new = pa.compute.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False) | (block[1:] != block[:-1]) if b.num_rows else np.zeros(0, bool)
    return [0, *(np.flatnonzero(new) + 1).tolist(), b.num_rows] if b.num_rows else []


def _joined(lines: pa.Array) -> bytes:
    """Lines with their line feeds again, without a Python object for each."""
    return pa.compute.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), b"\n")[0].as_py() + b"\n"


def file_pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, size, at (offset), data: the bytes of all files under path, in pieces, read by as many tasks as they have splits.

    Spark's line reader cuts a file of any size at line feeds and keeps all other bytes as they are; the lines of a split put
    together again are its bytes, and the pieces' lengths, summed in order, give their offsets."""
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size")]
    lines = spark.read.option("lineSep", "\n").text(path).select(*where, F.col("value").cast("binary").alias("data"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, own, held = 0, None, bytearray()

        def cut(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal n
            while len(held) >= least:
                part = bytes(held[:PIECE])
                del held[:PIECE]
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*own, n, len(part))] + [pa.array([part], pa.binary())], ["file", "size", "block", "n", "long", "data"])
                n += 1

        for b in batches:
            for start, end in pairwise(_runs(b)):
                where = tuple(b.column(c)[start].as_py() for c in ("file", "size", "block"))
                if where != own:
                    yield from cut(1)
                    own = where
                held += _joined(b.column("data").slice(start, end - start))
                yield from cut(PIECE)
        yield from cut(1)

    pieces = written(lines.mapInArrow(join, "file string, size long, block long, n long, long long, data binary"), "pieces")
    before = F.sum("long").over(Window.partitionBy("file").orderBy("block", "n").rowsBetween(Window.unboundedPreceding, -1))
    places = pieces.select("file", "block", "n", F.coalesce(before, F.lit(0)).alias("at"))
    # a file that does not end with a line feed gets none
    return pieces.join(places, ["file", "block", "n"]).select("file", "size", "at", F.expr("substring(data, 1, int(least(long, size - at)))").alias("data")).where("length(data) > 0")


def file_chunks(pieces: DataFrame, chunk: int) -> DataFrame:
    """file, size, k, data: bytes k * chunk to (k + 1) * chunk of each file, and LAP more for what begins in them."""
    last = F.col("at") + F.length("data") - 1
    spread = pieces.select("*", F.explode(F.sequence(F.greatest(F.floor((F.col("at") - LAP) / chunk), F.lit(0)), F.floor(last / chunk))).alias("k"))
    start, end = F.greatest(F.col("at"), F.col("k") * chunk), F.least(last + 1, (F.col("k") + 1) * chunk + LAP)
    parts = spread.withColumn("start", start).withColumn("end", end).where("start < end").select("file", "size", "k", "start", F.expr("substring(data, int(start - at + 1), int(end - start))").alias("data"))

    def whole(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("start").to_numpy())
        data = b"".join(t.column("data")[int(i)].as_py() for i in order)
        return pa.table([t.column(c).slice(0, 1) for c in ("file", "size", "k")] + [pa.array([data], pa.binary())], ["file", "size", "k", "data"])

    return written(parts.groupBy("file", "k").applyInArrow(whole, "file string, size long, k long, data binary"), "chunks")


@dataclass(frozen=True)
class Kind:
    """What a file's head tells: its format, byte order (of the first section), parts of a microsecond and link type."""

    blocks: bool
    order: str
    part: int
    link: int

    @classmethod
    def of(cls, head: bytes) -> Kind:
        if head[:4] == SECTION:
            return cls(True, byte_order(head, 0), 1, -1)
        if head[:4] not in MARKS or len(head) < 24:
            raise ValueError("no capture file")
        order, part = MARKS[head[:4]]
        return cls(False, order, part, struct.unpack(order + "I", head[20:24])[0])

    @property
    def first(self) -> int:
        return 0 if self.blocks else 24


def byte_order(data: bytes, at: int) -> str:
    magic = data[at + 8 : at + 12]
    if magic not in (b"\x4d\x3c\x2b\x1a", b"\x1a\x2b\x3c\x4d"):
        raise ValueError(f"no byte-order mark at {at}")
    return "<" if magic[0] == 0x4D else ">"


def steps(kind: Kind, data: bytes, base: int, chunk: int, size: int, at: int, order: str) -> Iterator[tuple[int, int, str]]:
    """Records from the one at offset `at` (of the file) that begin in the chunk at `base`: place in data, next offset, byte
    order. A record that the file cuts off is an error."""
    while at < min(base + chunk, size):
        here = at - base
        if at + (12 if kind.blocks else 16) > size:
            raise ValueError(f"record at {at} is cut off")
        if kind.blocks:
            if data[here : here + 4] == SECTION:
                order = byte_order(data, here)
            step = struct.unpack(order + "I", data[here + 4 : here + 8])[0]
            if step < 12:
                raise ValueError(f"block at {at} is cut off")
        else:
            step = 16 + struct.unpack(order + "I", data[here + 8 : here + 12])[0]
        if at + step > size:
            raise ValueError(f"record at {at} is cut off")
        yield here, at + step, order
        at += step


def guesses(kind: Kind, data: bytes, base: int, chunk: int, size: int, order: str) -> list[tuple[int, int]]:
    """(start, offset behind the chunk) of the chains of likely records that run through the chunk, each from its first record.

    Every offset that looks like a record gets the next one that its length names; their jumps are doubled until all leave the
    chunk or meet one that does not, and a chain counts if all of its records look like records. Mostly one is left. A true chain that looks unlikely is found later."""
    span = min(chunk, size - base)
    raw = np.zeros(span + 16, np.uint8)
    held = np.frombuffer(data[: span + 16], np.uint8)
    raw[: len(held)] = held

    def number(i: int) -> np.ndarray:
        out = np.empty(span, np.int64)
        for k in range(min(4, span)):
            own = out[k::4]
            own[:] = raw[i + k : i + k + 4 * len(own)].view(order + "u4")
        return out

    at = np.arange(span)
    if kind.blocks:
        step = number(4)
        fits = (at + base) % 4 == 0
        fits &= (step >= 12) & (step % 4 == 0) & np.isin(number(0), BLOCKS)
    else:
        kept, fraction = number(8), number(4)
        step = 16 + kept
        fits = (kept > 0) & (kept <= SNAP) & (fraction < 1_000_000 * kind.part)
    fits &= base + at + step <= size
    at = np.flatnonzero(fits)
    after, n = at + step[at], len(at)
    row = np.full(span + 1, n + 1)  # of a likely record; n behind the chunk, n + 1 where none is likely
    row[at], row[span] = np.arange(n), n
    next_ = row[np.minimum(after, span)]
    jump, end = np.append(next_, [n, n + 1]), np.append(after, [0, 0])
    while (on := jump < n)[:n].any():
        end = np.where(on, end[jump], end)
        jump = jump[jump]
    sure = jump[:n] == n
    follows = np.zeros(n + 2, bool)
    follows[next_[sure]] = True
    return [(base + int(at[i]), base + int(end[i])) for i in np.flatnonzero(sure & ~follows[:n])]


def record_starts(chunks: DataFrame, kinds: DataFrame, chunk: int) -> DataFrame:
    """file, k, node: the first record of each chunk that has one, on the chain that begins at the file's first record.

    A node is twice a record's offset, and one more for the other byte order. Each chunk gives guessed links (node, next: the
    first record behind it). Pointer doubling then takes from all links those that the first record leads to: the reached
    nodes and the jumps both double with each round. Where the chain meets a node that no chunk guessed, that chunk is read from
    there, and the search goes on."""

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                row = {c: b.column(c)[r].as_py() for c in b.schema.names}
                kind = Kind.of(row["head"])
                found = [(2 * a + (o == ">"), 2 * e + (o == ">")) for o in ("<>" if kind.blocks else kind.order) for a, e in guesses(kind, row["data"], row["k"] * chunk, chunk, row["size"], o)]
                yield pa.RecordBatch.from_arrays([pa.array([row["file"]] * len(found), pa.string()), pa.array([a for a, _ in found], pa.int64()), pa.array([e for _, e in found], pa.int64())], ["file", "node", "next"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                row = {c: b.column(c)[r].as_py() for c in b.schema.names}
                end, order = row["node"] // 2, "<>"[row["node"] % 2]
                for _, end, order in steps(Kind.of(row["head"]), row["data"], row["k"] * chunk, chunk, row["size"], end, order):
                    pass
                yield pa.RecordBatch.from_arrays([pa.array([row["file"]]), pa.array([row["node"]]), pa.array([2 * end + (order == ">")])], ["file", "node", "next"])

    read = chunks.join(kinds, "file")
    links = written(read.mapInArrow(guess, "file string, node long, next long"), "links")
    first = kinds.select("file", "first").withColumnRenamed("first", "node")
    sizes = kinds.select("file", "size")
    while True:
        reached, jumps = written(first, "reached"), links
        while True:
            ahead = jumps.select("file", F.col("node").alias("_n"), "next")
            more = reached.join(ahead, (reached["file"] == ahead["file"]) & (reached["node"] == ahead["_n"])).select(reached["file"], F.col("next").alias("node"))
            grown = written(reached.union(more).distinct(), "reached")
            if grown.count() == reached.count():
                break
            twice = jumps.select("file", "node", F.col("next").alias("_m"))
            jumps = written(twice.join(ahead, (twice["file"] == ahead["file"]) & (twice["_m"] == ahead["_n"])).select(twice["file"], "node", "next"), "jumps")
            reached = grown
        starts = reached.join(sizes, "file").where(F.floor(F.col("node") / 2) < F.col("size")).select("file", F.floor(F.col("node") / (2 * chunk)).alias("k"), "node")
        open_ = starts.join(links.select("file", "node"), ["file", "node"], "left_anti")
        if open_.limit(1).count() == 0:
            return written(starts, "starts")
        links = written(links.unionByName(read.join(open_, ["file", "k"]).mapInArrow(follow, "file string, node long, next long")), "links")


def packets(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """One row for each packet of all captures under path. A file is decoded by as many tasks as it has chunks."""
    chunks = file_chunks(file_pieces(spark, path), chunk)
    heads = chunks.where("k = 0").select("file", "size", F.expr("substring(data, 1, 32)").alias("head"))

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [Kind.of(h) for h in f["head"]]
            yield f.assign(first=[2 * k.first + (k.order == ">") for k in found])

    kinds = written(heads.mapInPandas(look, "file string, size long, head binary, first long"), "kinds")
    starts = record_starts(chunks.drop("size"), kinds, chunk)
    mine = chunks.drop("size").join(kinds.drop("first"), "file").join(starts, ["file", "k"])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                row = {c: b.column(c)[r].as_py() for c in b.schema.names}
                kind, base, data, found = Kind.of(row["head"]), row["k"] * chunk, row["data"], []
                for here, _, order in steps(kind, data, base, chunk, row["size"], row["node"] // 2, "<>"[row["node"] % 2]) if kind.blocks else ():
                    name = struct.unpack(order + "I", data[here : here + 4])[0]
                    if data[here : here + 4] == SECTION or name == 1:
                        found.append((base + here, -1 if name != 1 else struct.unpack(order + "H", data[here + 8 : here + 10])[0]))
                yield pa.RecordBatch.from_arrays([pa.array([row["file"]] * len(found), pa.string()), pa.array([a for a, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int32())], ["file", "at", "link"])

    # a file's sections and interfaces are few; they go with each of its chunks
    faces = mine.mapInArrow(describe, "file string, at long, link int").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("at", "link"))).alias("faces"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds_ = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
        for b in batches:
            for r in range(b.num_rows):
                rows = list(_packets({c: b.column(c)[r].as_py() for c in b.schema.names}, chunk))
                columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds_]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds_, strict=True)], [c.split()[0] for c in PACKET.split(", ")])

    return mine.join(written(faces, "faces"), "file", "left").mapInArrow(decode, PACKET)


def _packets(row: dict, chunk: int) -> Iterator[tuple]:
    """The packets of one chunk from its first record on."""
    kind, base, data = Kind.of(row["head"]), row["k"] * chunk, row["data"]
    known = [(f["at"], f["link"]) for f in row["faces"] or []]
    for here, after, order in steps(kind, data, base, chunk, row["size"], row["node"] // 2, "<>"[row["node"] % 2]):
        at = base + here
        if not kind.blocks:
            seconds, fraction, kept = struct.unpack(order + "III", data[here : here + 12])
            yield row["file"], at, seconds * 1_000_000 + fraction // kind.part, *decode_link(kind.link, data[here + 16 : here + 16 + kept], order), kept
        elif struct.unpack(order + "I", data[here : here + 4])[0] == 6:
            face, high, low, kept = struct.unpack(order + "IIII", data[here + 8 : here + 24])
            before = bisect_left(known, (at, -2))
            section = max((i for i in range(before) if known[i][1] < 0), default=-1)
            if section + 1 + face >= before:
                raise ValueError(f"packet at {at} names an interface that is not described")
            if at + 28 + kept > after:
                raise ValueError(f"packet at {at} is cut off")
            yield row["file"], at, high << 32 | low, *decode_link(known[section + 1 + face][1], data[here + 28 : here + 28 + kept], order), kept


def packet_events(found: DataFrame) -> DataFrame:
    """Packets as events; a packet's offset in its file names it."""
    ts = F.timestamp_micros("micros")
    known = attributes(protocol=F.col("protocol"), source_port=F.col("sport"), destination_port=F.col("dport"), packet_length=F.col("size"), offset=F.col("position"))
    return found.select(*event_columns(event_id=F.concat(F.lit("pcapng-packet-"), "position"), seq=F.col("position"), ts_text=utc_text(ts, fraction=True), ts=ts, source=F.lit("packet_capture"), event_type=F.lit("network_packet"), source_entity=F.col("src"), destination_entity=F.col("dst"), action=F.lower("protocol"), attributes=known))


def traffic_flows(found: DataFrame) -> DataFrame:
    """Flows by addresses, ports and protocol: packets, first and last time, duration in seconds."""
    flow = found.groupBy("src", "dst", "protocol", "sport", "dport").agg(F.count("*").alias("packets"), F.min("micros").alias("first_micros"), F.max("micros").alias("last_micros"))
    return flow.withColumn("seconds", (F.col("last_micros") - F.col("first_micros")) / 1e6)


def traffic_counts(found: DataFrame, containers: DataFrame | None = None) -> DataFrame:
    """kind (protocol, source, destination), name, packets, container of the address where containers (address, container) has one."""
    sets = found.groupingSets([["protocol"], ["src"], ["dst"]], "protocol", "src", "dst").agg(F.count("*").alias("packets"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "protocol").when(F.col("g") == 5, "source").otherwise("destination")
    out = sets.select(kind.alias("kind"), F.coalesce("protocol", "src", "dst").alias("name"), "packets")
    if containers is None:
        return out.withColumn("container", F.lit(None).cast("string"))
    return out.join(containers.select(F.col("address").alias("name"), "container"), "name", "left").select("kind", "name", "packets", F.when(F.col("kind") != "protocol", F.col("container")).alias("container"))
