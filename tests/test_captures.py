"""Captures decoded in chunks, against one pass over the file: both formats, both byte orders, odd places and cut files."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from tracewright.sources import captures


def frame(rng, n):
    """An Ethernet frame with an IPv4 packet of UDP or TCP and n bytes of anything, line feeds and look-alikes too."""
    head = bytes(12) + b"\x08\x00" + bytes([0x45, 0, 0, 40, 0, 0, 0, 0, 64, rng.choice([6, 17]), 0, 0]) + bytes([10, 0, 0, rng.randrange(256), 10, 0, 1, rng.randrange(256)])
    return head + struct.pack(">HH", rng.randrange(65536), 80) + bytes(rng.choice([10, 0, 1, 255, rng.randrange(256)]) for _ in range(n))


def classic(order, n, seed, nano=False):
    rng = random.Random(seed)
    data = struct.pack(order + "IHHiIII", 0xA1B23C4D if nano else 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    want = []
    for i in range(n):
        body = frame(rng, rng.choice([0, 5, 60, 400, 3000]))
        if i % 7 == 3:  # a packet within a packet
            body += struct.pack(order + "IIII", i, 5, 40, 40) + bytes(40)
        want.append((len(data), i * 1_000_000 + 5, body))
        data += struct.pack(order + "IIII", i, 5000 if nano else 5, len(body), len(body)) + body
    return data, want


def sections(orders, n, seed):
    rng = random.Random(seed)
    data, want = b"", []
    for order in orders:
        block = lambda kind, body: struct.pack(order + "II", kind, len(body) + 12) + body + struct.pack(order + "I", len(body) + 12)  # noqa: B023, E731
        data += b"\x0a\x0d\x0d\x0a" + struct.pack(order + "IIHHqI", 28, 0x1A2B3C4D, 1, 0, -1, 28) + block(1, struct.pack(order + "HHI", 1, 0, 0))
        for i in range(n):
            if i == n // 2:
                data += block(1, struct.pack(order + "HHI", 0, 0, 0))
            if i % 9 == 4:
                data += block(rng.choice([5, 0x0BAD]), bytes(4 * rng.randrange(200)))
            body, face = frame(rng, rng.choice([0, 7, 90, 1500])), int(i >= n // 2 and i % 2)
            own = struct.pack("<I", 2) + body[14:] if face else body
            want.append((len(data), i, own))
            data += block(6, struct.pack(order + "IIIII", face, 0, i, len(own), len(own)) + own + bytes(-len(own) % 4))
    return data, want


def key(want):
    out = []
    for at, micros, body in want:
        ip = body[4:] if body[:4] == struct.pack("<I", 2) else body[14:]
        sport, dport = struct.unpack(">HH", ip[20:24])
        out.append((at, micros, {6: "TCP", 17: "UDP"}[ip[9]], ".".join(map(str, ip[12:16])), ".".join(map(str, ip[16:20])), sport, dport, len(body)))
    return sorted(out)


FILES = {
    "classic": classic(">", 120, 1), "nano": classic("<", 90, 2, True), "blocks": sections("<", 150, 3), "mixed": sections("<><", 60, 4),
    "long": ((d := classic("<", 3, 5))[0] + struct.pack("<IIII", 9, 9, 40_000, 40_000) + (tail := frame(random.Random(1), 0)) + bytes(40_000 - len(tail)), [*d[1], (len(d[0]), 9_000_009, tail + bytes(40_000 - len(tail)))]),
    "empty": (classic("<", 0, 1)[0], []),
}


@pytest.mark.parametrize("chunk", [1000, 1 << 20])
def test_equals_one_pass(spark, tmp_path, chunk):
    for name, (data, _) in FILES.items():
        (tmp_path / name).write_bytes(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 5000)
    try:
        got = captures.packets(spark, f"file://{tmp_path}", chunk).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, (_, want) in FILES.items():
        own = sorted(tuple(r)[1:] for r in got if r["file"].endswith("/" + name))
        assert own == key(want), name


def test_bytes_come_back(spark, tmp_path):
    """Any bytes, cut at line feeds and put together again, at the end of a file too."""
    rng = random.Random(7)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 700)
    try:
        for k, end in enumerate([b"\n", b"\n\n", b"\r", b"x", b"\r\n"]):
            data = bytes(rng.choice([10, 13, 0, 200, 255, rng.randrange(256)]) for _ in range(3000)) + end
            (tmp_path / f"f{k}").write_bytes(data)
            parts = captures.file_pieces(spark, f"file://{tmp_path}/f{k}").orderBy("at").collect()
            assert b"".join(bytes(p["data"]) for p in parts) == data
            assert [p["at"] for p in parts] == [sum(len(q["data"]) for q in parts[:i]) for i in range(len(parts))]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_short_lines_make_no_short_pieces(spark, tmp_path):
    """A file of line feeds alone has as many pieces as its bytes need, however many lines it has."""
    (tmp_path / "x").write_bytes(b"\n" * 300_000 + b"ab\n\nc")
    parts = captures.file_pieces(spark, f"file://{tmp_path}/x").orderBy("at").collect()
    assert b"".join(bytes(p["data"]) for p in parts) == (tmp_path / "x").read_bytes()
    assert len(parts) <= 8  # 31 pieces were made of batches of 10,000 lines


def test_unlikely_records_are_found(spark, tmp_path):
    """Packets that no guess takes for likely: without bytes, and with a fraction of more than a second."""
    data = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    want = []
    for i in range(200):
        want.append((len(data), i * 1_000_000 + 2_000_000, 20 if i % 2 else 0))
        data += struct.pack("<IIII", i, 2_000_000, want[-1][2], 60) + b"\x01" * want[-1][2]
    (tmp_path / "x").write_bytes(data)
    got = captures.packets(spark, f"file://{tmp_path}/x", 1000).select("position", "micros", "size").orderBy("position").collect()
    assert [tuple(r) for r in got] == want


def test_chunks_are_decoded_apart(spark, tmp_path):
    data, want = classic("<", 400, 8)
    (tmp_path / "x").write_bytes(data)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which would put so few bytes into one task
    try:
        found = captures.packets(spark, f"file://{tmp_path}/x", 20_000).select("position", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(found) == len(want) and len({r["task"] for r in found}) > 1


def test_cut_and_foreign_files(spark, tmp_path):
    for name, data in (("cut", classic("<", 50, 1)[0][:-3]), ("cut2", sections("<", 50, 1)[0][:-8]), ("odd", b"GET / HTTP/1.1\r\n"), ("face", sections("<", 1, 1)[0].replace(struct.pack("<II", 6, 0), b"")[:28] + sections("<", 4, 1)[0][48:])):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception, match="cut off|no capture file|not described"):
            captures.packets(spark, f"file://{tmp_path}/{name}", 1000).collect()
