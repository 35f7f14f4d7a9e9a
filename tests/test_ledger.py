"""The token ledger: its rules, and a stream with late rows against all rows in order."""

import datetime as dt
import random

from tracewright.streaming import ledger

BASE = dt.datetime(2026, 1, 1)


def outcomes(rows, limit=100, window=60):
    return [(r[3], r[4], r[5]) for r in ledger.settle([(int(at * 1e6), i, *r) for i, (at, *r) in enumerate(rows)], [], limit, window * 1_000_000)[0]]


def test_rules():
    got = outcomes([
        (0, "reserve", "a", 60), (1, "reserve", "b", 50), (2, "commit", "a", 40), (3, "reserve", "b", 50), (4, "commit", "a", 1), (5, "release", "b", None),
        (6, "reserve", "c", 101), (7, "reserve", "c", 0), (8, "reserve", "c", 60), (9, "commit", "c", None), (59.9, "reserve", "d", 1), (60, "reserve", "e", 40),
        (61, "release", "zz", None), (61, "spend", "e", 1), (62, "reserve", "e", 1), (130, "reserve", "a", 10), (185, "commit", "e", 5),
    ])
    assert got == [
        ("a", "granted", 60), ("b", "refused", 60), ("a", "committed", 40), ("b", "granted", 90), ("a", "unknown", 90), ("b", "released", 40),
        ("c", "over_limit", 40), ("c", "invalid", 40), ("c", "granted", 100), ("c", "committed", 100), ("d", "refused", 100), ("e", "granted", 100),
        ("zz", "unknown", 100), ("e", "invalid", 100), ("e", "invalid", 100), ("a", "granted", 10), ("e", "unknown", 10),
    ]


def test_stream_with_late_rows(spark, tmp_path):
    rng = random.Random(6)
    rows, seq = [], 0
    for account in ("x", "y", "z"):
        at, names = 0.0, []
        for i in range(60):
            at += rng.choice([0.5, 3, 9, 40])
            action = rng.choice(["reserve", "reserve", "commit", "release"])
            name = f"{account}{i}" if action == "reserve" or not names else rng.choice(names)
            names.append(name)
            rows.append((account, BASE + dt.timedelta(seconds=at), seq, action, name, rng.choice([10, 30, 55, 120, None])))
            seq += 1
    rows.sort(key=lambda r: r[1])
    swapped = rows[:]
    for i in range(0, len(rows) - 3, 3):
        if (swapped[i + 2][1] - swapped[i][1]).total_seconds() < 50:
            swapped[i], swapped[i + 2] = swapped[i + 2], swapped[i]
    end = [("zzz", rows[-1][1] + dt.timedelta(hours=h), 10_000 + h, "reserve", f"end{h}", 1) for h in (1, 2)]
    schema = "account string, at timestamp, seq long, action string, request_id string, tokens long"
    whole = swapped + end
    for k in range(0, len(whole), 12):
        spark.createDataFrame(whole[k : k + 12], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ledger.STORE)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = ledger.token_ledger(stream, 100).writeStream.format("memory").queryName("tokens").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
        q.awaitTermination(300)
        got = {r["seq"]: (r["outcome"], r["used"]) for r in spark.table("tokens").collect()}
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    want = {}
    for account in ("x", "y", "z"):
        own = [(int((at - BASE).total_seconds() * 1e6), s, *r) for a, at, s, *r in rows if a == account]
        want |= {r[1]: (r[4], r[5]) for r in ledger.settle(own, [], 100, 60_000_000)[0]}
    assert {k: v for k, v in got.items() if k < 10_000} == want
    assert {o for o, _ in want.values()} >= {"granted", "refused", "over_limit", "committed", "released", "unknown", "invalid"}
