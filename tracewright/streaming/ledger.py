"""A ledger of tokens by account on a stream: reservations within a sliding window, settled or given back later.

Rows (account, at, seq, action, request_id, tokens) are `reserve`, `commit` (with the provider's count, or null to keep the
estimate) and `release`. A reservation is granted if it fits what the window that ends with it leaves of the limit; nobody
waits. It is settled once; later settlements of it change nothing. A reservation counts from its own time for one window and is
forgotten after KEPT windows.

State is kept by account with transformWithState: `waiting` holds rows until the watermark has passed them, so that rows which
come late, but within the watermark, are taken in the order of their times whatever batch brought them; `held` holds the
reservations of the last windows. A timer at each row's time takes what is due; one more purges an account that fell silent.
State stays as large as the rows of the watermark's delay and of KEPT windows. It needs the RocksDB state store
(spark.sql.streaming.stateStore.providerClass)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Windows after which a reservation that nobody settled is forgotten.
KEPT = 2
RESULT = "account string, at timestamp, seq long, action string, request_id string, outcome string, used long"


def settle(rows: list[tuple], held: list[tuple], limit: int, window: int) -> tuple[list[tuple], list[tuple]]:
    """Rows (micros, seq, action, request, tokens) in order against held (micros, request, tokens, settled): the outcomes
    (…, outcome, used) and what is held then. window is in microseconds."""
    out = []
    for at, seq, action, request, tokens in sorted(rows, key=lambda r: (r[0], r[1])):
        held = [h for h in held if h[0] > at - KEPT * window]
        used = sum(h[2] for h in held if h[0] > at - window)
        mine = next((i for i, h in enumerate(held) if h[1] == request and not h[3]), None)
        if action == "reserve":
            outcome = "invalid" if tokens is None or tokens < 1 or any(h[1] == request for h in held) else "over_limit" if tokens > limit else "refused" if tokens > limit - used else "granted"
            if outcome == "granted":
                held, used = [*held, (at, request, tokens, False)], used + tokens
        elif mine is None:
            outcome = "unknown"
        elif action == "commit":
            was, outcome = held[mine], "committed"
            now = was[2] if tokens is None or tokens < 0 else tokens
            used += (now - was[2]) * (was[0] > at - window)
            held = [*held[:mine], (was[0], request, now, True), *held[mine + 1 :]]
        elif action == "release":
            was, outcome = held[mine], "released"
            used -= was[2] * (was[0] > at - window)
            held = [*held[:mine], *held[mine + 1 :]]
        else:
            outcome = "invalid"
        out.append((at, seq, action, request, outcome, used))
    return out, held


class Ledger(StatefulProcessor):
    def __init__(self, limit: int, window: int):
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, seq long, action string, request string, tokens long")
        self.held = handle.getListState("held", "at long, request string, tokens long, settled boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            new = [(int(r.at.value // 1000), int(r.seq), r.action, r.request_id, None if pd.isna(r.tokens) else int(r.tokens)) for r in frame.itertuples()]
            if new:
                self.waiting.appendList(new)
                self.handle.registerTimer(max(min(r[0] for r in new) // 1000 + 1, passed + 1))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        now = [r for r in rows if r[0] < due]
        held = [tuple(h) for h in self.held.get()] if self.held.exists() else []
        out, held = settle(now, held, self.limit, self.window)
        held = [h for h in held if h[0] > due - KEPT * self.window]
        later = [r for r in rows if r[0] >= due]
        for state, left in ((self.waiting, later), (self.held, held)):
            if left:
                state.put(left)
            elif state.exists():
                state.clear()
        if later:
            self.handle.registerTimer(min(r[0] for r in later) // 1000 + 1)
        if held:
            self.handle.registerTimer((held[-1][0] + KEPT * self.window) // 1000 + 1)  # forgotten by then
        if out:
            frame = pd.DataFrame(out, columns=["at", "seq", "action", "request_id", "outcome", "used"])
            frame["at"] = pd.to_datetime(frame["at"], unit="us")
            frame.insert(0, "account", key[0])
            yield frame


def token_ledger(rows: DataFrame, limit: int, seconds: int = 60, late: str = "1 minute") -> DataFrame:
    """Outcomes of a stream of rows, each once the watermark has passed it: granted, refused, over_limit, invalid, committed,
    released, unknown; used is what the window holds then. Rows later than the watermark are dropped."""
    known = rows.withWatermark("at", late).select("account", "at", F.col("seq").cast("long").alias("seq"), "action", "request_id", F.col("tokens").cast("long").alias("tokens"))
    return known.groupBy("account").transformWithStateInPandas(Ledger(limit, seconds * 1_000_000), RESULT, "append", "eventTime")
