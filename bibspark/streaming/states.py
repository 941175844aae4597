"""Keyed state with timers: login challenges and pending requests, as a fold over sorted partitions and as a stream.

Both ways share one small transition function for each kind. The batch way sorts a key's events by time and id and folds them, holding one
key's state. The stream way (`transformWithStateInPandas`) takes events in any order: they wait in list state until the watermark
passes their time, then an event-time timer hands them over in order, so the result is that of the batch way for all events that
are not later than `late`. State is bounded: a key holds one challenge or request, and the events of the last `late`; a timer at its
expiry clears it. Streams need the RocksDB state store, which `stream` sets for its session.

Events are (key, t, id, kind, who, code): t microseconds, ties in order of id. Events without a key or time are left out.
Kinds that a state doesn't know have the status "unknown" and change nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

SECOND = 1_000_000
# Seconds between requests, of a code's life and of a pending request's, and wrong codes after which a challenge ends.
COOLDOWN, EXPIRY, PENDING, ATTEMPTS = 60, 600, 900, 5
EVENT = "key string, t long, id long, kind string, who string, code string"
#: (time of the last request or creation, end of life or 0, wrong codes, secret or owner)
STATE = "last long, ends long, wrong int, held string"
NONE = (None, 0, 0, None)
Step = Callable[[tuple, int, str, str, str], tuple[tuple, str]]


def challenge(state: tuple, t: int, kind: str, who: str | None, code: str | None) -> tuple[tuple, str]:
    """Login codes of an address: a request within the cooldown of the last accepted one is refused, else it supersedes what is open; a
    check is ok once, with the right code, before the end of life; the fifth wrong code ends the challenge."""
    last, ends, wrong, held = state
    if kind == "request":
        if last is not None and last >= t - COOLDOWN * SECOND:
            return state, "cooldown"
        return (t, t + EXPIRY * SECOND, 0, code), "accepted"
    if kind == "verify":
        if ends <= t:
            return (last, 0, 0, None), "none"
        if code == held:
            return (last, 0, 0, None), "ok"
        return ((last, 0, 0, None), "ended") if wrong + 1 >= ATTEMPTS else ((last, ends, wrong + 1, held), "wrong")
    return state, "unknown"


def pending(state: tuple, t: int, kind: str, who: str | None, code: str | None) -> tuple[tuple, str]:
    """A request kept for its owner: the owner consumes it once before the end of its life; someone else doesn't."""
    last, ends, _, held = state
    if kind == "create":
        return (t, t + PENDING * SECOND, 0, who), "created"
    if kind == "consume":
        if ends <= t:
            return NONE, "expired"
        return (state, "wrong_user") if held != who else (NONE, "ok")
    return state, "unknown"


STEPS: dict[str, tuple[Step, int]] = {"challenge": (challenge, max(COOLDOWN, EXPIRY)), "pending": (pending, PENDING)}


def events(rows: DataFrame, key: str, ts: str, ident: str, kind: str, who: str, code: str) -> DataFrame:
    return rows.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(ident).cast("long").alias("id"), F.col(kind).cast("string").alias("kind"), F.col(who).cast("string").alias("who"), F.col(code).cast("string").alias("code")).where("key is not null and t is not null")


def fold(rows: DataFrame, what: str) -> DataFrame:
    """(key, id, status) of the rows of EVENT, what: "challenge" or "pending"."""
    step, _ = STEPS[what]

    def run(batches):
        now, state = None, NONE
        for batch in batches:
            out = []
            for key, t, _, kind, who, code in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    now, state = key, NONE
                state, status = step(state, t, kind, who, code)
                out.append(status)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.string())], ["key", "id", "status"])

    ordered = rows.select("key", "t", "id", "kind", "who", "code").repartition("key").sortWithinPartitions("key", "t", "id")
    return ordered.mapInArrow(run, "key string, id long, status string")


class Keyed(StatefulProcessor):
    """Events in order of time for one transition function."""

    def __init__(self, what: str):
        self.what = what

    def init(self, handle) -> None:
        self.handle, (self.step, self.life) = handle, STEPS[self.what]
        self.state = handle.getValueState("state", STATE)
        self.waiting = handle.getListState("waiting", "t long, id long, kind string, who string, code string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            if len(batch):
                for t, *rest in batch[["t", "id", "kind", "who", "code"]].itertuples(index=False):
                    self.waiting.appendValue((int(t), int(rest[0]), *[None if pd.isna(x) else x for x in rest[1:]]))
                    self.handle.registerTimer(-(-int(t) // 1000))
        yield pd.DataFrame({"key": [], "id": [], "status": []}).astype({"key": str, "id": "int64", "status": str})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs() * 1000
        waiting = sorted(self.waiting.get())
        due, later = [x for x in waiting if x[0] <= at], [x for x in waiting if x[0] > at]
        state, out = self.state.get() if self.state.exists() else NONE, []
        state = tuple(state)
        for t, ident, kind, who, code in due:
            state, status = self.step(state, t, kind, who, code)
            out.append((key[0], ident, status))
        if due:
            self.waiting.put(later) if later else self.waiting.clear()
        over = state == NONE or (state[0] or 0) + self.life * SECOND < at
        if over and not later:
            self.state.clear()
        elif due:
            self.state.update(state)
            self.handle.registerTimer(-(-((state[0] or 0) + self.life * SECOND) // 1000) + 1)
        yield pd.DataFrame(out, columns=["key", "id", "status"]).astype({"key": str, "id": "int64", "status": str})


def stream(rows: DataFrame, what: str, late: str) -> DataFrame:
    """`fold` of a stream of EVENT rows that come at most `late` after their time."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = rows.withColumn("at", F.timestamp_micros("t")).withWatermark("at", late)
    return timed.groupBy("key").transformWithStateInPandas(Keyed(what), "key string, id long, status string", "Append", "eventTime")
