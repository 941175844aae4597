"""Event logic in batch: trailing counts, cooldowns, latest rows, token buckets, expiring duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: str):
    """Whole microseconds since the epoch of a timestamp without zone."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def trailing_count(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Events of the key in the last `seconds`, both ends included, this one too."""
    frame = Window.partitionBy(key).orderBy(micros(ts)).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("recent", F.count("*").over(frame))


def cooldown(events: DataFrame, key: str, ts: str, ident: str, seconds: int) -> DataFrame:
    """`rejected` if the key's previous event is at most `seconds` ago."""
    before = F.lag(micros(ts)).over(Window.partitionBy(key).orderBy(ts, ident))
    return events.withColumn("rejected", F.coalesce(micros(ts) - before <= seconds * 1_000_000, F.lit(False)))


def latest(events: DataFrame, keys: list[str], ts: str, ident: str) -> DataFrame:
    return events.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(ts), F.desc(ident)))).where("r = 1").drop("r")


def token_bucket(events: DataFrame, key: str, ts: str, ident: str, rate: float, burst: float) -> DataFrame:
    """(ident, key, allowed, retry_after) of each event in order: a bucket refills at `rate` a second up to `burst`, an event takes one.

    A key's events are folded in order by Python generators over sorted partitions, so a hot key streams and is never held whole.
    """
    import math

    import pyarrow as pa

    rows = events.select(F.col(key).cast("long").alias("k"), micros(ts).alias("t"), F.col(ident).cast("long").alias("i")).repartition("k").sortWithinPartitions("k", "t", "i")

    def run(batches):
        name, tokens, last = None, burst, 0
        for batch in batches:
            allowed, wait = [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != name:
                    name, tokens, last = k, burst, t
                tokens, last = min(burst, tokens + (t - last) / 1e6 * rate), t
                ok = tokens >= 1
                wait.append(0 if ok else math.ceil((1 - tokens) / rate))
                tokens -= ok
                allowed.append(ok)
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.array(allowed, pa.bool_()), pa.array(wait, pa.int64())], ["i", "k", "allowed", "retry_after"])

    return rows.mapInArrow(run, "i long, k long, allowed boolean, retry_after long").select(F.col("i").alias(ident), F.col("k").alias(key), "allowed", "retry_after")


def first_seen(events: DataFrame, keys: list[str], ts: str, ident: str, ttl: int) -> DataFrame:
    """(keys, ident, fresh): an event is a duplicate within `ttl` seconds of the last fresh one of its keys; duplicates don't extend it.

    Folded over sorted partitions as in `token_bucket`: only the current keys and their last fresh time are held.
    """
    import pyarrow as pa

    names = [*keys, ident]
    rows = events.select(*names, micros(ts).alias("_t")).repartition(*keys).sortWithinPartitions(*keys, "_t", ident)

    def run(batches):
        now, last = None, None
        for batch in batches:
            fresh = []
            own = zip(*(c.to_pylist() for c in batch.columns[: len(keys)]), strict=True)
            for k, t in zip(own, batch.column(len(names)).to_pylist(), strict=True):
                if k != now:
                    now, last = k, None
                # an event without a time is fresh and leaves the last fresh time as it is
                new = last is None or t is None or t - last >= ttl * 1_000_000
                last = t if new and t is not None else last
                fresh.append(new)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(fresh, pa.bool_())], [*names, "fresh"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", fresh boolean")
