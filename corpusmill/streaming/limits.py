"""Keyed rate limits and windowed metrics, for streams and for batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "key string, ts timestamp, event_id long, allowed boolean, remaining int"


def decide(times: list[float], limit: int, seconds: float, log: list[float]) -> list[tuple[bool, int]]:
    """Sliding-window log: entries at or before now - seconds go; a full log rejects, and rejected requests aren't logged. log is
    changed in place; it never holds more than limit entries."""
    out = []
    for now in times:
        log[:] = [t for t in log if t > now - seconds]
        if len(log) >= limit:
            out.append((False, 0))
        else:
            log.append(now)
            out.append((True, limit - len(log)))
    return out


def _seconds(ts: pd.Series) -> list[float]:
    return (ts.astype("datetime64[us]").astype("int64") / 1e6).tolist()


def limited(requests: DataFrame, limit: int, seconds: float = 60.0) -> DataFrame:
    """Batch: requests (key, ts, event_id) with allowed and remaining. A decision depends on those before it, so a key's requests
    are taken in order, in batches as they are read: a key's log is all that is held."""
    rows = requests.select(F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"))
    ordered = rows.repartition("key").sortWithinPartitions("key", "ts", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, log = None, []
        for batch in batches:
            for name, group in batch.groupby("key", sort=False, dropna=False):
                if name != key:
                    key, log = name, []
                found = decide(_seconds(group["ts"]), limit, seconds, log)
                yield group.assign(allowed=[x for x, _ in found], remaining=[x for _, x in found])

    return ordered.mapInPandas(run, SCHEMA)


def limited_stream(requests: DataFrame, limit: int, seconds: float = 60.0) -> DataFrame:
    """The same for a stream: a key's log is its state; it is dropped when the key has been silent for the window."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = list(state.get[0]) if state.exists else []
        group = pd.concat(batches).sort_values(["ts", "event_id"])
        found = decide(_seconds(group["ts"]), limit, seconds, log)
        state.update((log,))
        state.setTimeoutDuration(max(1, int(seconds * 1000)))
        yield group.assign(allowed=[x for x, _ in found], remaining=[x for _, x in found])[["key", "ts", "event_id", "allowed", "remaining"]]

    return requests.groupBy("key").applyInPandasWithState(run, SCHEMA, "log array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def windowed(events: DataFrame, length: str, slide: str | None = None, by: tuple[str, ...] = ("event_type",), late: str | None = None) -> DataFrame:
    """Count and sum of value in tumbling or sliding windows; late: the watermark's delay, for streams."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", length, slide), *by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def sessions(events: DataFrame, gap: str, by: str = "user_id") -> DataFrame:
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.groupBy(F.session_window("ts", gap), by).agg(F.count("*").alias("n"))


def audit_sink(events: DataFrame, path: str, checkpoint: str, key: bytes):
    """Signs an audit stream and appends it as JSON lines."""
    from corpusmill.operators.metrics import signed

    return signed(events, key).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
