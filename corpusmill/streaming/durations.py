"""How long things take: starts and stops of a key paired in a table or in a stream, and metrics that add up across restarts."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpusmill.operators.metrics import accumulated

SPANS = "key string, labels string, started long, ended long, outcome string"


def spans(marks: DataFrame, timeout: float, until: datetime | None = None) -> DataFrame:
    """(key, labels, started, ended, seconds, outcome) of each start in marks (key, labels, kind start or stop, ts, event_id) whose end is
    known. In a key's order of ts and event_id the next mark of any kind decides: a stop within timeout seconds ends it (outcome
    ended), another start within it takes its place (restarted); without either it has timed out, which is known once marks reach
    beyond it (until: where the greatest ts isn't what is known). Stops that nothing was started for don't count. Keys are those
    of requests or users: a key's marks are ordered in one task."""
    rows = marks.where(F.col("kind").isin("start", "stop") & F.col("ts").isNotNull()).select(F.col("key").cast("string").alias("key"), "labels", "kind", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    order = Window.partitionBy("key").orderBy("ts", "event_id")
    after = rows.withColumns({"next_kind": F.lead("kind").over(order), "next_ts": F.lead("ts").over(order)}).where("kind = 'start'")
    known = F.lit(until) if until else None
    if known is None:
        after = after.join(F.broadcast(rows.agg(F.max("ts").alias("known"))), F.lit(True))
        known = F.col("known")
    since = lambda c: (F.unix_micros(c) - F.unix_micros("ts")) / 1e6
    after = after.withColumn("took", since(F.col("next_ts"))).withColumn("outcome", F.when((F.col("took") <= timeout) & (F.col("next_kind") == "stop"), "ended").when(F.col("took") <= timeout, "restarted").when(since(known) > timeout, "timed out"))
    ended = F.col("outcome") == "ended"
    return after.where("outcome IS NOT NULL").select("key", "labels", F.col("ts").alias("started"), F.when(ended, F.col("next_ts")).alias("ended"), F.when(ended, F.col("took")).alias("seconds"), "outcome")


class Pairing(StatefulProcessor):
    """A key's marks wait until the watermark has passed them, so that late ones find their place; then they are taken in order. A timer
    at each mark wakes the key, and one at the end of its time an open start. Times are microseconds."""

    def __init__(self, timeout: float) -> None:
        self.timeout = round(timeout * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, event_id long, kind string, labels string")
        self.open = handle.getValueState("open", "us long, labels string")

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(us // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for us, event_id, kind, labels in zip(batch["us"], batch["event_id"], batch["kind"], batch["labels"]):
                self.waiting.appendValue((int(us), int(event_id), kind, None if pd.isna(labels) else labels))
                self._wake(int(us))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        marks = sorted((tuple(x) for x in self.waiting.get()), key=lambda x: x[:2]) if self.waiting.exists() else []
        ready, later = [x for x in marks if x[0] < now], [x for x in marks if x[0] >= now]
        open_, out = tuple(self.open.get()) if self.open.exists() else None, []
        for at, _, kind, labels in ready:
            if open_:
                out.append((key[0], open_[1], open_[0], at if kind == "stop" and at - open_[0] <= self.timeout else None, "timed out" if at - open_[0] > self.timeout else "ended" if kind == "stop" else "restarted"))
            open_ = (at, labels) if kind == "start" else None
            if open_:
                self._wake(at + self.timeout)
        if open_ and now - open_[0] > self.timeout:
            out.append((key[0], open_[1], open_[0], None, "timed out"))
            open_ = None
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        if open_:
            self.open.update(open_)
        else:
            self.open.clear()
        yield pd.DataFrame(out, columns=["key", "labels", "started", "ended", "outcome"]).astype({"ended": "Int64"}) if out else pd.DataFrame()

    def close(self) -> None:
        pass


def spans_stream(marks: DataFrame, timeout: float, late: str = "10 minutes") -> DataFrame:
    """The same for a stream: a span is given out once its end is known, which is when the watermark (the greatest ts less `late`) has
    passed it. Marks that come later than that are dropped. The session's state store must be RocksDB (see with_rocksdb)."""
    rows = marks.where(F.col("kind").isin("start", "stop")).select(F.col("key").cast("string").alias("key"), "labels", "kind", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id").withWatermark("ts", late)
    found = rows.groupBy("key").transformWithStateInPandas(Pairing(timeout), SPANS, "Append", "EventTime")
    return found.select("key", "labels", F.timestamp_micros("started").alias("started"), F.timestamp_micros("ended").alias("ended"), ((F.col("ended") - F.col("started")) / 1e6).alias("seconds"), "outcome")


def with_rocksdb(spark: SparkSession) -> SparkSession:
    """Sets the state store that timers and several states of a key need; a cluster may have it in its configuration."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def metric_sink(observed: DataFrame, path: str, checkpoint: str, **options):
    """Adds a stream of (metric, labels, value, ts) up and writes the whole of it, a row for each metric, labels and bucket, to
    path/batch=<number> after each batch. Sums are the query's state: a restart goes on where the last run ended, and a batch that
    runs again writes the same rows over its own."""

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return accumulated(observed).writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(**options)


def metrics_now(spark: SparkSession, path: str) -> DataFrame:
    """The newest batch that metric_sink has written."""
    rows = spark.read.option("basePath", path).parquet(path)
    return rows.join(F.broadcast(rows.agg(F.max("batch").alias("newest"))), F.col("batch") == F.col("newest")).drop("batch", "newest")
