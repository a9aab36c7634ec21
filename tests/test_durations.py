"""Durations and metrics: the batch beside a plain version, streams beside the batch, late and missing marks, restarts."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from corpusmill.operators import metrics
from corpusmill.plans import monitoring
from corpusmill.streaming import durations

MARKS = "key string, labels string, kind string, ts timestamp, event_id long"
START = datetime(2024, 1, 1)


def plain(rows, timeout):
    out, known = [], max(r[3] for r in rows if r[2])
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key and r[2]), key=lambda r: (r[3], r[4]))
        for k, r in enumerate(own):
            if r[2] == "start":
                after = own[k + 1] if k + 1 < len(own) else None
                took = (after[3] - r[3]).total_seconds() if after else None
                if after and took <= timeout:
                    out.append((key, r[1], r[3], after[3], took, "ended") if after[2] == "stop" else (key, r[1], r[3], None, None, "restarted"))
                elif (known - r[3]).total_seconds() > timeout:
                    out.append((key, r[1], r[3], None, None, "timed out"))
    return Counter(out)


def some_marks(n=300, seed=2):
    rng, rows = random.Random(seed), []
    for k in range(n):
        at = START + timedelta(seconds=rng.randrange(4000), microseconds=rng.choice([0, 1, 250_000]))
        rows.append((f"k{rng.randrange(25)}", rng.choice([None, 'model="a"']), rng.choice(["start", "stop", "start", None]), at, k))
    return rows


def test_spans_match_plain_version(spark):
    rows = [*some_marks(), ("tie", None, "start", START, 900), ("tie", None, "stop", START, 901), ("lone", None, "stop", START, 902), ("open", "x", "start", START + timedelta(seconds=3990), 903)]
    found = durations.spans(spark.createDataFrame(rows, MARKS), 60.0).collect()
    assert Counter(map(tuple, found)) == plain(rows, 60.0)
    assert {r["outcome"] for r in found} == {"ended", "restarted", "timed out"} and ("open" not in {r["key"] for r in found})
    assert durations.spans(spark.createDataFrame([], MARKS), 60.0).count() == 0


def test_stream_of_spans_with_late_and_missing_marks(spark, tmp_path):
    """Files arrive in the order of time, but marks are late by up to five minutes, across files, and some have no stop."""
    rng, rows = random.Random(7), sorted(some_marks(), key=lambda r: r[3])
    late = sorted(rows, key=lambda r: r[3] + timedelta(seconds=rng.randrange(300)))
    far = [("last", None, "start", START + timedelta(days=2), 5000), ("last", None, "stop", START + timedelta(days=2, seconds=1), 5001)]
    too_late = [("k1", None, "start", START, 6000)]
    for k, part in enumerate([late[:100], late[100:200], late[200:], far, too_late, [("last", None, "stop", START + timedelta(days=4), 5002)]]):
        spark.createDataFrame(part, MARKS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        for f in (tmp_path / "in" / str(k)).glob("part-*"):
            f.rename(tmp_path / f"{k}.parquet")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        durations.with_rocksdb(spark)
        (tmp_path / "files").mkdir()
        for run in (range(2), range(2, 6)):  # the second run goes on from the first one's state
            for k in run:
                (tmp_path / f"{k}.parquet").rename(tmp_path / "files" / f"{k}.parquet")
                marks = spark.readStream.schema(MARKS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "files"))
                query = durations.spans_stream(marks, 60.0, "10 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
                query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    found = Counter(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("key", "labels", "started", "ended", "seconds", "outcome").collect()))
    want = plain([*rows, *far], 60.0)
    assert found == want and len(want) > 80


def test_metrics_add_up_across_restarts(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    observed = monitoring.full_observations(events)
    (tmp_path / "in").mkdir()
    for run in range(3):
        observed.where(f"pmod(xxhash64(metric, labels, value, ts), 3) = {run}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(observed.schema).parquet(str(tmp_path / "in"))
        durations.metric_sink(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    rows = lambda d: {(r["metric"], r["labels"], r["place"]): (r["n"], r["total"], r["last"], r["last_ts"]) for r in d.collect()}
    now = durations.metrics_now(spark, str(tmp_path / "out"))
    got, want = rows(now), rows(metrics.accumulated(observed))
    assert got.keys() == want.keys() and all((a[0], *a[2:]) == (b[0], *b[2:]) and a[1] == pytest.approx(b[1]) for a, b in zip(got.values(), map(want.get, got)))
    assert {r["metric"] for r in now.collect()} == set(monitoring.FULL) and len(monitoring.FULL) == 25
    parted = lambda d: Counter((name, round(float(value))) for name, _, value in (r["line"].rpartition(" ") for r in d.collect()))
    lines, plain_lines = parted(metrics.exposed(now)), parted(metrics.exposition(observed))
    assert not plain_lines - lines  # all that the other form shows, and the gauges besides
    assert sum(lines.values()) - sum(plain_lines.values()) == now.where("metric IN ('active_queries', 'vector_store_documents_total', 'vector_store_chunks_total', 'bm25_index_size')").count()


def test_durations_outcomes_and_scores_become_observations(spark):
    spans = spark.createDataFrame([("a", None, START, START + timedelta(seconds=2), 2.0, "ended"), ("b", None, START, None, None, "timed out")], "key string, labels string, started timestamp, ended timestamp, seconds double, outcome string")
    from pyspark.sql import functions as F

    assert [tuple(r) for r in metrics.duration_observations(spans, "retrieval", retrieval_type=F.lit("hybrid")).collect()] == [("retrieval_duration", 'retrieval_type="hybrid"', 2.0)]
    rows = spark.createDataFrame([("m", "admin", False, "expired", True), ("m", "admin", True, None, False)], "model string, user_role string, grounded boolean, auth_failure string, limited boolean")
    assert sorted(tuple(r)[:2] for r in metrics.outcome_observations(rows).collect()) == [("auth_failures_total", 'failure_type="expired"'), ("hallucination_detected_total", 'model="m",user_role="admin"'), ("rate_limit_exceeded_total", 'user_role="admin"')]
    scores = spark.createDataFrame([(0.5, None, 0.25, 1.0)], "faithfulness double, answer_relevancy double, context_precision double, context_recall double")
    assert sorted(tuple(r) for r in metrics.score_observations(scores).collect()) == [("context_precision_score", "", 0.25), ("context_recall_score", "", 1.0), ("faithfulness_score", "", 0.5)]
    taken = spark.createDataFrame([("pdf", "c1")], "file_type string, document_category string")
    assert tuple(metrics.ingest_observations(taken).first()) == ("documents_ingested_total", 'file_type="pdf",document_category="c1"', 1.0)
