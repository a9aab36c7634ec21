"""Queries of the catalogue about durations and the whole set of metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import rules
from corpusmill.operators import metrics
from corpusmill.plans.catalogue import query, read
from corpusmill.streaming import durations

#: Seconds after which a start without a stop has timed out.
TIMEOUT = 86_400.0
_KIND_SQL = "CASE WHEN event_type IN ('view', 'click') THEN 'start' WHEN event_type IN ('purchase', 'error') THEN 'stop' END"
_SPANS_SQL = f"""
    marks AS (SELECT user_id::VARCHAR AS key, event_id, {_KIND_SQL} AS kind, ts FROM events WHERE event_type <> 'signup'),
    following AS (SELECT *, lead(kind) OVER w AS nk, lead(ts) OVER w AS nt, max(ts) OVER () AS known FROM marks WINDOW w AS (PARTITION BY key ORDER BY ts, event_id)),
    judged AS (
        SELECT key, ts AS started, nt, (epoch_us(nt) - epoch_us(ts)) / 1e6 AS took, nk, CASE WHEN (epoch_us(nt) - epoch_us(ts)) / 1e6 <= {TIMEOUT} THEN CASE nk WHEN 'stop' THEN 'ended' ELSE 'restarted' END WHEN (epoch_us(known) - epoch_us(ts)) / 1e6 > {TIMEOUT} THEN 'timed out' END AS outcome
        FROM following WHERE kind = 'start'),
    spans AS (SELECT key, started, CASE WHEN outcome = 'ended' THEN nt END AS ended, CASE WHEN outcome = 'ended' THEN took END AS seconds, outcome FROM judged WHERE outcome IS NOT NULL)
"""


def marks(events: DataFrame) -> DataFrame:
    """A user's views and clicks start something, purchases and errors end it."""
    kind = F.when(F.col("event_type").isin("view", "click"), "start").when(F.col("event_type").isin("purchase", "error"), "stop")
    return events.select(F.col("user_id").cast("string").alias("key"), F.lit(None).cast("string").alias("labels"), kind.alias("kind"), "ts", "event_id")


@query(f"WITH {_SPANS_SQL} SELECT key, epoch_us(started) AS started_us, coalesce(epoch_us(ended), -1) AS ended_us, round(coalesce(seconds, -1), 6) AS seconds, outcome FROM spans")
def duration_spans(spark, folder):
    found = durations.spans(marks(read(spark, folder, "events")), TIMEOUT)
    return found.select("key", F.unix_micros("started").alias("started_us"), F.coalesce(F.unix_micros("ended"), F.lit(-1)).alias("ended_us"), F.round(F.coalesce("seconds", F.lit(-1.0)), 6).alias("seconds"), "outcome")


#: A metric of the full set: its labels, each an expression over events that both dialects read, its value and which events have it.
_ROLE = "CASE user_id % 3 WHEN 0 THEN 'customer' WHEN 1 THEN 'underwriter' ELSE 'admin' END"
_MODEL = "CASE event_id % 2 WHEN 0 THEN 'm0' ELSE 'm1' END"
FULL = {
    "hallucination_detected_total": ({"model": _MODEL, "user_role": _ROLE}, "1", "event_id % 13 = 0"),
    "pii_detections_total": ({"pii_type": "CASE event_id % 4 WHEN 0 THEN 'email' ELSE 'phone' END", "location": "CASE user_id % 2 WHEN 0 THEN 'query' ELSE 'response' END"}, "1", "event_id % 9 = 0"),
    "compliance_violations_total": ({"violation_type": "event_type", "severity": "'high'", "regulation": "'mixed'"}, "1", "event_id % 8 = 0"),
    "blocked_queries_total": ({"block_reason": "CASE event_id % 3 WHEN 0 THEN 'pii' ELSE 'compliance' END"}, "1", "event_id % 10 = 0"),
    "auth_failures_total": ({"failure_type": "CASE event_id % 4 WHEN 0 THEN 'expired' ELSE 'revoked' END"}, "1", "event_type = 'error'"),
    "rate_limit_exceeded_total": ({"user_role": _ROLE}, "1", "value > 150"),
    "queries_total": ({"user_role": _ROLE, "document_category": "event_type", "success": "CASE WHEN event_type = 'error' THEN 'false' ELSE 'true' END"}, "1", "event_id >= 0"),
    "token_usage_total": ({"model": _MODEL, "token_type": "CASE event_id % 3 WHEN 0 THEN 'input' ELSE 'output' END"}, "event_id % 500", "event_id >= 0"),
    "cost_usd_total": ({"model": _MODEL, "operation": "CASE event_id % 5 WHEN 0 THEN 'embedding' ELSE 'generation' END"}, "(user_id % 100) / 1000.0", "event_id >= 0"),
    "documents_ingested_total": ({"file_type": "CASE event_id % 3 WHEN 0 THEN 'pdf' ELSE 'txt' END", "document_category": "event_type"}, "1", "event_id % 6 = 0"),
    "cache_hits_total": ({"cache_type": "'query'", "result": "CASE event_id % 3 WHEN 0 THEN 'hit' ELSE 'miss' END"}, "1", "event_id >= 0"),
    "query_duration": ({"user_role": _ROLE, "query_category": "event_type", "cache_hit": "CASE event_id % 3 WHEN 0 THEN 'true' ELSE 'false' END"}, "value / 40", "event_id >= 0"),
    "retrieval_duration": ({"retrieval_type": "CASE event_id % 2 WHEN 0 THEN 'dense' ELSE 'hybrid' END"}, "value / 200", "event_id >= 0"),
    "generation_duration": ({"model": _MODEL, "user_role": _ROLE}, "value / 10", "event_id >= 0"),
    "embedding_duration": ({"model": _MODEL}, "value / 900", "event_id >= 0"),
    "guardrails_duration": ({"check_type": "CASE event_id % 3 WHEN 0 THEN 'pii' WHEN 1 THEN 'compliance' ELSE 'output_validation' END"}, "value / 5000", "event_id >= 0"),
    "retrieval_score": ({"user_role": _ROLE}, "value / 100", "event_id >= 0"),
    "faithfulness_score": ({}, "value / 110", "event_id % 2 = 0"),
    "answer_relevancy_score": ({}, "value / 120", "event_id % 2 = 1"),
    "context_precision_score": ({}, "value / 130", "event_id % 3 = 0"),
    "context_recall_score": ({}, "value / 140", "event_id % 3 = 1"),
    "active_queries": ({}, "event_id % 17", "event_id >= 0"),
    "vector_store_documents_total": ({"collection": "CASE event_id % 2 WHEN 0 THEN 'loans' ELSE 'rates' END"}, "event_id", "event_type = 'signup'"),
    "vector_store_chunks_total": ({"collection": "CASE event_id % 2 WHEN 0 THEN 'loans' ELSE 'rates' END"}, "event_id * 7", "event_type = 'signup'"),
    "bm25_index_size": ({}, "event_id * 3", "event_type = 'purchase'"),
}


def full_observations(events: DataFrame) -> DataFrame:
    """(metric, labels, value, ts) of all eleven counters, ten histograms and four gauges, made of events in one pass."""
    each = [F.when(F.expr(which), metrics.observation(name, F.expr(value), **{k: F.expr(x) for k, x in labels.items()})) for name, (labels, value, which) in FULL.items()]
    return events.select(F.inline(F.array_compact(F.array(*each))), "ts")


def _labels_sql(labels: dict[str, str]) -> str:
    return " || ',' || ".join(f"'{k}=\"' || {x} || '\"'" for k, x in labels.items()) or "''"


_FULL_SQL = " UNION ALL ".join(f"SELECT '{name}' AS metric, {_labels_sql({k: labels[k] for k in (rules.COUNTERS | rules.HISTOGRAMS | rules.GAUGES)[name]})} AS labels, ({value})::DOUBLE AS value, ts FROM events WHERE {which}" for name, (labels, value, which) in FULL.items())
_PLACE_SQL = "CASE " + " ".join(f"WHEN metric = '{name}' THEN " + " + ".join(f"(value > {x})::INT" for x in edges) for name, edges in rules.BUCKETS.items()) + " END"


@query(f"WITH o AS ({_FULL_SQL}) SELECT metric, labels, coalesce({_PLACE_SQL}, -1)::INT AS place, count(*) AS n, round(sum(value), 6) AS total, arg_max(value, (ts, value)) AS last FROM o GROUP BY 1, 2, 3")
def metrics_full(spark, folder):
    return metrics.accumulated(full_observations(read(spark, folder, "events"))).select("metric", "labels", F.coalesce("place", F.lit(-1)).alias("place"), "n", F.round("total", 6).alias("total"), "last")
