"""Counters, histograms, gauges and the signed audit table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import rules
from corpusmill.functions.text import hmac_sha256


def histogram(rows: DataFrame, value: str, buckets: list[float], by: list[str]) -> DataFrame:
    """(by, le, count): cumulative counts, the last bucket without bound; one pass, one sum a bucket before the shuffle."""
    edges = [*buckets, float("inf")]
    sums = rows.groupBy(*by).agg(*(F.count_if(F.col(value) <= x).alias(f"b{k}") for k, x in enumerate(edges)))
    pairs = F.array(*(F.struct(F.lit("+Inf" if x == float("inf") else str(x)).alias("le"), F.col(f"b{k}").alias("count")) for k, x in enumerate(edges)))
    return sums.select(*by, F.inline(pairs))


def histogram_totals(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """What a histogram shows beside its buckets: the sum and the number of observations."""
    return rows.groupBy(*by).agg(F.round(F.sum(value), 6).alias("sum"), F.count(value).alias("count"))


def performance(rows: DataFrame, by: list[str]) -> DataFrame:
    """Means of latency_ms, tokens and cost_usd, where a missing figure counts as 0; the latency at place floor(0.95 n); the sum of tokens."""
    from corpusmill.operators.answers import p95

    filled = rows.select(*by, *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("latency_ms", "tokens", "cost_usd")))
    means = filled.groupBy(*by).agg(F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms"), F.round(F.avg("tokens"), 6).alias("avg_tokens"), F.round(F.avg("cost_usd"), 8).alias("avg_cost_usd"), F.sum("tokens").alias("total_tokens"))
    return means.join(p95(filled, "latency_ms", by).withColumnRenamed("p95", "p95_latency_ms"), by)


def labelled(name: str, **labels: Column) -> Column:
    """struct(metric, labels) of a counter or a histogram, labels in the order of its definition."""
    order = next((known[name] for known in (rules.COUNTERS, rules.HISTOGRAMS, rules.GAUGES) if name in known), list(labels))
    if set(order) != set(labels):
        raise ValueError(f"{name} has the labels {', '.join(order)}")
    pairs = [F.concat(F.lit(f'{x}="'), labels[x].cast("string"), F.lit('"')) for x in order]
    return F.struct(F.lit(name).alias("metric"), (F.concat_ws(",", *pairs) if pairs else F.lit("")).alias("labels"))


def _observed(what: Column, value: Column) -> Column:
    return F.struct(what["metric"].alias("metric"), what["labels"].alias("labels"), value.cast("double").alias("value"))


def observation(name: str, value: Column, **labels: Column) -> Column:
    """struct(metric, labels, value)."""
    return _observed(labelled(name, **labels), value)


def observations(rows: DataFrame) -> DataFrame:
    """(metric, labels, value): what a finished question adds: itself, its tokens by type, its cost, whether the cache had it, and one
    observation for each retrieval score. rows: user_role, document_category, success, tokens_input, tokens_output, model,
    cost_usd, retrieval_scores (array), cache_hit."""
    c = F.col
    kept = F.array(
        _observed(labelled("queries_total", user_role=c("user_role"), document_category=c("document_category"), success=c("success")), F.lit(1)),
        _observed(labelled("token_usage_total", model=c("model"), token_type=F.lit("input")), c("tokens_input")),
        _observed(labelled("token_usage_total", model=c("model"), token_type=F.lit("output")), c("tokens_output")),
        _observed(labelled("cost_usd_total", model=c("model"), operation=F.lit("generation")), c("cost_usd")),
        _observed(labelled("cache_hits_total", cache_type=F.lit("query"), result=F.when(c("cache_hit"), "hit").otherwise("miss")), F.lit(1)),
    )
    scores = F.transform("retrieval_scores", lambda x: _observed(labelled("retrieval_score", user_role=c("user_role")), x))
    return rows.select(F.inline(F.concat(kept, scores)))


def security_observations(rows: DataFrame) -> DataFrame:
    """(metric, labels, value) of guarded questions: each kind of personal data, each violation (severity high, regulation mixed) and
    the block. rows: pii_types, violation_types (arrays), block_reason."""
    one = F.lit(1)
    data = F.transform("pii_types", lambda x: _observed(labelled("pii_detections_total", pii_type=x, location=F.lit("query")), one))
    broken = F.transform("violation_types", lambda x: _observed(labelled("compliance_violations_total", violation_type=x, severity=F.lit("high"), regulation=F.lit("mixed")), one))
    block = F.array_compact(F.array(F.when(F.col("block_reason").isNotNull(), _observed(labelled("blocked_queries_total", block_reason=F.col("block_reason")), one))))
    return rows.select(F.inline(F.concat(data, broken, block)))


def outcome_observations(rows: DataFrame) -> DataFrame:
    """(metric, labels, value) of what went wrong: answers that their context doesn't bear out, failed sign-ins, requests over a limit.
    rows: model, user_role, grounded, auth_failure (null where none), limited."""
    c, one = F.col, F.lit(1)
    found = F.array(
        F.when(~c("grounded"), _observed(labelled("hallucination_detected_total", model=c("model"), user_role=c("user_role")), one)),
        F.when(c("auth_failure").isNotNull(), _observed(labelled("auth_failures_total", failure_type=c("auth_failure")), one)),
        F.when(c("limited"), _observed(labelled("rate_limit_exceeded_total", user_role=c("user_role")), one)),
    )
    return rows.select(F.inline(F.array_compact(found)))


def ingest_observations(rows: DataFrame) -> DataFrame:
    """(metric, labels, value): a document taken in, by its file's type and its category."""
    return rows.select(F.inline(F.array(_observed(labelled("documents_ingested_total", file_type=F.col("file_type"), document_category=F.col("document_category")), F.lit(1)))))


def duration_observations(spans: DataFrame, stage: str, **labels: Column) -> DataFrame:
    """(metric, labels, value): the seconds of ended spans of a stage (query, retrieval, generation, embedding, guardrails)."""
    return spans.where("outcome = 'ended'").select(F.inline(F.array(_observed(labelled(f"{stage}_duration", **labels), F.col("seconds")))))


def score_observations(rows: DataFrame) -> DataFrame:
    """(metric, labels, value) of evaluated answers. rows: faithfulness, answer_relevancy, context_precision, context_recall; nulls
    aren't observed."""
    kept = [F.when(F.col(x).isNotNull(), _observed(labelled(f"{x}_score"), F.col(x))) for x in ("faithfulness", "answer_relevancy", "context_precision", "context_recall")]
    return rows.select(F.inline(F.array_compact(F.array(*kept))))


def gauge_observations(rows: DataFrame, name: str, value: Column, **labels: Column) -> DataFrame:
    """(metric, labels, value, ts): a gauge's value at each row's ts."""
    return rows.select(F.inline(F.array(_observed(labelled(name, **labels), value))), "ts")


def _place() -> Column:
    """The number of the histogram's bucket that value falls into; null for other metrics."""
    place = F.lit(None).cast("int")
    for name, edges in rules.BUCKETS.items():
        over = sum((F.when(F.col("value") > x, 1).otherwise(0) for x in edges), F.lit(0))
        place = F.when(F.col("metric") == name, over).otherwise(place)
    return place


def accumulated(observed: DataFrame) -> DataFrame:
    """(metric, labels, place, n, total, last, last_ts) of (metric, labels, value[, ts]) rows, of a table or a stream: place numbers the
    histogram's bucket that a value falls into (null otherwise), last is the value of the greatest ts, of equal ones the greatest.
    All are sums or extremes, so parts of a table, batches of a stream and what a restart finds in its state add up alike."""
    rows = observed if "ts" in observed.columns else observed.withColumn("ts", F.lit(None).cast("timestamp"))
    last = F.max(F.struct("ts", "value"))
    sums = rows.withColumn("place", _place()).groupBy("metric", "labels", "place").agg(F.count("value").alias("n"), F.sum("value").alias("total"), last.alias("m"))
    return sums.select("metric", "labels", "place", "n", "total", F.col("m.value").alias("last"), F.col("m.ts").alias("last_ts"))


def exposed(sums: DataFrame) -> DataFrame:
    """(line): the text form of an accumulated table: counters, histograms with all their buckets, and gauges."""
    counted = sums.where(F.col("metric").isin(list(rules.COUNTERS))).select(F.format_string("%s{%s} %.6f", "metric", "labels", "total").alias("line"))
    gauges = sums.where(F.col("metric").isin(list(rules.GAUGES))).select(F.when(F.col("labels") == "", F.format_string("%s %.6f", "metric", "last")).otherwise(F.format_string("%s{%s} %.6f", "metric", "labels", "last")).alias("line"))
    edges = F.create_map(*(x for name, e in rules.BUCKETS.items() for x in (F.lit(name), F.array(*(F.lit(str(b)) for b in [*e, "+Inf"])))))
    rows = sums.where(F.col("metric").isin(list(rules.BUCKETS))).groupBy("metric", "labels").agg(F.collect_list(F.struct("place", "n")).alias("b"), F.sum("total").alias("total"), F.sum("n").alias("n"))  # as many as edges
    upto = F.transform(edges[F.col("metric")], lambda le, k: F.struct(le.alias("le"), F.aggregate(F.filter("b", lambda x: x["place"] <= k), F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("c")))
    joined = F.when(F.col("labels") == "", F.lit("")).otherwise(F.concat("labels", F.lit(",")))
    buckets = rows.select("metric", joined.alias("j"), F.inline(upto)).select(F.format_string('%s_bucket{%sle="%s"} %d', "metric", "j", "le", "c").alias("line"))
    totals = rows.select(F.explode(F.array(F.format_string("%s_sum{%s} %.6f", "metric", "labels", F.round("total", 6)), F.format_string("%s_count{%s} %d", "metric", "labels", "n"))).alias("line"))
    return counted.union(gauges).union(buckets).union(totals)


def exposition(observed: DataFrame) -> DataFrame:
    """(line): the text form of (metric, labels, value) rows that scrapers read: counters as sums; histograms as cumulative buckets, sum
    and count. One pass over the rows for all metrics, summed before the shuffle."""
    rows = observed.where(F.col("metric").isin([*rules.COUNTERS, *rules.BUCKETS])).withColumn("place", _place())
    sums = rows.groupBy("metric", "labels", "place").agg(F.count("value").alias("n"), F.sum("value").alias("total"))
    return exposed(sums.withColumn("last", F.lit(None).cast("double")))


def counters(rows: DataFrame, by: list[str], amounts: dict[str, Column]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("total"), *(F.round(F.sum(x), 6).alias(name) for name, x in amounts.items()))


def running_gauge(rows: DataFrame, change: Column, by: list[str], order: list[str]) -> DataFrame:
    """The gauge after each event: the sum of changes so far within each group of by."""
    return rows.withColumn("gauge", F.sum(change).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def preview(x: Column) -> Column:
    return F.nullif(F.left(x, F.lit(100)), F.lit(""))


def signed(events: DataFrame, key: bytes) -> DataFrame:
    """events (event_id, ts string, user_id, event_type) with hmac_signature over these four, parted by |."""
    message = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("event_id", "ts", "user_id", "event_type")))
    return events.withColumn("hmac_signature", hmac_sha256(key, message))


def alerts(events: DataFrame) -> DataFrame:
    """Security events of high or critical severity and failed logins."""
    return events.where(F.col("severity").isin("high", "critical") | (F.col("event_type") == "LOGIN_FAILURE"))


def query_events(rows: DataFrame) -> DataFrame:
    """Audit rows of answered and blocked questions. rows: query_id, user_id, question, answer, block_reason."""
    blocked = F.col("block_reason").isNotNull()
    return rows.select(
        F.concat(F.lit("evt-"), F.col("query_id").cast("string")).alias("event_id"), F.when(blocked, "QUERY_BLOCKED").otherwise("QUERY_PROCESSED").alias("event_type"), "user_id", "query_id",
        preview(F.col("question")).alias("query_preview"), preview(F.col("answer")).alias("response_preview"), blocked.alias("was_blocked"), "block_reason",
    )


def security_events(rows: DataFrame) -> DataFrame:
    """Audit rows of security events. rows: event_id, event_type, user_id, description, severity (high where missing), was_blocked."""
    return rows.select("event_id", "event_type", "user_id", F.coalesce("severity", F.lit("high")).alias("severity"), F.coalesce("was_blocked", F.lit(False)).alias("was_blocked"), F.col("description").alias("block_reason"))


def auth_events(rows: DataFrame) -> DataFrame:
    """Audit rows of sign-ins: blocked where they failed, with the reason. rows: event_id, event_type, user_id, success, failure_reason."""
    return rows.select("event_id", "event_type", "user_id", (~F.col("success")).alias("was_blocked"), F.col("failure_reason").alias("block_reason"))


def stamped(events: DataFrame, at: str | None = None, id_of: list[str] | None = None) -> DataFrame:
    """events with event_id and ts: at as it is given (else now, in UTC) and a random id, or one made of the columns id_of, which a
    task that runs again makes again."""
    if id_of:
        h = F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in id_of)))
        name = F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    else:
        name = F.uuid()
    now = F.lit(at) if at else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    return events.withColumns({"event_id": name, "ts": now})


def as_json(events: DataFrame) -> DataFrame:
    """Each event as one line without its null fields."""
    return events.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("value"))
