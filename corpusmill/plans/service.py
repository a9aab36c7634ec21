"""More queries of the catalogue: access, ingest, per-document retrieval, prompts, metric and audit rows of the service."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import rules
from corpusmill.functions.text import fixed
from corpusmill.operators import access, answers, chunking, guardrails, metrics, retrieval, testcases
from corpusmill.plans import ingest
from corpusmill.plans.catalogue import DENSE_SQL, FUSED_SQL, ORACLES, QUERIES, SCANNED_SQL, SPARSE_SQL, _lists, _questions, _quoted, _said, _words, query, read
from corpusmill.index.embeddings import EmbeddingCache
from corpusmill.index.folders import scratch
from corpusmill.sources import loaders
from corpusmill.sources.store import ChunkStore

_NAMES = ["customer", "loan_officer", "underwriter", "compliance_officer", "admin", "guest"]


def _pick(values: list, number):
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


# ---- access


@query(f"""
    WITH a AS (SELECT DISTINCT user_id, {_quoted(_NAMES)}[user_id % 6 + 1] AS user_role FROM events), acts AS (SELECT unnest({_quoted([*rules.ACTIONS, 'other'])}) AS action)
    SELECT user_id, user_role, action, CASE {" ".join(f"WHEN action = '{k}' THEN user_role IN ({', '.join(repr(x) for x in v)})" for k, v in rules.ACTIONS.items())} ELSE false END AS allowed FROM a, acts
""")
def role_permissions(spark, folder):
    users = read(spark, folder, "events").select("user_id").distinct().withColumn("user_role", _pick(_NAMES, F.col("user_id")))
    acts = users.withColumn("action", F.explode(F.array(*map(F.lit, [*rules.ACTIONS, "other"]))))
    return acts.withColumn("allowed", access.may(F.col("action"), F.col("user_role")))


_ADDRESSES = [*rules.ROLE_OF, "someone@else.org"]


@query(f"SELECT user_id, address, CASE {' '.join(f'WHEN address = {a!r} THEN {r!r}' for a, r in rules.ROLE_OF.items())} ELSE 'customer' END AS user_role FROM (SELECT DISTINCT user_id, {_quoted(_ADDRESSES)}[user_id % 6 + 1] AS address FROM events)")
def address_roles(spark, folder):
    users = read(spark, folder, "events").select("user_id").distinct().withColumn("address", _pick(_ADDRESSES, F.col("user_id")))
    return users.withColumn("user_role", access.role_of(F.col("address")))


@query("SELECT event_id AS token_id, user_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'error')")
def tokens_unrevoked(spark, folder):
    events = read(spark, folder, "events").select(F.col("event_id").alias("token_id"), "user_id", "event_type")
    return access.unrevoked(events, events.where("event_type = 'error'")).select("token_id", "user_id")


_ENVIRONMENTS = ["development", "staging", "production", "test", "Production"]


@query(f"SELECT n_nationkey, {_quoted(_ENVIRONMENTS)}[n_nationkey % 5 + 1] IN ('development', 'staging', 'production') AS sound FROM nation")
def environments(spark, folder):
    return read(spark, folder, "nation").select("n_nationkey", access.sound_environment(_pick(_ENVIRONMENTS, F.col("n_nationkey"))).alias("sound"))


# ---- files and ingest

_UPLOAD = "source || ['.pdf', '.docx', '.doc', '.txt', '.md', '.html', '.xlsx', ''][doc_id % 8 + 1]"


@query(f"""
    WITH f AS (SELECT doc_id, {_UPLOAD} AS path, n_chars * 4000 AS length FROM documents), e AS (SELECT *, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS ext FROM f)
    SELECT doc_id, CASE WHEN ext NOT IN ('.pdf', '.docx', '.doc', '.txt', '.md', '.html', '.htm') THEN 'unsupported file type' WHEN length > 10485760 THEN 'too large' END AS refusal,
           CASE WHEN ext = '.pdf' THEN 'expected application/pdf, found text/plain' WHEN ext = '.docx' THEN 'expected application/vnd.openxmlformats-officedocument.wordprocessingml.document, found text/plain'
                WHEN ext = '.xlsx' THEN 'expected application/vnd.openxmlformats-officedocument.spreadsheetml.sheet, found text/plain' END AS media_warning FROM e
""")
def upload_validation(spark, folder):
    rows = read(spark, folder, "documents").withColumn("path", F.concat("source", _pick([".pdf", ".docx", ".doc", ".txt", ".md", ".html", ".xlsx", ""], F.col("doc_id"))))
    return rows.select("doc_id", loaders.upload_refusal(F.col("path"), F.col("n_chars") * 4000).alias("refusal"), loaders.media_warning(F.col("path"), F.lit("text/plain")).alias("media_warning"))


def _turns(spark, folder):
    """Conversations as documents, their turns as paragraphs; the category is a rest of the id."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    docs = read(spark, folder, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["text"]), "\n\n").alias("content"))
    return docs.select(F.col("conv_id").alias("doc_id"), "content", F.concat(F.lit("c"), (F.col("conv_id") % 5).cast("string")).alias("document_category"))


def _paragraphs(docs, keep):
    rows = docs.select("doc_id", *keep, F.posexplode(chunking.paragraph_chunks(F.col("content"), 40)).alias("chunk_index", "content"))
    return rows.withColumn("chunk_id", F.format_string("%s_chunk_%04d", F.col("doc_id").cast("string"), "chunk_index"))


_CHUNKED_SQL = ORACLES["chunk_paragraph"].strip().removesuffix("SELECT conv_id, unnest(range(0, len(chunks)))::INT AS chunk_index, unnest(chunks) AS content FROM ended").rstrip()


@query(f"{_CHUNKED_SQL} SELECT count(*) AS documents, count(*) FILTER (len(chunks) = 0) AS empty, coalesce(sum(len(chunks)), 0)::BIGINT AS chunks, 0::BIGINT AS stored FROM ended")
def ingest_dry_run(spark, folder):
    return ingest.ingest(_turns(spark, folder), None, ["document_category"], _paragraphs, dry_run=True)[0]


@query(f"{_CHUNKED_SQL} SELECT count(*) AS documents, count(*) FILTER (len(chunks) = 0) AS empty, coalesce(sum(len(chunks)), 0)::BIGINT AS chunks, coalesce(sum(len(chunks)), 0)::BIGINT AS stored FROM ended")
def ingest_stored(spark, folder):
    """The storing run: chunks with vectors are put into a table, twice, and what the table holds of them is counted."""
    schema = "doc_id long, document_category string, chunk_index int, content string, chunk_id string, vector array<float>"
    store = ChunkStore(spark, scratch(spark, "chunks"), schema, partition="document_category", settings={"dimension": 64})
    for _ in range(2):
        found = ingest.ingest(_turns(spark, folder), store, ["document_category"], _paragraphs)[0]
    return found


@query(f"{_CHUNKED_SQL} SELECT 'c' || (conv_id % 5) AS document_category, sum(len(chunks))::BIGINT AS chunks, min(conv_id || '_chunk_0000') AS first_chunk FROM ended WHERE len(chunks) > 0 GROUP BY 1")
def ingest_by_category(spark, folder):
    return ingest.ingest(_turns(spark, folder), None, ["document_category"], _paragraphs, dry_run=True)[1]


@query(f"{_CHUNKED_SQL} SELECT conv_id AS doc_id, len(chunks) AS chunks FROM ended WHERE len(chunks) > 0")
def document_list(spark, folder):
    return chunking.listed(chunking.payload(_paragraphs(_turns(spark, folder), ["document_category"])))


@query(f"""
    WITH k AS (SELECT doc_id, md5('hashed:' || text) AS key, text FROM documents), known AS (SELECT DISTINCT key FROM k WHERE doc_id % 3 = 0),
    n AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS place, count(*) AS n FROM (SELECT doc_id, unnest({_words('lower(text)')}) AS w FROM k) GROUP BY ALL),
    long AS (SELECT doc_id, sqrt(sum(n * n)) AS size FROM n GROUP BY doc_id),
    said AS (SELECT doc_id, place, coalesce(n / size, 0)::FLOAT AS x FROM (SELECT doc_id, unnest(range(64)) AS place FROM k) LEFT JOIN n USING (doc_id, place) LEFT JOIN long USING (doc_id))
    SELECT doc_id, key IN (SELECT key FROM known) AS cached, CASE WHEN key IN (SELECT key FROM known) THEN 0 ELSE ceil(length(text) / 4.0) END::INT AS tokens, vector FROM k
    JOIN (SELECT doc_id, string_agg(printf('%.5f', x::DOUBLE), ',' ORDER BY place) AS vector FROM said GROUP BY doc_id) USING (doc_id)
""")
def embed_cached(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", "text")
    model = retrieval.hashed_terms(64)
    cached = docs.where("doc_id % 3 = 0").select(retrieval.cache_key("hashed", F.col("text")).alias("key"), retrieval.embedder(model, 64)("text").alias("vector"))
    vector = F.array_join(F.transform("vector", lambda x: fixed(x, 5)), ",")
    return retrieval.embedded(docs, cached, "hashed", model, 64).select("doc_id", "cached", "tokens", vector.alias("vector"))


@query(f"""
    WITH k AS (SELECT doc_id, md5('hashed:' || text) AS key, text FROM documents), known AS (SELECT DISTINCT key FROM k WHERE doc_id % 3 <> 0),
    n AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS place, count(*) AS n FROM (SELECT doc_id, unnest({_words('lower(text)')}) AS w FROM k) GROUP BY ALL),
    long AS (SELECT doc_id, sqrt(sum(n * n)) AS size FROM n GROUP BY doc_id),
    said AS (SELECT doc_id, place, coalesce(n / size, 0)::FLOAT AS x FROM (SELECT doc_id, unnest(range(64)) AS place FROM k) LEFT JOIN n USING (doc_id, place) LEFT JOIN long USING (doc_id))
    SELECT doc_id, key IN (SELECT key FROM known) AS known, vector FROM k
    JOIN (SELECT doc_id, string_agg(printf('%.5f', x::DOUBLE), ',' ORDER BY place) AS vector FROM said GROUP BY doc_id) USING (doc_id)
""")
def embed_lasting(spark, folder):
    """Two thirds of the documents fill a cache, all are embedded through it, it is compacted and asked again."""
    docs = read(spark, folder, "documents").select("doc_id", "text")
    cache = EmbeddingCache(spark, scratch(spark, "cache"), "hashed", retrieval.hashed_terms(64), 64)
    cache.fill(docs.where("doc_id % 3 <> 0"))
    known = docs.where("doc_id % 3 <> 0").select(retrieval.cache_key("hashed", F.col("text")).alias("key"), F.lit(True).alias("known")).distinct()
    cache.embedded(docs)
    cache.compact()
    vector = F.array_join(F.transform("vector", lambda x: fixed(x, 5)), ",")
    return cache.embedded(docs).join(known, "key", "left").select("doc_id", F.coalesce("known", F.lit(False)).alias("known"), vector.alias("vector"))


@query("SELECT doc_id, text <> '' AND md5('hashed:' || text) IN (SELECT md5('hashed:' || text) FROM documents WHERE doc_id % 3 = 0) AS hit FROM documents WHERE md5('hashed:' || text) IN (SELECT md5('hashed:' || text) FROM documents WHERE doc_id % 3 = 0)")
def embed_cache_hits(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", "text")
    cached = docs.where("doc_id % 3 = 0").select(retrieval.cache_key("hashed", F.col("text")).alias("key"), F.array(F.lit(1.0)).alias("vector"))
    return retrieval.cache_hits(docs, cached, "hashed").select("doc_id", (F.col("text") != "").alias("hit"))


# ---- retrieval within a document

_WITHIN_SQL = """
    chunks AS (SELECT vec_id // 50 AS document_id, vec_id AS chunk_id, embedding::DOUBLE[] AS vector FROM embeddings),
    asked AS (SELECT chunk_id AS query_id, document_id, CASE WHEN document_id % 4 <> 0 THEN vector END AS query_vector FROM chunks WHERE chunk_id % 20 = 0),
    near AS (SELECT query_id, document_id, chunk_id, round(list_distance(vector, query_vector), 10) AS distance FROM chunks JOIN asked USING (document_id) WHERE query_vector IS NOT NULL),
    hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id)::INT AS rank FROM near)
"""


def _chunk_vectors(spark, folder):
    """Fifty vectors are a document's chunks; every chunk whose id is divisible by 20 asks within its document, without a vector in
    every fourth document."""
    chunks = read(spark, folder, "embeddings").select(F.expr("vec_id DIV 50").alias("document_id"), F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return chunks, chunks.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "document_id", F.when(F.col("document_id") % 4 != 0, F.col("vector")).alias("query_vector"))


@query(f"WITH {_WITHIN_SQL} SELECT query_id, document_id, chunk_id, round(distance, 6) AS distance, rank FROM hits WHERE rank <= 20")
def within_document(spark, folder):
    return retrieval.within_document(*_chunk_vectors(spark, folder), 20)


@query(f"""
    WITH {_WITHIN_SQL}, first AS (SELECT document_id, chunk_id, row_number() OVER (PARTITION BY document_id ORDER BY chunk_id)::INT AS rank FROM chunks)
    SELECT query_id, document_id, chunk_id, rank, true AS found FROM hits WHERE rank <= 20
    UNION ALL SELECT query_id, document_id, f.chunk_id, f.rank, false FROM asked JOIN first f USING (document_id) WHERE query_vector IS NULL AND f.rank <= 20
""")
def found_or_first_chunks(spark, folder):
    return retrieval.found_or_first(*_chunk_vectors(spark, folder), 20)


# ---- prompts and test cases


@query("SELECT DISTINCT user_role, md5(prompt) AS prompt_md5 FROM (SELECT " + _quoted(_NAMES) + "[user_id % 6 + 1] AS user_role FROM events) JOIN (VALUES " + ", ".join(f"('{r}', '{rules.SYSTEM} {rules.TONE.get(r, rules.TONE['customer'])}')" for r in _NAMES) + ") p(role, prompt) ON role = user_role")
def role_prompts(spark, folder):
    users = read(spark, folder, "events").select(_pick(_NAMES, F.col("user_id")).alias("user_role")).distinct()
    return users.select("user_role", F.md5(answers.system_prompt(F.col("user_role"))).alias("prompt_md5"))


_KINDS_SQL = f"list_filter({_quoted(rules.TEST_TYPES)}, lambda t: (conv_id + length(t)) % 3 <> 0)"
_EXAMPLES_SQL = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in rules.EXAMPLES.items()) + "}"


@query(f"""
    WITH r AS (SELECT conv_id, list(text ORDER BY turn) AS chunks, {_KINDS_SQL} AS kinds FROM conversations GROUP BY conv_id)
    SELECT conv_id, md5('REQUIREMENTS:' || chr(10) || array_to_string(chunks[1:20], chr(10) || chr(10) || '---' || chr(10) || chr(10)) || chr(10) || chr(10) || 'Write up to 50 test cases of these types: ' || array_to_string(kinds, ', ') || '.' || chr(10)
           || 'Each names the requirement it tests. After the JSON array, on a line of its own: {{"coverage_gaps": [...]}}.' || chr(10) || chr(10) || 'EXAMPLES:' || chr(10)
           || array_to_string(list_transform(list_filter(kinds, lambda t: list_contains({_quoted(rules.EXAMPLES)}, t)), lambda t: {_EXAMPLES_SQL}[t]), chr(10))) AS prompt_md5 FROM r
""")
def case_prompts(spark, folder):
    kinds = F.filter(F.array(*map(F.lit, rules.TEST_TYPES)), lambda t: (F.col("conv_id") + F.length(t)) % 3 != 0)
    rows = read(spark, folder, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]).alias("chunks"))
    return testcases.prompts(rows.withColumn("test_types", kinds)).select("conv_id", F.md5("prompt").alias("prompt_md5"))


@query("SELECT conv_id, 'Case ' || conv_id AS title, 1 AS cases, 'gap' AS gaps FROM (SELECT DISTINCT conv_id FROM conversations)")
def case_generation(spark, folder):
    """The prompt, a stand-in model that answers with one case and one gap, and the parser."""
    rows = read(spark, folder, "conversations").groupBy("conv_id").agg(F.collect_list("text").alias("chunks")).withColumn("test_types", F.array(F.lit("edge")))
    model = lambda prompt: F.when(F.contains(prompt, F.lit("types: edge.")), F.concat(F.lit('```json\n[{"title": "Case '), F.col("conv_id").cast("string"), F.lit('", "test_type": "edge"}]\n```\n{"coverage_gaps": ["gap"]}')))
    found = testcases.generated(rows, model)
    return found.select("conv_id", F.col("cases")[0]["title"].alias("title"), F.size("cases").alias("cases"), F.array_join("coverage_gaps", "|").alias("gaps"))


_FORMATS = ["csv", "json", "jira", "pdf"]


@query(f"""
    WITH asked AS (SELECT c_custkey AS document_id, {_quoted(_FORMATS)}[c_custkey % 4 + 1] AS format FROM customer), n AS (SELECT o_custkey AS document_id, count(*) AS cases FROM orders GROUP BY 1)
    SELECT document_id, format, coalesce(cases, 0) AS cases, CASE WHEN format = 'pdf' THEN 'unknown format' WHEN document_id % 7 = 0 THEN 'not found' WHEN cases IS NULL THEN 'no cases' ELSE 'ready' END AS outcome FROM asked LEFT JOIN n USING (document_id)
""")
def export_outcomes(spark, folder):
    asked = read(spark, folder, "customer").select(F.col("c_custkey").alias("document_id"), _pick(_FORMATS, F.col("c_custkey")).alias("format"))
    cases = read(spark, folder, "orders").select(F.col("o_custkey").alias("document_id"))
    return testcases.outcomes(asked, cases, asked.where("document_id % 7 <> 0")).select("document_id", "format", "cases", "outcome")


# ---- evaluation


@query(r"""
    WITH s AS (
        SELECT 'eval_' || item_id AS sample_id, left(text, 60) AS question, regexp_extract_all(text, '[A-Z][a-z]+') AS cited, ['eligibility', 'process', 'rates'][item_id % 3 + 1] AS category, text AS truth, CASE WHEN item_id % 2 = 0 THEN 'fha' ELSE '' END AS loan FROM benchmark)
    SELECT sample_id, question, len(cited)::INT AS citations, category, md5(truth) AS truth_md5, loan AS loan_type FROM s ORDER BY sample_id LIMIT 100
""")
def eval_first_samples(spark, folder):
    """Benchmark items as an evaluation set with its ground truth, of which a run takes the first hundred by id."""
    c = F.col
    rows = read(spark, folder, "benchmark").select(
        F.concat(F.lit("eval_"), c("item_id").cast("string")).alias("sample_id"), F.left("text", F.lit(60)).alias("question"), F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0)).alias("regulatory_citations"),
        _pick(["eligibility", "process", "rates"], c("item_id")).alias("category"), c("text").alias("ground_truth_answer"), F.when(c("item_id") % 2 == 0, "fha").otherwise("").alias("expected_loan_type"))
    found = answers.eval_samples(spark, 100, rows)
    return found.select("sample_id", "question", F.size("regulatory_citations").alias("citations"), "category", F.md5("ground_truth_answer").alias("truth_md5"), F.col("expected_loan_type").alias("loan_type"))


@query("""
    WITH e AS (SELECT event_type, CASE WHEN event_id % 11 <> 0 THEN value * 10 ELSE 0 END AS latency, CASE WHEN event_id % 7 <> 0 THEN user_id ELSE 0 END AS tokens, user_id / 1e5 AS cost FROM events),
    p AS (SELECT event_type, latency, row_number() OVER (PARTITION BY event_type ORDER BY latency) AS place, count(*) OVER (PARTITION BY event_type) AS n FROM e)
    SELECT e.event_type, round(avg(e.latency), 6) AS avg_latency_ms, round(avg(tokens), 6) AS avg_tokens, round(avg(cost), 8) AS avg_cost_usd, sum(tokens)::BIGINT AS total_tokens, any_value(p.latency) AS p95_latency_ms
    FROM e JOIN p ON p.event_type = e.event_type AND place = least(floor(n * 0.95) + 1, n) GROUP BY e.event_type
""")
def eval_performance(spark, folder):
    rows = read(spark, folder, "events").select(
        "event_type", F.when(F.col("event_id") % 11 != 0, F.col("value") * 10).alias("latency_ms"), F.when(F.col("event_id") % 7 != 0, F.col("user_id")).alias("tokens"), (F.col("user_id") / 1e5).alias("cost_usd"))
    return metrics.performance(rows, ["event_type"])


# ---- metrics and audit

_SEEN_SQL = f"""
    seen AS (SELECT {_quoted(_NAMES)}[user_id % 5 + 1] AS user_role, event_type AS document_category, event_type <> 'error' AS success, event_id % 500 AS tokens_input, user_id % 100 AS tokens_output, 'm' || (event_id % 2) AS model,
        (event_id % 500) / 1e6 AS cost_usd, [value / 100, value / 50] AS scores, event_id % 3 = 0 AS cache_hit FROM events),
    observed AS (
        SELECT 'queries_total' AS metric, 'user_role="' || user_role || '",document_category="' || document_category || '",success="' || success || '"' AS labels, 1::DOUBLE AS value FROM seen
        UNION ALL SELECT 'token_usage_total', 'model="' || model || '",token_type="input"', tokens_input FROM seen
        UNION ALL SELECT 'token_usage_total', 'model="' || model || '",token_type="output"', tokens_output FROM seen
        UNION ALL SELECT 'cost_usd_total', 'model="' || model || '",operation="generation"', cost_usd FROM seen
        UNION ALL SELECT 'cache_hits_total', 'cache_type="query",result="' || CASE WHEN cache_hit THEN 'hit' ELSE 'miss' END || '"', 1 FROM seen
        UNION ALL SELECT 'retrieval_score', 'user_role="' || user_role || '"', unnest(scores) FROM seen)
"""


def _observations(spark, folder):
    c = F.col
    rows = read(spark, folder, "events").select(
        _pick(_NAMES[:5], c("user_id")).alias("user_role"), c("event_type").alias("document_category"), (c("event_type") != "error").alias("success"), (c("event_id") % 500).alias("tokens_input"), (c("user_id") % 100).alias("tokens_output"),
        F.concat(F.lit("m"), (c("event_id") % 2).cast("string")).alias("model"), ((c("event_id") % 500) / 1e6).alias("cost_usd"), F.array(c("value") / 100, c("value") / 50).alias("retrieval_scores"), (c("event_id") % 3 == 0).alias("cache_hit"))
    return metrics.observations(rows)


@query(f"WITH {_SEEN_SQL} SELECT metric, labels, count(*) AS observations, round(sum(value), 4) AS total FROM observed GROUP BY ALL")
def query_metrics(spark, folder):
    return _observations(spark, folder).groupBy("metric", "labels").agg(F.count("*").alias("observations"), F.round(F.sum("value"), 4).alias("total"))


@query(f"""
    WITH {_SEEN_SQL},
    sums AS (SELECT metric, labels, sum(value) AS value FROM observed WHERE metric <> 'retrieval_score' GROUP BY ALL),
    scored AS (SELECT labels, value FROM observed WHERE metric = 'retrieval_score'),
    buckets AS (SELECT labels, unnest({_quoted([*map(str, rules.BUCKETS["retrieval_score"]), "+Inf"])}) AS le, unnest([{", ".join([f"count(*) FILTER (value <= {x})" for x in rules.BUCKETS["retrieval_score"]] + ["count(value)"])}]) AS n FROM scored GROUP BY labels)
    SELECT printf('%s{{%s}} %.6f', metric, labels, value) AS line FROM sums
    UNION ALL SELECT printf('retrieval_score_bucket{{%s,le="%s"}} %d', labels, le, n) FROM buckets
    UNION ALL SELECT printf('retrieval_score_sum{{%s}} %.6f', labels, round(sum(value), 6)) FROM scored GROUP BY labels
    UNION ALL SELECT printf('retrieval_score_count{{%s}} %d', labels, count(value)) FROM scored GROUP BY labels
""")
def metrics_exposition(spark, folder):
    return metrics.exposition(_observations(spark, folder))


@query(f"""
    WITH {SCANNED_SQL}, kinds AS (SELECT doc_id, list_transform(v, lambda x: x.kind) AS kinds, should_block FROM checked)
    SELECT 'compliance_violations_total' AS metric, 'violation_type="' || kind || '",severity="high",regulation="mixed"' AS labels, count(*)::DOUBLE AS total FROM (SELECT unnest(kinds) AS kind FROM kinds) GROUP BY ALL
    UNION ALL SELECT 'blocked_queries_total', 'block_reason="compliance"', count(*)::DOUBLE FROM kinds WHERE should_block
    UNION ALL SELECT 'pii_detections_total', 'pii_type="email",location="query"', count(*)::DOUBLE FROM said WHERE doc_id % 9 = 0
""")
def security_metrics(spark, folder):
    checked = guardrails.checked(_said(spark, folder), "text")
    rows = checked.select(F.when(F.col("doc_id") % 9 == 0, F.array(F.lit("email"))).otherwise(F.array().cast("array<string>")).alias("pii_types"), F.transform("violations", lambda v: v["violation_type"]).alias("violation_types"), F.when(F.col("should_block"), "compliance").alias("block_reason"))
    return metrics.security_observations(rows).groupBy("metric", "labels").agg(F.sum("value").alias("total"))


@query(f"WITH {SCANNED_SQL} SELECT doc_id, len(list_filter(v, lambda x: x.severity = 'critical'))::INT AS critical, len(list_filter(v, lambda x: x.severity = 'high'))::INT AS high FROM checked")
def violation_levels(spark, folder):
    found = guardrails.violations(F.col("text"))
    rows = _said(spark, folder).withColumn("v", found)
    return rows.select("doc_id", F.size(guardrails.of_severity(F.col("v"), "critical")).alias("critical"), F.size(guardrails.of_severity(F.col("v"), "high")).alias("high"))


@query("""
    SELECT 'a' || event_id AS event_id, CASE WHEN event_type = 'error' THEN 'LOGIN_FAILURE' ELSE 'LOGIN_SUCCESS' END AS event_type, user_id, event_type = 'error' AS was_blocked, CASE WHEN event_type = 'error' THEN 'bad password' END AS block_reason, NULL AS severity FROM events
    UNION ALL SELECT 's' || event_id, 'SECURITY_ALERT', user_id, false, event_type, CASE WHEN value > 50 THEN 'critical' ELSE 'high' END FROM events
""")
def audit_built(spark, folder):
    events, failed = read(spark, folder, "events"), F.col("event_type") == "error"
    signed_in = metrics.auth_events(events.select(F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("event_id"), F.when(failed, "LOGIN_FAILURE").otherwise("LOGIN_SUCCESS").alias("event_type"), "user_id", (~failed).alias("success"), F.when(failed, "bad password").alias("failure_reason")))
    alerts = metrics.security_events(events.select(F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("event_id"), F.lit("SECURITY_ALERT").alias("event_type"), "user_id", F.col("event_type").alias("description"), F.when(F.col("value") > 50, "critical").alias("severity"), F.lit(None).cast("boolean").alias("was_blocked")))
    return signed_in.unionByName(alerts, allowMissingColumns=True)


@query("SELECT event_id AS source_id, h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS event_id, '2024-01-01T00:00:00+00:00' AS ts FROM (SELECT event_id, md5(event_id || '|' || user_id) AS h FROM events)")
def audit_stamped(spark, folder):
    rows = read(spark, folder, "events").select(F.col("event_id").alias("source_id"), "user_id")
    return metrics.stamped(rows, "2024-01-01T00:00:00+00:00", ["source_id", "user_id"]).select("source_id", "event_id", "ts")


# ---- spans, least scores, failing models


@query("""
    WITH s AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000000 AS start, epoch_us(ts) // 1000000 + floor(value)::BIGINT * 60 AS "end" FROM events)
    SELECT event_id, start, "end" FROM s WHERE event_type IN ('view', 'click') AND NOT EXISTS (SELECT 1 FROM s f WHERE f.event_type = 'error' AND f.user_id = s.user_id AND f.start < s."end" AND s.start < f."end")
""")
def spans_kept(spark, folder):
    """Views and clicks that last some minutes, but for those that meet an error of their user's."""
    start = F.expr("unix_micros(cast(ts AS timestamp)) DIV 1000000")
    rows = read(spark, folder, "events").select("event_id", "user_id", "event_type", start.alias("start"), (start + F.floor("value") * 60).alias("end"))
    kept = guardrails.without_overlaps(rows.where(F.col("event_type").isin("view", "click")), rows.where("event_type = 'error'"), "user_id")
    return kept.select("event_id", "start", "end")


@query(f"WITH {DENSE_SQL}, {SPARSE_SQL}, {FUSED_SQL}, cut AS (SELECT query_id, doc_id, rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, dense_rank NULLS LAST, doc_id)::INT AS rank FROM fused) SELECT * FROM cut WHERE rank <= 10 AND rrf >= 0.0102")
def hybrid_least(spark, folder):
    """Fused lists, ids of one list included, with a least fused score after the cut."""
    return retrieval.hybrid(*_lists(spark, folder), 10, "doc_id", least=0.0102, keep_sparse_only=True).select("query_id", "doc_id", "rrf", "rank")


@query(f"""
    WITH {SPARSE_SQL},
    scored AS (SELECT query_id, doc_id, rank, CASE WHEN query_id % 3 <> 0 AND doc_id % 4 <> 0 THEN round(1.0 / (1 + doc_id % 7), 6) END AS s FROM sparse WHERE rank <= 20),
    cut AS (SELECT query_id, doc_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY s DESC NULLS LAST, rank, doc_id)::INT AS rerank_rank FROM scored)
    SELECT * FROM cut WHERE rerank_rank <= 5
""")
def rerank_failed(spark, folder):
    """A reranker that fails on every third query and every fourth document: these keep their first order behind the others."""
    found = retrieval.bm25(read(spark, folder, "documents"), _questions(spark, folder), 20)
    score = F.when((F.col("query_id") % 3 != 0) & (F.col("doc_id") % 4 != 0), F.round(1.0 / (1 + F.col("doc_id") % 7), 6))
    rows = found.withColumns({"question": F.lit(""), "content": F.lit("")})
    return retrieval.rerank(rows, 5, "doc_id", score=score).select("query_id", "doc_id", "rank", "rerank_rank")
