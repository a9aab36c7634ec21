"""The query catalogue: each query runs operators over whole tables of a folder, beside SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import rules
from corpusmill.operators import answers, chunking, classify, guardrails, metrics, retrieval, testcases
from corpusmill.plans import bindings
from corpusmill.plans.answering import answer
from corpusmill.sources import loaders
from corpusmill.streaming import limits

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
read, documents = bindings.read, bindings.documents


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _quoted(values) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in values) + "]"


DOCS_SQL = "docs AS (SELECT doc_id, text AS content, source AS source_file, lang, ['public', 'internal', 'confidential', 'restricted'][doc_id % 4 + 1] AS access_level FROM documents)"
WORDS_SQL = r"list_filter(string_split_regex({}, '[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+'), lambda w: w <> '')"


def _words(x: str) -> str:
    return WORDS_SQL.format(x)


# ---- classification and document handling

_CATEGORY_SQL = ", ".join(f"{{'score': len(list_filter({_quoted(words)}, lambda k: contains(lower(content), k) OR contains(lower(source_file), k))), 'ord': {-n}, 'name': '{name}'}}" for n, (name, words) in enumerate(rules.CATEGORY_KEYWORDS.items()))
_TAGS_SQL = ", ".join(f"CASE WHEN len(list_filter({_quoted(words)}, lambda k: contains(lower(content), k))) > 0 THEN '{name}' END" for name, words in rules.TAG_KEYWORDS.items())
CLASSIFIED_SQL = f"classified AS (SELECT *, CASE WHEN best.score > 0 THEN best.name ELSE 'general' END AS document_category FROM (SELECT *, list_max([{_CATEGORY_SQL}]) AS best, list_filter([{_TAGS_SQL}], lambda t: t IS NOT NULL) AS regulatory_tags FROM docs))"


@query(f"WITH {DOCS_SQL}, {CLASSIFIED_SQL} SELECT doc_id, document_category, array_to_string(regulatory_tags, ',') AS tags FROM classified")
def doc_category_tags(spark, folder):
    return classify.classified(documents(spark, folder)).select("doc_id", "document_category", F.array_join("regulatory_tags", ",").alias("tags"))


@query(f"WITH {DOCS_SQL}, {CLASSIFIED_SQL} SELECT document_category, count(*) AS n, min(doc_id) AS first_doc FROM classified GROUP BY 1")
def category_counts(spark, folder):
    return classify.classified(documents(spark, folder)).groupBy("document_category").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("SELECT doc_id, 'doc_' || left(sha256(text), 16) AS content_id, sha256(text) AS sha256_hash, md5('stub:' || text) AS cache_key FROM documents")
def doc_ids_sha(spark, folder):
    return read(spark, folder, "documents").select("doc_id", F.concat(F.lit("doc_"), F.left(F.sha2("text", 256), F.lit(16))).alias("content_id"), F.sha2("text", 256).alias("sha256_hash"), F.md5(F.concat(F.lit("stub:"), "text")).alias("cache_key"))


@query("SELECT sha256(text) AS sha256_hash, min(doc_id) AS kept, count(*) AS copies FROM documents GROUP BY 1")
def doc_dedup_hash(spark, folder):
    return read(spark, folder, "documents").groupBy(F.sha2("text", 256).alias("sha256_hash")).agg(F.min("doc_id").alias("kept"), F.count("*").alias("copies"))


_NAME = "source || ['.pdf', '.docx', '.txt', '.xlsx', '.csv', '.mp4', '.html', ''][doc_id % 8 + 1]"


@query(f"""
    WITH f AS (SELECT doc_id, {_NAME} AS path, n_chars * 4000 AS length, text FROM documents),
    e AS (SELECT *, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS ext FROM f)
    SELECT doc_id, ext, CASE WHEN ext NOT IN ('.pdf', '.docx', '.txt', '.xlsx', '.csv') THEN 'unsupported file type' WHEN length > 52428800 THEN 'too large' WHEN NOT regexp_matches(text, '\\S') THEN 'empty' END AS refusal FROM e
""")
def file_validation(spark, folder):
    kinds = F.array(*map(F.lit, [".pdf", ".docx", ".txt", ".xlsx", ".csv", ".mp4", ".html", ""]))
    rows = read(spark, folder, "documents").withColumn("path", F.concat("source", F.element_at(kinds, (F.col("doc_id") % 8 + 1).cast("int"))))
    refused = F.coalesce(loaders.refusal(F.col("path"), F.col("n_chars") * 4000), F.when(~F.regexp_like("text", F.lit(r"\S")), "empty"))
    return rows.select("doc_id", loaders.extension(F.col("path")).alias("ext"), refused.alias("refusal"))


@query("SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS text FROM pages")
def html_strip(spark, folder):
    return read(spark, folder, "pages").select("page_id", loaders.html_text(F.col("html")).alias("text"))


# ---- chunking


@query(f"""
    WITH RECURSIVE joined AS (SELECT conv_id, string_agg(text, E'\\n\\n' ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
    segments AS (SELECT conv_id, list_filter(list_transform(string_split_regex(text, '\\n{{2,}}'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS s FROM joined),
    fold(conv_id, s, i, buf, n, done) AS (
        SELECT conv_id, s, 1, '', 0, []::VARCHAR[] FROM segments
        UNION ALL
        SELECT conv_id, s, i + 1,
               CASE WHEN n + len({_words('s[i]')}) > 40 OR buf = '' THEN s[i] ELSE buf || E'\\n\\n' || s[i] END,
               CASE WHEN n + len({_words('s[i]')}) > 40 THEN len({_words('s[i]')}) ELSE n + len({_words('s[i]')}) END,
               CASE WHEN n + len({_words('s[i]')}) > 40 AND buf <> '' THEN list_append(done, buf) ELSE done END
        FROM fold WHERE i <= len(s)),
    ended AS (SELECT conv_id, CASE WHEN buf <> '' THEN list_append(done, buf) ELSE done END AS chunks FROM fold WHERE i = len(s) + 1)
    SELECT conv_id, unnest(range(0, len(chunks)))::INT AS chunk_index, unnest(chunks) AS content FROM ended
""")
def chunk_paragraph(spark, folder):
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    joined = read(spark, folder, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["text"]), "\n\n").alias("text"))
    return joined.select("conv_id", F.posexplode(chunking.paragraph_chunks(F.col("text"), 40)).alias("chunk_index", "content"))


@query()
def chunk_recursive(spark, folder):
    return chunking.recursive_chunks(documents(spark, folder), "doc_id", "content", keep=["source_file", "access_level"])


@query(r"""
    WITH t AS (SELECT doc_id, substr(regexp_replace(text, '^\s+|\s+$', '', 'g'), 1, 200) AS h FROM (
        SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN E'1.2 Terms of the Loan\n' || text WHEN 1 THEN E'ELIGIBILITY RULES\n' || text WHEN 2 THEN E'# Overview of Rates\n' || text WHEN 3 THEN E'[Page 3]\n' || text ELSE text END AS text FROM documents))
    SELECT doc_id, CASE
        WHEN regexp_matches(h, '(?m)^(\d+\.[\d\.]*)\s+([A-Z][^\n]{3,80})$') THEN nullif(regexp_replace(regexp_extract(h, '(?m)^(\d+\.[\d\.]*)\s+([A-Z][^\n]{3,80})$', 2), '^\s+|\s+$', '', 'g'), '')
        WHEN regexp_matches(h, '(?m)^([A-Z][A-Z\s]{4,60})$') THEN nullif(regexp_replace(regexp_extract(h, '(?m)^([A-Z][A-Z\s]{4,60})$', 1), '^\s+|\s+$', '', 'g'), '')
        WHEN regexp_matches(h, '(?m)^([A-Z][a-zA-Z\s]{4,60}):$') THEN nullif(regexp_replace(regexp_extract(h, '(?m)^([A-Z][a-zA-Z\s]{4,60}):$', 1), '^\s+|\s+$', '', 'g'), '')
        WHEN regexp_matches(h, '(?m)^#{1,4}\s+(.+)$') THEN nullif(regexp_replace(regexp_extract(h, '(?m)^#{1,4}\s+(.+)$', 1), '^\s+|\s+$', '', 'g'), '')
        END AS section_title FROM t
""")
def chunk_section(spark, folder):
    k, text = F.col("doc_id") % 5, F.col("text")
    headed = F.when(k == 0, F.concat(F.lit("1.2 Terms of the Loan\n"), text)).when(k == 1, F.concat(F.lit("ELIGIBILITY RULES\n"), text)).when(k == 2, F.concat(F.lit("# Overview of Rates\n"), text)).when(k == 3, F.concat(F.lit("[Page 3]\n"), text)).otherwise(text)
    return read(spark, folder, "documents").select("doc_id", chunking.section_title(headed).alias("section_title"))


# ---- retrieval

QUERY_VECTORS_SQL = "q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS query_vector FROM embeddings WHERE vec_id % 20 = 0)"
COSINE_SQL = "round(list_dot_product(query_vector, e.embedding::DOUBLE[]) / sqrt(list_dot_product(query_vector, query_vector) * list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 10)"


def _asked(spark, folder):
    """Every row whose id is divisible by 20: the query side grows with the table."""
    return read(spark, folder, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def _knn_sql(where: str, k: int) -> str:
    return f"WITH {QUERY_VECTORS_SQL}, s AS (SELECT query_id, vec_id, {COSINE_SQL} AS score FROM q, embeddings e WHERE {where}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s WHERE score >= -2 {{}}) SELECT query_id, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= {k}"


@query(_knn_sql("true", 10).format(""))
def knn_topk(spark, folder):
    return retrieval.knn(read(spark, folder, "embeddings"), _asked(spark, folder), 10)


@query(_knn_sql("label IN (1, 3, 5)", 10).format(""))
def knn_filtered(spark, folder):
    return retrieval.knn(read(spark, folder, "embeddings"), _asked(spark, folder), 10, where=retrieval.matches(categories=[1, 3, 5], category=F.col("label")))


@query(_knn_sql("true", 20).format("AND score >= 0.2"))
def knn_threshold(spark, folder):
    return retrieval.knn(read(spark, folder, "embeddings"), _asked(spark, folder), 20, least=0.2)


@query("SELECT md5('stub:' || text) AS key, doc_id FROM documents WHERE md5('stub:' || text) NOT IN (SELECT md5('stub:' || text) FROM documents WHERE doc_id % 3 = 0)")
def embed_cache_misses(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", "text")
    cached = docs.where("doc_id % 3 = 0").select(F.md5(F.concat(F.lit("stub:"), "text")).alias("key"))
    return retrieval.cache_misses(docs, cached, "stub").select("key", "doc_id")


BM25_SQL = f"""
    parted AS MATERIALIZED (SELECT doc_id, {_words("lower(coalesce(text, ''))")} AS w FROM documents),
    tokens AS (SELECT doc_id, unnest(w) AS term, len(w) AS dl FROM parted),
    size AS (SELECT count(*) AS n_docs, avg(len(w)) AS avgdl FROM parted),
    postings AS (SELECT doc_id, term, dl, count(*) AS tf FROM tokens GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
    raw AS (SELECT term, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw, n_docs, avgdl FROM df, size),
    stats AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf, n_docs, avgdl FROM raw)
"""
ASKED_SQL = f"asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({_words('lower(text)')}) AS term FROM benchmark) GROUP BY ALL)"
SPARSE_SQL = f"""
    {BM25_SQL}, {ASKED_SQL},
    bm AS (SELECT query_id, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 10) AS score FROM postings JOIN stats USING (term) JOIN asked USING (term) GROUP BY ALL),
    sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM bm WHERE score > 0)
"""


@query(f"WITH {BM25_SQL} SELECT term, df, round(idf, 6) AS idf FROM stats")
def bm25_stats(spark, folder):
    return retrieval.bm25_stats(read(spark, folder, "documents"), "text").select("term", "df", F.round("idf", 6).alias("idf"))


def _questions(spark, folder):
    return read(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


@query(f"WITH {SPARSE_SQL} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM sparse WHERE rank <= 10")
def bm25_topk(spark, folder):
    return retrieval.bm25(read(spark, folder, "documents"), _questions(spark, folder), 10)


DENSE_SQL = f"""
    q AS (SELECT item_id AS query_id, embedding::DOUBLE[] AS query_vector FROM benchmark JOIN embeddings ON vec_id = item_id),
    near AS (SELECT query_id, vec_id AS doc_id, {COSINE_SQL} AS score FROM q, embeddings e),
    dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM near)
"""
FUSED_SQL = """
    lists AS (
        SELECT query_id, doc_id, 0.7 / (60 + rank) AS part, rank AS dense_rank FROM dense WHERE rank <= 20
        UNION ALL SELECT query_id, doc_id, 0.3 / (60 + rank), NULL FROM sparse WHERE rank <= 20),
    fused AS (SELECT query_id, doc_id, round(sum(part), 9) AS rrf, max(dense_rank) AS dense_rank FROM lists GROUP BY ALL)
"""


def _lists(spark, folder):
    asked = bindings.questions(spark, folder)
    dense = retrieval.knn(read(spark, folder, "embeddings").select("vec_id", "embedding"), asked.select("query_id", "query_vector"), 20).withColumnRenamed("vec_id", "doc_id")
    return dense, retrieval.bm25(read(spark, folder, "documents"), _questions(spark, folder), 20)


@query(f"WITH {DENSE_SQL}, {SPARSE_SQL}, {FUSED_SQL} SELECT query_id, doc_id, rrf, dense_rank FROM fused")
def rrf_fuse(spark, folder):
    return retrieval.fuse(*_lists(spark, folder), "doc_id").select("query_id", "doc_id", "rrf", "dense_rank")


@query(f"WITH {DENSE_SQL}, {SPARSE_SQL}, {FUSED_SQL}, cut AS (SELECT query_id, doc_id, rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, dense_rank, doc_id)::INT AS rank FROM fused WHERE dense_rank IS NOT NULL) SELECT * FROM cut WHERE rank <= 10")
def hybrid_topk(spark, folder):
    return retrieval.hybrid(*_lists(spark, folder), 10, "doc_id").select("query_id", "doc_id", "rrf", "rank")


_ROLE_SQL = "roles(role, levels, chunks) AS (VALUES " + ", ".join(f"('{r}', {_quoted(levels)}, {n})" for r, levels, _, n in rules.ROLES) + ")"


@query(f"""
    WITH {_ROLE_SQL}, {DOCS_SQL},
    asks AS (SELECT item_id AS query_id, {_quoted(r[0] for r in rules.ROLES)}[item_id % 5 + 1] AS user_role FROM benchmark),
    able AS (SELECT query_id, user_role, doc_id, least(chunks, 5) AS max_chunks FROM asks JOIN roles ON role = user_role JOIN docs ON list_contains(levels, access_level)),
    q AS (SELECT item_id AS query_id, embedding::DOUBLE[] AS query_vector FROM benchmark JOIN embeddings ON vec_id = item_id),
    near AS (SELECT query_id, doc_id, {COSINE_SQL} AS score FROM able JOIN q USING (query_id) JOIN embeddings e ON vec_id = doc_id),
    dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM near),
    {SPARSE_SQL.replace("FROM bm WHERE", "FROM bm JOIN able USING (query_id, doc_id) WHERE")}, {FUSED_SQL},
    cut AS (SELECT query_id, user_role, doc_id, rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, dense_rank, doc_id)::INT AS rank, max_chunks
            FROM fused JOIN able USING (query_id, doc_id) WHERE dense_rank IS NOT NULL)
    SELECT * FROM cut WHERE rank <= max_chunks
""")
def hybrid_rbac(spark, folder):
    """Both lists are cut after the role's filter, as the reference does; BM25 statistics are the whole corpus's."""
    asked = retrieval.with_role(bindings.questions(spark, folder))
    dense, sparse = retrieval.visible_lists(asked, documents(spark, folder), read(spark, folder, "embeddings").select("vec_id", "embedding"), 20, read(spark, folder, "benchmark"))
    fused = retrieval.fuse(dense, sparse, "doc_id").where("dense_rank IS NOT NULL")
    seen = fused.join(retrieval.small(asked.select("query_id", "user_role", "max_chunks"), read(spark, folder, "benchmark")), "query_id")
    cut = retrieval.top(seen, ["query_id"], rules.MOST_CHUNKS, [F.desc("rrf"), F.col("dense_rank"), F.col("doc_id")])
    return cut.where("rank <= max_chunks").select("query_id", "user_role", "doc_id", "rrf", "rank", "max_chunks")


@query(f"""
    WITH {SPARSE_SQL},
    found AS (SELECT s.query_id, s.doc_id, s.rank, list_distinct({_words('lower(b.text)')}) AS asked, list_distinct({_words('lower(d.text)')}) AS has FROM sparse s JOIN benchmark b ON b.item_id = s.query_id JOIN documents d USING (doc_id) WHERE s.rank <= 20),
    scored AS (SELECT query_id, doc_id, rank, round(len(list_intersect(asked, has)) / greatest(len(asked), 1), 6) AS rerank_score FROM found),
    cut AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, rank, doc_id)::INT AS rerank_rank FROM scored)
    SELECT * FROM cut WHERE rerank_rank <= 5
""")
def rerank_lexical(spark, folder):
    found = retrieval.bm25(read(spark, folder, "documents"), _questions(spark, folder), 20).join(retrieval.small(_questions(spark, folder)), "query_id")
    rows = read(spark, folder, "documents").select("doc_id", F.col("text").alias("content")).join(retrieval.small(found, read(spark, folder, "benchmark")), "doc_id")
    return retrieval.rerank(rows, 5, "doc_id").select("query_id", "doc_id", "rank", "rerank_score", "rerank_rank")


# ---- context, history, answers


@query(f"""
    WITH {SPARSE_SQL}, {DOCS_SQL}, {CLASSIFIED_SQL},
    found AS (SELECT query_id, rank, '[SOURCE ' || rank || '] ' || source_file || ' | Category: ' || document_category || ' | Regulatory: ' || coalesce(nullif(array_to_string(regulatory_tags, ', '), ''), 'General') || ' | Relevance: ' || printf('%.2f', round(score, 6)) || E'\\n---\\n' || content || E'\\n' AS block
              FROM sparse JOIN classified USING (doc_id) WHERE rank <= 10),
    used AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM found)
    SELECT query_id, count(*) AS n_sources, md5(string_agg(block, E'\\n\\n' ORDER BY rank)) AS context_md5 FROM used WHERE used <= 24000 GROUP BY query_id
""")
def context_budget(spark, folder):
    found = retrieval.bm25(read(spark, folder, "documents"), _questions(spark, folder), 10)
    # only what is found is classified
    rows = classify.classified(documents(spark, folder).join(retrieval.small(found, read(spark, folder, "benchmark")), "doc_id"))
    block = answers.source_block(F.col("rank"), F.col("source_file"), F.col("document_category"), F.col("regulatory_tags"), F.col("score"), F.lit(None).cast("string"), F.col("content"))
    return answers.contexts(answers.within_budget(rows.withColumn("block", block), "block"), "block").select("query_id", "n_sources", F.md5("context").alias("context_md5"))


@query("SELECT conv_id, turn, role, from_end FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC)::INT AS from_end FROM conversations) WHERE from_end <= 6")
def history_last6(spark, folder):
    return answers.last_turns(read(spark, folder, "conversations")).select("conv_id", "turn", "role", "from_end")


#: A stand-in answer: the second to fifth sentences of the text with a source; its context is another text of the same source.
ANSWERS_SQL = """
    paired AS (SELECT doc_id, text, source, lag(text) OVER (PARTITION BY source ORDER BY doc_id) AS context FROM documents),
    answers AS (SELECT doc_id, text AS answer, coalesce(context, '') AS context, CASE WHEN doc_id % 3 = 0 THEN text || ' [Source: ' || source || '.pdf] and (source: b.txt)' WHEN doc_id % 3 = 1 THEN 'According to ' || source || '.pdf, ' || text ELSE text END AS cited FROM paired)
"""


def _answers(spark, folder):
    k, text, source = F.col("doc_id") % 3, F.col("text"), F.col("source")
    cited = F.when(k == 0, F.concat(text, F.lit(" [Source: "), source, F.lit(".pdf] and (source: b.txt)"))).when(k == 1, F.concat(F.lit("According to "), source, F.lit(".pdf, "), text)).otherwise(text)
    docs = read(spark, folder, "documents")
    before = answers.with_previous(docs.select("source", "doc_id"), "source", "doc_id").select("doc_id", "previous")
    texts = docs.select(F.col("doc_id").alias("previous"), F.col("text").alias("context"))
    # ids alone are so few bytes that one task would take them, and with them all texts if these were sent to it: so the texts are dealt out
    rows = docs.join(before.hint("shuffle_hash"), "doc_id").join(texts.hint("merge"), "previous", "left")
    return rows.select("doc_id", text.alias("answer"), F.coalesce("context", F.lit("")).alias("context"), cited.alias("cited"))


def _keys(x: str, stop: list[str]) -> str:
    return f"list_filter(list_distinct({_words(x)}), lambda w: NOT list_contains({_quoted(stop)}, w))"


GROUNDED_SQL = rf"""
    sentences AS (SELECT doc_id, answer, context, list_filter(list_transform(string_split(answer, '.'), lambda s: regexp_replace(s, '^[\s\x0B\p{{Z}}]+|[\s\x0B\p{{Z}}]+$', '', 'g')), lambda s: length(s) > 20)[1:5] AS s FROM answers),
    scored AS (SELECT doc_id, answer, len(list_filter(s, lambda x: len({_keys('lower(x)', rules.GROUNDING_STOP)}) >= 3 AND len(list_filter({_keys('lower(x)', rules.GROUNDING_STOP)}, lambda w: contains(lower(context), w))) / len({_keys('lower(x)', rules.GROUNDING_STOP)}) >= 0.4)) / greatest(len(s), 1) AS score FROM sentences),
    grounded AS (SELECT doc_id, round(score, 6) AS score, score >= 0.3 OR len(list_filter({_quoted(rules.UNCERTAIN)}, lambda p: contains(lower(answer), p))) > 0 AS is_grounded FROM scored)
"""


@query(f"WITH {ANSWERS_SQL}, {GROUNDED_SQL} SELECT * FROM grounded")
def groundedness(spark, folder):
    a, c = F.col("answer"), F.col("context")
    rows = _answers(spark, folder).withColumn("share", answers.grounded_score(a, c))
    return rows.select("doc_id", F.round("share", 6).alias("score"), answers.is_grounded(a, c, F.col("share")).alias("is_grounded"))


@query(f"""
    WITH {ANSWERS_SQL},
    found AS (SELECT doc_id, list_concat(list_concat(regexp_extract_all(cited, '(?i)\\[Source:\\s*([^\\]]+)\\]', 1), regexp_extract_all(cited, '(?i)\\(Source:\\s*([^\\)]+)\\)', 1)), regexp_extract_all(cited, '(?i)According to ([^,\\.]+\\.(?:pdf|docx|txt))', 1)) AS c FROM answers)
    SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(c, lambda x: trim(x)))), '|') AS sources FROM found
""")
def citations(spark, folder):
    return _answers(spark, folder).select("doc_id", F.array_join(answers.citations(F.col("cited")), "|").alias("sources"))


@query("SELECT event_id, round((event_id % 5000 * 4) / 1e6 * 2.50 + (user_id * 7) / 1e6 * 10.00, 6) AS cost_usd FROM events")
def cost_estimate(spark, folder):
    return read(spark, folder, "events").select("event_id", answers.cost_usd(F.col("event_id") % 5000 * 4, F.col("user_id") * 7).alias("cost_usd"))


@query("SELECT doc_id, regexp_extract(source, '([^/]*)$', 1) AS source, round(n_chars / 7000.0, 3) AS score, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview FROM documents")
def source_citations(spark, folder):
    made = answers.source_citation(F.col("source"), F.col("n_chars") / 7000.0, F.col("text"))
    return read(spark, folder, "documents").select("doc_id", F.inline(F.array(made)))


# ---- guardrails

#: The look-aheads of the SSN rule, which the SQL dialect lacks, as conditions on what the rest of its pattern matches.
_SSN_SQL = r"list_filter(regexp_extract_all(text, '\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b'), lambda x: NOT regexp_matches(x, '^(000|666|9)') AND NOT regexp_matches(x, '^\d{3}[-\s]?00') AND NOT regexp_matches(x, '0000$'))"
_PII_SQL = {kind: f"len({_SSN_SQL})::INT" if kind == "ssn" else f"len(regexp_extract_all(text, '{pattern.replace(chr(39), chr(39) * 2)}'))::INT" for kind, _, _, pattern, _ in rules.PII_RULES}
_SHOWN_PII = [kind for kind, risk, sure, *_ in rules.PII_RULES if risk != "low" and sure >= rules.MIN_CONFIDENCE]
_HIGH_PII = [kind for kind, risk, *_ in rules.PII_RULES if risk == "high"]
COUNTED_SQL = "counted AS (SELECT doc_id, " + ", ".join(f"{sql} AS {kind}" for kind, sql in _PII_SQL.items()) + " FROM documents)"


@query(f"WITH {COUNTED_SQL} SELECT * FROM counted")
def pii_counts(spark, folder):
    found = guardrails.pii_counts(F.col("text"), threshold="low")
    return read(spark, folder, "documents").select("doc_id", *(n.alias(k) for k, n in found.items()))


@query(f"""
    WITH {COUNTED_SQL}, summed AS (SELECT *, {" + ".join(_SHOWN_PII)} AS total, {" + ".join(_HIGH_PII)} AS high FROM counted)
    SELECT doc_id, '{{' || array_to_string(list_filter([{", ".join(f"CASE WHEN {k} > 0 THEN '{chr(34)}{k}{chr(34)}:' || {k} END" for k in _SHOWN_PII)}], lambda x: x IS NOT NULL), ',') || '}}' AS summary, total::INT AS pii_count,
           CASE WHEN high > 0 THEN 'high' WHEN total > 0 THEN 'medium' ELSE 'low' END AS risk_level, high >= {rules.BLOCK_HIGH_ENTITIES} AS should_block FROM summed
""")
def pii_summary(spark, folder):
    rows = read(spark, folder, "documents").select("doc_id", guardrails.pii_count_struct(F.col("text")).alias("n"))
    total = sum((F.col(f"n.{k}") for k in _SHOWN_PII), F.lit(0))
    high = sum((F.col(f"n.{k}") for k in _HIGH_PII), F.lit(0))
    summary = F.map_filter(F.create_map(*(x for k in _SHOWN_PII for x in (F.lit(k), F.col(f"n.{k}")))), lambda _, n: n > 0)
    risk = F.when(high > 0, "high").when(total > 0, "medium").otherwise("low")
    return rows.select("doc_id", F.to_json(summary).alias("summary"), total.alias("pii_count"), risk.alias("risk_level"), (high >= rules.BLOCK_HIGH_ENTITIES).alias("should_block"))


def _spans_sql(order: int, kind: str, risk: str, pattern: str, mask: str) -> str:
    """A rule's matches with their places: what stands between matches and the matches themselves add up to each start."""
    found = r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b" if kind == "ssn" else pattern.replace("'", "''")
    sound = r"NOT regexp_matches(m[i], '^(000|666|9)') AND NOT regexp_matches(m[i], '^\d{3}[-\s]?00') AND NOT regexp_matches(m[i], '0000$')" if kind == "ssn" else "true"
    return f"""
        SELECT doc_id, {order} AS ord, '{risk}' AS risk, '{mask}' AS mask, (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start, length(m[i]) AS size
        FROM (SELECT doc_id, m, p, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{found}') AS m, string_split_regex(text, '{found}') AS p FROM documents)) WHERE {sound}"""


_REDACTED_SQL = " UNION ALL ".join(_spans_sql(k, kind, risk, pattern, mask) for k, (kind, risk, sure, pattern, mask) in enumerate(rules.PII_RULES) if risk != "low" and sure >= rules.MIN_CONFIDENCE)


@query(f"""
    WITH RECURSIVE spans AS MATERIALIZED ({_REDACTED_SQL}),
    placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, ord) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM spans),
    fold(doc_id, k, n, upto, done) AS (
        SELECT DISTINCT doc_id, 0::BIGINT, n, 0::BIGINT, '' FROM placed
        UNION ALL
        SELECT f.doc_id, f.k + 1, f.n, CASE WHEN s.start >= f.upto THEN s.start + s.size ELSE f.upto END, CASE WHEN s.start >= f.upto THEN f.done || substr(d.text, f.upto + 1, s.start - f.upto) || s.mask ELSE f.done END
        FROM fold f JOIN placed s ON s.doc_id = f.doc_id AND s.k = f.k + 1 JOIN documents d ON d.doc_id = f.doc_id),
    ended AS (SELECT f.doc_id, f.n, f.done || substr(d.text, f.upto + 1) AS redacted FROM fold f JOIN documents d USING (doc_id) WHERE k = n),
    risks AS (SELECT doc_id, CASE WHEN bool_or(risk = 'high') THEN 'high' ELSE 'medium' END AS risk_level FROM spans GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n, 0)::INT AS n_entities, md5(coalesce(redacted, text)) AS redacted_md5, coalesce(risk_level, 'low') AS risk_level, n IS NOT NULL AS was_modified
    FROM documents d LEFT JOIN ended e ON e.doc_id = d.doc_id LEFT JOIN risks r ON r.doc_id = d.doc_id
""")
def pii_redact(spark, folder):
    made = guardrails.redaction(F.col("text"))
    return read(spark, folder, "documents").select("doc_id", made.alias("m")).select("doc_id", F.size("m.entities").alias("n_entities"), F.md5("m.redacted").alias("redacted_md5"), "m.risk_level", "m.was_modified")


#: Phrases that are put before texts so that rules fire: doc_id modulo 8 chooses.
PHRASES = ["We do not lend to religion groups. ", "Your rate is definitely 3.5 %. ", "You will be approved. ", "No hidden fees ever! ", "You should declare bankruptcy. ", "The interest rate moves. ", "PMI may apply. ", ""]
_TEXT_SQL = f"said AS (SELECT doc_id, {_quoted(PHRASES)}[doc_id % 8 + 1] || text AS text FROM documents)"
_VIOLATIONS_SQL = "[" + ", ".join("{'kind': '" + kind + "', 'severity': '" + severity + "', 'm': regexp_extract(text, '(?i)" + p.replace("'", "''") + "')}" for kind, severity, _, patterns in rules.COMPLIANCE_RULES for p in patterns) + "]"
SCANNED_SQL = f"{_TEXT_SQL}, scanned AS (SELECT doc_id, text, list_filter({_VIOLATIONS_SQL}, lambda v: v.m <> '') AS v FROM said), checked AS (SELECT *, len(list_filter(v, lambda x: x.severity IN ('high', 'critical'))) > 0 AS should_block FROM scanned)"


def _said(spark, folder):
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("doc_id") % 8 + 1).cast("int"))
    return read(spark, folder, "documents").select("doc_id", F.concat(phrase, "text").alias("text"))


@query(f"WITH {SCANNED_SQL} SELECT doc_id, array_to_string(list_transform(v, lambda x: x.kind || ':' || x.severity || ':' || x.m), '|') AS found, len(v) = 0 AS is_compliant, should_block FROM checked")
def compliance_scan(spark, folder):
    found = F.array_join(F.transform("violations", lambda v: F.concat_ws(":", v["violation_type"], v["severity"], v["matched_text"])), "|")
    return guardrails.checked(_said(spark, folder), "text").select("doc_id", found.alias("found"), "is_compliant", "should_block")


_NOTES_SQL = " ".join(f"WHEN regexp_matches(text, '{p}') AND NOT contains(text, '{note}') THEN '{note}'" for p, note in rules.DISCLAIMERS)


@query(f"WITH {SCANNED_SQL}, noted AS (SELECT doc_id, text, CASE WHEN should_block THEN NULL {_NOTES_SQL} END AS note FROM checked) SELECT doc_id, note IS NOT NULL AS disclaimer_added, md5(text || note) AS modified_md5 FROM noted")
def disclaimers(spark, folder):
    return guardrails.checked(_said(spark, folder), "text").select("doc_id", "disclaimer_added", F.md5("modified_text").alias("modified_md5"))


# ---- evaluation


EVAL_SQL = f"""
    {ANSWERS_SQL}, {GROUNDED_SQL}, said AS (SELECT doc_id, answer AS text FROM answers), scanned AS (SELECT doc_id, text, list_filter({_VIOLATIONS_SQL}, lambda v: v.m <> '') AS v FROM said),
    heur AS (
        SELECT a.doc_id, a.doc_id % 4 AS run, a.answer, a.cited, {_keys('lower(a.answer)', rules.ANSWER_STOP)} AS ak, {_keys('lower(d.source || chr(32) || left(a.answer, 80))', rules.QUESTION_STOP)} AS qk, a.context, g.is_grounded,
               len(list_filter(v, lambda x: x.severity IN ('high', 'critical'))) > 0 AS blocked
        FROM answers a JOIN documents d USING (doc_id) JOIN grounded g USING (doc_id) JOIN scanned USING (doc_id)),
    parts AS (
        SELECT *, CASE WHEN len(ak) > 0 THEN least(len(list_filter(ak, lambda w: contains(lower(context), w))) / len(ak) * 1.2, 1.0) END AS f,
               CASE WHEN len(qk) > 0 THEN least(len(list_filter(qk, lambda w: contains(lower(answer), w))) / len(qk) * 1.3, 1.0) END AS r FROM heur)
"""


def _evaluated(spark, folder):
    samples = read(spark, folder, "documents").select(F.col("doc_id").alias("sample_id"), (F.col("doc_id") % 4).alias("run"), F.concat("source", F.lit(" "), F.left("text", F.lit(80))).alias("question"), F.array(F.lit("RESPA Section 5")).alias("regulatory_citations"))
    return answers.evaluate(samples, _answers(spark, folder).select(F.col("doc_id").alias("sample_id"), "answer", "context"), ["run"])


@query(f"WITH {EVAL_SQL} SELECT run, round(coalesce(avg(f), 0), 6) AS faithfulness, round(coalesce(avg(r), 0), 6) AS answer_relevancy, 0.72::DOUBLE AS context_precision, 0.75::DOUBLE AS context_recall FROM parts GROUP BY run")
def eval_heuristic(spark, folder):
    return _evaluated(spark, folder).select("run", "faithfulness", "answer_relevancy", "context_precision", "context_recall")


@query(f"""
    WITH {EVAL_SQL}, n AS (SELECT run, greatest(count(*) FILTER (answer <> ''), 1) AS n FROM parts GROUP BY run)
    SELECT run, round(count(*) FILTER (answer <> '' AND NOT blocked) / any_value(n), 6) AS compliance_pass_rate, round(count(*) FILTER (answer <> '' AND context <> '' AND NOT is_grounded) / any_value(n), 6) AS hallucination_rate,
           round(count(*) FILTER (answer <> '' AND (contains(answer, '[Source:') OR contains(answer, '[source:') OR contains(answer, 'According to'))) / any_value(n), 6) AS citation_rate,
           round(count(*) FILTER (contains(lower(answer), 'respa sect')) / greatest(count(*), 1), 6) AS regulatory_accuracy, count(*) AS n_samples
    FROM parts JOIN n USING (run) GROUP BY run
""")
def eval_banking(spark, folder):
    return _evaluated(spark, folder).select("run", "compliance_pass_rate", "hallucination_rate", "citation_rate", "regulatory_accuracy", "n_samples")


@query("WITH p AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS place, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, value AS p95 FROM p WHERE place = least(floor(n * 0.95) + 1, n)")
def eval_p95(spark, folder):
    return answers.p95(read(spark, folder, "events"), "value", ["event_type"])


@query("SELECT event_type, round(0.30 * a + 0.25 * b + 0.15 * 0.72 + 0.15 * 0.75 + 0.15 * c, 4) AS overall_score, false AS passes, a + 0.4 >= 0.85 AND b + 0.38 >= 0.8 AS passes_raised FROM (SELECT event_type, round(avg(user_id % 10) / 10, 6) AS a, round(avg(user_id % 7) / 7, 6) AS b, round(avg((user_id % 3 = 0)::INT), 6) AS c FROM events GROUP BY 1)")
def eval_overall(spark, folder):
    rows = read(spark, folder, "events").groupBy("event_type").agg(F.round(F.avg(F.col("user_id") % 10) / 10, 6).alias("a"), F.round(F.avg(F.col("user_id") % 7) / 7, 6).alias("b"), F.round(F.avg((F.col("user_id") % 3 == 0).cast("int")), 6).alias("c"))
    p, rc = F.lit(rules.HEURISTIC_PRECISION), F.lit(rules.HEURISTIC_RECALL)
    bar = answers.passes_bar({"faithfulness": F.col("a"), "answer_relevancy": F.col("b"), "context_precision": p, "context_recall": rc, "compliance_pass_rate": F.col("c"), "pii_leak_rate": F.lit(0.0), "hallucination_rate": F.lit(0.0)})
    # the heuristic's constants for precision and recall are under the bar; figures that can pass it
    raised = answers.passes_bar({"faithfulness": F.col("a") + 0.4, "answer_relevancy": F.col("b") + 0.38, "context_precision": F.lit(0.8), "context_recall": F.lit(0.85), "compliance_pass_rate": F.lit(1.0), "pii_leak_rate": F.lit(0.0), "hallucination_rate": F.lit(0.0)})
    return rows.select("event_type", answers.overall(F.col("a"), F.col("b"), p, rc, F.col("c")).alias("overall_score"), bar.alias("passes"), raised.alias("passes_raised"))


# ---- test cases

CASES_SQL = f"""
    lines AS (SELECT l_orderkey, list({{'step_number': l_linenumber, 'action': 'ship part ' || l_partkey, 'expected': l_returnflag}} ORDER BY l_linenumber, 'ship part ' || l_partkey, l_returnflag) AS steps FROM lineitem GROUP BY 1),
    cases AS (
        SELECT 'TC-' || lpad(o_orderkey::VARCHAR, 8, '0') AS id, 'order of ' || o_custkey AS title, {_quoted(rules.TEST_TYPES)}[o_orderkey % 8 + 1] AS test_type, {_quoted(rules.PRIORITIES)}[o_orderkey % 4 + 1] AS priority,
               ['customer ' || o_custkey, 'stock'] AS preconditions, steps, o_orderstatus AS expected_result, o_orderpriority AS linked_requirement, ['order', lower(o_orderstatus)] AS tags,
               CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'draft' ELSE 'rejected' END AS status
        FROM orders JOIN lines ON l_orderkey = o_orderkey)
"""


@query(f"""
    WITH {CASES_SQL}
    SELECT id AS "Test ID", title AS "Title", test_type AS "Type", priority AS "Priority", array_to_string(preconditions, '; ') AS "Preconditions", array_to_string(list_transform(steps, lambda s: s.step_number || '. ' || s.action || ' → ' || s.expected), ' | ') AS "Steps",
           expected_result AS "Expected Result", linked_requirement AS "Linked Requirement", array_to_string(tags, ', ') AS "Tags", status AS "Status" FROM cases
""")
def export_csv_rows(spark, folder):
    return testcases.export(bindings.test_cases(spark, folder), "csv")


@query(f"""
    WITH {CASES_SQL}
    SELECT '[' || id || '] ' || title AS "Summary", 'Test' AS "Issue Type", CASE left(priority, 2) WHEN 'P0' THEN 'Highest' WHEN 'P1' THEN 'High' WHEN 'P2' THEN 'Medium' WHEN 'P3' THEN 'Low' ELSE 'Medium' END AS "Priority",
           '<b>Preconditions:</b> ' || array_to_string(preconditions, '; ') || '<br/><b>Steps:</b><br/>' || array_to_string(list_transform(steps, lambda s: '<b>Step ' || s.step_number || ':</b> ' || s.action || ' — <i>Expected: ' || s.expected || '</i>'), '<br/>') || '<br/><b>Expected Result:</b> ' || expected_result AS "Description",
           array_to_string(tags, ' ') AS "Labels", linked_requirement AS "Custom Field (Linked Req)" FROM cases
""")
def export_jira_rows(spark, folder):
    return testcases.export(bindings.test_cases(spark, folder), "jira")


@query(f"WITH {CASES_SQL} SELECT id, to_json({{'id': id, 'title': title, 'test_type': test_type, 'priority': priority, 'preconditions': preconditions, 'steps': steps, 'expected_result': expected_result, 'linked_requirement': linked_requirement, 'tags': tags, 'status': status}})::VARCHAR AS json FROM cases")
def export_json_rows(spark, folder):
    return testcases.export(bindings.test_cases(spark, folder), "json")


@query(f"WITH {CASES_SQL} SELECT status, count(*) AS n FROM cases GROUP BY 1")
def status_counts(spark, folder):
    return bindings.test_cases(spark, folder).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {CASES_SQL} SELECT test_type, count(*) AS n, count(DISTINCT title) AS titles FROM cases GROUP BY 1")
def type_counts(spark, folder):
    return bindings.test_cases(spark, folder).groupBy("test_type").agg(F.count("*").alias("n"), F.count_distinct("title").alias("titles"))


@query(f"WITH {CASES_SQL} SELECT id, title, status FROM cases WHERE test_type = 'security'")
def type_filter(spark, folder):
    return bindings.test_cases(spark, folder).where("test_type = 'security'").select("id", "title", "status")


@query(f"""
    WITH {CASES_SQL}, reviews AS (SELECT 'TC-' || lpad(o_orderkey::VARCHAR, 8, '0') AS id, ['approve', 'reject', 'edit', 'skip'][o_custkey % 4 + 1] AS action, CASE WHEN o_orderkey % 2 = 0 THEN 'edited ' || o_orderkey END AS edited FROM orders WHERE o_orderkey % 3 = 0)
    SELECT c.id, CASE WHEN action = 'edit' AND edited IS NOT NULL THEN edited ELSE title END AS title, CASE WHEN action = 'approve' THEN 'approved' WHEN action = 'reject' THEN 'rejected' WHEN action = 'edit' AND edited IS NOT NULL THEN 'approved' ELSE status END AS status
    FROM cases c LEFT JOIN reviews r ON r.id = c.id
""")
def review_merge(spark, folder):
    action = F.element_at(F.array(*map(F.lit, ["approve", "reject", "edit", "skip"])), (F.col("o_custkey") % 4 + 1).cast("int"))
    edited = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("edited "), F.col("o_orderkey").cast("string")))
    reviews = read(spark, folder, "orders").where("o_orderkey % 3 = 0").select(F.concat(F.lit("TC-"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("id"), action.alias("action"), edited.alias("edited_title"))
    return testcases.reviewed(bindings.test_cases(spark, folder), reviews).select("id", "title", "status")


_RAW = ['```json\n[{"title": "A", "test_type": "edge", "steps": [{"step_number": 1, "action": "x", "expected": "y"}]}, {"title": "B", "test_type": "odd"}]\n```\n{"coverage_gaps": ["g1", "g2"]}', 'Here: [{"priority": "P0 - Critical", "tags": ["t"]}, {"title": "C", "steps": [{"action": "x"}]}] done', "no cases"]


@query(f"""
    WITH raw AS (SELECT o_orderkey, {_quoted(_RAW)}[o_orderkey % 3 + 1] AS raw FROM orders)
    SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'A:edge:P2 - Medium:1' WHEN 1 THEN 'Untitled:functional:P0 - Critical:0' ELSE '' END AS cases, CASE o_orderkey % 3 WHEN 0 THEN 'g1|g2' WHEN 1 THEN '' ELSE '{testcases.UNPARSED}' END AS gaps FROM raw
""")
def llm_parse_cases(spark, folder):
    raw = read(spark, folder, "orders").select("o_orderkey", F.element_at(F.array(*map(F.lit, _RAW)), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("raw"))
    shown = F.array_join(F.transform("cases", lambda c: F.concat_ws(":", c["title"], c["test_type"], c["priority"], F.size(c["steps"]).cast("string"))), "|")
    return testcases.parsed(raw).select("o_orderkey", shown.alias("cases"), F.array_join("coverage_gaps", "|").alias("gaps"))


# ---- metrics, audit, limits, windows

_EDGES = rules.BUCKETS["query_duration"]


@query("SELECT event_type, unnest(" + _quoted([*map(str, _EDGES), "+Inf"]) + ") AS le, unnest([" + ", ".join([f"count(*) FILTER (value / 10 <= {x})" for x in _EDGES] + ["count(*) FILTER (value IS NOT NULL)"]) + "]) AS count FROM events GROUP BY event_type")
def histogram_buckets(spark, folder):
    return metrics.histogram(read(spark, folder, "events").withColumn("seconds", F.col("value") / 10), "seconds", _EDGES, ["event_type"])


@query("SELECT event_type, user_id % 5 AS user_role, count(*) AS total, round(sum(value), 6) AS value_sum FROM events GROUP BY ALL")
def counters_by_label(spark, folder):
    return metrics.counters(read(spark, folder, "events").withColumn("user_role", F.col("user_id") % 5), ["event_type", "user_role"], {"value_sum": F.col("value")})


@query("SELECT event_id, user_id, sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS gauge FROM events")
def gauge_running(spark, folder):
    change = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return metrics.running_gauge(read(spark, folder, "events"), change, ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", "gauge")


@query("SELECT doc_id, nullif(left(text, 100), '') AS query_preview FROM documents")
def audit_preview(spark, folder):
    return read(spark, folder, "documents").select("doc_id", metrics.preview(F.col("text")).alias("query_preview"))


_PADS = [bytes(x ^ pad for x in b"audit-key".ljust(64, b"\0")).hex() for pad in (0x36, 0x5C)]


@query(f"""
    WITH e AS (SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, user_id, event_type FROM events)
    SELECT *, sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(event_id || '|' || ts || '|' || user_id || '|' || event_type)))) AS hmac_signature FROM e
""")
def audit_hmac(spark, folder):
    events = read(spark, folder, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "user_id", "event_type")
    return metrics.signed(events, b"audit-key")


@query("SELECT event_id, user_id, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS severity FROM events WHERE value > 50")
def audit_alerts(spark, folder):
    rows = read(spark, folder, "events").withColumn("severity", F.when(F.col("value") > 50, "high").otherwise("low"))
    return metrics.alerts(rows).select("event_id", "user_id", "severity")


@query("""
    WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    run(user_id, k, event_id, log, allowed, remaining) AS (
        SELECT DISTINCT user_id, 0::BIGINT, NULL::BIGINT, []::DOUBLE[], NULL::BOOLEAN, NULL::INT FROM events
        UNION ALL
        SELECT user_id, k, event_id, CASE WHEN len(kept) < 3 THEN list_append(kept, t) ELSE kept END, len(kept) < 3, greatest(2 - len(kept), 0)::INT
        FROM (SELECT e.user_id, e.k, e.event_id, e.t, list_filter(run.log, lambda x: x > e.t - 3600) AS kept FROM run JOIN e ON e.user_id = run.user_id AND e.k = run.k + 1))
    SELECT user_id, event_id, allowed, remaining FROM run WHERE k > 0
""")
def rate_limit(spark, folder):
    return limits.limited(read(spark, folder, "events").select(F.col("user_id").alias("key"), "ts", "event_id"), 3, 3600.0).select(F.col("key").cast("long").alias("user_id"), "event_id", "allowed", "remaining")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def window_tumbling(spark, folder):
    return limits.windowed(read(spark, folder, "events"), "1 hour").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("WITH s AS (SELECT *, unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS start FROM events) SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY ALL")
def window_sliding(spark, folder):
    return limits.windowed(read(spark, folder, "events"), "1 hour", "30 minutes").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("""
    WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL '30 minutes' THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, session
""")
def session_gap(spark, folder):
    return limits.sessions(read(spark, folder, "events"), "30 minutes").select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


# ---- relational extensions


@query("SELECT c_custkey, c_name, 'active' AS kind FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, c_name, 'idle' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def rel_join_semi_anti(spark, folder):
    customers, orders = read(spark, folder, "customer"), read(spark, folder, "orders")
    meet = customers.c_custkey == orders.o_custkey
    parts = [customers.join(orders, meet, how).select("c_custkey", "c_name", F.lit(kind).alias("kind")) for how, kind in (("left_semi", "active"), ("left_anti", "idle"))]
    return parts[0].union(parts[1])


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def rel_cube(spark, folder):
    return read(spark, folder, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("quantity"))


@query("(SELECT l_partkey AS key FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A') EXCEPT SELECT p_partkey FROM part WHERE p_size < 10")
def rel_setops(spark, folder):
    lines = read(spark, folder, "lineitem")
    side = lambda flag: lines.where(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("key"))
    return side("R").intersect(side("A")).subtract(read(spark, folder, "part").where("p_size < 10").select("p_partkey"))


@query("SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC)::INT AS price_rank, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders")
def rel_rank(spark, folder):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey")
    return read(spark, folder, "orders").select("o_orderkey", F.rank().over(w.orderBy(F.desc("o_totalprice"))).alias("price_rank"), F.lag("o_orderkey").over(w.orderBy("o_orderdate", "o_orderkey")).alias("before"))


@query("""
    SELECT n_name, count(*) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY n_name
""")
def rel_revenue(spark, folder):
    rows = read(spark, folder, "lineitem").join(read(spark, folder, "orders").where("o_orderdate >= timestamp_ntz'1995-01-01 00:00:00'"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(read(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.count("*").alias("n_lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


# ---- questions, prompts, reports, audit rows

_ROLE_LIMITS = "roles(role, levels, per_minute, chunks) AS (VALUES " + ", ".join(f"('{r}', '{','.join(levels)}', {limit}, {n})" for r, levels, limit, n in rules.ROLES) + ")"


@query(f"WITH {_ROLE_LIMITS}, asks AS (SELECT user_id, ['customer', 'loan_officer', 'underwriter', 'compliance_officer', 'admin', 'guest'][user_id % 6 + 1] AS user_role FROM events GROUP BY user_id) SELECT user_id, user_role, coalesce(levels, 'public') AS levels, coalesce(per_minute, 10)::INT AS rate_limit, least(coalesce(chunks, 3), 5)::INT AS max_chunks FROM asks LEFT JOIN roles ON role = user_role")
def role_limits(spark, folder):
    names = F.array(*map(F.lit, ["customer", "loan_officer", "underwriter", "compliance_officer", "admin", "guest"]))
    users = read(spark, folder, "events").select("user_id").distinct().withColumn("user_role", F.element_at(names, (F.col("user_id") % 6 + 1).cast("int")))
    return retrieval.with_role(users).select("user_id", "user_role", F.array_join("access_levels", ",").alias("levels"), "rate_limit", "max_chunks")


@query(r"SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS question FROM documents WHERE length(text) BETWEEN 5 AND 1000")
def question_constraints(spark, folder):
    return read(spark, folder, "documents").where(answers.sound_question(F.col("text"))).select("doc_id", answers.cleaned_question(F.col("text")).alias("question"))


@query("SELECT event_id, user_id % 7 AS rating FROM events WHERE user_id % 7 BETWEEN 1 AND 5 AND length(props) <= 500")
def feedback_constraints(spark, folder):
    return read(spark, folder, "events").withColumn("rating", F.col("user_id") % 7).where(answers.sound_feedback(F.col("rating"), F.col("props"))).select("event_id", "rating")


@query("""
    WITH h AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn) AS turns, max(text) AS question FROM conversations GROUP BY conv_id),
    m AS (SELECT conv_id, list_append(turns[greatest(len(turns) - 5, 1):], {'role': 'user', 'text': 'DOCUMENTATION:' || chr(10) || 'none' || chr(10) || chr(10) || 'QUESTION: ' || question || chr(10) || chr(10) || 'Answer from the documentation above only, name the source of each statement as [Source: file], and say so where it holds no answer.'}) AS messages FROM h)
    SELECT conv_id, len(messages)::INT AS n_messages, md5(array_to_string(list_transform(messages, lambda x: x.role || '=' || x.text), '|')) AS messages_md5 FROM m
""")
def prompt_messages(spark, folder):
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    rows = read(spark, folder, "conversations").groupBy("conv_id").agg(turns.alias("history"), F.max("text").alias("question"))
    made = rows.select("conv_id", answers.messages(F.col("history"), F.col("question"), F.lit("none")).alias("m"))
    return made.select("conv_id", F.size("m").alias("n_messages"), F.md5(F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit("="), x["text"])), "|")).alias("messages_md5"))


@query("SELECT conv_id, array_to_string(CASE WHEN conv_id % 3 = 0 THEN list(role ORDER BY turn)[1:2] ELSE list(text ORDER BY turn)[1:2] END, '|') AS chosen FROM conversations GROUP BY conv_id")
def found_or_first(spark, folder):
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("turn", c))), lambda t: t[c])
    rows = read(spark, folder, "conversations").groupBy("conv_id").agg(listed("role").alias("found"), listed("text").alias("chunks"))
    return rows.select("conv_id", F.array_join(answers.found_or_first(F.when(F.col("conv_id") % 3 == 0, F.col("found")), F.col("chunks"), 2), "|").alias("chosen"))


@query()
def chunk_stats(spark, folder):
    return chunking.chunk_stats(chunking.recursive_chunks(documents(spark, folder), "doc_id", "content", keep=["access_level"]), ["access_level"])


_BAR_SQL = {k: f"{k} {'<=' if k.endswith(('leak_rate', 'hallucination_rate')) else '>='} {bar}" for k, bar in rules.QUALITY_BAR.items()}
_LINES_SQL = " || chr(10) || ".join(f"'{k}: ' || printf('%.4f', {k}) || ' ({'at most' if '<=' in _BAR_SQL[k] else 'at least'} {bar}) ' || CASE WHEN {_BAR_SQL[k]} THEN 'ok' ELSE 'missed' END" for k, bar in rules.QUALITY_BAR.items())


@query(f"""
    WITH {EVAL_SQL}, {COUNTED_SQL}, n AS (SELECT run, greatest(count(*) FILTER (answer <> ''), 1) AS n FROM parts GROUP BY run),
    m AS (
        SELECT run, round(coalesce(avg(f), 0), 6) AS faithfulness, round(coalesce(avg(r), 0), 6) AS answer_relevancy, {rules.HEURISTIC_PRECISION}::DOUBLE AS context_precision, {rules.HEURISTIC_RECALL}::DOUBLE AS context_recall,
               round(count(*) FILTER (answer <> '' AND NOT blocked) / any_value(n), 6) AS compliance_pass_rate, round(count(*) FILTER (answer <> '' AND {" + ".join(_HIGH_PII)} > 0) / any_value(n), 6) AS pii_leak_rate,
               round(count(*) FILTER (answer <> '' AND context <> '' AND NOT is_grounded) / any_value(n), 6) AS hallucination_rate
        FROM parts JOIN n USING (run) JOIN counted USING (doc_id) GROUP BY run)
    SELECT run, {_LINES_SQL} || chr(10) || CASE WHEN {" AND ".join(_BAR_SQL.values())} THEN 'PASS' ELSE 'FAIL' END AS report FROM m
""")
def eval_report(spark, folder):
    rows = _evaluated(spark, folder)
    return rows.select("run", answers.report({name: F.col(name) for name in rules.QUALITY_BAR}).alias("report"))


@query("SELECT 'evt-' || doc_id AS event_id, CASE WHEN doc_id % 4 = 0 THEN 'QUERY_BLOCKED' ELSE 'QUERY_PROCESSED' END AS event_type, nullif(left(text, 100), '') AS query_preview, doc_id % 4 = 0 AS was_blocked FROM documents")
def audit_query_events(spark, folder):
    rows = read(spark, folder, "documents").select(F.col("doc_id").alias("query_id"), F.col("source").alias("user_id"), F.col("text").alias("question"), F.col("lang").alias("answer"), F.when(F.col("doc_id") % 4 == 0, "pii").alias("block_reason"))
    return metrics.query_events(rows).select("event_id", "event_type", "query_preview", "was_blocked")


# ---- the whole pipeline


@query()
def answer_pipeline(spark, folder):
    return answer(bindings.questions(spark, folder), documents(spark, folder), read(spark, folder, "embeddings").select("vec_id", "embedding"), bound=read(spark, folder, "benchmark"))
