"""The queries opN_<name>: each applies its operator to the whole table. ORACLES holds SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import divergence, fim, imatch, itq, langid, mixing, packing, simhash, substrings, topk, toxicity, urlfilter, warc
from corpusmill.llm.base import crc_fold, table


def op9_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_fold("doc_id", 3) == 1
    found = langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), held_out)
    return found.select("doc_id", held_out.alias("held_out"), "__lang.lang_pred", "__lang.score", "__lang.mixture")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(crc_fold("doc_id", 5) != 0).select("doc_id", F.col("toxic").cast("int").alias("label"))
    found = toxicity.detect(docs, labels)
    return found.select("doc_id", (crc_fold("doc_id", 5) == 0).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


#: Shares of the training tokens.
TARGETS = {"high": 0.92, "low": 0.07, "toxic": 0.01}


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = mixing.mix(docs, mixing.domain_labels(table(spark, sf_dir, "labels")), TARGETS, keep_text=False)
    shares = [F.col("__posterior")[x].alias(f"p_{x}") for x in sorted(TARGETS)]
    return found.select("doc_id", F.col("__tokens").alias("tokens"), *shares, F.col("__rate").alias("rate"), mixing.copies(F.col("__rate"), F.col("doc_id")).alias("copies"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.without_repeats(docs).select("doc_id", "__kept.n_words", "__kept.n_removed", F.sha2("__kept.kept", 256).alias("kept_sha256"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.records_of(warc.archive(table(spark, sf_dir, "pages")))
    return found.select(F.col("page").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


RULES = [
    urlfilter.Rule("allow", "org", "/"),
    urlfilter.Rule("block", "example.org", "/es/"),
    urlfilter.Rule("block", "example.org", "/en/1"),
    urlfilter.Rule("allow", "com", "/fr/"),
    urlfilter.Rule("block", "com", "/de/"),
]


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).drop("url")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = fim.restored(F.col("form"), F.col("output"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


def op13_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = itq.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select("vec_id", "n_links", F.col("component").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("component")).alias("kept"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_mixing, op3_topk, op4_substrings, op5_fingerprints, op6_warc, op7_urls, op8_packing, op9_languages, op10_simhash, op11_fim, op12_divergence, op13_embeddings)}
ORACLES: dict[str, str] = {
    "op3_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 10
    """,
    "op4_substrings": r"""
        WITH words AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        starts AS (SELECT r, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35),
        windows AS (SELECT s.r, s.i, md5(array_to_string(w[s.i : s.i + 34], ' ')) AS h FROM starts s JOIN words USING (r)),
        repeated AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM windows) WHERE n > 1),
        gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS k FROM repeated),
        lost AS (SELECT r, list(k) AS ks FROM gone GROUP BY r),
        kept AS (
            SELECT doc_id, len(w) AS n_words, coalesce(len(ks), 0) AS n_removed,
                   CASE WHEN ks IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda k: NOT list_contains(ks, k)), lambda k: w[k]) END AS w
            FROM words LEFT JOIN lost USING (r))
        SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(w, ' ')) AS kept_sha256 FROM kept
    """,
    "op6_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages),
        r AS (
            SELECT *, min(page_id) OVER (PARTITION BY h) AS first, row_number() OVER (PARTITION BY h, page_id) AS turn,
                   list_transform(range(8), lambda k: ('0x' || substr(h, 5 * k + 1, 5))::INT) AS fives
            FROM p)
        SELECT page_id, octet_length(b)::BIGINT AS payload_bytes,
               array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (fives[j // 4 + 1] >> (15 - 5 * (j % 4)) & 31)::INT + 1, 1)), '') AS payload_digest,
               CASE WHEN page_id = first AND turn = 1 THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = first AND turn = 1 THEN NULL ELSE first END AS refers_to
        FROM r
    """,
    "op7_urls": """
        WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        b AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
        r(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
        u AS (SELECT DISTINCT host, path FROM b),
        m AS (
            SELECT host, path, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY host, path ORDER BY length(rhost || rpath) DESC) AS k
            FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
        SELECT page_id, b.host, b.path, rule, coalesce(verdict, 'allow') AS verdict
        FROM b LEFT JOIN m ON b.host = m.host AND b.path = m.path AND k = 1
    """,
    "op11_fim": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+')) AS n,
                   list_transform(regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+'), lambda x: length(x)) AS sizes,
                   list_transform(range(4), lambda k: ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), (8 * k + 1)::INT, 8))::BIGINT) AS h FROM documents),
        c AS (
            SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
                   coalesce(list_sum(sizes[1 : least(h[1] % (n + 1), h[2] % (n + 1))]), 0)::BIGINT AS a, coalesce(list_sum(sizes[1 : greatest(h[1] % (n + 1), h[2] % (n + 1))]), 0)::BIGINT AS b FROM d),
        p AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM c)
        SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM p
    """,
    "op12_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS c FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 30),
        langs AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY ALL),
        per AS (SELECT lang, source, term, count(*) AS c FROM o SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        own AS (SELECT lang, source, sum(c) AS n FROM per GROUP BY ALL),
        grp AS (SELECT DISTINCT lang, source FROM d),
        f AS (
            SELECT g.lang, g.source, k.term, coalesce(p.c, 0) AS c, 1 + 1000000000 * (coalesce(p.c, 0)::HUGEINT + 5) // (coalesce(own.n, 0) + 5 * v) AS p, 1 + 1000000000 * (k.c::HUGEINT + 5) // (langs.n + 5 * v) AS q
            FROM grp g JOIN kept k USING (lang) JOIN langs USING (lang) LEFT JOIN per p ON p.lang = g.lang AND p.source = g.source AND p.term = k.term LEFT JOIN own ON own.lang = g.lang AND own.source = g.source),
        x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
        terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM f WHERE c > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM terms))
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
    """,
    "op13_embeddings": """
        WITH RECURSIVE r AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        v AS (SELECT r, vec_id, e, sqrt(list_dot_product(e, e)) AS l FROM r WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        links AS (SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON len(a.e) = len(b.e) AND a.r <> b.r WHERE list_dot_product(a.e, b.e) / (a.l * b.l) >= 0.95),
        reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
        least AS (SELECT a, min(vec_id) AS component FROM reach JOIN r ON r.r = reach.b GROUP BY ALL),
        degree AS (SELECT a, count(*) AS n FROM links GROUP BY ALL)
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, component) AS component_id, vec_id IS NOT DISTINCT FROM least(vec_id, component) AS kept
        FROM r LEFT JOIN least ON least.a = r.r LEFT JOIN degree ON degree.a = r.r
    """,
}
