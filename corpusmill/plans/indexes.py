"""Queries of the catalogue that build stored indexes and ask them."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.index.folders import scratch
from corpusmill.index.keywords import KeywordIndex
from corpusmill.index.vectors import VectorIndex
from corpusmill.plans.catalogue import _asked, _knn_sql, _questions, BM25_SQL, SPARSE_SQL, query, read

_BUILT: dict = {}


def _once(spark, folder, name, build):
    """The index of a folder's table, built at its first use in this session."""
    key = spark.sparkContext.applicationId, folder, name
    if key not in _BUILT:
        _BUILT[key] = build(scratch(spark, name))
    return _BUILT[key]


def vector_index(spark, folder) -> VectorIndex:
    rows = read(spark, folder, "embeddings").select("vec_id", "embedding", F.col("label").cast("string").alias("label"), F.array_compact(F.array(F.when(F.col("vec_id") % 2 == 0, "even"), F.when(F.col("vec_id") % 3 == 0, "third"))).alias("tags"))
    return _once(spark, folder, "vectors", lambda path: VectorIndex(spark, path).build(rows, payload=["label", "tags"]))


def keyword_index(spark, folder) -> KeywordIndex:
    return _once(spark, folder, "keywords", lambda path: KeywordIndex(spark, path).build(read(spark, folder, "documents")))


@query(_knn_sql("true", 10).format(""))
def vector_index_exact(spark, folder):
    """knn_topk through the stored index: every list, every vector."""
    return vector_index(spark, folder).search(_asked(spark, folder), 10, exact=True).drop("looked")


@query(_knn_sql("label IN (1, 3, 5)", 10).format(""))
def vector_index_filtered(spark, folder):
    """knn_filtered through the index's bitmaps."""
    return vector_index(spark, folder).search(_asked(spark, folder), 10, exact=True, where={"label": ["1", "3", "5"]}).drop("looked")


@query(_knn_sql("label IN (1, 3, 5) AND (vec_id % 2 = 0 OR vec_id % 3 = 0)", 10).format("AND score >= 0.1"))
def vector_index_tags(spark, folder):
    """A category and any of some tags, with a score to reach."""
    return vector_index(spark, folder).search(_asked(spark, folder), 10, exact=True, where={"label": ["1", "3", "5"], "tags": ["even", "third"]}, least=0.1).drop("looked")


@query()
def vector_index_topk(spark, folder):
    """The ten nearest that walks of the graphs find, with the products that they took; the tests hold it against all pairs."""
    return vector_index(spark, folder).search(_asked(spark, folder), 10)


@query(f"WITH {SPARSE_SQL} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM sparse WHERE rank <= 10")
def keyword_index_topk(spark, folder):
    """bm25_topk from stored postings."""
    return keyword_index(spark, folder).search(_questions(spark, folder), 10)


_LATER = BM25_SQL.replace("FROM documents)", "FROM documents WHERE doc_id % 10 <> 3)", 1)


@query(f"WITH {_LATER} SELECT term, df, round(idf, 6) AS idf FROM stats")
def keyword_index_updated(spark, folder):
    """Statistics after two updates: a fifth of the documents comes later, a tenth leaves."""
    docs = read(spark, folder, "documents").select("doc_id", "text")

    def build(path):
        made = KeywordIndex(spark, path).build(docs.where("doc_id % 5 <> 4"))
        return made.update(docs.where("doc_id % 5 = 4"), docs.where("doc_id % 20 = 3")).update(None, docs.where("doc_id % 20 = 13"))

    return _once(spark, folder, "updated", build).statistics().select("term", "df", F.round("idf", 6).alias("idf"))
