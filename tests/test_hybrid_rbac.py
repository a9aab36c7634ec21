"""hybrid_rbac beside SQL that filters by role before either list is cut."""

import duckdb
import pytest

from corpusmill.functions import rules
from corpusmill.plans import catalogue

SF = "/root/testdata/sf0.001"

FILTERED_SQL = f"""
    WITH {catalogue._ROLE_SQL}, {catalogue.DOCS_SQL},
    asks AS (SELECT item_id AS query_id, {catalogue._quoted(r[0] for r in rules.ROLES)}[item_id % 5 + 1] AS user_role FROM benchmark),
    able AS (SELECT query_id, user_role, doc_id, least(chunks, 5) AS max_chunks FROM asks JOIN roles ON role = user_role JOIN docs ON list_contains(levels, access_level)),
    q AS (SELECT item_id AS query_id, embedding::DOUBLE[] AS query_vector FROM benchmark JOIN embeddings ON vec_id = item_id),
    near AS (SELECT query_id, doc_id, {catalogue.COSINE_SQL} AS score FROM able JOIN q USING (query_id) JOIN embeddings e ON vec_id = doc_id),
    dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM near),
    {catalogue.SPARSE_SQL.replace("FROM bm WHERE", "FROM bm JOIN able USING (query_id, doc_id) WHERE")}, {catalogue.FUSED_SQL},
    cut AS (SELECT query_id, user_role, doc_id, rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, dense_rank, doc_id)::INT AS rank, max_chunks
            FROM fused JOIN able USING (query_id, doc_id) WHERE dense_rank IS NOT NULL)
    SELECT query_id, user_role, doc_id, round(rrf, 8) AS rrf, rank, max_chunks FROM cut WHERE rank <= max_chunks
"""


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_roles_filter_before_the_cuts(spark, duck):
    found = catalogue.hybrid_rbac(spark, SF).selectExpr("query_id", "user_role", "doc_id", "round(rrf, 8)", "rank", "max_chunks").collect()
    assert sorted(map(tuple, found)) == sorted(duck.execute(FILTERED_SQL).fetchall())


def test_hidden_documents_take_no_place(spark, tmp_path):
    """The 50 restricted documents are nearest to every question: each role still gets its full number of rows."""
    docs = [(k, "loan rate" if k < 160 and k % 4 == 3 else f"loan text {k}", "x", "en") for k in range(200)]
    vectors = [(k, [1.0, 0.001 * k if k % 4 == 3 else 1.0 + 0.001 * k]) for k in range(200)]
    asks = [(4 * k + 3, "loan rate") for k in range(5)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame(asks, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = catalogue.hybrid_rbac(spark, str(tmp_path)).collect()
    levels = {role: names for role, names, *_ in rules.ROLES}
    for query, _ in asks:
        rows = [r for r in found if r["query_id"] == query]
        assert rows and len(rows) == rows[0]["max_chunks"]
        assert all(["public", "internal", "confidential", "restricted"][r["doc_id"] % 4] in levels[r["user_role"]] for r in rows)
