"""What larger tables showed: rows that small ones lack, and steps whose cost grew faster than their input."""

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import rules
from corpusmill.functions.text import holds
from corpusmill.operators import answers, chunking, guardrails, metrics, retrieval
from corpusmill.plans import indexes, monitoring, service  # noqa: F401  these add their queries
from corpusmill.plans.catalogue import ORACLES, QUERIES


def beside_sql(spark, name, folder, **tables):
    """The rows of a query and of its SQL over tables that are written below folder."""
    c = duckdb.connect()
    for table, df in tables.items():
        df.write.parquet(f"{folder}/{table}.parquet")
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want = c.execute(ORACLES[name])
    columns = [x[0] for x in want.description]
    return sorted(map(repr, map(tuple, QUERIES[name](spark, str(folder)).select(*(f"`{x}`" for x in columns)).collect()))), sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("name", ["embed_cached", "embed_lasting"])
def test_vectors_whose_sixth_digit_is_a_lone_five(spark, tmp_path, name):
    """Lengths of 64 give components of whole 64ths: 1/64 = 0.015625 is printed as 0.01562, 11/64 = 0.171875 as 0.17188."""
    text = "aa " * 63 + "bb " * 11 + "cc cc dd e"
    docs = spark.createDataFrame([(k, f"{text} " if k % 2 else "other words", "x", "en", 1) for k in range(4)], "doc_id long, text string, source string, lang string, n_chars long")
    got, want = beside_sql(spark, name, tmp_path, documents=docs)
    assert got == want and any("0.01562" in x for x in got) and any("0.17188" in x for x in got)


def test_keywords_are_summed_in_blocks_without_a_row_for_each_pair(spark, tmp_path, monkeypatch):
    """Blocks cut at any place, odd white space, empty and null texts, repeated terms, terms in over half of the texts: as the SQL says.
    The plan shuffles no text and has no join that makes a row for each document and query."""
    for name, most in (("TEXTS", 3), ("TEXT_CHARS", 60), ("PAIRS", 5), ("QUERIES", 2)):
        monkeypatch.setattr(retrieval, name, most)
    texts = ["", None, "Loan loan rate", "the\x1crate the  the", " the term\x85", "the " * 40, "rate\nthe", "État the loan", "x"]
    docs = spark.createDataFrame([(k, texts[k % len(texts)] if k % 7 else f"the loan{k % 3} rate {'z ' * k}", "x", "en", 1) for k in range(60)], "doc_id long, text string, source string, lang string, n_chars long").repartition(3)
    asked = spark.createDataFrame([(1, "the loan loan"), (2, ""), (3, None), (4, "état\x1frate nowhere"), (5, "z x loan1")], "item_id long, text string")
    for name in ("bm25_topk", "rerank_lexical", "context_budget"):
        got, want = beside_sql(spark, name, tmp_path / name, documents=docs, benchmark=asked)
        assert got == want and got
    plan = retrieval.bm25(docs, asked.toDF("query_id", "question"), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(filter(split(lower" in plan and plan.count("Generate explode(filter") == plan.count("coalesce(question")


def test_exposition_is_one_pass(spark):
    """The text form reads its rows once a kind of line, not once a metric, and a value that is no number counts in the last bucket."""
    rows = [("retrieval_score", 'user_role="a"', x, t) for x, t in ((0.1, 1), (float("nan"), 2), (None, 3), (0.55, 2))] + [("active_queries", "", x, t) for x, t in ((5.0, 7), (9.0, 7), (11.0, 3))] + [("active_queries", None, 4.0, None)]
    observed = spark.createDataFrame(rows, "metric string, labels string, value double, t int").selectExpr("metric", "labels", "value", "timestamp_seconds(t) AS ts")
    made = metrics.accumulated(observed)
    assert {(r["metric"], r["labels"]): r["last"] for r in made.collect() if r["metric"] == "active_queries"} == {("active_queries", ""): 9.0, ("active_queries", None): 4.0}
    text = metrics.exposition(observed)
    assert 'retrieval_score_bucket{user_role="a",le="+Inf"} 3' in {r[0] for r in text.collect()}
    passes = metrics.exposition(spark.range(3).selectExpr("'retrieval_score' AS metric", "'' AS labels", "cast(id AS double) AS value"))
    assert passes._jdf.queryExecution().optimizedPlan().toString().count("Range (") <= 4


def test_chunks_are_handed_on_for_a_few_texts_at_a_time(spark, monkeypatch):
    docs = spark.createDataFrame([(k, None if k % 5 == 0 else f"Sentence {k} of a text. " * (7 * k)) for k in range(40)], "id long, text string").repartition(2)
    want = sorted(map(repr, chunking.recursive_chunks(docs, "id", "text").collect()))
    monkeypatch.setattr(chunking, "TOGETHER", 500)
    assert sorted(map(repr, chunking.recursive_chunks(docs, "id", "text").collect())) == want and want


def test_evaluation_looks_words_up_and_matches_only_where_a_rule_can(spark):
    """Figures by looked-up words, and rules behind what their matches need, are those of the plain expressions; the plan searches no text
    for a word in a lambda and matches no pattern on a text that can't hold it."""
    hits = [
        "We do not lend to religion groups", "sex applicants tend to be late", "we prefer\tnot race", "YOUR Interest rate will be exactly 3.5 %", "I am able to promise you an APR", "guaranteed low rate", "you are definitely approved", "guaranteed LOAN approval",
        "a 100% approval", "no one is ever denied", "No hidden fees whatsoever", "completely free mortgage", "no credit check needed", "instant decision guaranteed", "lowest rates in the nation", "123-45-6789", "4111111111111", "routing no. 021000021", "account # 12345678",
        "loan # AB1234567", "12-3456789", "license # AB123456", "a@b.com", "it is not available", "plain words \u0130 \u212a of no rule 123",
    ]
    texts = [*hits, None, "", *(f"{x}. The rate of this loan is a matter of long papers\x1cand of rates. Short. {y.upper()} among other things of the paper" for x, y in zip(hits, hits[5:]))]
    rows = spark.createDataFrame([(k, a, texts[(k * 7 + 3) % len(texts)], f"What is the {(a or 'x')[:9]}") for k, a in enumerate(texts)], "sample_id int, answer string, context string, question string")
    a, c = F.col("answer"), F.col("context")
    may = rows.withColumn("may", holds(F.lower(a), rules.COMPLIANCE_NEEDS)).select(guardrails.breaks(a, F.col("may")).alias("x"), guardrails.blocks(guardrails.violations(a)).alias("y"), guardrails.leaks(a).alias("p"), (guardrails.high_risk_count(a) > 0).alias("q"), "answer")
    told = may.where("answer IS NOT NULL").collect()
    assert all(r["x"] == r["y"] and r["p"] == r["q"] for r in told) and 15 <= sum(r["x"] for r in told) < len(told) and 7 <= sum(r["p"] for r in told) < len(told)
    samples = rows.select("sample_id", "question", F.array(F.lit("RESPA")).alias("regulatory_citations"))
    got = {r["sample_id"]: r for r in answers.evaluate(samples, rows.select("sample_id", "answer", "context"), ["sample_id"]).collect()}
    plain = rows.select("sample_id", F.round(F.coalesce(answers.faithfulness(a, c), F.lit(0.0)), 6).alias("f"), F.round(F.coalesce(answers.relevancy(F.col("question"), a), F.lit(0.0)), 6).alias("r"), F.coalesce(((a != "") & (c != "") & ~answers.is_grounded(a, c)).cast("double"), F.lit(0.0)).alias("h"))
    for r in plain.collect():
        assert (r["f"], r["r"], r["h"]) == tuple(got[r["sample_id"]][x] for x in ("faithfulness", "answer_relevancy", "hallucination_rate")), r
    plan = answers.evaluate(samples, rows.select("sample_id", "answer", "context"), ["sample_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "lambda w: contains" not in plan and "regexp_count" not in plan
