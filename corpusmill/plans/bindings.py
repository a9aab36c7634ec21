"""How the tables of a folder stand for the engine's entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = ["public", "internal", "confidential", "restricted"]


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """content, source_file and an access level by doc_id modulo 4."""
    level = F.element_at(F.array(*map(F.lit, LEVELS)), (F.col("doc_id") % 4 + 1).cast("int"))
    return read(spark, folder, "documents").select("doc_id", F.col("text").alias("content"), F.col("source").alias("source_file"), "lang", level.alias("access_level"))


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """Each benchmark item asks with its text, in a role by its id, beside the vector of the same number."""
    from corpusmill.functions import rules

    names = F.array(*(F.lit(r[0]) for r in rules.ROLES))
    vectors = read(spark, folder, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    rows = read(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.element_at(names, (F.col("item_id") % 5 + 1).cast("int")).alias("user_role"))
    return rows.join(vectors, "query_id")


def test_cases(spark: SparkSession, folder: str) -> DataFrame:
    """An order is a test case and its lines are the steps."""
    from corpusmill.functions import rules

    kinds, ranks = F.array(*map(F.lit, rules.TEST_TYPES)), F.array(*map(F.lit, rules.PRIORITIES))
    steps = read(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("step_number"), F.concat(F.lit("ship part "), F.col("l_partkey").cast("string")).alias("action"), F.col("l_returnflag").alias("expected")))).alias("steps"))
    status = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", "draft").otherwise("rejected")
    return read(spark, folder, "orders").join(steps, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.concat(F.lit("TC-"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("id"), F.concat(F.lit("order of "), F.col("o_custkey").cast("string")).alias("title"),
        F.element_at(kinds, (F.col("o_orderkey") % 8 + 1).cast("int")).alias("test_type"), F.element_at(ranks, (F.col("o_orderkey") % 4 + 1).cast("int")).alias("priority"),
        F.array(F.concat(F.lit("customer "), F.col("o_custkey").cast("string")), F.lit("stock")).alias("preconditions"), "steps", F.col("o_orderstatus").alias("expected_result"), F.col("o_orderpriority").alias("linked_requirement"),
        F.array(F.lit("order"), F.lower("o_orderstatus")).alias("tags"), status.alias("status"),
    )
