"""A lasting cache of embedded texts: a bucketed Parquet table, which joins read as it lies."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.retrieval import cache_key, embedder


class EmbeddingCache:
    """Vectors by key (md5 of model:text) in folder/vectors, in `buckets` buckets by the key. Where texts meet the cache only the texts
    are shuffled, into as many partitions as there are buckets; the cache's side is read bucket by bucket. A run adds a file a
    bucket at most; compact() makes them one again. Runs at one time may both embed a text that neither has found; readers take one
    vector a key, so no row is doubled by that."""

    def __init__(self, spark: SparkSession, folder: str, name: str, model, dimension: int, buckets: int = 32) -> None:
        self.spark, self.folder, self.name, self.model, self.dimension, self.buckets = spark, folder.rstrip("/"), name, model, dimension, buckets
        self.table = f"embeddings_{hashlib.md5(self.folder.encode()).hexdigest()[:16]}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} (key STRING, vector ARRAY<FLOAT>) USING PARQUET CLUSTERED BY (key) SORTED BY (key) INTO {buckets} BUCKETS LOCATION '{self.folder}/vectors'")

    def read(self) -> DataFrame:
        """(key, vector), one row a key."""
        return self.spark.table(self.table).groupBy("key").agg(F.min("vector").alias("vector"))

    def missing(self, texts: DataFrame, text_col: str = "text") -> DataFrame:
        """(key, said): the distinct texts that the cache doesn't have."""
        keyed = texts.where(F.col(text_col).isNotNull()).select(cache_key(self.name, F.col(text_col)).alias("key"), F.col(text_col).alias("said"))
        return keyed.repartition(self.buckets, "key").groupBy("key").agg(F.min("said").alias("said")).join(self.spark.table(self.table).select("key"), "key", "left_anti")

    def fill(self, texts: DataFrame, text_col: str = "text", batch: int = 50) -> None:
        """Embeds what is missing, each distinct text once, and adds it to the cache."""
        made = self.missing(texts, text_col).select("key", embedder(self.model, self.dimension, batch)("said").alias("vector"))
        made.repartition(self.buckets, "key").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

    def embedded(self, texts: DataFrame, text_col: str = "text", batch: int = 50) -> DataFrame:
        """texts with key and vector, null for null texts; what is missing is embedded first."""
        self.fill(texts, text_col, batch)
        keyed = texts.withColumn("key", cache_key(self.name, F.col(text_col))).repartition(self.buckets, "key")
        return keyed.join(self.read(), "key", "left")

    def compact(self) -> None:
        """One file a bucket, one row a key: written beside the table first, then in its place."""
        staged = f"{self.folder}/next"
        self.read().write.mode("overwrite").parquet(staged)
        self.spark.read.parquet(staged).repartition(self.buckets, "key").write.insertInto(self.table, overwrite=True)
        self.spark.catalog.refreshTable(self.table)
