"""A chunk table in plain Parquet, partitioned by access level: create, append, keyed upsert, delete, statistics."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class ChunkStore:
    """Rows lie in root/data, a folder for each value of the partition column; root/settings holds the settings as JSON. A change of
    some rows writes the partitions that hold them anew, to root/next first and then over the old ones, by dynamic partition
    overwrite: the others aren't touched. A row without a key stands in each partition so written, so that one that loses all its
    rows is overwritten too; readers leave it out. One writer at a time; a change that failed half-way is made again by running
    it again, as upserts and deletes give the same table twice."""

    def __init__(self, spark: SparkSession, root: str, schema: str, partition: str = "access_level", settings: dict | None = None, key: str = "chunk_id") -> None:
        self.spark, self.root, self.schema, self.partition, self.key = spark, root.rstrip("/"), schema, partition, key
        self.settings = settings or {}

    def _there(self, name: str) -> bool:
        try:
            return bool(self.spark.read.text(f"{self.root}/{name}").columns)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return False

    def _sound(self, rows: DataFrame) -> None:
        size = self.settings.get("dimension")
        if size and "vector" in rows.columns and rows.where(F.col("vector").isNotNull() & (F.size("vector") != size)).limit(1).count():
            raise ValueError(f"vectors must have {size} components")
        if rows.where(F.col(self.key).isNull()).limit(1).count():
            raise ValueError("a row without a key")

    def create(self) -> bool:
        """Writes the settings, if there are none yet; whether it did."""
        if self._there("settings"):
            return False
        self.spark.createDataFrame([(json.dumps(self.settings, sort_keys=True),)], "value string").coalesce(1).write.text(f"{self.root}/settings")
        return True

    def _all(self) -> DataFrame:
        if not self._there("data"):
            return self.spark.createDataFrame([], self.schema)
        names = [x.name for x in self.spark.createDataFrame([], self.schema).schema]
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/data").select(*names)

    def read(self) -> DataFrame:
        return self._all().where(F.col(self.key).isNotNull())

    def append(self, rows: DataFrame) -> None:
        """Adds rows, whatever keys are there already."""
        self._sound(rows)
        self.create()
        rows.write.mode("append").partitionBy(self.partition).parquet(f"{self.root}/data")

    def _replace(self, touched: list, rows: DataFrame) -> None:
        """Puts rows in place of all that the touched partitions hold."""
        self.create()
        rows.write.mode("overwrite").parquet(f"{self.root}/next")
        names = rows.columns
        marks = self.spark.createDataFrame([tuple(x if c == self.partition else None for c in names) for x in touched], rows.schema)
        staged = self.spark.read.schema(rows.schema).parquet(f"{self.root}/next").union(marks)
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.partition).parquet(f"{self.root}/data")

    def _partitions(self, rows: DataFrame) -> list:
        """The partitions of rows: access levels, so few."""
        return [r[0] for r in rows.select(self.partition).distinct().collect()]

    def _within(self, touched: list) -> Column:
        return reduce(lambda a, b: a | b, (F.col(self.partition).eqNullSafe(F.lit(x)) for x in touched), F.lit(False))

    def upsert(self, rows: DataFrame) -> None:
        """Rows replace those with their key; of several rows with one key the greatest, by all columns, stays."""
        self._sound(rows)
        others = [c for c in rows.columns if c != self.key]
        one = rows.groupBy(self.key).agg(F.max(F.struct(*others)).alias("m")).select(self.key, *(f"m.{c}" for c in others)).select(*rows.columns)
        touched = self._partitions(self.read().join(one.select(self.key), self.key, "left_semi").select(self.partition).union(one.select(self.partition)))
        rest = self.read().where(self._within(touched)).join(one.select(self.key), self.key, "left_anti")
        self._replace(touched, rest.select(*rows.columns).unionByName(one))

    def delete(self, doc_id, column: str = "doc_id") -> None:
        hit = F.col(column).eqNullSafe(F.lit(doc_id))
        touched = self._partitions(self.read().where(hit))
        if touched:
            self._replace(touched, self.read().where(self._within(touched) & ~hit))

    def find(self, value, column: str = "doc_id") -> DataFrame:
        """The rows of one document; none where it isn't there."""
        return self.read().where(F.col(column) == F.lit(value))

    def stats(self) -> DataFrame:
        rows = self.read()
        size = F.max(F.size("vector")) if "vector" in rows.columns else F.lit(None).cast("int")
        return rows.agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("documents"), size.alias("dimension"))

    def healthy(self) -> bool:
        return self._there("settings")
