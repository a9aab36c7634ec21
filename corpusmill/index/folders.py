"""Where stored tables lie when a query needs some of its own."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below the folder that the cluster shares (spark.checkpoint.dir); where that is unset and all runs on this
    machine, as in tests, a temporary one. On a cluster its absence is an error, as executors would not see each other's files."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="corpusmill-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        top = f"file://{_OWN[0]}"
    return f"{top.rstrip('/')}/corpusmill/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, path: str, mode: str = "error", by: tuple[str, ...] = ()) -> DataFrame:
    """df, written to path and read again."""
    df.write.mode(mode).partitionBy(*by).parquet(path)
    return df.sparkSession.read.parquet(path)
