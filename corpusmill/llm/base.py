"""What the operators share: scratch tables in the cluster's shared folder, keys for rows, table readers."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). Where the setting is absent and everything runs on this machine, as
    in tests, a temporary one; executors on other machines would not see that, so on a cluster its absence is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="corpusmill-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/corpusmill/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: cuts the lineage so that a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores more as df's columns (in any case of letters) and the names before it ask for."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def long_texts(spark: SparkSession) -> None:
    """Holds Arrow batches to a number of rows that fits memory beside whole texts; plans made from now on have it."""
    key, most = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
    if not 0 < int(spark.conf.get(key)) <= most:
        spark.conf.set(key, str(most))


def released() -> None:
    """Gives freed memory back to the system: Python workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def crc_fold(id_col: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n
