"""The ingest run: documents into chunks, vectors and the chunk table, with its totals."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import chunking, retrieval
from corpusmill.sources import loaders
from corpusmill.sources.store import ChunkStore

#: What a stream of files reads of each; fixed by the engine's format for whole files.
FILES = "path string, modificationTime timestamp, length long, content binary"


def chunks_of(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The usual way to chunk: recursively, with the columns of keep."""
    return chunking.recursive_chunks(docs, "doc_id", "content", keep=keep)


def totals(docs: DataFrame, chunks: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One row: documents, those without a chunk, chunks, and chunks stored (0 in a dry run)."""
    each = docs.select("doc_id").join(chunks.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left")
    out = each.agg(F.count("*").alias("documents"), F.count_if(F.col("n").isNull()).alias("empty"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"))
    kept = F.lit(0).cast("long") if stored is None else F.col("kept")
    if stored is not None:
        out = out.join(F.broadcast(stored.agg(F.count("*").alias("kept"))), F.lit(True))
    return out.select("documents", "empty", "chunks", kept.alias("stored"))


def ingest(docs: DataFrame, store: ChunkStore | None, keep: list[str], chunk: Callable[[DataFrame, list[str]], DataFrame] = chunks_of, model=None, dimension: int = 64, dry_run: bool = False) -> tuple[DataFrame, DataFrame, float]:
    """docs (doc_id, content and the columns of keep) into chunks; without dry_run these are embedded by model (default: hashed terms)
    and put into store in place of those with their chunk_id. Returns the totals, the chunks of each category (if keep has
    document_category) and the chunks stored a second, 0 in a dry run."""
    chunks, began = chunk(docs, keep), time.monotonic()
    groups = chunking.by_category(chunks) if "document_category" in keep else chunks.limit(0)
    if dry_run or store is None:
        return totals(docs, chunks), groups, 0.0
    vectors = retrieval.embedder(model or retrieval.hashed_terms(dimension), dimension)
    store.upsert(chunks.withColumn("vector", vectors("content")))
    found = totals(docs, chunks, store.read().join(chunks.select("chunk_id"), "chunk_id", "left_semi"))
    return found, groups, found.first()["stored"] / max(time.monotonic() - began, 1e-9)


def ingest_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, chunk: Callable[[DataFrame, list[str]], DataFrame] = chunks_of, model=None, dimension: int = 64, most: int = loaders.LOAD_BYTES, allowed: list[str] = loaders.LOADED, files_each: int = 1000):
    """Takes in the files that a folder holds and those that come later, each once: loaded (refused and broken ones stay as rows that say
    why), chunked, embedded and written to out/chunks/batch=<number>, the files' rows to out/files/batch=<number>. A batch that runs
    again, as after a failure, writes over its own folder, so it counts once however often it is tried. Returns the running
    query, which ends when all files that were there have been taken in."""
    vectors = retrieval.embedder(model or retrieval.hashed_terms(dimension), dimension)
    keep = ["document_category", "access_level", "source_file"]

    def take(rows: DataFrame, number: int) -> None:
        loaded = loaders.load(rows, allowed=allowed, most=most)
        loaded.write.mode("overwrite").parquet(f"{out}/files/batch={number}")
        loaded = spark.read.parquet(f"{out}/files/batch={number}")
        chunk(loaded.where("status = 'loaded'"), keep).withColumn("vector", vectors("content")).write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")

    found = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_each).load(folder)
    return found.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def taken_in(spark: SparkSession, out: str) -> DataFrame:
    """One row: files loaded, failed and skipped, chunks stored, and documents that have any."""
    files, chunks = spark.read.option("basePath", f"{out}/files").parquet(f"{out}/files"), spark.read.option("basePath", f"{out}/chunks").parquet(f"{out}/chunks")
    return loaders.ingest_counts(files).join(chunks.agg(F.count("*").alias("stored"), F.count_distinct("doc_id").alias("documents")), F.lit(True))
