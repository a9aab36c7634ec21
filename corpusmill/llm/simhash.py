"""SimHash near-duplicates: segment popcounts place fingerprints on a lattice, a grid join under Manhattan distance finds
candidates, and the bits decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.base import free, long_texts, released, stored
from corpusmill.llm.graph import connected_components

SEED = 42
BLOCK, PRINTS = 1 << 15, 1 << 14


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of whole text as an unsigned number: words are runs outside ASCII white space, A-Z lower-cased; shingles
    keep repeats; a text shorter than a shingle is one shingle, a text without words gives 0, like null."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(starts), BLOCK):
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts[k : k + BLOCK].tolist(), ends[k : k + BLOCK].tolist())], np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * total > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprint_column(text: Column, shingle: int = 3) -> Column:
    """The fingerprint as a signed 64-bit number."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.array([fingerprint(x, shingle) for x in batch], np.uint64).view(np.int64))
        released()

    return of(text)


def _signed(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def lattice_point(fp: Column) -> Column:
    """Bits set in each of the 16 four-bit segments, a nibble each: the point's 16 coordinates in one number. Every bit
    that differs moves a coordinate by one at most, so Manhattan distance never exceeds Hamming distance."""
    bits = [F.shiftrightunsigned(fp, k).bitwiseAND(_signed(0x1111111111111111)) for k in range(4)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def _cells(point: Column) -> Column:
    """The lattice points at Manhattan distance 0 or 1: two points within 2 of each other share at least one."""
    near = [point]
    for k in range(16):
        at, one = F.shiftrightunsigned(point, 4 * k).bitwiseAND(F.lit(15)), _signed(1 << 4 * k)
        near += [F.when(at > 0, point - one), F.when(at < 4, point + one)]
    return F.array_compact(F.array(*near))


def links(prints: DataFrame) -> DataFrame:
    """prints: distinct fingerprints (fp long). Returns edges (a, b), each of two fingerprints at 2 or fewer differing bits,
    such that fingerprints are connected by edges exactly if they are by all such pairs.

    Grid range join: a fingerprint enters its lattice cell and the cells next to it; cells with one visitor end there. In
    the rest the bits decide: of a cell's visitors, those that turn into the same 64 bits by at most one flip lie within 2
    bits of each other, and each such set is tied to its least member. Rows grow with the number of fingerprints, never
    with the square of a cell; a task takes PRINTS of them, each of which becomes some thirty rows.
    """
    prints = prints.repartition(max(1, -(-prints.count() // PRINTS)), "fp")
    visits = prints.select("fp", F.explode(_cells(lattice_point(F.col("fp")))).alias("cell"))
    shared = visits.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell")
    flips = [F.col("fp"), *(F.col("fp").bitwiseXOR(_signed(1 << k)) for k in range(64))]
    centres = visits.join(shared, "cell", "left_semi").select("fp", F.explode(F.filter(F.array(*flips), lambda c: lattice_point(c) == F.col("cell"))).alias("centre"))
    centres = stored(centres, "centres")
    hubs = centres.groupBy("centre").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1").select("centre", "hub")
    return centres.join(hubs, "centre").where((F.col("fp") != F.col("hub")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))) <= 2)).select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, content, fp, root, component) for each row: content is a hash of the text, rows of one group share root."""
    long_texts(docs.sparkSession)
    content = F.xxhash64(F.coalesce(text_col, F.lit("")))
    rows = stored(docs.select(F.col(id_col).alias("id"), content.alias("content"), fingerprint_column(F.col(text_col), shingle).alias("fp")), "fingerprints")
    prints = stored(rows.groupBy("fp").agg(F.min("id").alias("first")), "prints")
    roots = connected_components(links(prints.select("fp")))
    placed = prints.join(roots, prints.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("first").alias("component"))
    return rows.join(placed.join(named, "root").select("fp", "root", "component"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp long, component): component is the smallest id reachable over links of 2 or fewer differing bits, the
    row's own included.

    Null and word-less texts have fingerprint 0 and are linked like any other; a null id keeps its row and never names a
    component unless all ids of the component are null (then null); repeated rows stay; other columns are ignored; an
    empty table gives an empty result.
    """
    return grouped(docs, id_col, text_col, shingle).select(F.col("id").alias(id_col), "fp", "component")


def fingerprint_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def least_of_each(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each root of groups (id, content, root): the one with the smallest id (null behind all others), of rows
    that share it one with the least hash of its text. docs keep all their columns, whatever their names."""
    who, of, own = free(docs, "__id", "__of", "__content")
    best = groups.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "content")).alias("best"))
    best = best.select(F.col("best.id").alias(who), F.col("best.content").alias(of)).distinct()
    keyed = docs.withColumn(own, F.xxhash64(F.coalesce(text_col, F.lit(""))))
    kept = keyed.join(best, (F.col(own) == F.col(of)) & F.col(id_col).eqNullSafe(F.col(who)), "left_semi")
    return kept.dropDuplicates([id_col, own]).select(*docs.columns)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, exact: bool = False) -> DataFrame:
    """The rows of docs that stay when one of each group of near-duplicates is kept: the one with the smallest id (null behind all
    others), of rows that share it one with the least hash of its text. Texts without words are one group.

    exact: texts are near if the similarity of their shingle sets is 0.8 or more, decided by the whole sets. Two bits reach few
    of such pairs: a bit differs with a chance of 0.15 at that similarity, ten of 64 on average. Fingerprints then give the
    nearest candidates only and bands of least hashes the others (see jaccard)."""
    if exact:
        from corpusmill.llm import jaccard

        return least_of_each(docs, jaccard.grouped(docs, id_col, text_col, shingle), id_col, text_col)
    return least_of_each(docs, grouped(docs, id_col, text_col, shingle), id_col, text_col)
