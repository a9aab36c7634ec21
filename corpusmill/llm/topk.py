"""Exact top-k by inner product: vectors grouped by length, each group pruned by its own cosine threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.base import stored

#: Vectors of a block at most on average; a bucket's longest vector over its shortest, at most; tasks of the last pass at most.
BLOCK, RATIO, TASKS = 8192, 1.1, 100_000
#: Vectors of a block that a query's cost of pruning is judged from; queries whose products are taken together; vectors of the first
#: block that give the first thresholds.
PROBE, TOGETHER, SEED = 64, 256, 512
#: What rounding may add to a bound.
SLACK = 1e-9


def scaled(vector: Column, factor: int = 1024) -> Column:
    """floor(factor * x) of each component as double; null for a vector that is null or holds a null or non-finite component. A
    component whose result leaves 62 bits is an error."""
    x = vector.cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = lambda v: F.when(F.abs(v) * factor < float(1 << 62), F.floor(v * factor).cast("long")).otherwise(F.raise_error(F.lit("a component leaves 62 bits")))
    return F.when(sound, F.transform(x, whole))


def _packed(rows: DataFrame, key: str) -> DataFrame:
    """Rows (d, key, id, v) into one row for each d and key: ids and the matrix, longest vectors first, and the greatest length."""

    def pack(group: pa.Table) -> pa.Table:
        ids, d = group.column("id").to_numpy(), group.column("d")[0].as_py()
        values = group.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), d)
        length = np.sqrt((values.astype(np.float64) ** 2).sum(axis=1))
        order = np.lexsort((ids, -length))
        width = next(w for w in (2, 4, 8) if w == 8 or not d or max(-int(values.min()), int(values.max())) < 1 << (8 * w - 1))
        return pa.table({"d": pa.array([d], pa.int32()), "block": [group.column(key)[0].as_py()], "n": pa.array([len(ids)], pa.int32()), "width": pa.array([width], pa.int32()), "ids": [ids[order].tobytes()], "vectors": [values[order].astype(f"<i{width}").tobytes()], "longest": [float(length.max())]})

    return rows.groupBy("d", key).applyInArrow(pack, "d int, block long, n int, width int, ids binary, vectors binary, longest double")


def _open(ids: bytes, vectors: bytes, n: int, d: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values = np.frombuffer(vectors, f"<i{width}").reshape(n, d).astype(np.int64)
    return np.frombuffer(ids, np.int64), values, np.sqrt((values.astype(np.float64) ** 2).sum(axis=1))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: through doubles where these hold every sum exactly. One that leaves 64 bits is an error."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most >= 2**62 and np.abs(a.astype(np.float64) @ b.T.astype(np.float64)).max(initial=0) >= 2**62:
        raise OverflowError("an inner product leaves 62 bits")
    return a @ b.T  # sums that wrap on the way come back


def block_top(q_ids, q, q_len, ids, vectors, lengths, k: int, floor: np.ndarray, tally: dict[str, int] | None = None) -> Iterator[tuple[int, int, int]]:
    """(query, vector, score) of a block that can be among a query's k best, given that k scores of floor or more are known
    elsewhere (floor: least long where not). vectors: longest first.

    A query's floor over its length is the length that a vector must have to reach it at cosine 1, and the floor over both
    lengths the cosine that it must have: the local threshold. Length pruning keeps the vectors that are long enough.
    Coordinate pruning also drops those whose products in the query's f largest coordinates, and of the rest the product of
    the remaining lengths, stay below the threshold. For each query the cheaper one is chosen, and f with it, from what a
    probe of the block's vectors would cost; products of what is left decide. Queries without a positive floor meet all.
    tally counts the products taken (verified), and queries by the way chosen."""
    n, d = vectors.shape
    tally = {} if tally is None else tally
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where((floor > 0) & (q_len > 0), floor / q_len, 0.0)
    stay = np.where(need > 0, np.searchsorted(-lengths, -need * (1 - SLACK), side="right"), n)
    unit, dense = None, []
    for i in np.flatnonzero(stay > 0).tolist():
        m, low = int(stay[i]), float(floor[i])
        if need[i] > 0 and m >= PROBE and d > 1:
            if unit is None:
                unit = np.ascontiguousarray((vectors / np.maximum(lengths, 1e-300)[:, None]).T)
            direction = q[i] / q_len[i]
            order = np.argsort(-np.abs(direction), kind="stable")
            turned = direction[order]
            rest = np.sqrt(np.maximum(0.0, 1 - np.cumsum(turned**2)))
            at = np.linspace(0, m - 1, PROBE).astype(int)
            seen = unit[order][:, at]
            bound = np.cumsum(seen * turned[:, None], axis=0) + np.sqrt(np.maximum(0.0, 1 - np.cumsum(seen**2, axis=0))) * rest[:, None]
            left = (bound * lengths[at] * q_len[i] >= low * (1 - SLACK)).mean(axis=1)
            cost = 2 * np.arange(1, d + 1) + d * left
            f = int(np.argmin(cost)) + 1
            if cost[f - 1] < d:
                focus = order[:f]
                some = unit[focus, :m]
                bound = direction[focus] @ some + np.sqrt(np.maximum(0.0, 1 - (some**2).sum(axis=0))) * rest[f - 1]
                near = np.flatnonzero(bound * lengths[:m] * q_len[i] >= low * (1 - SLACK))
                tally["coordinate"] = tally.get("coordinate", 0) + 1
                tally["verified"] = tally.get("verified", 0) + len(near)
                yield from _best(q_ids[i], ids[near], _products(q[i : i + 1], vectors[near])[0], k, floor[i])
                continue
        tally["length"] = tally.get("length", 0) + 1
        dense.append(i)
    dense.sort(key=lambda i: stay[i])
    for a in range(0, len(dense), TOGETHER):
        some = np.array(dense[a : a + TOGETHER])
        most = int(stay[some[-1]])
        tally["verified"] = tally.get("verified", 0) + len(some) * most
        for i, score in zip(some, _products(q[some], vectors[:most])):
            yield from _best(q_ids[i], ids[:most], score, k, floor[i])


def _best(query: int, ids: np.ndarray, score: np.ndarray, k: int, floor: int) -> Iterator[tuple[int, int, int]]:
    able = np.flatnonzero((score >= floor) & (ids != query))
    if len(able) > k:
        able = able[score[able] >= np.partition(score[able], -k)[-k]]
        able = able[np.lexsort((ids[able], -score[able]))[:k]]
    yield from zip([query] * len(able), ids[able].tolist(), score[able].tolist())


def seeded(q_ids, q, q_len, ids, vectors, lengths, k: int, tally: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of each query's k best in the first block, and the k-th best score of each query, in the order of q_ids
    (least long where there are fewer). The block's SEED longest vectors give thresholds, the rest is pruned by them: no product
    is taken twice."""
    least = np.iinfo(np.int64).min
    found: dict[int, list[tuple[int, int]]] = {x: [] for x in q_ids.tolist()}
    floor = np.full(len(q_ids), least)
    for part in (slice(0, SEED), slice(SEED, None)):
        for query, vec, score in block_top(q_ids, q, q_len, ids[part], vectors[part], lengths[part], k, floor, tally):
            found[query].append((-score, vec))
        found = {x: sorted(some)[:k] for x, some in found.items()}
        floor = np.array([-found[x][-1][0] if len(found[x]) == k else least for x in q_ids.tolist()], np.int64)
    rows = np.array([(x, vec, -score) for x, some in found.items() for score, vec in some], np.int64).reshape(-1, 3)
    return rows[:, 0], rows[:, 1], rows[:, 2], floor


def top_k(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = 1024, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where queries holds, the k other rows with the greatest inner products of
    floor(factor * x) vectors, all of them if fewer; ties go to smaller ids.

    Buckets of like length, split at random into blocks of bounded size, so that vectors of one length never meet in one task;
    queries come in blocks too. The first pass takes each query block's best of the block of the longest vectors (see seeded):
    the first threshold. Then the other blocks' greatest lengths meet the query blocks' least needed ones, without the matrices:
    only pairs that can add anything fetch these, and the second pass prunes within them. A pair of blocks gives at most k rows
    for a query, which are ranked at last.

    Rows with a null id or an unsound vector take no part. Inner products are those of vectors of one dimension: in a table
    that mixes them a query meets the vectors of its own. Rows that repeat an id are distinct candidates but never
    candidates of a query with their id, and a repeated query id is one query, its vector the longest by components, then
    the greatest; other columns are ignored; empty tables give an empty result. Components or scores that leave 62 bits are
    an error.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), scaled(F.col(vector_col), factor).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).where("id IS NOT NULL AND v IS NOT NULL")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    bucket = F.floor(F.log(F.greatest(square, F.lit(1.0))) / (2 * float(np.log(RATIO)))).cast("int")
    rows = rows.withColumns({"d": F.size("v"), "bucket": bucket})
    # a dimension has under a thousand buckets, as they grow with the logarithm of the lengths: this is small
    sizes = F.broadcast(rows.groupBy("d", "bucket").agg(F.ceil(F.count("*") / block).alias("parts")))
    place = (F.col("bucket").cast("long") * (1 << 32)) + F.pmod(F.xxhash64("id", "v"), F.col("parts"))
    blocks = stored(_packed(rows.join(sizes, ["d", "bucket"]).select("d", "id", "v", place.alias("key")), "key"), "blocks")
    asking = rows.where("asks").groupBy("id").agg(F.max(F.struct("d", "v")).alias("m")).select("id", "m.d", "m.v")
    asked = F.broadcast(rows.where("asks").groupBy("d").agg(F.ceil(F.count("*") / block).alias("groups")))
    groups = _packed(asking.join(asked, "d").select("d", "id", "v", F.pmod(F.xxhash64("id"), F.col("groups")).alias("key")), "key")
    groups = stored(groups.select("d", *(F.col(c).alias(f"q_{c}") for c in ("block", "n", "width", "ids", "vectors"))), "queries")

    def beside(some: DataFrame) -> DataFrame:
        """some (with d) beside the number of every query block of its dimension."""
        return some.join(asked, "d").withColumn("q_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).drop("groups")

    def floors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """What a block of queries finds in the first block, the k-th best score of each, and the least length needed."""
        for batch in batches:
            for r in batch.itertuples():
                q_ids, q, q_len = _open(r.q_ids, r.q_vectors, r.q_n, r.d, r.q_width)
                query, vec, score, got = seeded(q_ids, q, q_len, *_open(r.ids, r.vectors, r.n, r.d, r.width), k)
                need = np.where((got > 0) & (q_len > 0), got / np.maximum(q_len, 1e-300), 0.0).min()
                yield pd.DataFrame({"d": [r.d], "q_block": [r.q_block], "q_n": [r.q_n], "q_width": [r.q_width], "q_ids": [r.q_ids], "q_vectors": [r.q_vectors], "floors": [got.tobytes()], "need": [need], "first": [[{"query_id": x, "vec_id": y, "score": z} for x, y, z in zip(query.tolist(), vec.tolist(), score.tolist())]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                found = block_top(*_open(r.q_ids, r.q_vectors, r.q_n, r.d, r.q_width), *_open(r.ids, r.vectors, r.n, r.d, r.width), k, np.frombuffer(r.floors, np.int64))
                yield pd.DataFrame(list(found), columns=["query_id", "vec_id", "score"])

    seed = blocks.groupBy("d").agg(F.max(F.struct("longest", "n", "block")).alias("m")).select("d", F.col("m.block").alias("block"))
    first = beside(blocks.join(seed, ["d", "block"])).join(groups, ["d", "q_block"])
    started = stored(first.mapInPandas(floors, "d int, q_block long, q_n int, q_width int, q_ids binary, q_vectors binary, floors binary, need double, first array<struct<query_id:long,vec_id:long,score:long>>"), "floors")
    others = blocks.join(seed, ["d", "block"], "left_anti")
    pairs = beside(others.select("d", "block", "longest")).join(started.select("d", "q_block", "need"), ["d", "q_block"])
    pairs = stored(pairs.where(F.col("longest") >= F.col("need") * (1 - SLACK)).select("d", "block", "q_block"), "pairs")
    met = pairs.join(blocks, ["d", "block"]).join(started.drop("need", "first"), ["d", "q_block"])
    found = met.repartition(max(1, min(pairs.count(), TASKS))).mapInPandas(run, "query_id long, vec_id long, score long")
    found = found.union(started.select(F.inline("first")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
