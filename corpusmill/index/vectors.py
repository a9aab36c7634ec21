"""A stored index of vectors: inverted lists by learned centroids, dealt into shards of bounded size, each with a graph of near
neighbours that a search walks, and a bitmap for each value of its payload that a filter combines before vectors are read."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.retrieval import RANKED, SHOWN, top

#: Vectors that centroids are learned from at most, vectors of a list and of a shard on average, lists at most (the driver holds a
#: centroid for each), links of a vector.
FIT_ROWS, LIST_ROWS, SHARD_ROWS, LISTS, LINKS = 20_000, 16_384, 8192, 4096, 24
#: Queries that walk a graph together; vectors that each expands at a step; queries that a task holds beside a shard, on average; vectors
#: that are compared with a whole shard, or with all centroids, at once.
TOGETHER, STEP, ASKED, ROWS = 256, 4, 16_384, 256


def unit(x: np.ndarray) -> np.ndarray:
    length = np.sqrt((x**2).sum(axis=1, keepdims=True))
    return x / np.where(length > 0, length, 1.0)


def centroids(sample: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means of unit vectors."""
    found = sample[np.random.default_rng(5).permutation(len(sample))[:lists]].copy()
    for _ in range(rounds):
        at = np.argmax(sample @ found.T, axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, at, sample)
        full = np.bincount(at, minlength=len(found)) > 0
        found[full] = unit(sums[full])
    return found


def graph(v: np.ndarray, links: int = LINKS) -> np.ndarray:
    """(n, 2 * links) numbers of linked vectors, -1 where there are fewer: each vector's nearest ones, and of those that it is among
    the nearest of as many again as there is room for."""
    n, k = len(v), min(links, max(0, len(v) - 1))
    near = np.full((n, 2 * links), -1, np.int32)
    if not k:
        return near
    for a in range(0, n, ROWS):
        far = -(v[a : a + ROWS] @ v.T)
        far[np.arange(len(far)), a + np.arange(len(far))] = np.inf
        some = np.argpartition(far, k - 1, axis=1)[:, :k] if k < n - 1 else np.argsort(far, axis=1)[:, :k]
        near[a : a + ROWS, :k] = some
    back_to, back_of = near[:, :k].ravel(), np.repeat(np.arange(n, dtype=np.int32), k)
    order = np.argsort(back_to, kind="stable")
    back_to, back_of = back_to[order], back_of[order]
    place = np.arange(len(back_to)) - np.searchsorted(back_to, back_to)
    room = place < links
    near[back_to[room], k + place[room]] = back_of[room]
    return near


def walk(v: np.ndarray, links: np.ndarray, q: np.ndarray, breadth: int, able: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, scores, looked) of each query's `breadth` best vectors that the walk meets, best first: from some entry points, the best
    met so far are expanded until none of the best is left to be. able: vectors that may be found; others only lead on. looked:
    the products taken. Places of -1 stand for none."""
    n, m = len(v), len(q)
    entry = np.linspace(0, n - 1, min(n, max(breadth // 2, 16))).astype(np.int64)
    seen = np.zeros((m, n + 1), bool)
    seen[:, n] = True
    seen[:, entry] = True
    place = np.full((m, breadth), n, np.int64)
    score, done = np.full((m, breadth), -np.inf), np.ones((m, breadth), bool)
    got_place, got_score = place.copy(), score.copy()
    looked = np.full(m, len(entry), np.int64)
    allowed = np.append(np.ones(n, bool) if able is None else able, False)

    def merged(rows, new, value):
        """Takes what was met into the pool of what is expanded, and into what is found if it may be."""
        for where, at, marks in ((place, score, done), (got_place, got_score, None)):
            own = np.where(allowed[new], value, -np.inf) if marks is None else value
            all_p, all_s = np.concatenate([where[rows], new], axis=1), np.concatenate([at[rows], own], axis=1)
            best = np.argsort(-all_s, axis=1, kind="stable")[:, :breadth]
            where[rows], at[rows] = np.take_along_axis(all_p, best, axis=1), np.take_along_axis(all_s, best, axis=1)
            if marks is not None:
                flags = np.concatenate([marks[rows], ~np.isfinite(own)], axis=1)
                marks[rows] = np.take_along_axis(flags, best, axis=1)

    everyone = np.arange(m)
    merged(everyone, np.repeat(entry[None, :], m, axis=0), q @ v[entry].T)
    active = everyone
    while len(active):
        order = np.argsort(np.where(done[active], np.inf, -score[active]), axis=1, kind="stable")[:, :STEP]
        chosen = np.take_along_axis(place[active], order, axis=1)
        chosen[np.take_along_axis(done[active], order, axis=1)] = n
        done[active[:, None], order] = True
        padded = np.concatenate([links, np.full((1, links.shape[1]), -1, links.dtype)])
        new = padded[chosen].reshape(len(active), -1).astype(np.int64)
        new[new < 0] = n
        new.sort(axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = n
        new[seen[active[:, None], new]] = n
        seen[active[:, None], new] = True
        fresh = new < n
        value = np.full(new.shape, -np.inf)
        row, col = np.nonzero(fresh)
        value[row, col] = (q[active[row]] * v[new[row, col]]).sum(axis=1)
        looked[active] += fresh.sum(axis=1)
        merged(active, new, value)
        active = active[(~done[active]).any(axis=1)]
    got_place[~np.isfinite(got_score)] = -1
    return got_place, got_score, looked


def bitmap(flags: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(flags).tobytes(), 1)


def opened(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(raw), np.uint8), count=n).astype(bool)


class VectorIndex:
    """Tables below a folder: lists (list, centroid), shards (shard, n, ids, vectors, links; partitioned by list) and payload (list,
    shard, field, value, rows, bits). Every sound vector is in one shard; what isn't sound (null, empty, zero, with a null or
    non-finite component, or of another dimension) is in none. All are plain Parquet."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def build(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", payload: list[str] | None = None) -> VectorIndex:
        """Indexes every row of vectors. payload: columns (string or array of strings) that searches may filter by. The dimension is
        the most frequent one. Centroids are learned on a bounded sample (FIT_ROWS, by a hash of the id); a list with more rows
        than a shard's is dealt to several by a hash, so that a dense spot of a third of all rows never meets in one task."""
        payload = payload or []
        x = F.col(vector_col).cast("array<double>")
        sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
        rows = vectors.where(sound & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), x.alias("v"), *payload)
        sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        if not sizes:
            raise ValueError("no vector to index")
        rows = rows.where(F.size("v") == sizes["d"])
        some = rows.orderBy(F.xxhash64(F.lit("fit"), "id")).limit(FIT_ROWS).select("v").toArrow().column("v").combine_chunks()
        some = unit(some.flatten().to_numpy().reshape(-1, sizes["d"]))
        made = centroids(some, int(np.clip(-(-sizes["count"] // LIST_ROWS), 1, min(LISTS, len(some)))))
        self.spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(made)], "list int, centroid array<double>").write.parquet(f"{self.folder}/lists")

        @F.pandas_udf("int")
        def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                x = batch.to_numpy()
                yield pd.Series(np.concatenate([np.zeros(0, np.int32), *(np.argmax(np.stack(x[a : a + ROWS]) @ made.T, axis=1).astype(np.int32) for a in range(0, len(x), ROWS))]))

        placed = rows.withColumn("list", nearest("v"))
        # what is sent to every executor here and in a search has a row for each list, LISTS at most; lists then aren't dealt whole
        parts = placed.groupBy("list").agg(F.ceil(F.count("*") / SHARD_ROWS).alias("parts"))
        dealt = placed.join(F.broadcast(parts), "list").withColumn("shard", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")

        def pack(group: pa.Table) -> pa.Table:
            group = group.sort_by("id")
            ids, v = group.column("id").to_numpy(), group.column("v").combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)
            bits = []
            for field in payload:
                held: dict[str, np.ndarray] = {}
                for k, value in enumerate(group.column(field).to_pylist()):
                    for one in value if isinstance(value, list) else [value]:
                        if one is not None:
                            held.setdefault(one, np.zeros(len(ids), bool))[k] = True
                bits += [{"field": field, "value": value, "rows": int(flags.sum()), "bits": bitmap(flags)} for value, flags in sorted(held.items())]
            kind = pa.list_(pa.struct([("field", pa.string()), ("value", pa.string()), ("rows", pa.int32()), ("bits", pa.binary())]))
            return pa.table({"list": pa.array([group.column("list")[0].as_py()], pa.int32()), "shard": pa.array([group.column("shard")[0].as_py()], pa.int32()), "n": pa.array([len(ids)], pa.int32()), "ids": [ids.tobytes()], "vectors": [v.tobytes()], "links": [graph(unit(v)).tobytes()], "payload": pa.array([bits], kind)})

        packed = dealt.groupBy("list", "shard").applyInArrow(pack, "list int, shard int, n int, ids binary, vectors binary, links binary, payload array<struct<field:string,value:string,rows:int,bits:binary>>")
        packed.write.parquet(f"{self.folder}/packed")
        packed = self._table("packed")
        packed.drop("payload").write.partitionBy("list").parquet(f"{self.folder}/shards")
        packed.select("list", "shard", "n", F.inline("payload")).sortWithinPartitions("field", "value").write.parquet(f"{self.folder}/payload")
        return self

    def matching(self, where: dict[str, list[str]]) -> DataFrame:
        """(list, shard, able binary, able_rows): of shards that hold a row with one of the values of every field of where, the rows that
        do, as a bitmap. The bitmaps of a field's values are joined by OR, those of fields by AND; vectors aren't read. An empty
        list of values admits none."""
        wanted = [F.col("field").eqNullSafe(f) & F.col("value").isin(values) if values else F.lit(False) for f, values in where.items()]
        fields = len(where)
        any_of = wanted[0]
        for x in wanted[1:]:
            any_of = any_of | x

        def combine(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
            n, each = group.column("n")[0].as_py(), {}
            for field, bits in zip(group.column("field").to_pylist(), group.column("bits").to_pylist()):
                each[field] = each.get(field, np.zeros(n, bool)) | opened(bits, n)
            able = np.logical_and.reduce(list(each.values())) if len(each) == fields else np.zeros(n, bool)
            return pa.table({"list": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()), "able": [bitmap(able)], "able_rows": pa.array([int(able.sum())], pa.int32())})

        found = self._table("payload").where(any_of).groupBy("list", "shard").applyInArrow(combine, "list int, shard int, able binary, able_rows int")
        return found.where("able_rows > 0")

    def search(self, queries: DataFrame, k: int, probe: int | None = None, breadth: int = 64, where: dict[str, list[str]] | None = None, exact: bool = False, least: float | None = None, query_id: str = "query_id", query_vector: str = "query_vector", id_col: str = "vec_id") -> DataFrame:
        """(query_id, id, score, rank, looked): the k nearest by cosine that the search finds, ties to smaller ids; looked counts the
        products that the query took in all shards. probe: lists that a query visits, its nearest (all where None). breadth: how
        many of the best are kept on a walk; the greater, the nearer to all. exact: every vector of the shards is compared, which
        with all lists is the exact answer. where: see matching; only shards that match are read. least: a score to reach.
        Queries without a sound vector of the index's dimension find nothing."""
        able = self.matching(where) if where is not None else None
        lists = self._table("lists")
        made = [np.array(r["centroid"]) for r in lists.orderBy("list").collect()]  # LISTS at most
        table, d = np.stack(made), len(made[0])
        x = F.col(query_vector).cast("array<double>")
        sound = (F.size(x) == d) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
        asked = queries.where(sound).select(F.col(query_id).alias("q_id"), x.alias("q"))
        width = min(len(table), probe or len(table))

        @F.pandas_udf("array<int>")
        def visited(batch: pd.Series) -> pd.Series:
            x = batch.to_numpy()
            near = (np.argsort(-(np.stack(x[a : a + ROWS]) @ table.T), axis=1, kind="stable")[:, :width].astype(np.int32) for a in range(0, len(x), ROWS))
            return pd.Series([one for some in near for one in some])

        visits = asked.withColumn("list", F.explode(visited("q")))
        # a shard meets a part of the queries that visit it, both of bounded size, and every such pair is a group of its own: a task holds one
        # shard at a time, whatever the number of shards and queries
        held = (self._table("packed") if able is None else able).groupBy("list").agg(F.collect_list("shard").alias("held"))
        counts = visits.groupBy("list").agg(F.ceil(F.count("*") / ASKED).alias("parts"))
        part = F.pmod(F.xxhash64("q_id"), F.col("parts"))
        groups = visits.join(F.broadcast(counts), "list").join(F.broadcast(held), "list").select("list", F.explode("held").alias("shard"), part.alias("part"), "q_id", "q")
        shards = self._table("shards")
        shards = shards.join(able, ["list", "shard"]) if able is not None else shards.withColumns({"able": F.lit(None).cast("binary")})
        beside = shards.join(F.broadcast(counts), "list").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        met = [x.groupBy("list", "shard", "part") for x in (beside.select("list", "shard", "part", "n", "ids", "vectors", "links", "able"), groups)]
        kinds = dict(queries.dtypes)[query_id]

        def run(shard: pa.Table, who: pa.Table) -> pa.Table:
            names, out = [query_id, id_col, "score", "looked"], []
            if shard.num_rows and who.num_rows:
                n, ids, raw, linked, flags = (shard.column(c)[0].as_py() for c in ("n", "ids", "vectors", "links", "able"))
                ids, v, linked = np.frombuffer(ids, np.int64), unit(np.frombuffer(raw, np.float64).reshape(n, -1)), np.frombuffer(linked, np.int32).reshape(n, -1)
                mask = None if flags is None else opened(flags, n)
                own = np.arange(n) if mask is None else np.flatnonzero(mask)
                for at in range(0, who.num_rows, TOGETHER):
                    some = who.slice(at, TOGETHER).combine_chunks()
                    q = unit(some.column("q").combine_chunks().flatten().to_numpy().reshape(some.num_rows, -1))
                    if exact or n <= 2 * breadth or (mask is not None and mask.sum() <= 2 * breadth):
                        score = np.round(q @ v[own].T, RANKED)
                        order = np.argsort(-score, axis=1, kind="stable")[:, :k]
                        places, scores, looked = own[order], np.take_along_axis(score, order, axis=1), np.full(len(q), len(own))
                    else:
                        places, scores, looked = walk(v, linked, q, breadth, mask)
                        places, scores = places[:, :k], np.round(scores[:, :k], RANKED)
                    good = places >= 0
                    if least is not None:
                        good &= scores >= least
                    row, col = np.nonzero(good)
                    first = np.concatenate([np.ones(min(1, len(row)), bool), row[1:] != row[:-1]])
                    none = np.flatnonzero(~good.any(axis=1))
                    whose = np.concatenate([row, none])
                    found = pa.array(np.concatenate([ids[places[row, col]], np.zeros(len(none), np.int64)]), mask=np.arange(len(whose)) >= len(row))
                    out.append(pa.table([some.column("q_id").take(pa.array(whose)), found, pa.array(np.concatenate([scores[row, col], np.zeros(len(none))])), pa.array(np.concatenate([np.where(first, looked[row], 0), looked[none]]).astype(np.int64))], names))
            return pa.concat_tables(out) if out else pa.table([pa.nulls(0, who.schema.field("q_id").type), pa.nulls(0, pa.int64()), pa.nulls(0, pa.float64()), pa.nulls(0, pa.int64())], names)

        found = met[0].cogroup(met[1]).applyInArrow(run, f"`{query_id}` {kinds}, `{id_col}` long, score double, looked long")
        from pyspark.sql import Window

        found = found.withColumn("looked", F.sum("looked").over(Window.partitionBy(query_id)))
        best = top(found.where(F.col(id_col).isNotNull()), [query_id], k, [F.desc("score"), F.col(id_col)])
        return best.withColumn("score", F.round("score", SHOWN)).select(query_id, id_col, "score", "rank", "looked")

    def size(self) -> DataFrame:
        """(lists, shards, vectors) of the index."""
        return self._table("packed").agg(F.count_distinct("list").alias("lists"), F.count("*").alias("shards"), F.coalesce(F.sum("n"), F.lit(0)).alias("vectors"))
