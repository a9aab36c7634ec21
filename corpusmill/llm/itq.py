"""Near-duplicate vectors: balanced binary codes by iterative quantisation, multi-index Hamming tables, exact cosines at last."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.base import free, stored
from corpusmill.llm.graph import connected_components

#: What a rotation is learned on at most: rows, and components in all. Dimensions of which rotations are learned; the others', which
#: are the rarest, are random.
FIT_ROWS, FIT_VALUES, LEARNED = 16_384, 4_000_000, 8
#: Share of pairs just at the threshold that must meet in a table; tables at most; bits of a key that may be flipped.
RECALL, TABLES, FLIPPED = 0.995, 24, 7
#: Visitors of a cell that meet in one row, vectors of a block, at most on average.
VISITORS, BLOCK = 512, 1024
#: Angles closer to a bound than this are settled by the vectors themselves.
SLACK = 1e-6

_SUBSETS = np.array([[m >> k & 1 for k in range(FLIPPED)] for m in range(1 << FLIPPED)], np.float64)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors at length 1, whatever their scale."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


@dataclass(frozen=True)
class Codes:
    """A dimension's quantiser: bits are the signs of (x - mean) @ turn. A vector's key in a table is `width` of its bits; it visits
    the cells of its key with such of its FLIPPED least certain bits flipped whose squares sum up to `budget` at most."""

    mean: np.ndarray
    turn: np.ndarray
    width: int
    tables: int
    budget: float
    spread: float

    def bits(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = (vectors - self.mean) @ self.turn
        return y > 0, y**2

    def word(self, bits: np.ndarray) -> np.ndarray:
        """The first 64 bits, which the tables' candidates are compared by."""
        return np.packbits(bits[:, :64], axis=1, bitorder="little").view(np.uint64)[:, 0].view(np.int64)

    def cells(self, bits: np.ndarray, squares: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, 2 ** FLIPPED) keys in a table, the first one unflipped, and what each costs."""
        part = slice(t * self.width, (t + 1) * self.width)
        own, cost = bits[:, part].astype(np.int64), squares[:, part]
        least = np.argsort(cost, axis=1, kind="stable")[:, :FLIPPED]
        k = least.shape[1]
        key = own @ (1 << np.arange(self.width, dtype=np.int64))
        subsets = _SUBSETS[: 1 << k, :k]
        turned = (1 << least.astype(np.int64)) @ subsets.T.astype(np.int64)
        return key[:, None] ^ turned, np.take_along_axis(cost, least, axis=1) @ subsets.T

    def apart(self, angle: np.ndarray) -> np.ndarray:
        """Bits of 64 that two vectors at this angle or less hardly ever exceed."""
        p = np.minimum(0.5, self.spread * np.minimum(angle, math.pi) / math.pi)
        return np.ceil(64 * p + 5 * np.sqrt(64 * p * (1 - p)) + 1)


def _rotation(x: np.ndarray, d: int, rng: np.random.Generator, steps: int = 30) -> np.ndarray:
    """(d, bits): principal directions of centred rows, turned so that the signs are as near to the values as may be: iterative
    quantisation. Too few rows give a random turn."""
    k = min(d, 64)
    turn = np.linalg.qr(rng.normal(size=(k, k)))[0]
    if len(x) < 4 * k:
        return np.linalg.qr(rng.normal(size=(d, k)))[0]
    main = np.linalg.svd(x, full_matrices=False)[2][:k].T
    y = x @ main
    for _ in range(steps):
        u, _, v = np.linalg.svd(np.where(y @ turn > 0, 1.0, -1.0).T @ y)
        turn = (u @ v).T
    return main @ turn


def _neighbours(x: np.ndarray, cosine: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Pairs just at the threshold: a sampled vector moved any way, and moved towards another sampled vector."""
    some = x[rng.permutation(len(x))[:400]]
    ways = np.concatenate([rng.normal(size=some.shape), x[rng.integers(0, len(x), len(some))] + 1e-3 * rng.normal(size=some.shape)])
    both = np.concatenate([some, some])
    ways = ways - (ways * both).sum(axis=1, keepdims=True) * both
    length = np.sqrt((ways**2).sum(axis=1, keepdims=True))
    return both, cosine * both + math.sqrt(1 - cosine**2) * ways / np.where(length > 0, length, 1.0)


def fit(x: np.ndarray, d: int, rows: int, cosine: float, seed: int = 11) -> Codes:
    """Codes for about `rows` vectors of dimension d from a sample x of unit vectors (rows, d). Keys have as many bits as make a
    cell per vector; the number of tables and the flips' budget are the cheapest ones by which RECALL of made-up pairs just at
    the threshold meet, for either way of making them. Rotations beyond the first start from other random turns."""
    rng = np.random.default_rng(seed)
    width = int(np.clip(round(math.log2(max(2, rows))), 6, 40))
    mean = x.mean(axis=0) if len(x) >= 4 * min(d, 64) else np.zeros(d)
    turns = []
    while sum(t.shape[1] for t in turns) < max(64, width * TABLES):
        turns.append(_rotation(x - mean, d, rng))
    made = Codes(mean, np.concatenate(turns, axis=1), width, TABLES, 0.0, 1.0)
    if d == 1 or len(x) < 2:
        x = unit(rng.normal(size=(64, d)) if d > 1 else np.ones((2, 1)))
    a, b = _neighbours(x, cosine, rng)
    (bits_a, sq_a), (bits_b, sq_b) = made.bits(a), made.bits(b)
    need = np.full((len(a), TABLES), np.inf)  # the least budget by which a pair meets in a table
    costs = []
    for t in range(TABLES):
        (cell_a, cost_a), (cell_b, cost_b) = made.cells(bits_a, sq_a, t), made.cells(bits_b, sq_b, t)
        costs.append(cost_a)
        for i in range(len(a)):
            _, at, to = np.intersect1d(cell_a[i], cell_b[i], return_indices=True)
            if len(at):
                need[i, t] = np.maximum(cost_a[i, at], cost_b[i, to]).min()
    half, best = len(a) // 2, None
    for tables in range(2, TABLES + 1):
        met = need[:, :tables].min(axis=1)
        budget = max(np.quantile(met[:half], RECALL, method="higher"), np.quantile(met[half:], RECALL, method="higher"))
        visits = tables * np.mean([(c <= budget).sum(axis=1).mean() for c in costs[:tables]])
        if np.isfinite(budget) and (best is None or visits < best[0]):
            best = visits, tables, float(budget)
    _, tables, budget = best or (0, TABLES, math.inf)
    differ = (bits_a[:, :64] != bits_b[:, :64]).mean(axis=1)
    spread = float(max(1.0, differ[:half].mean(), differ[half:].mean()) if d == 1 else max(1.0, max(differ[:half].mean(), differ[half:].mean()) * math.pi / math.acos(cosine)))
    return Codes(mean, made.turn[:, : max(64, width * tables)], width, tables, budget, spread)


def sound(vector: Column) -> Column:
    """The vector in doubles; null where it is null, empty or zero or holds a null or non-finite component."""
    x = vector.cast("array<double>")
    return F.when(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0), x)


def fitted(vectors: DataFrame, cosine: float) -> tuple[dict[int, Codes], int]:
    """Codes of the most frequent dimensions of vectors (d int, v array<double>), and the number of rows. A bounded sample, chosen
    by a hash, is all that comes to the driver."""
    sizes = vectors.groupBy("d").count()
    rows = sizes.agg(F.sum("count")).first()[0] or 0
    made = {}
    for r in sizes.orderBy(F.desc("count"), "d").limit(LEARNED).collect():
        most = max(1, min(FIT_ROWS, FIT_VALUES // r["d"]))
        some = vectors.where(F.col("d") == r["d"]).orderBy(F.xxhash64(F.lit("fit"), "num")).limit(most).select("v").toArrow()
        x = unit(some.column("v").combine_chunks().flatten().to_numpy().reshape(-1, r["d"]))
        made[r["d"]] = fit(x, r["d"], r["count"], cosine)
    return made, rows


def _coded(vectors: DataFrame, models: dict[int, Codes], rows: int, cosine: float) -> DataFrame:
    """(num, d, weight, least, u binary, word, spread, key, cells): each vector's unit form, code, first key and the cells that it visits."""
    known = dict(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, some in batch.groupby("d"):
                d = int(d)
                if d not in known:
                    known[d] = fit(np.zeros((0, d)), d, rows, cosine)
                codes = known[d]
                u = unit(np.stack(some["v"].to_numpy()).astype(np.float64).reshape(-1, d))
                bits, squares = codes.bits(u)
                cells = []
                for t in range(codes.tables):
                    keys, costs = codes.cells(bits, squares, t)
                    # the dimension, the table and the key, one beside the other: no two cells share a number
                    cells.append(((keys << 23) | (t << 18) | (d % (1 << 18)), costs <= codes.budget))
                all_keys, paid = (np.concatenate([c[k] for c in cells], axis=1) for k in (0, 1))
                yield pd.DataFrame({"num": some["num"], "d": d, "weight": some["weight"], "least": some["least"], "u": [x.tobytes() for x in u], "word": codes.word(bits), "key": cells[0][0][:, 0], "cells": [k[p] for k, p in zip(all_keys, paid)]})

    return vectors.select("num", "d", "weight", "least", "v").mapInPandas(run, "num long, d int, weight long, least long, u binary, word long, key long, cells array<long>")


def _near(one: Column, two: Column) -> Column:
    """Cosines of unit vectors (binary doubles), in batches."""

    @F.pandas_udf("double")
    def cosines(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([float(np.frombuffer(x, np.float64) @ np.frombuffer(y, np.float64)) for x, y in zip(a, b)], dtype=float)

    return cosines(one, two)


def _clumps(coded: DataFrame, cosine: float, rounds: int = 2) -> DataFrame:
    """(num, clump, away): vectors of one key within half the threshold's angle of the key's least vector are its clump, those left
    over form another around their own least one, the rest are each a clump; away is the angle from the clump's first vector.
    All vectors of a clump are linked, as each is at half the angle from one: no pair of them need be looked at."""
    half = math.acos(cosine) / 2 - SLACK
    rest, out = coded.select("num", "d", "key", "u"), None
    for _ in range(rounds):
        first = rest.groupBy("d", "key").agg(F.min_by("u", "num").alias("first"), F.min("num").alias("clump"), F.count("*").alias("n")).where("n > 1").drop("n")
        first = stored(first, "first")  # a table of its own, so that the engine can split a key that many share
        met = rest.join(first, ["d", "key"], "left").withColumn("away", F.when(F.col("num") == F.col("clump"), 0.0).when(F.col("clump").isNotNull(), F.acos(F.least(F.lit(1.0), _near(F.coalesce("u", F.lit(b"")), F.coalesce("first", "u"))))))
        met = stored(met.select("num", "d", "key", "u", "clump", "away"), "clumps")
        taken = met.where(F.col("away") <= half).select("num", "clump", "away")
        out = taken if out is None else out.union(taken)
        rest = met.where(F.col("away").isNull() | (F.col("away") > half)).select("num", "d", "key", "u")
    return out.union(rest.select("num", F.col("num").alias("clump"), F.lit(0.0)))


def _meetings(visits: DataFrame, models: dict[int, Codes], angle: float) -> DataFrame:
    """(a, b) clumps, a < b, that visit a cell together and whose codes are no farther apart than linked vectors of theirs make
    likely. visits: (cell, clump, word, d, far). A cell's visitors are dealt to rows of VISITORS, which meet two and two."""
    parts = F.ceil(F.count("*") / VISITORS).cast("int")
    shared = visits.groupBy("cell", "d").agg(F.count("*").alias("n"), parts.alias("parts")).where("n > 1").drop("n")
    seats = visits.join(shared, ["cell", "d"]).withColumn("part", F.pmod(F.xxhash64("clump"), F.col("parts")).cast("int"))
    tables = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(F.least("part", x).alias("i"), F.greatest("part", x).alias("j")))
    seats = seats.select("cell", "d", "part", "clump", "word", "far", F.explode(tables).alias("at")).repartition("cell", "d", "at").groupBy("cell", "d", "at").agg(F.collect_list(F.struct("part", "clump", "word", "far")).alias("who"))
    limits = {d: codes.apart(angle + np.arange(0, 65) / 64 * angle) for d, codes in models.items()}
    free_limit = np.full(65, 65.0)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who = batch.column("who").combine_chunks() if isinstance(batch.column("who"), pa.ChunkedArray) else batch.column("who")
            starts, size = who.offsets.to_numpy()[:-1].astype(np.int64), np.diff(who.offsets.to_numpy()).astype(np.int64)
            part, clump, word, far = (who.values.field(c).to_numpy(zero_copy_only=False) for c in ("part", "clump", "word", "far"))
            word = word.view(np.uint64)
            dims, i, j = batch.column("d").to_numpy(), pa.compute.struct_field(batch.column("at"), "i").to_numpy(), pa.compute.struct_field(batch.column("at"), "j").to_numpy()
            found = []
            for n in np.unique(size[size > 1]).tolist():
                rows = np.flatnonzero(size == n)
                step = max(1, (1 << 20) // (n * n))
                x, y = np.triu_indices(n, 1)
                for k in range(0, len(rows), step):
                    some = rows[k : k + step]
                    at = starts[some][:, None] + np.arange(n)
                    left, right = at[:, x], at[:, y]
                    bits = np.bitwise_count(word[left] ^ word[right])
                    far_sum = np.minimum(64, np.ceil((far[left] + far[right]) / angle * 64)).astype(int)
                    most = np.stack([limits.get(int(d), free_limit) for d in dims[some]])
                    near = bits <= np.take_along_axis(most, far_sum, axis=1)
                    # two of one part have met in the row of that part alone
                    same = (part[left] == part[right]) & (i[some] != j[some])[:, None]
                    near &= ~same
                    found.append(np.stack([clump[left[near]], clump[right[near]]], axis=1))
            pairs = np.concatenate([*found, np.zeros((0, 2), np.int64)])
            pairs = np.unique(np.sort(pairs, axis=1), axis=0)
            yield pa.RecordBatch.from_pydict({"a": pairs[:, 0], "b": pairs[:, 1]})

    return seats.mapInArrow(meet, "a long, b long").distinct()


def _settled(pairs: DataFrame, heads: DataFrame, cosine: float) -> DataFrame:
    """pairs with how they stand by their clumps' first vectors: 1 all vectors of the one link to all of the other, 0 perhaps some;
    pairs of which none can are left out. Clumps of one vector each are settled by that. heads: (clump, u, far, n, weight)."""
    angle = math.acos(cosine)
    one, two = (heads.select(*(F.col(c).alias(f"{c}_{x}") for c in ("clump", "u", "d", "far", "n", "weight"))) for x in "ab")
    met = pairs.join(one, F.col("a") == F.col("clump_a")).join(two, (F.col("b") == F.col("clump_b")) & (F.col("d_a") == F.col("d_b")))
    met = met.withColumn("cos", _near(F.col("u_a"), F.col("u_b")))
    alone = (F.col("n_a") == 1) & (F.col("n_b") == 1)
    between, reach = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "cos"))), F.col("far_a") + F.col("far_b")
    state = F.when(alone, F.when(F.col("cos") >= cosine, 1)).when(between + reach <= angle - SLACK, 1).when(between - reach <= angle + SLACK, 0)
    return met.withColumn("state", state).where("state IS NOT NULL").select("a", "b", "state", "weight_a", "weight_b")


def _counted(some: DataFrame, members: DataFrame, cosine: float) -> DataFrame:
    """(a, b, num, links) for pairs of clumps that may link in part: each vector that has links across, and the weight of these.
    Clumps come in blocks, a pair of blocks in a task; links themselves are never made rows."""
    named = some.select("a").union(some.select("b")).distinct().withColumnRenamed("a", "clump")
    rows = members.join(named, "clump")
    parts = rows.groupBy("clump").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))

    def pack(group: pa.Table) -> pa.Table:
        return pa.table({"clump": [group.column("clump")[0].as_py()], "part": [group.column("part")[0].as_py()], "nums": [group.column("num").to_numpy().tobytes()], "weights": [group.column("weight").to_numpy().tobytes()], "us": [b"".join(group.column("u").to_pylist())]})

    blocks = rows.join(parts, "clump").select("clump", F.pmod(F.xxhash64("num"), F.col("parts")).alias("part"), "num", "weight", "u")
    blocks = stored(blocks.repartition("clump", "part").groupBy("clump", "part").applyInArrow(pack, "clump long, part long, nums binary, weights binary, us binary"), "blocks")
    one, two = (blocks.select(*(F.col(c).alias(f"{c}_{x}") for c in ("clump", "part", "nums", "weights", "us"))) for x in "ab")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                (na, wa, ua), (nb, wb, ub) = ((np.frombuffer(r[f"nums_{x}"], np.int64), np.frombuffer(r[f"weights_{x}"], np.int64), np.frombuffer(r[f"us_{x}"], np.float64)) for x in "ab")
                near = ua.reshape(len(na), -1) @ ub.reshape(len(nb), -1).T >= cosine
                num, links = np.concatenate([na, nb]), np.concatenate([near @ wb, wa @ near])
                some = links > 0
                yield pa.RecordBatch.from_pydict({"a": np.full(some.sum(), r["clump_a"]), "b": np.full(some.sum(), r["clump_b"]), "num": num[some], "links": links[some]})

    met = some.select("a", "b").join(one, F.col("a") == F.col("clump_a")).join(two, F.col("b") == F.col("clump_b"))
    return met.select("clump_a", "clump_b", *(f"{c}_{x}" for c in ("nums", "weights", "us") for x in "ab")).mapInArrow(count, "a long, b long, num long, links long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component) for each row: how many other rows' vectors lie at this cosine or more, and the smallest id reachable
    over such links, the row's own included.

    Equal vectors are one with a weight. Rotations learned by iterative quantisation on a bounded sample (FIT_ROWS) give balanced
    bits; every vector enters several tables of keys, in each its own key's cell and those with its least certain bits flipped,
    as far as a budget that is calibrated on pairs just at the threshold, of which RECALL must meet. Vectors of one cell whose
    codes are near are candidates, and their cosines in doubles decide: no pair below the threshold links, and a pair above it
    is missed with a chance of about 1 - RECALL at the threshold itself and of less beyond. Dense spots are settled as clumps
    (see _clumps): rows grow with clumps and their pairs, never with the pairs of a group of copies.

    Vectors of different dimensions don't link, nor does a vector that is null, empty or zero or holds a null or non-finite
    component: such a row has no links and its own id as component. Rows that repeat an id or a vector are vectors of their own;
    a null id keeps its row and names a component only if all its ids are null; other columns are ignored; an empty table gives
    an empty result.
    """
    rows = stored(vectors.select(F.col(id_col).cast("long").alias("id"), sound(F.col(vector_col)).alias("v")).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit("2"), F.reverse("v"))}), "vectors")
    own = rows.where("v IS NOT NULL").withColumn("d", F.size("v"))
    each = own.groupBy("d", "h1", "h2").agg(F.first("v").alias("v"), F.count("*").alias("weight"), F.min("id").alias("least"))
    each = stored(each.withColumn("num", F.monotonically_increasing_id()), "distinct")
    models, n = fitted(each, cosine)
    coded = stored(_coded(each, models, n, cosine), "codes")
    clumps = stored(_clumps(coded, cosine), "clump")
    members = stored(coded.drop("cells").join(clumps, "num"), "members")
    heads = members.groupBy("clump").agg(F.max("away").alias("far"), F.count("*").alias("n"), F.sum("weight").alias("weight"), F.min("least").alias("least"), *(F.max(F.when(F.col("num") == F.col("clump"), F.col(c))).alias(c) for c in ("word", "d", "u")))
    heads = stored(heads, "heads")
    visits = coded.select("num", F.explode("cells").alias("cell")).join(clumps.select("num", "clump"), "num").select("cell", "clump").distinct().join(heads.select("clump", "word", "d", "far"), "clump")
    settled = stored(_settled(_meetings(visits, models, math.acos(cosine)), heads, cosine), "settled")
    whole, part = settled.where("state = 1"), settled.where("state = 0")
    counted = stored(_counted(part, members.select("clump", "num", "weight", "u"), cosine), "counted")
    edges = whole.select("a", "b").union(counted.select("a", "b").distinct())
    roots = connected_components(edges)
    to_clump = whole.select(F.col("a").alias("clump"), F.col("weight_b").alias("links")).union(whole.select("b", "weight_a")).groupBy("clump").agg(F.sum("links").alias("across"))
    placed = heads.join(roots, heads.clump == roots.node, "left").select("clump", "weight", "least", F.coalesce("root", "clump").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("component"))
    placed = placed.join(named, "root").join(to_clump, "clump", "left").select("clump", "component", (F.col("weight") - 1 + F.coalesce("across", F.lit(0))).alias("in_clump"))
    further = counted.groupBy("num").agg(F.sum("links").alias("further"))
    found = members.select("num", "clump").join(placed, "clump").join(further, "num", "left").join(each.select("num", "d", "h1", "h2"), "num")
    found = found.select("h1", "h2", "component", (F.col("in_clump") + F.coalesce("further", F.lit(0))).alias("n_links"))
    out = rows.where("v IS NOT NULL").join(found, ["h1", "h2"]).select("id", "n_links", "component")
    out = out.union(rows.where("v IS NULL").select("id", F.lit(0).cast("long"), "id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component")
