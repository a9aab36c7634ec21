"""The SimHash operator's exact mode: near-duplicates by the similarity of whole shingle sets. Fingerprints within two bits, found on
the popcount lattice, and bands of least hashes, which reach what lies further off, give candidates; the sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.base import long_texts, released, stored
from corpusmill.llm.graph import connected_components
from corpusmill.llm.simhash import links

SEED = 42
SHINGLE = 5
#: Two sets are alike if LIKE[1] * common >= LIKE[0] * all, in whole numbers: at a similarity of 0.8.
LIKE = 4, 5
#: Bands and least hashes in each. A pair at 0.8 shares no band with a chance of (1 - 0.8**4)**32 = 5e-8, a closer pair with less.
BANDS, DEPTH = 32, 4
#: Shingles hashed at once; members of a band's group that meet in one task; rows that may be sent to every executor.
BLOCK, MEMBERS, BROADCAST_ROWS = 1024, 1024, 200_000

_random = np.random.default_rng(SEED)
_FACTOR = _random.integers(0, 1 << 31, (BANDS * DEPTH, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFT = _random.integers(0, 1 << 32, (BANDS * DEPTH, 1), dtype=np.uint32)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of the text's distinct shingles: words are runs outside ASCII white space, A-Z lower-cased; a text
    shorter than a shingle is one shingle, as is a text without words, like null."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    line = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64))


def bands(found: np.ndarray) -> list[int]:
    """A signed key for each band: the least values of its hashes over the set."""
    low = found.astype(np.uint32)
    least = np.full(BANDS * DEPTH, (1 << 32) - 1, np.uint32)
    for k in range(0, len(low), BLOCK):
        np.minimum(least, (low[k : k + BLOCK] * _FACTOR + _SHIFT).min(axis=1), out=least)
    raw, size = least.tobytes(), 4 * DEPTH
    return np.array([xxhash.xxh64_intdigest(raw[size * k : size * (k + 1)], k) for k in range(BANDS)], np.uint64).view(np.int64).tolist()


def fingerprint(found: np.ndarray) -> int:
    """The SimHash of a set of hashes: the bits that over half of them have."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(found), BLOCK):
        total += np.unpackbits(found[k : k + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * total > len(found), bitorder="little").view(np.uint64)[0])


def _marks(text: Column, shingle: int) -> Column:
    """struct(node, fp, bands): node is a hash of the whole set."""

    @F.pandas_udf("node long, fp long, bands array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(xxhash.xxh64_intdigest(x.tobytes(), SEED), fingerprint(x), bands(x)) for x in (shingles(t, shingle) for t in batch)]
            numbers = [np.array([r[k] for r in rows], np.uint64).view(np.int64) for k in (0, 1)]
            yield pd.DataFrame({"node": numbers[0], "fp": numbers[1], "bands": [r[2] for r in rows]})
        released()

    return of(text)


def _set_column(text: Column, shingle: int) -> Column:
    @F.pandas_udf("binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shingles(t, shingle).tobytes() for t in batch], dtype=object)
        released()

    return of(text)


def alike(common, a, b):
    return LIKE[1] * common >= LIKE[0] * (a + b - common)


def _agree(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows (a, b, sets x and y) the pairs that are alike."""
    for batch in batches:
        stay = []
        for raw_x, raw_y in zip(batch["x"], batch["y"]):
            x, y = np.frombuffer(raw_x, np.uint64), np.frombuffer(raw_y, np.uint64)
            able = alike(min(len(x), len(y)), len(x), len(y))
            stay.append(bool(able and alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
        yield batch.loc[stay, ["a", "b"]]


def _meet(group: pd.DataFrame) -> pd.DataFrame:
    """Edges that tie the alike members of one group (node, root, side, x), as far as root and earlier edges don't. Where two
    sides meet, members of one side don't meet each other."""
    nodes, side = group["node"].to_numpy(), group["side"].to_numpy()
    root = np.unique(group["root"].to_numpy(), return_inverse=True)[1]
    sets = [np.frombuffer(x, np.uint64) for x in group["x"]]
    size = np.array(list(map(len, sets)))
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(size)
    starts, two, edges = ends - size, len(np.unique(side)) > 1, []
    flag = np.zeros(token.max() + 1, np.int64)
    for k in range(len(nodes) - 1):
        open_ = root[k + 1 :] != root[k]
        if two:
            open_ &= side[k + 1 :] != side[k]
        if not open_.any():
            continue
        flag[token[starts[k] : ends[k]]] = 1
        common = np.add.reduceat(flag[token[ends[k] :]], starts[k + 1 :] - ends[k])
        flag[token[starts[k] : ends[k]]] = 0
        for j in np.flatnonzero(open_ & alike(common, size[k], size[k + 1 :])) + k + 1:
            if root[j] != root[k]:
                edges.append((nodes[k], nodes[j]))
                root[root == root[j]] = root[k]
    return pd.DataFrame(edges, columns=["a", "b"]).astype("int64")


def _few(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it is counted to be small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _near_prints(nodes: DataFrame) -> DataFrame:
    """(a, b): of nodes (node, fp), those that share a fingerprint with its least node, and the least nodes of fingerprints that the
    lattice links."""
    prints = stored(nodes.groupBy("fp").agg(F.min("node").alias("first")), "prints")
    same = nodes.join(prints, "fp").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    side = lambda name: prints.select(F.col("fp").alias(name), F.col("first").alias(f"first_{name}"))
    near = links(prints.select("fp")).join(side("a"), "a").join(side("b"), "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    return stored(same.union(near).distinct(), "near")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, content, node, root) for each row: content is a hash of the text, rows of one group share root. Groups are the connected
    components of all pairs of texts that are alike.

    Equal sets are one node. Fingerprints within two bits are candidates, as in the operator's other mode. A node also visits a
    group for each band; all of a group are compared with its least member, so that a large family of copies is tied by as
    many comparisons as it has members. Groups that fall into several components after that have their members of different
    components compared too.
    """
    long_texts(docs.sparkSession)
    content = F.xxhash64(F.coalesce(text_col, F.lit("")))
    made = docs.select(F.col(id_col).alias("id"), content.alias("content"), _marks(F.col(text_col), shingle).alias("m"))
    rows = stored(made.select("id", "content", "m.node", "m.fp", "m.bands"), "marks")
    near = _near_prints(rows.select("node", "fp").distinct())
    visits = rows.groupBy("node").agg(F.first("bands").alias("bands")).select("node", F.explode("bands").alias("band"))
    hubs = visits.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
    shared = stored(visits.join(hubs, "band"), "visits")
    rows = rows.drop("bands", "fp")

    met = shared.select("node").union(near.select("a")).union(near.select("b")).distinct()
    asked = rows.join(met, "node", "left_semi").groupBy("node").agg(F.min(F.struct("id", "content")).alias("one"))
    asked = _few(stored(asked.select("node", F.col("one.id").alias("__id"), F.col("one.content").alias("__of")), "asked"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), content.alias("content"))
    texts = texts.join(asked, (F.col("content") == F.col("__of")) & F.col("id").eqNullSafe(F.col("__id")))
    sets = stored(texts.select("node", _set_column(F.col("text"), shingle).alias("x")).groupBy("node").agg(F.first("x").alias("x")), "sets")

    pairs = shared.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).union(near).distinct()
    both = pairs.join(sets.select(F.col("node").alias("a"), "x"), "a").join(sets.select(F.col("node").alias("b"), F.col("x").alias("y")), "b")
    edges = stored(both.select("a", "b", "x", "y").mapInPandas(_agree, "a long, b long"), "alike")
    roots = connected_components(edges)

    placed = shared.where("n > 2").join(roots, "node", "left").select("band", "node", "n", F.coalesce("root", "node").alias("root"))
    placed = stored(placed, "placed")
    split = placed.groupBy("band").agg(F.bit_xor(F.xxhash64("node")).alias("mark"), F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high"))
    split = split.where("low <> high").groupBy("mark", "size").agg(F.min("band").alias("band")).select("band")
    parts = F.ceil(F.col("n") / MEMBERS).cast("int")
    members = placed.join(split, "band", "left_semi").withColumn("side", F.pmod(F.xxhash64("node"), parts).cast("int"))
    members = members.select("band", "node", "root", "side", F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    members = members.withColumns({"low": F.least("side", "other"), "high": F.greatest("side", "other")}).join(sets, "node")
    more = stored(members.select("band", "low", "high", "node", "root", "side", "x").groupBy("band", "low", "high").applyInPandas(_meet, "a long, b long"), "alike")
    if more.limit(1).count():
        roots = connected_components(more.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    return rows.join(roots, "node", "left").select("id", "content", "node", F.coalesce("root", "node").alias("root"))
