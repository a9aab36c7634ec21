"""How far sources of a language lie apart by their terms: dense tiles for terms of many groups, posting pairs for the others."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.base import long_texts, released, stored

#: Documents of a language that a kept term is in, at least; what is added to each count; the scale of shares; ranks of terms.
LEAST, ADDED, SCALE, RANKS = 30, 5, 1_000_000_000, 50
#: A term in more groups of its language is heavy; a light term's groups make LIGHT * (LIGHT - 1) / 2 pairs at most.
LIGHT = 6
#: Terms and groups of a tile; counts that a task holds before it gives them on.
TERMS, GROUPS, HELD = 2048, 64, 400_000

#: Bytes of terms, lower-cased; all others separate them. Characters outside ASCII belong to terms whole.
_FOLDED = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in range(256))


def terms_of(text: str) -> list[bytes]:
    """Runs of letters A to Z, lower-cased, and of characters outside ASCII, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLDED).split()


def counts(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each group's terms and documents that hold them, in part: tasks sum up what they
    read and give sums on, so that a group of a third of all rows costs no task more than others."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def given() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, seen) in held.items():
                said = pa.array(n, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(n)), pa.repeat(source, len(n)), said, pa.array(np.fromiter(n.values(), np.int64, len(n))), pa.array(np.fromiter(map(seen.__getitem__, n), np.int64, len(n)))], ["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                found = terms_of(text)
                if found:
                    n, seen = held.setdefault((lang, source), (Counter(), Counter()))
                    n.update(found)
                    seen.update(set(found))
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from given()
        yield from given()
        released()

    long_texts(docs.sparkSession)
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(x) for c, x in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    return rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def share(n: Column, total: Column, size: Column, added: int = ADDED, scale: int = SCALE) -> Column:
    """1 + floor(scale * (n + added) / (total + added * size)), exact for counts of 18 digits and more."""
    whole = lambda c: c.cast("decimal(22,0)")
    over = whole(F.lit(scale)).cast("decimal(10,0)") * (whole(n) + F.lit(added))
    return F.call_function("div", over, whole(total) + F.lit(added).cast("decimal(6,0)") * size.cast("decimal(15,0)")).cast("long") + 1


def _tiles(frames: DataFrame, groups: int, terms: int) -> DataFrame:
    """(lang, g, h, value): for each pair of tiles of one block of terms, the pairs of their groups, g < h, and the sums of the
    differences of their shares over the block's terms."""

    def dense(default: np.ndarray, width: int, cells: list) -> np.ndarray:
        out = np.repeat(default[:, None], width, axis=1)
        if cells:
            out[[x["i"] for x in cells], [x["t"] for x in cells]] = [x["p"] for x in cells]
        return out

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                a = dense(np.array(r["p0"], np.int64), r["width"], r["cells"] or [])
                b = a if r["gb"] == r["gb_"] else dense(np.array(r["p0_"], np.int64), r["width"], r["cells_"] or [])
                value = np.stack([np.abs(b - x).sum(axis=1) for x in a])
                g, h = np.meshgrid(r["gb"] * groups + np.arange(len(a)), r["gb_"] * groups + np.arange(len(b)), indexing="ij")
                once = g < h
                yield pa.RecordBatch.from_pydict({"lang": pa.array([r["lang"]] * int(once.sum()), pa.string()), "g": g[once].astype(np.int64), "h": h[once].astype(np.int64), "value": value[once]})

    other = frames.select("lang", "tb", *(F.col(c).alias(f"{c}_") for c in ("gb", "p0", "cells")))
    return frames.join(other, ["lang", "tb"]).where("gb <= gb_").mapInArrow(sums, "lang string, g long, h long, value long")


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = LEAST, ranks: int = RANKS, light: int = LIGHT) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language lies from its other sources (part pair) and the
    terms that it has more of than its language (part term).

    A language keeps the terms that at least `least` of its documents hold. Their shares in a group (language, source) and in the
    language are whole numbers: 1 + floor(SCALE * (n + ADDED) / (N + ADDED * V)). A pair's value is the sum of the differences of
    all kept terms' shares. Heavy terms, in more than `light` groups, form dense tiles of TERMS terms and GROUPS groups, which
    meet tile by tile. Light terms form postings. Without any posting their sum would be V times the difference of the shares
    of a count of 0; a posting's own correction depends on its share and the other group's share of 0 only, so that postings
    of equal shares go together; and terms that both groups hold correct that by the pairs of a term's postings, at most
    light * (light - 1) / 2 for each term. All sums are of whole numbers, so that the split changes nothing.

    Nulls in any of the three columns count as empty strings; groups without terms and languages without kept terms (all values
    0) have their rows; a language's only source has no pairs; repeated rows count each time; very long texts are read whole;
    other columns are ignored; an empty table gives an empty result. Ties go to the smaller item in UTF-8.
    """
    # dealt by term at once: a group's count, its language's and the number of groups need no other shuffle
    found = counts(docs, lang_col, source_col, text_col).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of = Window.partitionBy("lang", "term")
    found = found.withColumns({"in_docs": F.sum("docs").over(of), "all": F.sum("n").over(of), "k": F.count("*").over(of), "leads": F.min("source").over(of) == F.col("source")})
    posts = stored(found.where(F.col("in_docs") >= least).select("lang", "source", "term", "n", "all", "k", "leads"), "kept")
    sizes = posts.groupBy("lang").agg(F.count_if("leads").alias("size"), F.sum("n").alias("total"), F.count_if(F.col("leads") & (F.col("k") > light)).alias("heavy"))
    groups = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(x) for c, x in ((lang_col, "lang"), (source_col, "source")))).distinct()
    groups = groups.join(posts.groupBy("lang", "source").agg(F.sum("n").alias("own")), ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0)
    # a row for each group, of which the result has the square: numbering a language's groups is less than its rows
    groups = groups.withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1)
    groups = stored(groups.withColumn("p0", share(F.lit(0), F.col("own"), F.greatest("size", F.lit(1)))), "groups")
    posts = posts.join(groups.select("lang", "source", "g", "own", "size", "total", "heavy", "p0"), ["lang", "source"])
    posts = posts.withColumns({"p": share(F.col("n"), F.col("own"), F.col("size")), "q": share(F.col("all"), F.col("total"), F.col("size"))})
    posts = stored(posts.select("lang", "source", "g", "p0", "term", "p", "q", "k", "leads", "heavy"), "postings")

    over = posts.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = over.withColumn("rank", rank).where(F.col("rank") <= ranks)

    one, two = (groups.select("lang", *(F.col(c).alias(f"{c}{x}") for c in ("g", "p0")), *rest) for x, rest in (("", [(F.col("size") - F.col("heavy")).alias("light")]), ("_", [])))
    apart = F.abs(F.col("p0") - F.col("p0_"))
    base = one.join(two, "lang").where("g < g_").select("lang", F.col("g"), F.col("g_").alias("h"), (F.col("light") * apart).alias("value"))

    rare = posts.where(F.col("k") <= light)
    single = rare.groupBy("lang", "g", "p0", "p").agg(F.count("*").alias("c")).join(two, "lang").where("g <> g_")
    single = single.select("lang", F.least("g", "g_").alias("g"), F.greatest("g", "g_").alias("h"), (F.col("c") * (F.abs(F.col("p") - F.col("p0_")) - apart)).alias("value"))
    other = rare.where("k > 1").select("lang", "term", F.col("g").alias("g_"), F.col("p0").alias("p0_"), F.col("p").alias("p_"))
    both = rare.where("k > 1").join(other, ["lang", "term"]).where("g < g_")
    mend = F.abs(F.col("p") - F.col("p_")) - F.abs(F.col("p") - F.col("p0_")) - F.abs(F.col("p_") - F.col("p0")) + apart
    both = both.groupBy("lang", "g", F.col("g_").alias("h")).agg(F.sum(mend).alias("value"))

    dealt = F.pmod(F.xxhash64("term"), F.ceil(F.col("heavy") / TERMS))
    place = posts.where((F.col("k") > light) & F.col("leads")).select("lang", "term", dealt.alias("tb"))
    place = stored(place.withColumn("t", F.row_number().over(Window.partitionBy("lang", "tb").orderBy("term")) - 1), "places")
    cells = posts.where(F.col("k") > light).join(place, ["lang", "term"])
    cells = cells.groupBy("lang", "tb", (F.col("g") / GROUPS).cast("long").alias("gb")).agg(F.collect_list(F.struct((F.col("g") % GROUPS).cast("int").alias("i"), F.col("t").cast("int").alias("t"), "p")).alias("cells"))
    frames = groups.where("heavy > 0").groupBy("lang", (F.col("g") / GROUPS).cast("long").alias("gb")).agg(F.transform(F.array_sort(F.collect_list(F.struct("g", "p0"))), lambda x: x["p0"]).alias("p0"))
    widths = place.groupBy("lang", "tb").agg(F.count("*").cast("int").alias("width"))
    frames = frames.join(widths, "lang").join(cells, ["lang", "tb", "gb"], "left")
    tiles = _tiles(stored(frames, "tiles"), GROUPS, TERMS)

    sums = base.union(single).union(both).union(tiles).groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    ways = sums.select("lang", F.explode(F.array(F.struct("g", F.col("h").alias("to")), F.struct(F.col("h").alias("g"), F.col("g").alias("to")))).alias("way"), "value").select("lang", "way.*", "value")
    names = groups.select("lang", "g", "source")
    pairs = ways.join(names, ["lang", "g"]).join(names.select("lang", F.col("g").alias("to"), F.col("source").alias("item")), ["lang", "to"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", rank)
    return pairs.union(terms)
