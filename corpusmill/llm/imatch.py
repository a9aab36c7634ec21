"""I-Match fingerprints: terms of a band of document frequencies, sorted, hashed whole and through randomised lexicons. Built of
DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from corpusmill.llm.base import stored

#: Terms in less than one document of RARE, or in more than COMMON of all, are out of the band. As Σ df = documents x distinct
#: terms each, the lexicon never has more than RARE times the mean number of distinct terms of a document.
RARE, COMMON = 500, 0.15
#: The lexicon is a table of BITS_EACH to twice as many bits for each term that it has, HASHES of them set. Of the terms out of the
#: band a few pass too (under 0.2 %), the same ones everywhere.
BITS_EACH, HASHES = 24, 3
#: Randomised lexicons: SERIES independent ones for each share 1 / 2**n of the terms.
SERIES, SHARES = 7, (3, 4, 5, 6, 7, 8, 9)
#: Documents with fewer terms in the band are known by all their terms.
FEW = 3
#: What xxhash64 gives for no terms.
EMPTY = 42
#: Text bytes of a range of ids; percentiles that part the ids, each range between two of them parted evenly; ranges whose first rows
#: may be sent to every executor.
BUCKET_BYTES, MOST_BOUNDS, BROADCAST_BUCKETS = 8 << 20, 4096, 100_000


def terms(text: Column) -> Column:
    """The distinct terms, by their hashes: runs outside ASCII white space, lower-cased."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    return F.array_distinct(F.transform(words, lambda x: F.xxhash64(x)))


def _numbers(values: list[int]) -> Column:
    """A list as one literal: an expression for each number would take the optimizer long."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _bits(h: Column, size: int) -> list[tuple[Column, Column]]:
    """The word and the bit in it of each of a term's places in a table of 2**size bits."""
    places = [F.shiftrightunsigned(h, k * (64 - size) // (HASHES - 1)).bitwiseAND(F.lit((1 << size) - 1)) for k in range(HASHES)]
    return [(F.shiftrightunsigned(x, 6).cast("int"), x.bitwiseAND(F.lit(63)).cast("int")) for x in places]


def lexicon(docs: DataFrame, text_col: str, n_docs: int, rare: int = RARE, common: float = COMMON) -> list[int]:
    """The band's terms as a bit table, 64 bits a number, all that the driver gets; its size follows the number of terms. Document
    frequencies are exact counts over all documents, partly summed before the shuffle."""
    df = docs.select(F.explode(terms(F.coalesce(text_col, F.lit("")))).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    band = stored(df.where((F.col("n") >= max(2, n_docs / rare)) & (F.col("n") <= max(2, n_docs * common))).select("h"), "lexicon")
    size = max(10, (BITS_EACH * band.count() - 1).bit_length())
    used = band.select(F.explode(F.array(*(F.struct(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bits")) for word, bit in _bits(F.col("h"), size)))).alias("x"))
    table = [0] * (1 << (size - 6))
    for r in used.groupBy("x.word").agg(F.bit_or("x.bits").alias("bits")).collect():
        table[r["word"]] = r["bits"]
    return table


def with_fingerprint(docs: DataFrame, text: Column, numbers: list[int], prefix: str) -> DataFrame:
    """numbers: the lexicon. docs with {prefix}slots (array: a hash for each randomised lexicon) and {prefix}whole (the hash of all band terms)."""

    table, size = _numbers(numbers), len(numbers).bit_length() + 5

    def listed(h: Column) -> Column:
        found = [F.call_function("shiftrightunsigned", F.get(table, word), bit) for word, bit in _bits(h, size)]
        return reduce(Column.bitwiseAND, found).bitwiseAND(F.lit(1).cast("long")) == 1

    seen, band = f"{prefix}seen", f"{prefix}band"
    out = docs.withColumn(seen, terms(text)).withColumn(band, F.filter(seen, listed))
    out = out.withColumn(band, F.sort_array(F.transform(F.when(F.size(band) >= FEW, F.col(band)).otherwise(F.col(seen)), lambda h: F.xxhash64(h, F.lit("lexicon")))))
    bits = lambda y, shift, mask: F.call_function("shiftrightunsigned", y, shift).bitwiseAND(mask) == 0
    masks = [F.lit((1 << n) - 1).cast("long") for n in SHARES]
    # a series' smaller lexicons lie within its largest: only the terms that it holds are looked at again
    series = F.transform(F.array(*(F.lit(9 * s) for s in range(SERIES))), lambda s: F.struct(s.alias("shift"), F.filter(band, lambda y: bits(y, s, masks[0])).alias("held")))
    slots = F.flatten(F.transform(series, lambda s: F.transform(F.array(*masks), lambda m: F.xxhash64(F.filter(s["held"], lambda y: bits(y, s["shift"], m))))))
    return out.withColumn(f"{prefix}slots", slots).withColumn(f"{prefix}whole", F.xxhash64(band)).drop(seen, band)


def as_text(whole: Column, slots: Column) -> Column:
    short = F.transform(slots, lambda x: F.when(x == EMPTY, F.lit("-")).otherwise(F.lower(F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFFFF))), 6, "0"))))
    return F.concat_ws(":", F.lower(F.lpad(F.hex(whole), 16, "0")), F.array_join(short, ":"))


def likeness(whole_a: Column, slots_a: Column, whole_b: Column, slots_b: Column) -> Column:
    """1 for equal fingerprints; else the share of randomised lexicons with equal hashes, of those that hold a term of either."""
    pairs = F.arrays_zip(slots_a.alias("a"), slots_b.alias("b"))
    held = F.size(F.filter(pairs, lambda p: (p["a"] != EMPTY) | (p["b"] != EMPTY)))
    same = F.size(F.filter(pairs, lambda p: (p["a"] != EMPTY) & (p["a"] == p["b"])))
    return F.when((whole_a == whole_b) & (slots_a == slots_b), 1.0).otherwise(F.coalesce(F.try_divide(same.cast("double"), held.cast("double")), F.lit(0.0)))


def _count_below(key: Column, bounds: Column, n: int, or_equal: bool) -> Column:
    """How many of the sorted bounds are below key (or equal to it), by halving."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(max(1, n.bit_length())))))
    below = (lambda x: x <= key) if or_equal else (lambda x: x < key)
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(below(F.get(bounds, at + s - 1)), at + s).otherwise(at))


def id_ranges(docs: DataFrame, id_col: str, buckets: int, most: int = MOST_BOUNDS) -> tuple[list[int], int, int]:
    """What parts the ids into about so many ranges: their least, approximate percentiles and their greatest; into how many even
    parts each range between two of these is cut; and the ranges that rows without an id are dealt to."""
    coarse = min(buckets, most)
    marks = F.percentile_approx(id_col, [k / coarse for k in range(1, coarse)], max(10_000, 4 * most)) if coarse > 1 else F.lit(None)
    low, high, found, n, unknown = docs.agg(F.min(id_col), F.max(id_col), marks, F.count("*"), F.count_if(F.col(id_col).isNull())).first()
    return [] if low is None else [low, *(found or []), high], -(-buckets // coarse), -(-unknown * buckets // max(1, n))


def range_of(key: Column, tie: Column, marks: list[int], parts: int, unknown: int) -> Column:
    """The number of a row's range; ranges are in the order of (id, tie), rows without an id first. An id that several marks name
    has ranges of its own, as many as its rows ask for, by its ties."""
    share = F.shiftrightunsigned(tie.bitwiseXOR(F.lit(-(1 << 63)).cast("long")), 11) / float(1 << 53)
    out = F.floor(share * unknown) - unknown
    if marks:
        bounds, n = _numbers(marks[1:-1]), len(marks) - 2
        all_marks = _numbers(marks)
        at = _count_below(key, bounds, n, True) if n else F.lit(0)
        below = _count_below(key, bounds, n, False) if n else F.lit(0)
        low, high = F.get(all_marks, at).cast("double"), F.get(all_marks, at + 1).cast("double")
        even = F.least(F.floor(F.coalesce(F.try_divide(key - low, high - low), F.lit(0.0)) * parts), F.lit(parts - 1).cast("long"))
        own = (at - below - 1) * parts
        placed = F.when(own > 0, (below + 1) * parts + F.floor(share * own)).otherwise(at * parts + even)
        out = F.when(key.isNull(), out).otherwise(placed)
    return out.cast("long")


def beside_next(docs: DataFrame, id_col: str, text_col: str, carried: list[str], ranges: tuple[list[int], int, int]) -> DataFrame:
    """docs with __next: struct(text and carried columns of the next row by id; after the last, the first). Null ids come first;
    rows of one id are ordered by a hash of their text.

    Rows are dealt to ranges of ids, so no task orders the table; each range also gets a copy of the first row of the next
    range that isn't empty. These first rows are as many as ranges; where that is more than may be sent to every executor,
    the engine joins them otherwise.
    """
    rows = docs.withColumn("__tie", F.xxhash64(text_col))
    rows = rows.withColumn("__bucket", range_of(F.col(id_col), F.col("__tie"), *ranges))
    heads = rows.groupBy("__bucket").agg(F.min(F.struct(F.col(id_col).isNotNull().alias("known"), F.col(id_col).alias("id"), F.col("__tie").alias("tie"))).alias("__head"))
    order = Window.orderBy("__bucket")
    heads = heads.withColumn("__before", F.coalesce(F.lag("__bucket").over(order), F.max("__bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))).withColumnRenamed("__bucket", "__of")
    if max(0, len(ranges[0]) - 1) * ranges[1] + ranges[2] <= BROADCAST_BUCKETS:
        heads = F.broadcast(heads)
    copies = rows.join(heads, F.col("__bucket") == F.col("__of")).where(F.col(id_col).eqNullSafe(F.col("__head.id")) & (F.col("__tie") == F.col("__head.tie")))
    copies = copies.withColumn("__bucket", F.col("__before")).select(*rows.columns)
    both = rows.withColumn("__copy", F.lit(0)).union(copies.withColumn("__copy", F.lit(1)))
    within = Window.partitionBy("__bucket").orderBy("__copy", F.col(id_col).asc_nulls_first(), "__tie")
    return both.withColumn("__next", F.lead(F.struct(text_col, *carried)).over(within)).where("__copy = 0").drop("__copy", "__bucket", "__tie")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = RARE, common: float = COMMON) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row. A fingerprint is the hash
    of the sorted terms in the band, then one for each randomised lexicon ("-" where it has none of the terms). The edited text
    ends with as many code points of the next row's start as are taken from its own end: a quarter, rounded down.

    Ids are whole numbers. Null texts are empty; equal texts have equal fingerprints, those of empty texts included; documents
    with under FEW terms in the band are known by all their terms; repeated rows stay; very long texts are read whole; other
    columns are ignored; an empty table gives an empty result.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise ValueError(f"{id_col} must hold whole numbers")
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(text_col, F.lit("")).alias("__text"))
    n, size = rows.agg(F.count("*"), F.sum(F.octet_length("__text"))).first()
    table = lexicon(rows, "__text", n, rare, common)
    ranges = id_ranges(rows, "__id", max(1, -(-(size or 0) // BUCKET_BYTES)))
    rows = with_fingerprint(rows, F.col("__text"), table, "__own_")
    rows = beside_next(rows, "__id", "__text", ["__own_slots", "__own_whole"], ranges)
    length = F.length("__text")
    quarter = F.floor(length / 4).cast("int")
    rows = rows.withColumn("__edited", F.concat(F.left("__text", length - quarter), F.left(F.col("__next.__text"), quarter)))
    rows = with_fingerprint(rows, F.col("__edited"), table, "__new_")
    return rows.select(
        F.col("__id").alias(id_col),
        length.cast("long").alias("n_chars"),
        F.sha2("__edited", 256).alias("edited_sha256"),
        as_text(F.col("__own_whole"), F.col("__own_slots")).alias("fingerprint"),
        as_text(F.col("__new_whole"), F.col("__new_slots")).alias("edited_fingerprint"),
        likeness(F.col("__own_whole"), F.col("__own_slots"), F.col("__new_whole"), F.col("__new_slots")).alias("near_edited"),
        likeness(F.col("__own_whole"), F.col("__own_slots"), F.col("__next.__own_whole"), F.col("__next.__own_slots")).alias("near_next"),
    )
