"""Text expressions that keep to built-in functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once a row, however often f names it, inside of lambdas too."""
    return F.transform(F.array(value), f)[0]


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends (trim takes off spaces only)."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def words(x: Column) -> Column:
    """Runs outside white space, to which the separators 1C to 1F count, as in Python."""
    return F.filter(F.split(x, r"(?U)[\s\x1C-\x1F]+"), lambda w: w != "")


def fixed(x: Column, places: int) -> Column:
    """A single-precision number with so many places; of two equally near texts the even one, as C prints it (Java's formatter takes
    the greater)."""
    return F.bround(x.cast("double").cast("decimal(38,20)"), places).cast("string")


def any_in(text: Column, needles: list[str]) -> Column:
    out = F.lit(False)
    for x in needles:
        out = out | F.contains(text, F.lit(x))
    return out


def held(lists: Column, text: Column) -> Column:
    """array<int>: of each list of words (runs outside white space) how many occur in text, within words too. Most words that a text lacks
    cost a search of all of it, so this runs on Arrow batches: words of the text are looked up, only the others are searched for."""

    @F.arrow_udf("array<int>")
    def of(lists: pa.Array, texts: pa.Array) -> pa.Array:
        counts = []
        for at in range(0, len(texts), 256):
            some = lists.slice(at, 256)
            each = some.flatten()
            names, lengths = each.flatten().to_pylist(), pc.fill_null(each.value_lengths(), 0).to_pylist()
            word = group = 0
            for text, groups in zip(texts.slice(at, 256), pc.fill_null(some.value_lengths(), 0).to_pylist()):
                text = text.as_py() or ""
                known = set(text.split())
                for n in lengths[group : group + groups]:
                    counts.append(sum(w in known or w in text for w in names[word : word + n]))
                    word += n
                group += groups
        ends = np.append(0, np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(counts, pa.int32()))

    return of(lists, text)


def words_held(of: Column, stop: list[str], text: Column) -> Column:
    """struct(n, found): how many distinct words of of but stop there are, and how many of them occur in text, as held has it; null where
    of is null."""
    but = frozenset(stop)

    @F.arrow_udf("struct<n:int,found:int>")
    def run(ofs: pa.Array, texts: pa.Array) -> pa.Array:
        n, found = [], []
        for one, text in zip(ofs, texts):
            one, text = one.as_py(), text.as_py() or ""
            keys = None if one is None else set(one.split()) - but
            n.append(None if keys is None else len(keys))
            found.append(None if keys is None else len(keys) - sum(w not in text for w in keys.difference(text.split())))
        return pa.StructArray.from_arrays([pa.array(n, pa.int32()), pa.array(found, pa.int32())], ["n", "found"])

    return run(of, text)


def holds(text: Column, needles: list[list[str]]) -> Column:
    """array<boolean>: for each list, whether text holds one of it."""

    @F.arrow_udf("array<boolean>")
    def of(texts: pa.Array) -> pa.Array:
        found = [any(x in text for x in some) for text in (x.as_py() or "" for x in texts) for some in needles]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * len(needles), pa.int32()), pa.array(found, pa.bool_()))

    return of(text)


def count_in(texts: list[Column], needles: list[str]) -> Column:
    """How many needles occur in at least one of the texts."""
    out = F.lit(0)
    for x in needles:
        hit = F.lit(False)
        for text in texts:
            hit = hit | F.contains(text, F.lit(x))
        out = out + hit.cast("int")
    return out


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 as lower-case hex, of two nested digests; keys of at most 64 bytes."""
    padded = key.ljust(64, b"\0")
    inner, outer = bytes(x ^ 0x36 for x in padded), bytes(x ^ 0x5C for x in padded)
    digest = F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(digest)), 256)
