"""Removing passages that occur more than once: super-k-mer partitioning of word windows."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.base import free, long_texts, released

#: Words of a window, words of a minimiser.
WINDOW, MINIMISER = 35, 3
#: Text bytes that meet in a bucket on average, that a map task holds before it sends, and that are hashed at once.
BUCKET_BYTES, FLUSH_BYTES, GROUP_BYTES = 2 << 20, 8 << 20, 1 << 19
#: Text bytes that the frequent runs of minimiser words are looked for in, on average; the share of those texts, and the number of
#: them, that makes a run frequent. Where windows travel depends on this bounded sample, what is found doesn't.
SAMPLE_BYTES, HOT_SHARE, HOT_TEXTS = 16 << 20, 1 / 500, 8

_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_META = np.dtype([("key", "<i8"), ("crc", "<u4"), ("start", "<u4"), ("known", "u1")])
_RANGE = np.dtype([("key", "<i8"), ("crc", "<u4"), ("start", "<u4"), ("end", "<u4")])
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and their inverses."""
    size = 1 << max(20, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        base = np.full(size, _BASE)
        back = np.full(size, np.uint64(pow(int(_BASE), -1, 1 << 64)))
        base[0] = back[0] = 1
        _powers[size] = (np.cumprod(base), np.cumprod(back))
    return _powers[size]


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each start and end: equal stretches have equal hashes wherever they stand."""
    up, down = _power(len(values))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


class Lines:
    """Lines of words parted by single spaces: where each word starts and ends, its hash and its line; and the windows."""

    def __init__(self, data: bytes, window: int) -> None:
        raw = np.frombuffer(data, np.uint8)
        kind = np.int32 if len(raw) < 1 << 31 else np.int64
        gaps = np.flatnonzero((raw == 32) | (raw == 10)).astype(kind)
        self.starts, self.ends = np.concatenate((np.zeros(1, kind), gaps + kind(1))), np.append(gaps, kind(len(raw)))
        self.line = np.concatenate((np.zeros(1, np.int32), np.cumsum(raw[gaps] == 10, dtype=np.int32)))
        hashes, at = np.empty(len(self.starts), np.uint64), 0
        while at < len(self.starts):
            to = max(at + 1, int(np.searchsorted(self.ends, self.starts[at] + GROUP_BYTES)))
            low = self.starts[at]
            hashes[at:to] = _sums(raw[low : self.ends[to - 1]].astype(np.uint64) + np.uint64(1), self.starts[at:to] - low, self.ends[at:to] - low)
            at = to
        self.hashes = _mixed(hashes + (self.ends - self.starts).astype(np.uint64))
        n = max(0, len(self.starts) - window + 1)
        #: The words that a window starts at: its last word stands on the same line.
        self.windows = np.flatnonzero(self.line[:n] == self.line[window - 1 :]).astype(kind)

    def window_hashes(self, window: int) -> np.ndarray:
        out, step = np.empty(len(self.windows), np.uint64), 1 << 18
        for k in range(0, len(out), step):
            at = self.windows[k : k + step]
            low = int(at[0])
            out[k : k + step] = _sums(self.hashes[low : int(at[-1]) + window], at - low, at - low + window)
        return _mixed(out)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each stretch of width values."""
    got, span = values, 1
    while 2 * span <= width:
        got, span = np.minimum(got[:-span], got[span:]), 2 * span
    return np.minimum(got[: len(values) - width + 1], got[width - span : len(values) - span + 1])


def _grams(lines: Lines, minimiser: int) -> np.ndarray:
    grams = np.zeros(max(0, len(lines.hashes) - minimiser + 1), np.uint64)
    for k in range(minimiser):
        grams = grams * _BASE + lines.hashes[k : k + len(grams)]
    return grams


def hot_grams(texts: DataFrame, size: int, minimiser: int) -> np.ndarray:
    """Hashes, in order, of runs of minimiser words that many texts of a bounded sample have: a line in a third of all texts must not
    draw all windows around it to one bucket. texts: (text); size: their bytes."""
    share = min(1.0, SAMPLE_BYTES / max(1, size))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [np.zeros(0, np.uint64)], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = text.encode("utf-8", "surrogatepass").split()
                if len(words) >= minimiser:
                    found.append(np.unique(_grams(Lines(b" ".join(words), minimiser), minimiser)))
                    n += 1
        grams, times = np.unique(np.concatenate(found), return_counts=True)
        yield pa.RecordBatch.from_pydict({"gram": [*grams.view(np.int64).tolist(), None], "n": [*times.tolist(), n]}, schema=pa.schema([("gram", pa.int64()), ("n", pa.int64())]))
        released()

    some = texts.where(F.pmod(F.xxhash64(F.lit("hot"), "text"), F.lit(1 << 20)) < share * (1 << 20))
    counted = some.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    rows = counted.where(F.col("n") >= HOT_TEXTS).collect()  # no more than a bounded sample's words over HOT_TEXTS
    n = next((r["n"] for r in rows if r["gram"] is None), 0)
    return np.sort(np.array([r["gram"] for r in rows if r["gram"] is not None and r["n"] >= HOT_SHARE * n], np.int64).view(np.uint64))


def super_kmers(lines: Lines, window: int, minimiser: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows that share a minimiser: first window's word, last window's word, the minimiser's hash. A run of
    words that is frequent (in hot) is a window's minimiser only where all of the window's are."""
    if not len(lines.windows):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0, np.uint64)
    grams = _grams(lines, minimiser)
    rank = _mixed(grams) >> np.uint64(1)
    if len(hot):
        rank |= (hot[np.minimum(np.searchsorted(hot, grams), len(hot) - 1)] == grams).astype(np.uint64) << np.uint64(63)
    least = _least(rank, window - minimiser + 1)[lines.windows]
    at = lines.windows
    fresh = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1))))
    return at[fresh], at[np.append(fresh[1:], len(at)) - 1], _mixed(least[fresh] ^ _BASE)


def _sender(window: int, minimiser: int, buckets: int, hot: np.ndarray):
    """Map side: packs super-k-mers by bucket. A super-k-mer that a task has met before isn't sent again: its first copy is
    marked as repeated, and the later ones' ranges are settled at once."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        meta, by_bucket, settled, held = [], defaultdict(list), set(), 0
        pack = zstandard.ZstdCompressor(level=3)

        def add(rows: list[tuple[int, int, bytes]]) -> None:
            lines = Lines(data := b"\n".join(x[2] for x in rows), window)
            first, last, least = super_kmers(lines, window, minimiser, hot)
            place = np.searchsorted(lines.line, np.arange(len(rows)))
            line = lines.line[first]
            for a, b, row, start, end, bucket in zip(lines.starts[first].tolist(), lines.ends[last + window - 1].tolist(), line.tolist(), (first - place[line]).tolist(), (last + window - place[line]).tolist(), (least % np.uint64(buckets)).tolist()):
                words = data[a:b]
                at = seen.setdefault(words, len(meta))
                if at == len(meta):
                    meta.append([rows[row][0], rows[row][1], start, 0])
                    by_bucket[bucket].append(words)
                    by_bucket[bucket].append(at)
                else:
                    if meta[at][:3] != [rows[row][0], rows[row][1], start]:
                        settled.add((rows[row][0], rows[row][1], start, end))
                    meta[at][3] = 1

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            out: dict[str, list] = {"bucket": [], "words": [], "meta": []}
            for bucket, found in by_bucket.items():
                out["bucket"].append(bucket)
                out["words"].append(pack.compress(b"\n".join(found[::2])))
                out["meta"].append(np.array([tuple(meta[k]) for k in found[1::2]], _META).tobytes())
            ranges = defaultdict(list)
            for x in settled:
                ranges[x[0] % buckets].append(x)
            for bucket, found in ranges.items():
                out["bucket"].append(bucket)
                out["words"].append(None)
                out["meta"].append(np.array(found, _RANGE).tobytes())
            for x in (seen, meta, by_bucket, settled):
                x.clear()
            held = 0
            if out["bucket"]:
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("bucket", pa.int32()), ("words", pa.binary()), ("meta", pa.binary())]))

        for batch in batches:
            rows, size = [], 0
            for key, crc, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                words = text.encode("utf-8", "surrogatepass").split()
                if len(words) < window:
                    continue
                rows.append((key, crc, b" ".join(words)))
                size += len(rows[-1][2])
                if size >= GROUP_BYTES:
                    add(rows)
                    held += size
                    rows, size = [], 0
                    if held >= FLUSH_BYTES:
                        yield from flush()
            if rows:
                add(rows)
                held += size
        yield from flush()
        released()

    return send


def _repeats(lines: Lines, data: bytes, window: int, known: np.ndarray) -> np.ndarray:
    """Which of the windows occur twice or are known to: sorted by hash, then compared by their words."""
    at = lines.windows
    repeated = known[lines.line[at]].astype(bool)
    hashes = lines.window_hashes(window)
    order = np.argsort(hashes, kind="stable").astype(at.dtype)
    hashes = hashes[order]
    same = hashes[1:] == hashes[:-1]
    twice = np.concatenate((same, [False])) | np.concatenate(([False], same))
    group = np.concatenate(([0], np.cumsum(~same)))[twice]
    order = order[twice]
    words: dict[bytes, int] = {}
    now = -1
    for k, g, a, b in zip(order.tolist(), group.tolist(), lines.starts[at[order]].tolist(), lines.ends[at[order] + window - 1].tolist()):
        if g != now:
            words, now = {}, g
        first = words.setdefault(data[a:b], k)
        if first != k:
            repeated[first] = repeated[k] = True
    return repeated


def _counter(window: int):
    """Reduce side: the ranges of words that repeated windows of one bucket cover."""

    def count(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        parts, metas, out = [], [], []
        for words, meta in zip(table.column("words").to_pylist(), table.column("meta").to_pylist()):
            if words is None:
                out.append(np.frombuffer(meta, _RANGE))
            else:
                parts.append(unpack.decompress(words))
                metas.append(np.frombuffer(meta, _META))
        if metas:
            data, meta = b"\n".join(parts), np.concatenate(metas)
            parts.clear()
            lines = Lines(data, window)
            at = lines.windows[_repeats(lines, data, window, meta["known"])]
            if len(at):
                fresh = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (lines.line[at[1:]] != lines.line[at[:-1]]))))
                first, last = at[fresh], at[np.append(fresh[1:], len(at)) - 1]
                line = lines.line[first]
                shift = meta["start"][line].astype(np.int64) - np.searchsorted(lines.line, np.arange(len(meta)))[line]
                found = np.zeros(len(first), _RANGE)
                found["key"], found["crc"], found["start"], found["end"] = meta["key"][line], meta["crc"][line], first + shift, last + window + shift
                out.append(found)
        got = np.concatenate(out) if out else np.zeros(0, _RANGE)
        del parts, metas, out
        released()
        return pa.table({"key": got["key"], "crc": got["crc"].astype(np.int64), "span": got["start"].astype(np.int64) << 32 | got["end"]})

    return count


def _kept(text: Column, spans: Column) -> Column:
    @F.pandas_udf("kept string, n_words long, n_removed long")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, found in batches:
            rows = []
            for whole, ranges in zip(texts, found):
                words = whole.encode("utf-8", "surrogatepass").split() if whole else []
                n = len(words)
                if ranges is not None and len(ranges):
                    stay = np.ones(n + 1, bool)
                    for x in ranges.tolist():
                        stay[x >> 32 : x & 0xFFFFFFFF] = False
                    words = [words[k] for k in np.flatnonzero(stay[:n]).tolist()]
                rows.append((b" ".join(words).decode("utf-8", "surrogatepass"), n, n - len(words)))
            yield pd.DataFrame(rows, columns=["kept", "n_words", "n_removed"])
        released()

    return of(text, spans)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, minimiser: int = MINIMISER, into: str = "__kept") -> DataFrame:
    """docs with a column `into`: struct(kept, n_words, n_removed), which replaces one of that name; all others stay. Words are runs
    outside ASCII white space. A word goes if a window of `window` consecutive words covers it whose words, in order, also
    start elsewhere, in any text or the same one; every copy goes. kept joins the other words by one space.

    Windows that share a minimiser with their neighbours travel together as one string to the minimiser's bucket, so a window
    meets all its copies; there they are sorted and compared word for word. Buckets hold a fixed number of text bytes at any
    input size, on average: runs of words that many texts have are minimisers only of windows that have no others, so windows
    around a common line are dealt by what surrounds it, and copies within a map task are settled before the shuffle, so that
    a passage in a third of all rows reaches its bucket once per task. Ranges return to rows by a 96-bit key of id and text: repeated rows share theirs, and
    null ids are ids like any other. Null, empty and shorter texts lose nothing (null: kept is the empty text); an empty table
    gives an empty result.
    """
    long_texts(docs.sparkSession)
    own = docs.drop(into)
    key, crc, of, of_crc, spans_of = free(own, "__key", "__crc", "__of", "__of_crc", "__spans")
    whole = F.coalesce(F.col(text_col), F.lit(""))
    keyed = own.withColumns({key: F.xxhash64(F.col(id_col), whole), crc: F.crc32(whole.cast("binary"))})
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(32, -(-size // BUCKET_BYTES))
    hot = hot_grams(docs.select(whole.alias("text")), size, minimiser)
    sent = keyed.select(key, crc, whole.alias("text")).mapInArrow(_sender(window, minimiser, buckets, hot), "bucket int, words binary, meta binary")
    spans = sent.groupBy("bucket").applyInArrow(_counter(window), "key long, crc long, span long")
    spans = spans.groupBy("key", "crc").agg(F.collect_set("span").alias(spans_of)).withColumnsRenamed({"key": of, "crc": of_crc})
    joined = keyed.join(spans, (F.col(key) == F.col(of)) & (F.col(crc) == F.col(of_crc)), "left")
    return joined.withColumn(into, _kept(F.col(text_col), F.col(spans_of))).drop(key, crc, of, of_crc, spans_of)
