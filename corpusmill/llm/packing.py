"""Packing documents into sequences: cached tokenising, then bounded-space online best-fit."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.base import long_texts, released, stored

SEQUENCE = 2048
END_ID = 0
#: Open bins of a packer; the fullest closes when one more is needed.
OPEN_BINS = 64
#: Pieces that a packer holds before it places them, longest first; 1 is strictly online.
LOOK_AHEAD = 256
#: Pieces a packer gets on average: more packers for more pieces, never more pieces for a packer.
PIECES_EACH = 50_000
#: Words whose ids a worker remembers.
WORDS_KEPT = 150_000

_unsafe = re.compile(r" (?=\s|\Z)").search


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def _encoder(path: str):
    """text -> ids, with the vocabulary of a tokenizers file. Byte-level merges rank as their ids do, so a rank encoder gives the
    ids that tokenizers gives (the tests compare them), several times faster on words not seen before. Strings of added
    tokens are ordinary text here; encode_all takes them out first."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    special = {x["content"] for x in made["added_tokens"]}
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in printed} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in printed)}
    ranks = {bytes(map(byte.__getitem__, token)): number for token, number in made["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def _added(path: str) -> tuple[re.Pattern | None, dict[str, bytes]]:
    """What finds the strings of a tokenizers file's added tokens, and the id of each: the leftmost one counts, of several the longest."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)["added_tokens"]
    if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in made):
        raise ValueError("added tokens that look at the text around them")
    strings = sorted((x["content"] for x in made), key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, strings)) + ")") if strings else None, {x["content"]: array("I", [x["id"]]).tobytes() for x in made}


class _Words(dict):
    """The ids, as little-endian unsigned 32-bit numbers, of a space and what follows it. A word of letters is one piece of the
    pre-tokenizer; so is the mark after it, unless that could begin a contraction."""

    def __init__(self, path: str) -> None:
        whole = _encoder(path)
        self.whole, self.piece = whole.encode_ordinary, whole._core_bpe.encode_single_piece
        self.marks = {x: array("I", self.whole(x)).tobytes() for x in ",.;:!?|)"}

    def __missing__(self, word: str) -> bytes:
        if word.isalpha():
            found = array("I", self.piece(f" {word}".encode())).tobytes()
        elif word[:-1].isalpha() and word[-1] in self.marks:
            found = self[word[:-1]] + self.marks[word[-1]]
        else:
            found = array("I", self.whole(f" {word}")).tobytes()
        self[word] = found
        return found


@cache
def _words(path: str) -> _Words:
    return _Words(path)


def forget() -> None:
    """Drops the encoder and its memory of words at the end of a task: the worker lives on and others need the room."""
    _words.cache_clear()
    _encoder.cache_clear()
    _added.cache_clear()
    released()


def _chunks(text: str) -> list[str]:
    """text, cut before every space that a character other than white space follows: byte-level pre-tokenising always
    begins a token there, so that chunks can be encoded apart."""
    parts = text.split(" ")
    if _unsafe(text):
        joined = parts[:1]
        for x in parts[1:]:
            if x and not x[0].isspace():
                joined.append(x)
            else:
                joined[-1] += f" {x}"
        parts = joined
    return parts


def encode_all(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit numbers, those that tokenizers gives by default: strings of the file's
    added tokens are these tokens and what stands between them is encoded apart. Words seen before are looked up."""
    known, (find, ids), out = _words(path), _added(path), []
    for text in texts:
        made = []
        for k, part in enumerate(find.split(text) if any(map(text.__contains__, ids)) else [text]):
            if k % 2:
                made.append(ids[part])
                continue
            head, *rest = _chunks(part)
            made.append(array("I", known.whole(head)).tobytes() + b"".join(map(known.__getitem__, rest)))
        out.append(b"".join(made))
        if len(known) > WORDS_KEPT:
            known.clear()
    return out


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """(id, piece, start, length, ids_crc32): a document's ids and the closing id 0. Only documents over size are cut; then the
    first piece takes the remainder and the others are full. A null text is empty: one piece of the closing id."""
    long_texts(docs.sparkSession)
    path, kind = tokenizer or default_tokenizer(), dict(docs.dtypes)[id_col]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, data in zip(batch["id"], encode_all([x or "" for x in batch["text"]], path)):
                data += array("I", [END_ID]).tobytes()
                total, start, k = len(data) // 4, 0, 0
                while start < total:
                    end = start + ((total - 1) % size + 1 if k == 0 else size)
                    rows.append((key, k, start, end - start, zlib.crc32(data[4 * start : 4 * end])))
                    start, k = end, k + 1
            made = pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32"])
            made["id"] = made["id"].astype(batch["id"].dtype)
            yield made
        forget()

    made = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInPandas(cut, "id string, piece int, start long, length long, ids_crc32 long")
    return made.withColumn("id", F.col("id").cast(kind))


def best_fit(lengths: list[int], size: int = SEQUENCE, open_bins: int = OPEN_BINS) -> tuple[list[int], list[int]]:
    """The bin and the offset of each length (1 to size), taken online in the order given: the fullest open bin with room, else
    a new one. free is a bitset: bit f is set while an open bin with f free places stands in line f. With open_bins open, the
    fullest closes."""
    bins: list[list[int]] = [[] for _ in range(size + 1)]
    free, count, made = 0, 0, 0
    where, offset = [], []
    for n in lengths:
        fits = free >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            at = bins[room].pop()
            if not bins[room]:
                free ^= 1 << room
            count -= 1
        else:
            at, room, made = made, size, made + 1
        where.append(at)
        offset.append(size - room)
        if room > n:
            if count == open_bins:
                fullest = (free & -free).bit_length() - 1
                bins[fullest].pop()
                if not bins[fullest]:
                    free ^= 1 << fullest
                count -= 1
            bins[room - n].append(at)
            free |= 1 << (room - n)
            count += 1
    return where, offset


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, size: int = SEQUENCE, open_bins: int = OPEN_BINS, look_ahead: int = LOOK_AHEAD) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): every piece of every document in a sequence of at most size
    ids, without gaps.

    Pieces are dealt to packers at random and each packer takes its own in the order in which they came, look_ahead of them at a
    time, the longest of these first. So every packer sees the whole mix of lengths, places a piece once and for good and
    holds open_bins bins open at most: the fullest closes for the next, and only the last open ones stay part empty. A packer gets a bounded number of pieces at any input size. Null ids and repeated rows keep their pieces; null
    texts are empty, very long ones become many pieces; other columns are ignored; an empty table gives an empty result.
    Pieces are stored in the shared folder first: a lost packer reads the same ones again.
    """
    made = stored(pieces(docs, id_col, text_col, tokenizer, size), "pieces")
    packers = max(1, -(-made.count() // PIECES_EACH))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        released()
        group = group.sort_values("row")
        turn = np.arange(len(group)) // look_ahead
        group = group.iloc[np.lexsort((-group["length"].to_numpy(), turn))]
        where, offset = best_fit(group["length"].tolist(), size, open_bins)
        return group.assign(sequence_id=[(int(group["packer"].iloc[0]) << 32) + x for x in where], offset=offset).drop(columns=["packer", "row"])

    kind = dict(made.dtypes)["id"]
    dealt = made.withColumn("id", F.col("id").cast("string")).withColumn("row", F.monotonically_increasing_id()).withColumn("packer", F.pmod(F.xxhash64("row"), F.lit(packers)))
    packed = dealt.groupBy("packer").applyInPandas(fit, "id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return packed.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
