"""WARC archives whose records are compressed one by one with a dictionary that leads the file."""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.base import scratch_path, stored

#: Bytes that a file's dictionary is built from, of all records and of each, and its size, at most; records that it takes at least.
SAMPLE_BYTES, PIECE_BYTES, DICTIONARY_BYTES, SAMPLE_RECORDS, LEVEL = 1 << 20, 1 << 16, 32 << 10, 8, 3
#: Equal rows that one row on the way to the writer stands for, at most.
SLICE = 4096
#: Fixed by the format: the skippable frame that holds the dictionary, the start of a Zstandard frame.
SKIPPABLE, FRAME = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page: str | None, sha: str, label: str = "") -> str:
    """A record's name: unlike any other's, as rows that share an id differ in their payload or have a label."""
    return f"<urn:page:{'' if page is None else page}:{sha}{f'#{label}' if label else ''}>"


def _page(urn: str) -> str | None:
    return urn.removeprefix("<urn:page:").removesuffix(">").rpartition(":")[0] or None


def record(page: str | None, url: str | None, payload: bytes, response: str | None, revisit: bool, label: str = "") -> bytes:
    """One record. A revisit has the response's HTTP head, with the full payload's length, and no payload. label: tells the record
    from others of its id and payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block, sha = head if revisit else head + payload, digest(payload)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page, sha, label)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {' '.join(url.split())}")
    lines.append(f"WARC-Payload-Digest: sha1:{sha}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(response, sha)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(pieces: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """None where there are too few pieces to build one from. Pieces too short for training are the dictionary as they are."""
    if len(pieces) < SAMPLE_RECORDS:
        return None
    total = sum(map(len, pieces))
    try:
        return zstandard.train_dictionary(max(1024, min(DICTIONARY_BYTES, total // 16)), pieces)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(pieces)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write(out, records: Iterator[bytes]) -> tuple[int, int]:
    """Writes a file: the dictionary, built from the first records, in a skippable frame; then a frame for each record. Of each record
    the dictionary sees PIECE_BYTES at most, so that a large one doesn't stand for all. Holds SAMPLE_RECORDS records or
    SAMPLE_BYTES of pieces, whichever are more, with what is left of their records. Returns the numbers of records and of bytes
    before compression."""
    held, size = [], 0
    for x in records:
        held.append(x)
        size += min(len(x), PIECE_BYTES)
        if size >= SAMPLE_BYTES and len(held) >= SAMPLE_RECORDS:
            break
    made = _dictionary([x[:PIECE_BYTES] for x in held])
    if made:
        packed = zstandard.ZstdCompressor(level=19).compress(made.as_bytes())
        out.write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
    pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=made) if made else zstandard.ZstdCompressor(level=LEVEL)
    n = total = 0
    for part in (held, records):
        for x in part:
            out.write(pack.compress(x))
            n, total = n + 1, total + len(x)
    return n, total


class _Led:
    """A source some of whose bytes have been read already."""

    def __init__(self, head: bytes, rest) -> None:
        self.head, self.rest = head, rest

    def read(self, size: int = -1) -> bytes:
        if not self.head:
            return self.rest.read(size) if size >= 0 else self.rest.read()
        out, self.head = (self.head[:size], self.head[size:]) if size >= 0 else (self.head, b"")
        return out if size >= 0 else out + self.rest.read()


def read(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers (names lower-cased) and the block of each record of a file."""
    head, unpack = source.read(8), zstandard.ZstdDecompressor()
    if len(head) == 8 and struct.unpack("<II", head)[0] == SKIPPABLE:
        raw = source.read(struct.unpack("<II", head)[1])
        raw = unpack.decompress(raw) if raw.startswith(FRAME) else raw
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    else:
        source = _Led(head, source)
    stream = io.BufferedReader(unpack.stream_reader(source, read_across_frames=True))
    while first := stream.readline():
        if first.strip() != b"WARC/1.1":
            raise ValueError(f"no record starts with {first[:40]!r}")
        headers = {}
        while line := stream.readline().rstrip(b"\r\n"):
            name, _, value = line.decode("utf-8", "surrogatepass").partition(": ")
            headers[name.lower()] = value
        block = stream.read(int(headers["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record's end is missing")
        yield headers, block


def decisions(pages: DataFrame, id_col: str, url_col: str, payload: str) -> DataFrame:
    """The distinct rows of pages (id, url and payload) with __times, how many rows each stands for, __from, the first of these that it
    stands for (there is a row for each SLICE), __response, the smallest id of its payload, and __leads: whether it is that one,
    of rows with that id the one of the least url.

    Equal rows are combined before they are shuffled; equal payloads meet by their SHA-1 without their texts. So no payload, id
    or row that a third of the table shares gathers in a task, and the writers share the slices of a row that many repeat."""
    named = pages.withColumns({"__sha": F.sha1(payload), "__who": F.concat_ws(":", F.sha1(payload), F.coalesce(F.sha1(F.col(url_col).cast("binary")), F.lit("-")), F.col(id_col).cast("string"))})
    order = F.struct(F.col("__id").isNull(), F.col("__id").alias("id"), F.col("__url").isNull(), F.col("__url").alias("url"))
    each = named.groupBy(F.col("__who").alias("__whose")).agg(F.first(id_col).alias("__id"), F.first(url_col).alias("__url"), F.first("__sha").alias("__of"), F.count("*").alias("__times"))
    least = each.groupBy(F.col("__of").alias("__least_of")).agg(F.min(order).alias("__first"))
    leads = F.col("__id").eqNullSafe(F.col("__first.id")) & F.col("__url").eqNullSafe(F.col("__first.url"))
    each = each.join(least, F.col("__of") == F.col("__least_of")).select("__whose", "__times", F.col("__first.id").alias("__response"), leads.alias("__leads"))
    once = named.groupBy("__who").agg(*(F.first(c).alias(c) for c in pages.columns))
    joined = once.join(each, F.col("__who") == F.col("__whose")).drop("__who", "__whose")
    few = joined.where(F.col("__times") <= SLICE).withColumn("__from", F.lit(0).cast("long"))
    many = joined.where(F.col("__times") > SLICE).withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__times") - 1, F.lit(SLICE).cast("long"))))
    return few.unionByName(many.repartition(F.xxhash64(F.col("__from"), F.sha1(payload))))


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Writes a record for each page and returns the files: (path, records, bytes). folder: shared by all executors; where not
    given, one in the cluster's shared folder.

    Of equal payloads of least_bytes or more, the record with the smallest id is a response and the others revisit it; of rows
    that share id and payload one is that response. Null html is an empty payload; a null id stands behind every other id;
    equal rows have a record each (see decisions for rows that many share). A task that runs again writes another file and only
    the files of tasks that ended well are returned.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    rows = pages.select(F.col(id_col).cast("string").alias("page"), F.col(id_col).alias("__page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    chosen = decisions(rows, "__page_id", "url", "payload").select("page", "url", "payload", F.col("__response").cast("string").alias("response"), F.col("__leads").alias("leads"), F.col("__from").alias("start"), F.least(F.col("__times"), F.col("__from") + SLICE).alias("end"))

    def of(page, url, payload, response, leads, start, end) -> Iterator[bytes]:
        """The records of rows start to end of equal ones: the first is their payload's response if they lead, all if it is short."""
        short, own = len(payload) < least_bytes, "-" if url is None else hashlib.sha1(url.encode("utf-8", "surrogatepass")).hexdigest()[:20]
        for k in range(start, end):
            first = leads and not k
            yield record(page, url, payload, response, not (short or first), "" if first else own if not k else f"{own}.{k}")

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        records = (x for batch in batches for row in zip(*(batch[c].where(batch[c].notna(), None) for c in ("page", "url", "payload", "response", "leads", "start", "end"))) for x in of(*row))
        first = next(records, None)
        if first is None:
            return
        store, place = fs.FileSystem.from_uri(folder)
        store.create_dir(place, recursive=True)
        task = TaskContext.get()
        path = f"{place}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.zst"
        with store.open_output_stream(path, compression=None) as out:
            n, size = write(out, (x for part in ((first,), records) for x in part))
        yield pd.DataFrame({"path": [path], "records": [n], "bytes": [size]})

    return stored(chosen.mapInPandas(put, "path string, records long, bytes long").withColumn("folder", F.lit(folder)), "archives")


def records_of(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """(page string, url, record_type, refers_to string, payload_bytes, payload_digest[, payload]) of the records in files that
    archive() returned. A response whose payload differs from its digest or length is an error."""

    def get(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for folder, path in zip(batch["folder"], batch["path"]):
                store, _ = fs.FileSystem.from_uri(folder)
                rows = []
                with store.open_input_stream(path, compression=None) as source:
                    for headers, block in read(source):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        size = int(head.rpartition(b"Content-Length: ")[2])
                        sha, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
                        if kind == "response" and (len(payload) != size or digest(payload) != sha):
                            raise ValueError(f"a damaged payload in {path}")
                        rows.append((_page(headers["warc-record-id"]), headers.get("warc-target-uri"), kind, _page(headers.get("warc-refers-to", "")), size, sha, payload if payloads and kind == "response" else None))
                        if len(rows) >= 2000:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
                yield pd.DataFrame(rows, columns=names)

    names = ["page", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    spread = archives.repartition(max(1, archives.count()))
    found = spread.mapInPandas(get, "page string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary")
    return found if payloads else found.drop("payload")
