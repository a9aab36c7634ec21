"""Files as a data source of the engine: spark.read.format("documents").load(folder). Filters on path and length choose files before any
is opened."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from corpusmill.sources import loaders

#: Bytes of the files that a task takes, on average at most; a larger file is a task's own.
TASK_BYTES = 64 << 20
SCHEMA = "path string, length long, refused string, text string, page_count int, error string, sha256 string"

_TESTS = {
    EqualTo: lambda x, y: x == y, GreaterThan: lambda x, y: x > y, GreaterThanOrEqual: lambda x, y: x >= y, LessThan: lambda x, y: x < y, LessThanOrEqual: lambda x, y: x <= y,
    In: lambda x, y: x in y, StringStartsWith: lambda x, y: x.startswith(y), StringEndsWith: lambda x, y: x.endswith(y), StringContains: lambda x, y: y in x,
}


@dataclass(frozen=True)
class Files(InputPartition):
    """(path, length, why it is refused) of the files that a task takes."""

    files: tuple[tuple[str, int, str | None], ...]


class DocumentReader(DataSourceReader):
    """Options: path; most, the greatest length; allowed, extensions joined by commas."""

    def __init__(self, options: dict) -> None:
        self.folder = options["path"]
        self.most = int(options.get("most", loaders.LOAD_BYTES))
        self.allowed = options.get("allowed", ",".join(loaders.LOADED)).split(",")
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes comparisons of path and length; all others stay with the engine."""
        for x in filters:
            if type(x) in _TESTS and x.attribute in (("path",), ("length",)):
                self.tests.append((x.attribute[0], type(x), x.value))
            else:
                yield x

    def partitions(self) -> list[Files]:
        """Lists the folder and its folders; packs files in the order of their paths."""
        from pyarrow import fs

        store, place = fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)
        packs, size = [[]], 0
        for x in sorted(store.get_file_info(fs.FileSelector(place, recursive=True)), key=lambda x: x.path):
            own = {"path": f"file:{x.path}" if isinstance(store, fs.LocalFileSystem) else x.path, "length": x.size}
            if x.type != fs.FileType.File or os.path.basename(x.path).startswith(("_", ".")) or not all(_TESTS[kind](own[column], value) for column, kind, value in self.tests):
                continue
            kind = os.path.splitext(x.path)[1].lower()
            refused = "unsupported file type" if kind not in self.allowed else "too large" if x.size > self.most else None
            cost = 0 if refused else x.size
            if packs[-1] and size + cost > TASK_BYTES:
                packs.append([])
                size = 0
            packs[-1].append((own["path"], x.size, refused))
            size += cost
        return [Files(tuple(x)) for x in packs]

    def read(self, partition: Files) -> Iterator[tuple]:
        from pyarrow import fs

        for path, length, refused in partition.files:
            if refused:  # never opened
                yield path, length, refused, None, 0, None, None
                continue
            store, place = (fs.LocalFileSystem(), path.removeprefix("file:")) if path.startswith("file:") else fs.FileSystem.from_uri(self.folder)[:1] + (path,)
            with store.open_input_stream(place, compression=None) as source:
                data = source.read()
            try:
                text, pages = loaders.READERS[os.path.splitext(unquote(path))[1].lower()](data)
                error = None if text.strip() else "empty"
            except Exception as e:  # noqa: BLE001  the row says what went wrong
                text, pages, error = None, 0, f"{type(e).__name__}: {e}"[:200]
            yield path, length, None, text, pages, error, hashlib.sha256(data).hexdigest()


class Documents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DocumentReader:
        return DocumentReader(self.options)


def registered(spark: SparkSession) -> SparkSession:
    """Makes the format known to a session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Documents)
    return spark


def load(spark: SparkSession, folder: str, access_level: str = "internal", category: str | None = None, **options: str) -> DataFrame:
    """What loaders.load gives for the folder's files, read through the format; a refused file has no id and no hash, as it is never
    opened."""
    rows = registered(spark).read.format("documents").options(**options).load(folder)
    return loaders.documents_of(rows.select("path", "length", "refused", F.struct(F.col("text").alias("content"), "page_count", "error").alias("made"), F.col("sha256").alias("hash")), access_level, category)
