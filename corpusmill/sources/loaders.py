"""Reading files into documents: validation, decoding by type, hashing and classification, on the executors."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import basename, extension
from corpusmill.operators.classify import classified

# fixed values: extensions and sizes that are accepted
LOADED, UPLOADED = [".pdf", ".docx", ".txt", ".xlsx", ".csv"], [".pdf", ".docx", ".doc", ".txt", ".md", ".html", ".htm"]
LOAD_BYTES, UPLOAD_BYTES = 50 * 1024 * 1024, 10 * 1024 * 1024
WORD, SHEET = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}", "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def decode(data: bytes) -> str:
    """UTF-8, else Latin-1, which takes any byte."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def read_docx(data: bytes) -> tuple[str, int]:
    """Paragraphs, then [TABLES] with cells joined by bars."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD}body")
    said = lambda x: "".join(t.text or "" for t in x.iter(f"{WORD}t"))
    parts = [s for p in body.findall(f"{WORD}p") if (s := said(p)).strip()]
    rows = [" | ".join(said(c).strip() for c in r.findall(f"{WORD}tc")) for t in body.findall(f"{WORD}tbl") for r in t.findall(f"{WORD}tr")]
    return "\n\n".join([*parts, "[TABLES]", *rows] if rows else parts), 1


def _column(ref: str) -> int:
    """The number of a cell's column, from 0, by the letters of its reference."""
    n = 0
    for x in ref.rstrip("0123456789"):
        n = 26 * n + ord(x) - 64
    return n - 1


def read_xlsx(data: bytes) -> tuple[str, int]:
    """Each sheet's name and its rows that aren't empty, cells joined by bars, missing ones as empty. Sheets are found by the
    workbook's relations, in its order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names, out = set(z.namelist()), []
        shared = ["".join(t.text or "" for t in x.iter(f"{SHEET}t")) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{SHEET}si")] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))} if "xl/_rels/workbook.xml.rels" in names else {}
        for k, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{SHEET}sheet"), 1):
            target = targets.get(next((v for a, v in sheet.attrib.items() if a.endswith("}id")), None), f"worksheets/sheet{k}.xml")
            path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            if path not in names:
                continue
            out.append(f"[Sheet: {sheet.get('name')}]")
            for row in ElementTree.fromstring(z.read(path)).iter(f"{SHEET}row"):
                cells: list[str] = []
                for c in row.iter(f"{SHEET}c"):
                    cells += [""] * ((_column(c.get("r")) if c.get("r") else len(cells)) - len(cells))
                    v = c.find(f"{SHEET}v")
                    cells.append("".join(t.text or "" for t in c.iter(f"{SHEET}t")) if c.get("t") == "inlineStr" else "" if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text or "")
                if any(x.strip() for x in cells):
                    out.append(" | ".join(cells))
    return "\n".join(out), 1


def read_pdf(data: bytes) -> tuple[str, int]:
    """Pages that aren't blank, each under its mark. Needs the optional package pypdf."""
    from pypdf import PdfReader

    pages = [p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages]
    return "\n\n".join(f"[Page {k}]\n{x}" for k, x in enumerate(pages, 1) if x.strip()), len(pages)


def read_csv(data: bytes) -> tuple[str, int]:
    import csv

    return "\n".join(" | ".join(row) for row in csv.reader(io.StringIO(decode(data))) if any(row)), 1


def read_html(data: bytes) -> tuple[str, int]:
    return re.sub(r"<[^>]+>", "", data.decode("utf-8", "ignore")), 1


def read_text(data: bytes) -> tuple[str, int]:
    return decode(data), 1


def plain_pdf(data: bytes) -> tuple[str, int]:
    """All pages, blank ones too, joined by blank lines; without the optional package, or where it fails, the bytes read as text."""
    try:
        from pypdf import PdfReader

        pages = [p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages]
        return "\n\n".join(pages), len(pages)
    except Exception:  # noqa: BLE001  a broken file is read as far as it goes
        return data.decode("utf-8", "ignore"), 1


def plain_docx(data: bytes) -> tuple[str, int]:
    """Paragraphs that aren't blank, a line each; tables are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD}body")
    said = ("".join(t.text or "" for t in p.iter(f"{WORD}t")) for p in body.findall(f"{WORD}p"))
    return "\n".join(x for x in said if x.strip()), 1


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


def plain_html(data: bytes) -> tuple[str, int]:
    """The texts between tags, a line each."""
    made = _Text()
    made.feed(data.decode("utf-8", "ignore"))
    made.close()
    return "\n".join(x.strip() for x in made.parts if x.strip()), 1


def plain_text(data: bytes) -> tuple[str, int]:
    return data.decode("utf-8", "ignore"), 1


#: Readers by extension; callers may add theirs.
READERS: dict[str, Callable[[bytes], tuple[str, int]]] = {".pdf": read_pdf, ".docx": read_docx, ".doc": read_docx, ".xlsx": read_xlsx, ".csv": read_csv, ".html": read_html, ".htm": read_html, ".txt": read_text, ".md": read_text}
#: Readers of requirement files, which keep no marks of pages, sheets or tables.
PLAIN_READERS: dict[str, Callable[[bytes], tuple[str, int]]] = {".pdf": plain_pdf, ".docx": plain_docx, ".doc": plain_docx, ".html": plain_html, ".htm": plain_html, ".txt": plain_text, ".md": plain_text}
# fixed values: the media type that goes with an extension
MEDIA = {
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".txt": "text/plain",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".csv": "text/csv",
}


def html_text(html: Column) -> Column:
    """html without its tags; what stands in script and style stays."""
    return F.regexp_replace(html, r"<[^>]+>", "")


def refusal(path: Column, length: Column, allowed: list[str] = LOADED, most: int = LOAD_BYTES) -> Column:
    """Why a file isn't loaded; null if it is."""
    return F.when(~extension(path).isin(allowed), F.lit("unsupported file type")).when(length > most, F.lit("too large"))


def upload_refusal(path: Column, length: Column) -> Column:
    """The same for uploaded requirement files, which may have other extensions and be smaller."""
    return refusal(path, length, UPLOADED, UPLOAD_BYTES)


def media_warning(path: Column, media: Column) -> Column:
    """A note where a file's media type isn't its extension's; null where it is, and where either is unknown. It refuses nothing."""
    want = F.lit(None).cast("string")
    for kind, name in MEDIA.items():
        want = F.when(extension(path) == kind, name).otherwise(want)
    return F.when(media != want, F.concat(F.lit("expected "), want, F.lit(", found "), media))


def files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)


def load(found: DataFrame, access_level: str = "internal", allowed: list[str] = LOADED, most: int = LOAD_BYTES, readers: dict | None = None, category: str | None = None) -> DataFrame:
    """Binary files (path, length, content) into documents. Rows of files that can't be read stay, with status failed or skipped and
    the reason, so a bad file costs only itself. Contents of refused files aren't sent to the readers."""
    known = readers or READERS

    @F.pandas_udf("content string, page_count int, error string")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for kinds, blobs in batches:
            rows = []
            for kind, blob in zip(kinds, blobs):
                try:
                    text, pages = known[kind](bytes(blob)) if blob is not None else (None, 0)
                    rows.append((text, pages, None if text is None or text.strip() else "empty"))
                except Exception as e:  # noqa: BLE001  the row says what went wrong
                    rows.append((None, 0, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["content", "page_count", "error"])

    rows = found.withColumns({"refused": refusal(F.col("path"), F.col("length"), allowed, most), "file_type": extension(F.col("path"))})
    rows = rows.withColumns({"made": read("file_type", F.when(F.col("refused").isNull(), F.col("content"))), "hash": F.sha2("content", 256)})
    return documents_of(rows, access_level, category)


def documents_of(rows: DataFrame, access_level: str, category: str | None) -> DataFrame:
    """Documents of read files: path, length, refused, made (content, page_count, error) and hash."""
    rows = rows.withColumn("error", F.coalesce("refused", "made.error"))
    status = F.when(F.col("refused") == "unsupported file type", "skipped").when(F.col("error").isNotNull(), "failed").otherwise("loaded")
    rows = rows.select(
        F.concat(F.lit("doc_"), F.left("hash", F.lit(16))).alias("doc_id"), F.col("made.content").alias("content"), F.col("made.page_count").alias("page_count"), basename(F.col("path")).alias("source_file"),
        extension(F.col("path")).alias("file_type"), F.col("length").alias("file_size_bytes"), F.col("hash").alias("sha256_hash"), F.lit(access_level).alias("access_level"), F.lit("1.0").alias("version"), status.alias("status"), "error",
    )
    return classified(rows, override=category)


def ingest_counts(loaded: DataFrame) -> DataFrame:
    return loaded.agg(*(F.count_if(F.col("status") == x).alias(x) for x in ("loaded", "failed", "skipped")))
