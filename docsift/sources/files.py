"""File sources: checks of binary files, a reader of page text, JSON and text inputs, a store without overwriting."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docsift.functions.text import strip

MB = 1024 * 1024
MOST_PAGES, MOST_PAGE_CHARS = 500, 200_000


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def pdf_error(path: Column, content: Column, length: Column, most: int = 20 * MB) -> Column:
    """The first check a PDF fails: empty, size, suffix, magic bytes in its first 1024 bytes."""
    head = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    return F.when(length == 0, "EMPTY").when(length > most, "TOO_LARGE").when(~F.lower(path).endswith(".pdf"), "NOT_PDF_SUFFIX").when(~F.contains(head, F.lit("%PDF-")), "NO_MAGIC")


def file_error(content: Column, length: Column, most: int = 500 * MB) -> Column:
    """As in scripts: the first five bytes, and the size."""
    return F.when(length == 0, "EMPTY").when(length > most, "TOO_LARGE").when(~F.hex(F.substring(content, 1, 5)).startswith("255044462D"), "NO_MAGIC")


def image_source_error(content: Column, length: Column, pages: Column, most: int = 500 * MB) -> Column:
    """Before images are taken from a PDF: it is there, not empty, not too large, and has a page."""
    return F.when(content.isNull(), "MISSING").when(length == 0, "EMPTY").when(length > most, "TOO_LARGE").when(F.coalesce(pages, F.lit(0)) < 1, "NO_PAGES")


def upload_error(name: Column, content: Column, length: Column, most: int = 20 * MB) -> Column:
    """As at the upload: suffix, empty, size, and the file must begin with the magic bytes."""
    return F.when(~F.lower(name).endswith(".pdf"), "NOT_PDF_SUFFIX").when(length == 0, "EMPTY").when(length > most, "TOO_LARGE").when(~F.hex(F.substring(content, 1, 4)).startswith("25504446"), "NO_MAGIC")


def size_error(length: Column, most: int) -> Column:
    return F.when(length == 0, "empty").when(length > most, "too large")


def extension_allowed(name: Column, allowed: list[str]) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1)).isin(allowed)


def _strings(stream: bytes) -> str:
    """The text shown by a content stream: literal and hexadecimal strings before Tj, ' and in TJ arrays."""
    out = []
    for m in re.finditer(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]+>|T[*dDm]|'", stream):
        s = m[0]
        if s[:1] == b"(":
            s = re.sub(rb"\\([nrtbf()\\])", lambda x: {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}.get(x[1], x[1]), s[1:-1])
            out.append(s.decode("latin-1"))
        elif s[:1] == b"<":
            digits = b"".join(s[1:-1].split())
            out.append(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1"))
        else:
            out.append("\n")
    return "".join(out).strip()


def pdf_pages(content: bytes, most_pages: int = MOST_PAGES, most_chars: int = MOST_PAGE_CHARS) -> Iterator[tuple[int, str, str | None]]:
    """(page number, text, error) of a simple PDF: plain or deflated content streams, in file order. An encrypted or empty file gives one row with page 0."""
    if b"/Encrypt" in content:
        yield 0, "", "ENCRYPTED"
        return
    n = 0
    for m in re.finditer(rb"(?<!end)stream\r?\n(.*?)\r?\n?endstream", content, re.S):
        head, body = content[content.rfind(b"obj", 0, m.start()) + 3 : m.start()], m[1]
        if b"/Subtype" in head or b"/Type" in head:
            continue
        n += 1
        if n > most_pages:
            yield 0, "", "TOO_MANY_PAGES"
            return
        try:
            yield n, _strings(zlib.decompress(body) if b"FlateDecode" in head else body)[:most_chars], None
        except zlib.error as x:
            yield n, "", str(x)
    if not n:
        yield 0, "", "NO_PAGES"


def page_text(files: DataFrame) -> DataFrame:
    """Pages of binary files (path, content): path, page_number, text, error. A file's pages stay with its row."""
    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(p, *x) for p, c in zip(pdf["path"], pdf["content"], strict=True) for x in pdf_pages(c)]
            yield pd.DataFrame(rows, columns=["path", "page_number", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, page_number int, text string, error string")


class _Chunk(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _PdfReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]

    def partitions(self):
        return [_Chunk(p) for p in self.paths]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            for n, text, error in pdf_pages(f.read()):
                yield partition.path, n, text, error


class PdfPages(DataSource):
    """spark.read.format("pdf_pages").load("a.pdf,b.pdf"): a partition a file, for files that every worker can open."""

    @classmethod
    def name(cls):
        return "pdf_pages"

    def schema(self):
        return "path string, page_number int, text string, error string"

    def reader(self, schema):
        return _PdfReader(self.options)


def metadata_field(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def store_images(df: DataFrame, path: str, key: str = "image_id") -> None:
    """Partitioned by the first two characters of the id; an existing store is never overwritten."""
    df.withColumn("p", F.substring(key, 1, 2)).write.partitionBy("p").mode("errorifexists").parquet(path)
