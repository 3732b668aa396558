"""Sources: recorded tables, text lists, binary documents, and a Python Data Source for live pages.

Live fetching is a plug-in behind the same columns as the recorded table, so that a plan does not change; it refuses
addresses that are not public, limits bodies, and is not used by any query here.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from shutil import which

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """(url): the lines of a text file without blank ones and # comments."""
    line = F.regexp_replace("value", r"^\s+|\s+$", "")
    return spark.read.text(path).select(line.alias("url")).filter((F.col("url") != "") & ~F.col("url").startswith("#"))


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): binary files that start as PDF documents do."""
    files = spark.read.format("binaryFile").load(path)
    return files.filter(F.substring(F.col("content"), 1, 5) == F.encode(F.lit("%PDF-"), "UTF-8")).select("path", "content")


def is_pdf_body(html: Column) -> Column:
    return html.startswith("%PDF-")


@F.pandas_udf(StringType())
def pdf_text(content: pd.Series) -> pd.Series:
    """The text of PDF bodies by the machine's pdftotext; null where it is missing or fails."""
    tool = which("pdftotext")

    def run(raw: bytes | None) -> str | None:
        if not tool or raw is None:
            return None
        p = subprocess.run([tool, "-enc", "UTF-8", "-", "-"], input=bytes(raw), capture_output=True, timeout=60, check=False)
        return p.stdout.decode("utf-8", "replace") if p.returncode == 0 else None

    return content.map(run)


@F.pandas_udf(StringType())
def decode_body(content: pd.Series, content_type: pd.Series) -> pd.Series:
    """Bytes in the charset that the content type names, UTF-8 otherwise, lossily."""

    def run(raw: bytes | None, kind: str | None) -> str | None:
        if raw is None:
            return None
        name = (kind or "").lower().partition("charset=")[2].strip(" \"';") or "utf-8"
        try:
            return bytes(raw).decode(name, "replace")
        except LookupError:
            return bytes(raw).decode("utf-8", "replace")

    return pd.Series([run(a, b) for a, b in zip(content, content_type)])


class _Urls(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = [u for u in options.get("urls", "").split() if u]
        self.slices = max(1, int(options.get("parallel", 4)))

    def partitions(self) -> list[InputPartition]:
        return [_Urls(self.urls[i :: self.slices]) for i in range(min(self.slices, max(1, len(self.urls))))]

    def read(self, partition: _Urls) -> Iterator[tuple]:
        from .fetch import request

        for url in partition.urls:
            try:
                f = request(url)
                yield url, f.status, f.html, None
            except Exception as e:  # an error is a row, as one bad page must not fail the others
                yield url, None, None, str(e)[:200]


class PageSource(DataSource):
    """spark.read.format("web_pages").option("urls", "...").load()"""

    @classmethod
    def name(cls) -> str:
        return "web_pages"

    def schema(self) -> str:
        return "url string, status int, html string, error string"

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageSource)


def pdf_result(url: str, text: str, size: str, pages: str):
    """struct of a PDF's result: its text layer, or notes where none was read; pages are told, not applied."""
    body = F.coalesce(F.btrim(F.col(text), F.lit(" \t\n\r\f")), F.lit(""))
    ok = F.length(body) > 20
    unread = F.concat(F.lit("no text extracted from PDF ("), F.col(size).cast("string"), F.lit(" bytes): pdftotext missing, or scanned/image-only PDF"))
    return F.struct(
        ok.alias("content_ok"),
        body.alias("markdown"),
        F.when(~ok, unread).otherwise(F.concat(F.lit("pages="), F.col(pages), F.lit(" not applied; whole PDF text returned"))).alias("note"),
        F.when(~ok, F.lit("install poppler-utils (pdftotext) or use an HTML version of this document")).alias("next_action"),
        F.length(body).alias("total_chars"),
        F.when(ok, 0.6).otherwise(0.2).alias("quality_score"),
    )
