"""Files as tables: scans, fingerprints, decoding, and conversion of text formats to Markdown behind a pluggable reader.

A file that cannot be read gives a row with an error instead of ending the job. Hidden files and folders, lock files and excluded
folders are left out of a scan.
"""

from __future__ import annotations

import codecs
import csv
import io
from collections.abc import Callable, Iterable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from folio.sources.html import html_to_markdown
from folio.sources.rtf import rtf_to_markdown

#: Kinds by extension. Fixed values.
KINDS = {"txt": "text", "md": "text", "markdown": "text", "csv": "table", "html": "html", "htm": "html", "rtf": "rtf", "pdf": "pdf", "png": "image", "jpg": "image", "jpeg": "image", "tif": "image", "tiff": "image", "docx": "office", "xlsx": "office", "pptx": "office"}


class Reader(Protocol):
    """Reads what text formats cannot give: pages of a PDF, an image, an office file."""

    def read(self, path: str, content: bytes) -> str: ...


def scan(spark: SparkSession, root: str, exclude: Iterable[str] = ()) -> DataFrame:
    """(path, name, ext, kind, modified, bytes, content) below a folder; kind is null for extensions that are not supported."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace("path", "^.*?" + _quoted(root.rstrip("/")) + "/", "")
    hidden = rel.rlike(r"(^|/)([.]|~\$)")
    for folder in exclude:
        hidden = hidden | rel.startswith(folder.strip("/") + "/")
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.coalesce(*(F.when(ext == e, k) for e, k in KINDS.items()))
    return rows.filter(~hidden).select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), ext.alias("ext"), kind.alias("kind"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"), "content")


def _quoted(text: str) -> str:
    import re

    return re.escape(text.split("://", 1)[-1].split(":", 1)[-1])


def fingerprints(files: DataFrame) -> DataFrame:
    return files.withColumn("sha256", F.sha2("content", 256))


def decode(data: bytes) -> str:
    """By byte-order mark, else UTF-8, else the western code page."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


def csv_to_markdown(text: str) -> str:
    rows = [[c.strip().replace("|", "\\|").replace("\n", " ") for c in r] for r in csv.reader(io.StringIO(text)) if r]
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join([*r, *[""] * (width - len(r))]) + " |" for r in rows]
    return "\n".join([lines[0], "|" + "---|" * width, *lines[1:]])


CONVERTERS: dict[str, Callable[[bytes], str]] = {"text": decode, "table": lambda b: csv_to_markdown(decode(b)), "html": lambda b: html_to_markdown(decode(b)), "rtf": rtf_to_markdown}


def convert(files: DataFrame, reader: Reader | None = None) -> DataFrame:
    """(path, md, error): Markdown of each file; formats without a built-in converter go to the reader."""

    def run(batches):
        for pdf in batches:
            out = []
            for path, kind, content in zip(pdf["path"], pdf["kind"], pdf["content"]):
                try:
                    if kind in CONVERTERS:
                        out.append((path, CONVERTERS[kind](bytes(content)), None))
                    elif reader is not None and kind is not None:
                        out.append((path, reader.read(path, bytes(content)), None))
                    else:
                        out.append((path, None, "no reader for this format"))
                except Exception as e:  # noqa: BLE001 - one file must not end the job
                    out.append((path, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(out, columns=["path", "md", "error"])

    return files.select("path", "kind", "content").mapInPandas(run, "path string, md string, error string")


def labelled_queries(spark: SparkSession, path: str) -> DataFrame:
    """(line, query, relevant, error) of JSON lines; '#' begins a comment, relevant defaults to none, broken lines keep their place."""
    schema = "query string, relevant array<struct<file:string,page:string>>"
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("i", "t")).filter(~F.col("t").rlike(r"^\s*(#|$)"))
    parsed = rows.select((F.col("i") + 1).alias("line"), F.from_json("t", schema).alias("q"))
    return parsed.select("line", "q.query", F.coalesce("q.relevant", F.array().cast("array<struct<file:string,page:string>>")).alias("relevant"), F.when(F.col("q.query").isNull(), "not a query").alias("error"))
