"""Uploads: zip members, delimiter and encoding detection, one frame for all towns."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DELIMITERS = (",", ";", "\t")


def detect_delimiter(text: Column) -> Column:
    """The most frequent of comma, semicolon and tab in a text; ties and none: the first of them."""
    counts = [F.length(text) - F.length(F.replace(text, F.lit(d), F.lit(""))) for d in DELIMITERS]
    most = F.greatest(*counts)
    out = F.lit(DELIMITERS[-1])
    for d, n in list(zip(DELIMITERS, counts))[-2::-1]:
        out = F.when(n == most, d).otherwise(out)
    return F.when(text.isNotNull(), out)


def detect_encoding(data: bytes) -> str:
    """utf-8, utf-8-sig, utf-16 or, where the bytes are none of them, cp1252."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16"
    if data[:3] == b"\xef\xbb\xbf":
        return "utf-8-sig"
    try:
        data.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        return "cp1252"


def delimiter_of(text: str) -> str:
    return max(DELIMITERS, key=text.count)


def _table_rows(name: str, data: bytes) -> Iterator[tuple[str, int, dict]]:
    text = data.decode(detect_encoding(data), "replace")
    for i, row in enumerate(csv.DictReader(io.StringIO(text), delimiter=delimiter_of(text))):
        yield name, i, {k: v for k, v in row.items() if k is not None and isinstance(v, str)}


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch.path, batch.content):
            found = []
            if path.lower().endswith(".zip"):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in archive.namelist():
                        if member.lower().endswith((".csv", ".txt")):
                            found = list(_table_rows(member, archive.read(member)))
                            yield pd.DataFrame(found, columns=["member", "line", "fields"])
            else:
                found = list(_table_rows(path.rsplit("/", 1)[-1], content))
                yield pd.DataFrame(found, columns=["member", "line", "fields"])


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """member, line, fields (map of text) of every CSV or text file below a path, also of those inside zip files.

    Encoding and delimiter are found per file. Every file is one task's work, as large as a file. Spreadsheets are not read.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content").filter(F.lower("path").rlike(r"\.(zip|csv|txt)$"))
    return files.mapInPandas(_members, "member string, line int, fields map<string,string>")


def labels_from_paths(spark: SparkSession, path: str, pattern: str = r"-([^/]+)/[^/]+$") -> DataFrame:
    """path, label of files below a folder: the label is the part of the folder's name that the pattern takes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.nullif(F.regexp_extract("path", pattern, 1), F.lit("")).alias("label"))
