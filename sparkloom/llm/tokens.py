"""Turning tag text into terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.html import resolve_entities

TAG_PATTERN = r"[\p{L}\p{N}+#.\-_]+"


def split_terms(text: Column, pattern: str = TAG_PATTERN) -> Column:
    """The terms of a text in any notation: runs of the pattern, lower-cased, after HTML entities are resolved.

    Null gives null; a text without a run gives an empty array.
    """
    return F.regexp_extract_all(F.lower(resolve_entities(text)), F.lit(pattern), F.lit(0))


def tag_rows(questions: DataFrame, record: str = "Id", tags: str = "Tags") -> DataFrame:
    """(record, terms) of each delivered row; rows without a record id or without tags are left out."""
    rows = questions.select(F.col(record).alias("record"), F.col(tags).alias("text")).filter("record is not null and text is not null")
    return rows.select("record", split_terms(F.col("text")).alias("terms")).filter(F.size("terms") > 0)
