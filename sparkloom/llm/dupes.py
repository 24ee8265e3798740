"""Duplicates hidden by formatting: commutative multiset fingerprints, then verification by equality.

Canonical form of a text: HTML entities resolved, NFC, lower case, and of that only letters and digits in
order, a point between two digits, and a run of ``+`` / ``#`` straight after a letter. The ``<li>`` items of
a text form a multiset. A field contributes hash(class, text); fields of one class are interchangeable. The
contributions are combined by addition modulo 2^64 in two independent lanes, which needs no order.

Rows are grouped by the 128-bit fingerprint; only rows of groups with two or more members are then read
again and compared with the group's first row, field by field as multisets by counting, without sorting. Those that differ from it
are grouped again among themselves.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.session import materialise

_ITEM = re.compile(r"<\s*li\b[^>]*>(.*?)(?:<\s*/\s*li\s*>|(?=<\s*li\b)|(?=<\s*/\s*[uo]l\b)|\Z)", re.S)
_NOISE = re.compile(r"(?<=[^\W\d_])([+#]+)|(?<=\d)(\.)(?=\d)|[\W_]+")
_ASCII_NOISE = re.compile(r"(?<=[a-z])([+#]+)|(?<=[0-9])(\.)(?=[0-9])|[^a-z0-9]+")
_MASK = (1 << 64) - 1
_LANES = (0x51_7C_C1, 0x27_22_0A)


def _keep(match: re.Match) -> str:
    return match.group(1) or match.group(2) or ""


def bare(text: str) -> str:
    """Letters and digits of a text that is already lower-cased, with the points and signs that count."""
    if text.isascii():
        return _ASCII_NOISE.sub(_keep, text)
    return _NOISE.sub(_keep, text)


def canonical(text: str) -> tuple[str, Counter]:
    """(text outside list items, multiset of list items)."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    text = text.lower()
    if "<" not in text or "li" not in text:
        return bare(text), Counter()
    items = Counter()

    def take(match: re.Match) -> str:
        items[bare(match.group(1))] += 1
        return "<li>"

    return bare(_ITEM.sub(take, text)), items


def _lane(value: str, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(value.encode("utf-8", "surrogatepass"), seed)


def fingerprint(values: Sequence[str], kinds: Sequence[str]) -> tuple[int, int]:
    """128-bit multiset hash of a row: both lanes are sums over the fields."""
    lanes = [0, 0]
    for value, kind in zip(values, kinds):
        rest, items = canonical(value)
        for i, seed in enumerate(_LANES):
            total = sum(_lane(item, seed ^ 0xA5) * times for item, times in items.items()) & _MASK
            lanes[i] += _lane(f"{kind}\x00{len(items)}\x00{total:x}\x00{rest}", seed)
    return tuple((x & _MASK) - (1 << 64) if (x & _MASK) >> 63 else x & _MASK for x in lanes)


def same_fields(left: Sequence[str], right: Sequence[str], kinds: Sequence[str]) -> bool:
    """Equality of two rows as multisets of (kind, text), without sorting: every field takes an equal partner."""
    free = [(k, *canonical(v)) for k, v in zip(kinds, right)]
    for kind, value in zip(kinds, left):
        rest, items = canonical(value)
        for at, other in enumerate(free):
            if other == (kind, rest, items):
                free.pop(at)
                break
        else:
            return False
    return not free


def _fingerprints(kinds: Sequence[str], texts: bool = False):
    """(id, h1, h2) of rows (id, fields), and the fields beside them if asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(1, batch.num_columns)]
            made = [fingerprint(values, kinds) for values in zip(*columns)]
            more = batch.columns[1:] if texts else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in made], pa.int64()), pa.array([b for _, b in made], pa.int64()), *more], ["id", "h1", "h2", *batch.schema.names[1 : 1 + len(more)]])

    return run


def _verified(kinds: Sequence[str]):
    n = len(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(2, 2 + 2 * n)]
            same = [same_fields(row[:n], row[n:], kinds) for row in zip(*columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.bool_())], ["id", "rep", "same"])

    return run


def _read(rows: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """id and the compared fields f0, f1, ... of the rows that take part."""
    return rows.select(F.col(id_col).cast("long").alias("id"), *[F.col(c).alias(f"f{i}") for i, c in enumerate(columns)]).na.drop("any")


def duplicate_groups(rows: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
    """id, h1, h2, rep, copies of every record whose fingerprint (h1, h2) another one shares.

    ``fields`` maps each compared column to its class; columns of one class are interchangeable. rep is the
    smallest id of the group, copies the number of distinct ids in it. Rows with a null id or a null field
    take no part; rows of the same id are one record: that of its texts counts whose fingerprint is smallest.
    Empty texts are texts. Ids are integers.

    A group that holds a third of all rows is one row of the grouped table, by partial aggregation.
    """
    marks = _read(rows, id_col, list(fields)).mapInArrow(_fingerprints(list(fields.values())), "id long, h1 long, h2 long")
    marks = materialise(marks.groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("h")).select("id", "h.h1", "h.h2"), "fingerprints")
    return materialise(_grouped(marks), "members")


def _grouped(marks: DataFrame) -> DataFrame:
    groups = marks.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return marks.join(groups, ["h1", "h2"]).select("id", "h1", "h2", "rep", "copies")


def member_texts(rows: DataFrame, members: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
    """id, f0, f1, ...: one text of every member, of those that have the fingerprint it was grouped by (the smallest in byte order)."""
    columns, kinds = list(fields), list(fields.values())
    raw = _read(rows, id_col, columns).join(members.select("id"), "id", "left_semi")
    texts = F.struct(*[f"f{i}" for i in range(len(columns))])
    one = raw.groupBy("id").agg(F.min(texts).alias("t"), F.max(texts).alias("u"))
    plain = one.filter("t = u").select("id", "t.*")  # most have one text
    several = raw.join(one.filter("t <> u").select("id"), "id", "left_semi")
    # of ids with several texts the fingerprints are made again, to find the one that counts
    marked = several.distinct().mapInArrow(_fingerprints(kinds, True), "id long, h1 long, h2 long, " + ", ".join(f"f{i} string" for i in range(len(columns))))
    chosen = marked.join(members.select("id", "h1", "h2"), ["id", "h1", "h2"]).groupBy("id").agg(F.min(texts).alias("t")).select("id", "t.*")
    return plain.unionAll(chosen)


def verify_groups(texts: DataFrame, members: DataFrame, kinds: Sequence[str], per_salt: int = 10_000) -> DataFrame:
    """id, rep, same: every member but the first compared with its group's first record by field equality.

    Members join their own text on their id; the texts of the first
    records go to one salted copy per ``per_salt`` members, so no task takes a whole hot group.
    """
    n = len(kinds)
    own = texts.join(members, "id")
    spread = F.floor(F.col("copies") / per_salt) + 1
    salted = own.withColumn("salt", F.pmod(F.col("id"), spread.cast("long")))
    reps = own.filter("id = rep").select("rep", F.explode(F.sequence(F.lit(0).cast("long"), (spread - 1).cast("long"))).alias("salt"), *[F.col(f"f{i}").alias(f"r{i}") for i in range(n)])
    pairs = salted.filter("id <> rep").join(reps, ["rep", "salt"])
    return pairs.select("id", "rep", *[f"f{i}" for i in range(n)], *[f"r{i}" for i in range(n)]).mapInArrow(_verified(kinds), "id long, rep long, same boolean")


def hidden_duplicates(rows: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
    """id, rep of every record that equals one with a smaller id; rep is the smallest id of its group.

    Records whose fingerprint is shared but whose fields differ from the first of their group (a hash collision) are grouped among
    themselves again, until every record equals its first or is alone: a collision neither makes nor loses a link.
    """
    members = duplicate_groups(rows, id_col, fields)
    out = None
    while True:
        texts = member_texts(rows, members, id_col, fields)
        checked = materialise(verify_groups(texts, members, list(fields.values())), "checked")
        found = checked.filter("same").select("id", "rep")
        out = found if out is None else out.unionAll(found)
        odd = checked.filter("not same").select("id")
        if odd.isEmpty():
            return out
        members = materialise(_grouped(members.join(odd, "id", "left_semi").select("id", "h1", "h2")), "members")


def collapse_duplicates(rows: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
    """One row per distinct record: id (the smallest of its group), copies (the number of ids it stands for).

    Records with a null field take no part in the comparison and are left out; an empty input gives no rows.
    """
    found = materialise(hidden_duplicates(rows, id_col, fields), "duplicates")
    taking = rows.na.drop("any", subset=list(fields)).select(F.col(id_col).cast("long").alias("id")).filter("id is not null")
    extra = found.groupBy(F.col("rep").alias("id")).agg(F.count(F.lit(1)).alias("extra"))
    firsts = taking.distinct().join(found.select("id"), "id", "left_anti")
    return firsts.join(extra, "id", "left").select("id", (F.coalesce("extra", F.lit(0)) + 1).alias("copies"))
