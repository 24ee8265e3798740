"""Frequency of every distinct term, by last-seen counters.

Terms are hash-partitioned and each partition is ordered by record. One pass keeps, per term, its
occurrences, its records and the last record it was seen in: a record counts only when it differs from
the last one. No set of records is ever held, so state is one counter row per distinct term of a
partition, whatever the number of records; above a number of terms all counters are emitted between two records.

Hot terms: the partition key is (term, salt), the salt a hash of the record, with as many salts as partitions, so a term that a
third of all records hold is spread over all of them; a term of few records has as few partial counters. A record lies in one salt only, so the partial counts of the
salts are of disjoint records and their sum is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLUSH = 1_000_000  # distinct terms that a task holds before it emits its counters


class _Counters:
    """Occurrences, records and last record of each term of a task."""

    def __init__(self) -> None:
        self.index: dict = {}
        self.last: list = []
        self.occurrences = np.zeros(1024, np.int64)
        self.records = np.zeros(1024, np.int64)

    def add(self, terms: pa.Array, ids: pa.Array) -> None:
        """Counts (term, record) rows that are ordered by record."""
        terms, ids = terms.dictionary_encode(), ids.dictionary_encode()
        names, values = terms.dictionary.to_pylist(), ids.dictionary.to_pylist()
        for name in names:
            if name not in self.index:
                self.index[name] = len(self.index)
                self.last.append(None)
        while len(self.index) > len(self.occurrences):
            self.occurrences, self.records = (np.concatenate([a, np.zeros(len(a), np.int64)]) for a in (self.occurrences, self.records))
        slot = np.fromiter((self.index[n] for n in names), np.int64, len(names))
        code, record = terms.indices.to_numpy(), ids.indices.to_numpy()
        order = np.argsort(code, kind="stable")  # rows of a term stay ordered by record
        code, record = code[order], record[order]
        first = np.r_[True, code[1:] != code[:-1]]
        new = first | np.r_[True, record[1:] != record[:-1]]
        for at in np.flatnonzero(first):
            seen = self.last[slot[code[at]]]
            new[at] = seen is None or seen != values[record[at]]
        for at in np.flatnonzero(np.r_[first[1:], True]):
            self.last[slot[code[at]]] = values[record[at]]
        np.add.at(self.occurrences, slot[code], 1)
        np.add.at(self.records, slot[code], new.astype(np.int64))

    def drain(self) -> Iterator[pa.RecordBatch]:
        names = list(self.index)
        for at in range(0, len(names), 20_000):
            to = min(len(names), at + 20_000)
            yield pa.RecordBatch.from_arrays([pa.array(names[at:to], pa.string()), pa.array(self.occurrences[at:to]), pa.array(self.records[at:to])], ["term", "occurrences", "records"])
        self.__init__()


def _last_seen(flush: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, before = _Counters(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            terms, ids = batch.column(0), batch.column(1)
            if len(counters.index) > flush:
                # between two records all counters can go: no later row belongs to a record that was counted
                same = np.flatnonzero(np.array(ids.to_pylist(), object) != before)
                cut = int(same[0]) if len(same) else len(ids)
                if cut:
                    counters.add(terms[:cut], ids[:cut])
                if cut < len(ids):
                    yield from counters.drain()
                terms, ids = terms[cut:], ids[cut:]
            if len(ids):
                counters.add(terms, ids)
                before = ids[-1].as_py()
        yield from counters.drain()

    return run


def term_frequencies(rows: DataFrame, record: str = "record", terms: str = "terms", salts: int | None = None, flush: int = FLUSH) -> DataFrame:
    """term, occurrences, records of every distinct term.

    ``rows`` holds a record id and an array of terms; a record may come in several rows. Occurrences count
    every time a term stands in a delivered row, records count distinct ids. Null records, null or empty
    arrays and null terms count nothing; an empty input gives no rows. Empty strings are terms.
    ``salts`` is the number of parts a term's records are dealt to, by default as many as there are shuffle partitions.
    """
    salts = salts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = rows.select(F.col(record).alias("record"), F.explode(F.col(terms)).alias("term")).filter("record is not null and term is not null")
    salted = one.withColumn("salt", F.pmod(F.xxhash64("record"), F.lit(salts)))
    parted = salted.repartition("term", "salt").sortWithinPartitions("record").select("term", "record")
    partial = parted.mapInArrow(_last_seen(flush), "term string, occurrences long, records long")
    return partial.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def mark_terms(frequencies: DataFrame, total: DataFrame, rare_below: int = 5, common_share: float = 0.1) -> DataFrame:
    """Adds ``mark``: rare (fewer records than ``rare_below``), common (more than ``common_share`` of all records), else null.

    ``total`` is a one-row frame with the column ``n``, the number of records with any term; its size is fixed.
    """
    joined = frequencies.crossJoin(F.broadcast(total))
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.col("n") * F.lit(common_share), "common")
    return joined.withColumn("mark", mark).drop("n")


def count_records(rows: DataFrame, record: str = "record") -> DataFrame:
    """One row: the number ``n`` of distinct records."""
    return rows.select(record).distinct().agg(F.count(F.lit(1)).alias("n"))
