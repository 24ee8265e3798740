"""Joins and lookups: chains, fuzzy addresses, number ranges, dictionaries."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.likeness import Known, one_by_one
from sparkloom.functions.scalars import strip_accents
from sparkloom.functions.text import token_set_ratio


def merge_chain(base: DataFrame, steps: Iterable[tuple[DataFrame, str | list[str], str]]) -> DataFrame:
    """Left-deep chain of equi joins: (frame, key or keys, how) one after another. Every step joins on key columns."""
    return reduce(lambda left, step: left.join(step[0], step[1], step[2]), steps, base)


def merge_report(base: DataFrame, steps: Iterable[tuple[DataFrame, str | list[str], str]]) -> DataFrame:
    """step, rows, change_percent of a chain: a count per step (an action for each)."""
    rows, out, current = base.count(), [], base
    for i, step in enumerate(steps, 1):
        current = merge_chain(current, [step])
        now = current.count()
        out.append((i, now, round((now - rows) / rows * 100, 2) if rows else None))
        rows = now
    return base.sparkSession.createDataFrame(out, "step int, rows long, change_percent double")


def lookup(df: DataFrame, column: str, dictionary: DataFrame, key: str, value: str, keep_unknown: bool = True) -> DataFrame:
    """A column translated by a dictionary frame (one row per key); unknown values stay, or become null."""
    d = dictionary.groupBy(F.col(key).alias("_k")).agg(F.min(value).alias("_v")).filter("_k is not null")
    new = F.coalesce("_v", column) if keep_unknown else F.col("_v")
    return df.join(d, F.col(column) == F.col("_k"), "left").withColumn(column, new).drop("_k", "_v")


def matched_unmatched(df: DataFrame, other: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a partner, rows without), which add up to all rows."""
    keys = other.select(F.col(key).alias("_k")).distinct()
    on = F.col(key) == F.col("_k")
    return df.join(keys, on, "left_semi"), df.join(keys, on, "left_anti")


def street_key(column: Column) -> Column:
    """A street name in comparable form: no accents, lower case, single blanks."""
    return F.trim(F.regexp_replace(strip_accents(column, lower=True), r"[^0-9a-z]+", " "))


def best_known(left: DataFrame, right: DataFrame, column: str, other: str, n: int = 5, scorer=token_set_ratio, block: int = 200_000, rows: int = 40_000) -> DataFrame:
    """a, b, score, rank: the n best known texts of each distinct text, ties by text. Every known text is a candidate.

    Both sides are packed into blocks of distinct texts (``rows`` of one, ``block`` of the other, which is broadcast) that meet pairwise;
    a task scores a pair of blocks and keeps n per text, so nothing but n rows per text and block is shuffled. ``token_set_ratio`` is searched
    for in an index of the block (``likeness.Known``), which leaves out what cannot be among the n best; for any other scorer there is no
    bound and all are scored. The work is the product of the two numbers of distinct texts either way.
    """

    def packed(df: DataFrame, name: str, column: str, size: int, spread: int = 1) -> tuple[DataFrame, int]:
        texts = df.select(F.col(column).alias("t")).distinct().filter("t is not null")
        count = texts.count()
        blocks = max(1, -(-count // size), min(spread, count // 128))  # fewer texts are not worth an index of their own
        blocks = -(-blocks // spread) * spread if blocks > spread else blocks  # as many for each core
        return texts.groupBy(F.pmod(F.xxhash64("t"), F.lit(blocks)).alias(f"_{name}")).agg(F.sort_array(F.collect_list("t")).alias(name)), blocks

    spread = left.sparkSession.sparkContext.defaultParallelism
    wanted, blocks = packed(left, "a", column, rows, spread)
    known, _ = packed(right, "b", other, block)
    pairs = wanted.repartitionById(blocks, F.col("_a").cast("int")).crossJoin(F.broadcast(known)).select("a", "_b", "b")

    indexed = scorer is token_set_ratio

    def run(batches):
        last = index = None
        for batch in batches:
            for texts, number, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if number != last:
                    known = known.as_py()
                    last, index = number, Known(known) if indexed else known
                if indexed:
                    out = index.best(texts, n)
                else:
                    out = (row for a in texts for row in one_by_one(a, index, np.full(len(index), np.inf), n, [], scorer))
                columns = list(zip(*out)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32())], ["a", "b", "score"])

    scored = pairs.mapInArrow(run, "a string, b string, score int")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))).filter(F.col("rank") <= n)


def fuzzy_matching(left: DataFrame, right: DataFrame, column: str, other: str, quality: int = 88, scorer=token_set_ratio) -> DataFrame:
    """a, b, score: for each text that no known one equals, its best known text (ties the smallest).

    Every known text is a candidate. A match is taken when the last word of the text is in the candidate or the score reaches ``quality``. The scorer
    is any Python function of two texts.
    """
    a = left.select(F.col(column).alias("_t")).distinct()
    exact = right.select(F.col(other).alias("_k")).distinct()
    open_ones = a.join(exact, F.col("_t") == F.col("_k"), "left_anti").filter("_t is not null")
    best = best_known(open_ones, right, "_t", other, 1, scorer).drop("rank")
    last = F.element_at(F.split(street_key(F.col("a")), " "), -1)
    return best.filter((F.col("score") >= quality) | F.array_contains(F.split(street_key(F.col("b")), " "), last))


def top_candidates(left: DataFrame, right: DataFrame, column: str, other: str, n: int = 5, scorer=token_set_ratio) -> DataFrame:
    """a, b, score, rank: the n best known texts of each text, ties by text."""
    return best_known(left, right, column, other, n, scorer)


def expand_ranges(ranges: DataFrame, last_number: int = 9999, open_end: int = 2000) -> DataFrame:
    """street, number, station: each number range as single numbers, by its parity; an open end (9999) goes up to ``open_end``.

    ``ranges`` has street, polling_station_id, number_start, number_stop, even_numbers_only, odd_numbers_only (Yes / No). Ranges
    with a null bound or a start beyond the stop give no numbers.
    """
    stop = F.when(F.col("number_stop") == last_number, open_end).otherwise(F.col("number_stop"))
    even, odd = F.lower("even_numbers_only") == "yes", F.lower("odd_numbers_only") == "yes"
    start = F.when(even & (F.col("number_start") % 2 == 1) | odd & (F.col("number_start") % 2 == 0), F.col("number_start") + 1).otherwise(F.col("number_start"))
    made = ranges.select("street", F.col("polling_station_id").alias("station"), start.alias("a"), stop.alias("b"), F.when(even | odd, 2).otherwise(1).alias("s")).filter("a <= b")
    return made.select("street", F.explode(F.sequence("a", "b", "s")).alias("number"), "station")


def redistrict(addresses: DataFrame, ranges: DataFrame, street: str = "street", number: str = "number", station: str = "station", **bounds: int) -> DataFrame:
    """Addresses in streets of more than one station get the station of their number range; the others keep theirs.

    Overlapping ranges give the smallest station.
    """
    several = ranges.groupBy("street").agg(F.countDistinct("polling_station_id").alias("n")).filter("n > 1").select("street")
    numbers = expand_ranges(ranges.join(several, "street", "left_semi"), **bounds).groupBy("street", "number").agg(F.min("station").alias("_s"))
    numbers = numbers.select(F.col("street").alias("_street"), F.col("number").alias("_number"), "_s")
    out = addresses.join(numbers, (F.col(street) == F.col("_street")) & (F.col(number) == F.col("_number")), "left")
    return out.withColumn(station, F.coalesce("_s", station)).drop("_s", "_street", "_number")


def geocoded_table(df: DataFrame, pattern: str, station: str, street: str, number: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """addresses, place_uid, lat, lon: upper-case address with its number if it has one, station id padded to three digits.

    Rows without valid coordinates (both above zero, lat above lon) are dropped.
    """
    name = F.upper(F.when(F.col(number).isNotNull(), F.concat_ws(" ", F.col(number).cast("string"), F.col(street))).otherwise(F.col(street)))
    uid = F.concat(F.lit(pattern), F.lpad(F.col(station).cast("string"), 3, "0"))
    return df.select(name.alias("addresses"), uid.alias("place_uid"), F.col(lat).alias("lat"), F.col(lon).alias("lon")).filter("lat > 0 and lon > 0 and lat > lon")


def complete_merge(matched: DataFrame, fallback: DataFrame, order: list[Column]) -> DataFrame:
    """Matched and fallback rows united by name, one row per (lat, lon), the first in the stated order."""
    both = matched.unionByName(fallback, allowMissingColumns=True)
    columns = both.columns
    keep = F.min_by(F.struct(*columns), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return both.groupBy("lat", "lon").agg(keep.alias("_r")).select("_r.*")


def geocoding_ratio(all_addresses: DataFrame, missing: DataFrame, column: str) -> DataFrame:
    """One row: percent of distinct addresses that were found, one decimal."""
    a = all_addresses.agg(F.countDistinct(column).alias("a"))
    m = missing.agg(F.countDistinct(column).alias("m"))
    return a.join(F.broadcast(m)).select(F.round((1 - F.try_divide(F.col("m").cast("double"), F.col("a"))) * 100, 1).alias("ratio"))
