"""Exact quantiles without one task that holds every distinct value.

Values are counted first. Approximate cut points, one mergeable sketch per key, split the distinct values of a key into buckets of
about equal size; the rows of every bucket are added up, which tells the buckets that hold a wanted rank. Only those are sorted, each
by itself, and the wanted ranks are read off. A sort spills to disk, so neither the number of rows nor of distinct values is bounded.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 128


def quantiles(df: DataFrame, key: str | Column, value: str | Column, probabilities: Sequence[float], buckets: int = BUCKETS) -> DataFrame:
    """key, q (array of the exact quantiles, linear between neighbours) of every key; null keys and values are left out.

    Keys are few (categories, column names): the cut points and bucket totals of all keys are kept together.
    """
    key, value = (F.col(c) if isinstance(c, str) else c for c in (key, value))
    rows = df.select(key.alias("_k"), value.cast("double").alias("_x")).filter("_k is not null and _x is not null")
    counts = rows.groupBy("_k", "_x").agg(F.count(F.lit(1)).alias("_n"))
    cuts = counts.groupBy("_k").agg(F.percentile_approx("_x", [i / buckets for i in range(1, buckets)], 20 * buckets).alias("_cuts"))
    placed = _bucketed(counts.join(cuts, "_k"), buckets - 1)
    of_key = Window.partitionBy("_k")  # one row per bucket
    totals = placed.groupBy("_k", "_b").agg(F.sum("_n").alias("_m"))
    totals = totals.withColumn("_start", F.sum("_m").over(of_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_m"))
    position = F.array(*[F.lit(float(p)) for p in probabilities])
    totals = totals.withColumn("_at", F.transform(position, lambda p: p * (F.sum("_m").over(of_key) - 1).cast("double")))
    ranks = F.flatten(F.transform("_at", lambda p: F.array(F.floor(p), F.ceil(p))))
    wanted = totals.filter(F.exists(ranks, lambda r: (r >= F.col("_start")) & (r < F.col("_start") + F.col("_m"))))
    inside = Window.partitionBy("_k", "_b").orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = placed.join(wanted, ["_k", "_b"]).withColumn("_to", F.sum("_n").over(inside) + F.col("_start"))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank < F.col("_to")) & (rank >= F.col("_to") - F.col("_n")), F.col("_x")))

    made = []
    for i in range(len(probabilities)):
        p = F.col("_at")[i]
        made.append(F.struct(F.max(p).alias("p"), at(F.floor(p)).alias("lo"), at(F.ceil(p)).alias("hi")))
    out = ranked.groupBy("_k").agg(F.array(*made).alias("_e"))
    line = F.transform("_e", lambda e: F.when(e["lo"] == e["hi"], e["lo"]).otherwise((F.ceil(e["p"]) - e["p"]) * e["lo"] + (e["p"] - F.floor(e["p"])) * e["hi"]))
    return out.select(F.col("_k").alias("key"), line.alias("q"))


def _bucketed(df: DataFrame, n: int) -> DataFrame:
    """_k, _x, _n and _b, the number of the n sorted cuts that are below _x: every sixteenth first, then the ones between."""
    x, step = F.col("_x"), 16
    coarse = sum((F.when(F.col("_cuts")[i] < x, step).otherwise(0) for i in range(step - 1, n, step)), F.lit(0))
    fine = sum((F.when(F.get("_cuts", F.col("_s") + i) < x, 1).otherwise(0) for i in range(step - 1)), F.lit(0))  # beyond the last cut is null
    return df.withColumn("_s", coarse).select("_k", "_x", "_n", (F.col("_s") + fine).alias("_b"))


def columns_long(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """name, x: the values of several columns under each other, in one pass."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.cast("double").alias("x")) for n, c in columns.items()])).alias("_e")).select("_e.*")


def column_quantiles(df: DataFrame, columns: Mapping[str, Column], probabilities: Sequence[float]) -> DataFrame:
    """One row with an array of quantiles for each named column (null where a column has no value)."""
    found = quantiles(columns_long(df, columns), "name", "x", probabilities)
    return found.agg(*[F.max(F.when(F.col("key") == n, F.col("q"))).alias(n) for n in columns])
