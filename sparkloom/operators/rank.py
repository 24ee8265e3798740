"""Ordered analytics over small results: cumulative importance, thresholds, elbows, top-n.

The frames here have one row per feature, class or component; the windows without a partition are over those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def features_importance(df: DataFrame, label: str, coefficient: str, absolute: bool = False, non_zero: bool = False) -> DataFrame:
    """label, coefficient, share, cumulative, rank: by falling coefficient, ties by label."""
    c = F.abs(coefficient) if absolute else F.col(coefficient)
    out = df.select(F.col(label).alias("label"), c.alias("coefficient"))
    out = out.filter(F.col("coefficient") != 0) if non_zero else out
    order = Window.orderBy(F.desc("coefficient"), "label")
    share = F.try_divide(F.col("coefficient").cast("double"), F.sum("coefficient").over(Window.partitionBy()))
    return out.withColumn("share", share).withColumn("cumulative", F.sum("share").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rank", F.row_number().over(order))


def rank_beyond(df: DataFrame, threshold: float = 0.9, cumulative: str = "cumulative", rank: str = "rank") -> DataFrame:
    """One row: the first rank whose cumulative share is above the threshold (null if none is)."""
    return df.agg(F.min(F.when(F.col(cumulative) > threshold, F.col(rank))).alias("rank"))


def first_ranks(df: DataFrame, threshold: float = 0.9) -> DataFrame:
    """The features up to the first rank beyond the threshold."""
    return df.join(F.broadcast(rank_beyond(df, threshold).withColumnRenamed("rank", "_last"))).filter("rank <= _last").drop("_last")


def top_n(df: DataFrame, column: str, n: int, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(column), *ties).limit(n)


def importance_ratio(df: DataFrame, n: int) -> DataFrame:
    """One row: the share of the first n features (percent, rounded 2)."""
    return df.agg(F.round(F.try_divide(F.sum(F.when(F.col("rank") <= n, F.col("coefficient"))) * 100.0, F.sum("coefficient")), 2).alias("ratio"))


def farthest_rows(df: DataFrame, distances: dict[int, Column], n: int = 50, tie: str = "id") -> DataFrame:
    """For every cluster the n rows farthest from its centre, of all rows, with rank. A top-k per task precedes the shuffle."""
    long = df.select("*", F.explode(F.array(*[F.struct(F.lit(c).alias("centre"), d.alias("distance")) for c, d in distances.items()])).alias("_d")).select(*df.columns, "_d.*")
    window = Window.partitionBy("centre").orderBy(F.desc("distance"), tie)
    return long.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= n)


def elbow(df: DataFrame, order: str, inertia: str, quantile: float | None = 0.25) -> DataFrame:
    """One row: position (from 1, plus 1) of the elbow of a curve.

    Changes are absolute percent changes of the cumulative inertia from one row to the next. With a quantile: the first
    position whose change is at or below that quantile of all changes; without: the position of the smallest change.
    """
    w = Window.orderBy(order)
    cumulative = F.sum(inertia).over(w.rowsBetween(Window.unboundedPreceding, 0))
    steps = df.withColumn("_c", cumulative).withColumn("_b", F.lag("_c").over(w)).withColumn("_p", F.row_number().over(w) - 1)
    steps = steps.withColumn("_d", F.abs(F.try_divide((F.col("_c") - F.col("_b")) * 100.0, F.col("_b")))).filter("_d is not null")
    if quantile is None:
        return steps.agg((F.min_by("_p", F.struct("_d", "_p")) + 1).cast("long").alias("position"))
    cut = steps.agg(F.percentile("_d", quantile).alias("_q"))
    return steps.join(F.broadcast(cut)).agg((F.min(F.when(F.col("_d") <= F.col("_q"), F.col("_p"))) + 1).cast("long").alias("position"))


def kaiser(df: DataFrame, ratio: str) -> DataFrame:
    """One row: the number of components whose explained share is above 1 / p."""
    return df.agg(F.collect_list(ratio).alias("r")).select(F.expr("size(filter(r, x -> x > 1.0 / size(r)))").cast("long").alias("components"))


def decision_index(df: DataFrame, index: str, rate: str, threshold: str, limit: float) -> DataFrame:
    """One row: the first index whose rate is above the limit, and its decision threshold."""
    hit = F.when(F.col(rate) > limit, F.struct(F.col(index).alias("index"), F.col(threshold).alias("threshold")))
    return df.agg(F.min(hit).alias("h")).select("h.index", "h.threshold")


def length_distribution(df: DataFrame, tokens: Column) -> DataFrame:
    """size, n, cumulative share of rows by number of tokens."""
    counts = df.groupBy(F.size(tokens).cast("long").alias("size")).agg(F.count(F.lit(1)).alias("n")).filter("size >= 0")
    w = Window.orderBy("size")
    return counts.withColumn("cumulative", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(Window.partitionBy()))


def token_frequency(df: DataFrame, tokens: Column, n: int, least: bool = False) -> DataFrame:
    """token, n, percent of all tokens: the n most (or least) frequent, ties by token."""
    counts = df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    out = counts.join(F.broadcast(total)).withColumn("percent", F.round(F.col("n") * 100.0 / F.col("_t"), 4)).drop("_t")
    return out.orderBy(F.asc("n") if least else F.desc("n"), "token").limit(n)
