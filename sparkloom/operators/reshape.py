"""Reshaping, encoding, binning, splitting and set differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.quantiles import column_quantiles

MAX_VALUES = 1000


def indicators(df: DataFrame, column: str, drop: bool = True, prefix: bool = False) -> DataFrame:
    """One 0/1 column per distinct value (null has none), named by the value. ValueError above MAX_VALUES distinct values."""
    values = [r[0] for r in df.select(column).distinct().filter(F.col(column).isNotNull()).limit(MAX_VALUES + 1).collect()]
    if len(values) > MAX_VALUES:
        raise ValueError(f"{column} has more than {MAX_VALUES} values")
    made = [F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{column}_{v}" if prefix else str(v)) for v in sorted(values)]
    return df.select(*[c for c in df.columns if not (drop and c == column)], *made)


def difference(a: DataFrame, b: DataFrame | None, key: str, distinct: bool = True) -> DataFrame:
    """Keys of a that b has not (all of a without b)."""
    left = a.select(key).distinct() if distinct else a.select(key)
    return left if b is None else left.join(b.select(F.col(key).alias("_k")).distinct(), F.col(key).eqNullSafe(F.col("_k")), "left_anti")


def with_row_number(df: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """Numbers rows from 0 in a stated total order, without sending all rows to one task.

    Rows are range-partitioned by the order; each partition is numbered on its own and shifted by the sizes of those before it.
    """
    parts = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    sizes = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    shift = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))  # one row per partition
    inner = Window.partitionBy("_p").orderBy(*order)
    return parts.withColumn("_i", F.row_number().over(inner) - 1).join(F.broadcast(shift), "_p").withColumn(name, F.col("_i") + F.col("_s")).drop("_p", "_i", "_s")


def quantile_bins(df: DataFrame, column: str, bins: int, labels: list[str] | None = None, name: str = "bin") -> DataFrame:
    """Adds the bin of a value among exact quantiles: left open, right closed, the minimum in the first; equal values share a bin.

    Labels, or the edges as text "left-right". Equal edges make their bin empty. Nulls have no bin.
    """
    cuts = column_quantiles(df, {"_q": F.col(column)}, [i / bins for i in range(bins + 1)])
    out = df.join(F.broadcast(cuts))  # one row
    label: Column = F.lit(None).cast("string")
    for i in range(bins - 1, -1, -1):
        text = F.lit(labels[i]) if labels else F.concat(F.round(F.col("_q")[i], 2).cast("string"), F.lit("-"), F.round(F.col("_q")[i + 1], 2).cast("string"))
        label = F.when(F.col(column) <= F.col("_q")[i + 1], text).otherwise(label)
    return out.withColumn(name, label).drop("_q")


def transpose(df: DataFrame, key: str, keys: list[str]) -> DataFrame:
    """Rows become columns: one row per former column, one column per key value (given, so that the order is stable)."""
    values = [c for c in df.columns if c != key]
    long = df.unpivot([key], values, "variable", "value")
    return long.groupBy("variable").pivot(key, keys).agg(F.first("value"))


def stratified_split(df: DataFrame, label: str | None, key: str, test_share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash of the key: the same rows in every run; with a label each class is split by itself to the nearest row.

    Without a label the share is met on average. With one, rows are ranked within a class by hash; a hot class is one sorted
    partition, which spills but does not grow beyond it.
    """
    drawn = F.xxhash64(F.col(key), F.lit(seed))
    if label is None:
        mark = F.pmod(drawn, F.lit(1 << 30)) < int(test_share * (1 << 30))
        return df.filter(~mark), df.filter(mark)
    w = Window.partitionBy(label)
    ranked = df.withColumn("_r", F.row_number().over(w.orderBy(drawn, key))).withColumn("_n", F.count(F.lit(1)).over(w))
    mark = F.col("_r") <= F.round(F.col("_n") * test_share)
    return ranked.filter(~mark).drop("_r", "_n"), ranked.filter(mark).drop("_r", "_n")


def shares_complete(df: DataFrame, parts: list[str], total: str, precision: int = 1) -> DataFrame:
    """Each part in percent of the total, their sum, and whether it is 100."""
    out = df.select("*", *[F.round(F.try_divide(F.col(c) * 100.0, F.col(total)), precision).alias(f"{c}_share") for c in parts])
    whole = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"{c}_share"), F.lit(0.0)) for c in parts])
    return out.withColumn("share_sum", F.round(whole, precision)).withColumn("complete", F.round(whole, 0) == 100)


def labels_until_share(df: DataFrame, label: str, share: float = 0.1) -> DataFrame:
    """The most frequent labels until so large a share of rows is reached, with n and cumulative share."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.desc("n"), label)  # one row per label
    out = counts.withColumn("cumulative", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(Window.partitionBy()))
    return out.filter(F.col("cumulative") <= share)
