"""Profiling: measures, dispersion, shape, counts, histograms, box plots, time series."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.quantiles import column_quantiles, columns_long, quantiles


def measures(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """column, count, mean, std (n - 1), min, q1, median, q3 (exact, linear), max of numeric columns, from one pass over the rows."""
    long = columns_long(df, {c: F.col(f"`{c}`") for c in columns})
    x = F.col("x")
    plain = long.groupBy(F.col("name").alias("column")).agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    cuts = quantiles(long, "name", "x", [0.25, 0.5, 0.75]).withColumnRenamed("key", "column")
    q = F.col("q")
    return plain.join(cuts, "column", "left").select("column", "count", "mean", "std", "min", q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"), "max")


def text_measures(df: DataFrame, column: str) -> DataFrame:
    """One row: count, unique, top (most frequent, ties the smallest), freq."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    top = F.min_by("v", F.struct((-F.col("n")).alias("n"), F.col("v")))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count"), F.count(F.lit(1)).alias("unique"), top.alias("top"), F.max("n").alias("freq"))


def modes(df: DataFrame, column: str) -> DataFrame:
    """All most frequent values (ties kept), null excluded, with their count."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    best = counts.agg(F.max("n").alias("best"))
    return counts.join(F.broadcast(best), F.col("n") == F.col("best")).drop("best")  # one row


def central_tendency(df: DataFrame, column: str) -> DataFrame:
    """One row: mean, median (exact)."""
    middle = column_quantiles(df, {"_q": F.col(column)}, [0.5]).select(F.col("_q")[0].alias("median"))
    return df.agg(F.avg(column).alias("mean")).join(F.broadcast(middle))  # one row


def dispersion(df: DataFrame, column: str) -> DataFrame:
    """One row: var, std (both n - 1), cv (std / mean)."""
    out = df.agg(F.var_samp(column).alias("var"), F.stddev_samp(column).alias("std"), F.avg(column).alias("mean"))
    return out.select("var", "std", F.try_divide(F.col("std"), F.col("mean")).alias("cv"))


def ranked(df: DataFrame, value: str) -> DataFrame:
    """(v, n, before, below): each distinct value with its count, the rows before it and the sum below it.

    A global running total without a single-task window: values are range-partitioned, sums of whole partitions are
    added up over the partitions (one row each), and the running part stays inside a partition.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    parts = counts.repartitionByRange("v").withColumn("p", F.spark_partition_id())
    inner = Window.partitionBy("p").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    local = parts.withColumn("before", F.coalesce(F.sum("n").over(inner), F.lit(0))).withColumn("below", F.coalesce(F.sum(F.col("n") * F.col("v")).over(inner), F.lit(0.0)))
    totals = parts.groupBy("p").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("s"))
    outer = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = totals.select("p", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("o"), F.coalesce(F.sum("s").over(outer), F.lit(0.0)).alias("os"))
    return local.join(F.broadcast(offsets), "p").select("v", "n", (F.col("before") + F.col("o")).alias("before"), (F.col("below") + F.col("os")).alias("below"))


def gini(df: DataFrame, column: str) -> DataFrame:
    """One row: the Gini index of a column of values at or above zero, from the Lorenz curve of sorted values.

    The sum of the Lorenz curve is taken over ranks, so equal values need no order among themselves.
    """
    r = ranked(df, column)
    # rows of one value stand at ranks before+1 .. before+n: their Lorenz sums are below + k v, k = 1..n
    lorenz = F.sum(F.col("n") * F.col("below") + F.col("v") * F.col("n") * (F.col("n") + 1) / 2)
    out = r.agg(lorenz.alias("l"), F.sum(F.col("n") * F.col("v")).alias("s"), F.sum("n").alias("n"))
    return out.select((2 * (F.lit(0.5) - (F.try_divide(F.col("l"), F.col("s")) - 0.5) / F.col("n"))).alias("gini"))


def shape(df: DataFrame, column: str) -> DataFrame:
    """One row: bias-corrected skewness and excess kurtosis; null below 3 and 4 rows."""
    out = df.agg(F.count(column).alias("n"), F.skewness(column).alias("g1"), F.kurtosis(column).alias("g2"))
    n = F.col("n").cast("double")
    skew = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, ((n + 1) * F.col("g2") + 6) * (n - 1) / ((n - 2) * (n - 3)))
    return out.select(skew.alias("skew"), kurt.alias("kurtosis"))


def univariate(df: DataFrame, column: str, measure: str = "c") -> DataFrame:
    """Central tendency (c), dispersion (d) or shape (s) of a column; KeyError for another measure."""
    return {"c": central_tendency, "d": dispersion, "s": shape}[measure](df, column)


def percentage_change(old: Column, new: Column, precision: int = 2) -> Column:
    """Percent change from old to new; null where old is zero."""
    return F.round(F.try_divide((new - old) * 100.0, old), precision)


def percentage_difference(a: Column, b: Column, precision: int = 2) -> Column:
    """Absolute difference in percent of the mean of both; null where that is zero."""
    return F.round(F.try_divide(F.abs(a - b) * 100.0, (a + b) / 2), precision)


def group_medians(df: DataFrame, category: str, columns: Iterable[str]) -> DataFrame:
    """Median of each numeric column by category; rows without a category are left out."""
    columns = list(columns)
    known = df.filter(F.col(category).isNotNull())
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("x")) for i, c in enumerate(columns)]))
    long = known.select(F.col(category).alias("c"), pairs.alias("_e")).select("c", "_e.*")
    found = quantiles(long, F.struct("c", "i"), "x", [0.5]).select("key.c", "key.i", F.col("q")[0].alias("m"))
    made = found.groupBy("c").agg(*[F.max(F.when(F.col("i") == i, F.col("m"))).alias(c) for i, c in enumerate(columns)])
    names = known.select(F.col(category).alias("c")).distinct()
    return names.join(made, "c", "left").withColumnRenamed("c", category)


def group_means(df: DataFrame, category: str, columns: Iterable[str]) -> DataFrame:
    """Mean of each numeric column by category (centroids); rows without a category are left out."""
    return df.filter(F.col(category).isNotNull()).groupBy(category).agg(*[F.avg(c).alias(c) for c in columns])


def value_counts(df: DataFrame, column: str, precision: int = 1, top: int | None = None) -> DataFrame:
    """value, n, percent (of all rows that are not null), most frequent first by n desc, value asc when ``top`` is given."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    out = counts.join(F.broadcast(total)).withColumn("percent", F.round(F.col("n") * 100.0 / F.col("total"), precision)).drop("total")  # one row
    return out.orderBy(F.desc("n"), "value").limit(top) if top else out


def frequency_count(df: DataFrame, key: str, frequency: str, precision: int = 3) -> DataFrame:
    """frequency, keys (distinct), percent of all keys."""
    counts = df.groupBy(frequency).agg(F.countDistinct(key).alias("keys"))
    return counts.withColumn("percent", F.round(F.col("keys") * 100.0 / F.sum("keys").over(Window.partitionBy()), precision))  # one row per frequency


def sum_ratio(df: DataFrame, by: str, a: str, b: str, precision: int = 2) -> DataFrame:
    """Sums of two measures by category and their ratio in percent."""
    out = df.groupBy(by).agg(F.sum(a).alias("sum_a"), F.sum(b).alias("sum_b"))
    return out.withColumn("ratio", F.round(F.try_divide(F.col("sum_a") * 100.0, F.col("sum_b")), precision))


def contingency(df: DataFrame, x: str, y: str) -> DataFrame:
    """x, y, n with the margins: null in x or y of a margin row is told apart by ``level`` (0 cell, 1 total over y, 2 total over x, 3 all)."""
    return df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).cube(x, y).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))


def row_shares(df: DataFrame, key: str, columns: list[str], precision: int = 1) -> DataFrame:
    """Sums by key and each column's percent of its row."""
    sums = df.groupBy(key).agg(*[F.sum(c).alias(c) for c in columns])
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    return sums.select(key, *[F.round(F.try_divide(F.col(c) * 100.0, total), precision).alias(c) for c in columns])


def histogram(df: DataFrame, column: str, bins: int = 10, by: str | None = None) -> DataFrame:
    """bin (1 to bins), n, density of equal-width bins between the global minimum and maximum, optionally by a category.

    The maximum lies in the last bin; a constant column is in bin 1. Nulls are left out; empty bins have no row.
    """
    values = df.filter(F.col(column).isNotNull()).select(*([by] if by else []), F.col(column).cast("double").alias("_x"))
    edge = values.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count(F.lit(1)).alias("_t"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    bucket = F.when(width > 0, F.least(F.floor((F.col("_x") - F.col("_lo")) / width) + 1, F.lit(bins))).otherwise(1).cast("int")
    keys = [by] if by else []
    out = values.join(F.broadcast(edge)).withColumn("bin", bucket).groupBy(*keys, "bin", "_lo", "_hi", "_t").agg(F.count(F.lit(1)).alias("n"))  # one row
    return out.select(*keys, "bin", "n", F.try_divide(F.col("n").cast("double"), F.col("_t") * width).alias("density"))


def histograms(df: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """variable, bin, n of several columns in one pass over the data."""
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("x")) for c in columns])
    long = df.select(F.explode(pairs).alias("e")).select("e.*").filter("x is not null")
    edge = long.groupBy("variable").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    bucket = F.when(width > 0, F.least(F.floor((F.col("x") - F.col("lo")) / width) + 1, F.lit(bins))).otherwise(1).cast("int")
    return long.join(F.broadcast(edge), "variable").withColumn("bin", bucket).groupBy("variable", "bin").agg(F.count(F.lit(1)).alias("n"))  # one row per column


def box_stats(df: DataFrame, by: str, column: str) -> DataFrame:
    """by, q1, median, q3, mean, low, high: quartiles and whiskers (the extreme values within 1.5 IQR) by category."""
    cuts = quantiles(df, F.struct(by), column, [0.25, 0.5, 0.75]).select(F.col(f"key.{by}").alias("_k"), "q")
    means = df.groupBy(F.col(by).alias("_by")).agg(F.avg(column).alias("mean"))
    q = means.join(cuts, F.col("_by").eqNullSafe(F.col("_k")), "left")
    q = q.select("_by", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "mean")
    iqr = F.col("q3") - F.col("q1")
    inside = F.col(column).between(F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr)
    out = df.join(q, F.col(by).eqNullSafe(F.col("_by"))).groupBy(by, "q1", "median", "q3", "mean")
    return out.agg(F.min(F.when(inside, F.col(column))).alias("low"), F.max(F.when(inside, F.col(column))).alias("high"))


def daily_counts(df: DataFrame, at: str, contains: str | None = None) -> DataFrame:
    """day, n; ``contains`` keeps the days whose text holds it (such as 2018-05)."""
    out = df.groupBy(F.to_date(at).alias("day")).agg(F.count(F.lit(1)).alias("n")).filter("day is not null")
    return out.filter(F.col("day").cast("string").contains(contains)) if contains else out


def daily_by_category(df: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """by, day, count, mean, median, max, min of a value, and lifetime: days between the category's first and last day."""
    days = df.groupBy(by, F.to_date(at).alias("day")).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.max(value).alias("max"), F.min(value).alias("min"))
    window = Window.partitionBy(by)  # one row per category and day
    return days.withColumn("lifetime", F.datediff(F.max("day").over(window), F.min("day").over(window)))


def size_label(size: Column) -> Column:
    """Bytes as text in o, Ko, Mo, Go, To by powers of 1000, two decimals."""
    out = F.concat(F.format_string("%.2f", size / 1e12), F.lit(" To"))
    for power, unit in ((1e9, "Go"), (1e6, "Mo"), (1e3, "Ko"), (1.0, "o")):
        out = F.when(size < power * 1000, F.concat(F.format_string("%.2f", size / power), F.lit(f" {unit}"))).otherwise(out)
    return out


def profile(df: DataFrame) -> DataFrame:
    """column, type, rows, nulls, approx_distinct, min, max of every column in one pass (all as text)."""
    aggs = [
        F.struct(F.lit(n).alias("column"), F.lit(t).alias("type"), F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col(f"`{n}`").isNull(), 1)).alias("nulls"), F.approx_count_distinct(f"`{n}`").alias("approx_distinct"), F.min(f"`{n}`").cast("string").alias("min"), F.max(f"`{n}`").cast("string").alias("max"))
        for n, t in df.dtypes
        if not t.startswith(("map", "variant"))
    ]
    return df.agg(*[a.alias(f"_{i}") for i, a in enumerate(aggs)]).select(F.explode(F.array(*[f"_{i}" for i in range(len(aggs))])).alias("p")).select("p.*")
