"""Customer segmentation: recency-frequency-monetary scores, segments, cohorts, behavioural features."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.quantiles import column_quantiles

#: Patterns over the recency and frequency digits, and the label of each, tried in this order.
SEGMENTS = {
    "11": "Churned customers",
    "1[2-3]": "Former potential loyalists",
    "[1-2]4": "Former best customers",
    "21": "About to churn",
    "22": "Average customers",
    "[2-3][3-4]": "Loyal customers",
    "31": "Rising customers",
    "41": "New customers",
    "[3-4][1-2]": "Potential loyalists",
    "4[3-4]": "Best customers",
}


def rfm(orders: DataFrame, customer: str, at: str, amount: str) -> DataFrame:
    """customer, recency (days from the customer's last order to the last order of all), frequency (rows), monetary (sum, rounded 2).

    Rows without a customer are left out. One aggregation by customer and a one-row maximum.
    """
    known = orders.filter(F.col(customer).isNotNull())
    last = known.agg(F.max(at).alias("_last"))
    out = known.groupBy(F.col(customer).alias("customer")).agg(F.max(at).alias("_at"), F.count(F.lit(1)).alias("frequency"), F.round(F.sum(amount), 2).alias("monetary"))
    return out.join(F.broadcast(last)).select("customer", F.datediff("_last", "_at").cast("long").alias("recency"), "frequency", "monetary")  # one row


def quantile_scores(df: DataFrame, columns: list[str], reverse: tuple[str, ...] = (), quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Adds <column>_score, 1 to n + 1 by exact quantiles (a value at a quantile falls below it); reversed columns score high when low."""
    cuts = column_quantiles(df, {f"_q_{c}": F.col(c) for c in columns}, quantiles)
    out = df.join(F.broadcast(cuts))  # one row
    for c in columns:
        n = len(quantiles)
        score = F.lit(1 if c in reverse else n + 1)
        for i in range(n - 1, -1, -1):
            score = F.when(F.col(c) <= F.col(f"_q_{c}")[i], n + 1 - i if c in reverse else i + 1).otherwise(score)
        out = out.withColumn(f"{c}_score", score.cast("int"))
    return out.drop(*[f"_q_{c}" for c in columns])


def label_by_pattern(code: Column, patterns: Mapping[str, str] = SEGMENTS) -> Column:
    """The label of the first pattern that a code matches as a whole, else null."""
    return reduce(lambda other, kv: F.when(code.rlike(f"^(?:{kv[0]})$"), kv[1]).otherwise(other), reversed(patterns.items()), F.lit(None).cast("string"))


def rfm_segments(orders: DataFrame, customer: str, at: str, amount: str, patterns: Mapping[str, str] = SEGMENTS) -> DataFrame:
    """rfm with scores, code (recency and frequency digits), score (sum of the three), segment."""
    scored = quantile_scores(rfm(orders, customer, at, amount), ["recency", "frequency", "monetary"], reverse=("recency",))
    code = F.concat(F.col("recency_score").cast("string"), F.col("frequency_score").cast("string"))
    total = F.col("recency_score") + F.col("frequency_score") + F.col("monetary_score")
    return scored.withColumn("code", code).withColumn("score", total).withColumn("segment", label_by_pattern(F.col("code"), patterns))


def segment_summary(segments: DataFrame) -> DataFrame:
    return segments.groupBy("segment").agg(F.count(F.lit(1)).alias("customers"), F.round(F.avg("recency"), 2).alias("recency"), F.round(F.avg("frequency"), 2).alias("frequency"), F.round(F.avg("monetary"), 2).alias("monetary"))


def retention(orders: DataFrame, customer: str, at: str) -> DataFrame:
    """cohort (month of the first order), period (1 for that month), customers, rate (share of the cohort's period 1).

    The first month comes from an aggregate joined back, not from a window over all orders of a customer.
    """
    months = orders.filter(F.col(customer).isNotNull() & F.col(at).isNotNull()).select(F.col(customer).alias("c"), F.trunc(F.col(at).cast("date"), "MM").alias("month")).distinct()
    first = months.groupBy("c").agg(F.min("month").alias("cohort"))
    cells = months.join(first, "c").groupBy("cohort", "month").agg(F.count(F.lit(1)).alias("customers"))  # months are distinct per customer
    period = ((F.year("month") - F.year("cohort")) * 12 + F.month("month") - F.month("cohort") + 1).cast("int")
    size = F.max(F.when(F.col("period") == 1, F.col("customers"))).over(Window.partitionBy("cohort"))
    return cells.withColumn("period", period).withColumn("rate", F.round(F.col("customers") / size, 6)).select("cohort", "period", "customers", "rate")


def retention_matrix(cells: DataFrame, periods: list[int]) -> DataFrame:
    """One row per cohort, one rate column per period."""
    return cells.groupBy("cohort").pivot("period", periods).agg(F.first("rate"))


def frequency_ratios(lines: DataFrame, key: str, other: str, order: str, quantity: str) -> DataFrame:
    """Per key: rows, distinct orders and partners, total quantity, share of distinct partners, repeat share (rounded 2)."""
    out = lines.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(order).alias("rows"), F.countDistinct(order).alias("orders"), F.countDistinct(other).alias("partners"), F.sum(quantity).alias("quantity")
    )
    unique = F.round(F.try_divide(F.col("partners").cast("double"), F.col("rows")), 2)
    return out.withColumn("unique_share", unique).withColumn("repeat_share", F.round(1 - F.try_divide(F.col("partners").cast("double"), F.col("rows")), 2))


def recurring_items(lines: DataFrame, key: str, item: str, default: str = "none") -> DataFrame:
    """Per key: repeated (rows less distinct items) and the most frequent item (ties the smallest; ``default`` where there is one row)."""
    counts = lines.filter(F.col(key).isNotNull()).groupBy(key, F.col(item).cast("string").alias("i")).agg(F.count(F.lit(1)).alias("n"))
    out = counts.groupBy(key).agg(F.sum("n").alias("rows"), F.count("i").alias("distinct"), F.min_by("i", F.struct((-F.col("n")).alias("m"), F.col("i"))).alias("top"))
    return out.select(key, (F.col("rows") - F.col("distinct")).alias("repeated"), F.when(F.col("rows") == 1, default).otherwise(F.col("top")).alias("top"))


def mode_by(df: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """Most frequent value of each expression by key, ties the smallest, null excluded."""
    out = None
    for name, value in values.items():
        counts = df.filter(F.col(key).isNotNull() & value.isNotNull()).groupBy(key, value.alias("v")).agg(F.count(F.lit(1)).alias("n"))
        one = counts.groupBy(key).agg(F.min_by("v", F.struct((-F.col("n")).alias("m"), F.col("v"))).alias(name))
        out = one if out is None else out.join(one, key, "full")
    return out


def period_features(orders: DataFrame, customer: str, at: str, amount: str, scale: str, compat: bool = False, periods: list[str] | None = None) -> DataFrame:
    """Per customer and period of ``scale`` (year, quarter, month): order count and payment sum, one column pair per period.

    compat gives each order row of a period's indicator the count of the customer's rows with the same indicator, so that
    rows outside a period carry the count of the rows outside. ``periods`` states the columns; else the periods in the data are collected
    first, which are few by nature.
    """
    label = {"year": F.year(at).cast("string"), "quarter": F.concat(F.year(at).cast("string"), F.lit("Q"), F.quarter(at).cast("string")), "month": F.lower(F.date_format(F.col(at), "MMMM"))}[scale]
    rows = orders.filter(F.col(customer).isNotNull()).withColumn("_p", label)
    periods = sorted(r._p for r in rows.select("_p").distinct().filter("_p is not null").collect()) if periods is None else periods
    if not compat:
        counts = [F.count(F.when(F.col("_p") == p, 1)).alias(f"{p}_count") for p in periods]
        sums = [F.round(F.coalesce(F.sum(F.when(F.col("_p") == p, F.col(amount))), F.lit(0.0)), 2).alias(f"{p}_sum") for p in periods]
        return rows.groupBy(customer).agg(*counts, *sums)
    total = rows.groupBy(customer).agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.when(F.col("_p") == p, 1)).alias(f"_{p}") for p in periods])
    joined = rows.join(total, customer)
    return joined.select(customer, at, *[F.when(F.col("_p") == p, F.col(f"_{p}")).otherwise(F.col("_n") - F.col(f"_{p}")).alias(f"{p}_count") for p in periods])


def drawn_share(key: Column, seed: int) -> Column:
    """A number from 0 to 1 drawn by the MD5 of a key and a seed: the same in every run and engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), F.lit(seed))), 1, 8), 16, 10).cast("long") / 4294967296.0


def stratified_by_frequency(df: DataFrame, frequency: str, key: str, fractions: tuple[float, float, float], seed: int = 42) -> DataFrame:
    """A sample with one fraction for frequency 1, one for 2 and one above, the same rows in every run.

    Rows are ordered by a hash of the key, not drawn, so the sample does not depend on partitions.
    """
    stratum = F.when(F.col(frequency) == 1, fractions[0]).when(F.col(frequency) == 2, fractions[1]).when(F.col(frequency) > 2, fractions[2]).otherwise(0.0)
    return df.filter(drawn_share(F.col(key), seed) < stratum)


def list_lengths(df: DataFrame, customer: str, order: str, value: str, name: str) -> DataFrame:
    """Rows joined on the customer with the number of values of each of their orders: a row comes once per order of its customer."""
    sizes = df.groupBy(customer, order).agg(F.count(F.lit(1)).alias(name)).select(F.col(customer).alias("_c"), name)
    return df.join(sizes, F.col(customer).eqNullSafe(F.col("_c")), "left").drop("_c")


def positive_rows(df: DataFrame, columns: list[str], shifted: tuple[str, ...] = ()) -> DataFrame:
    """Rows with every column above zero; the shifted columns are taken as one more than they are, and come back unchanged."""
    keep = reduce(lambda a, b: a & b, [(F.col(c) + (1 if c in shifted else 0)) > 0 for c in columns])
    return df.filter(keep)


def median_zero_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns whose exact median is 0."""
    row = column_quantiles(df, {f"_{i}": F.col(c) for i, c in enumerate(columns)}, [0.5]).head()
    return [c for c, q in zip(columns, row) if q is not None and q[0] == 0]


def label_rows(df: DataFrame, key: str, labels: DataFrame, label_key: str, label: str, name: str = "cluster") -> DataFrame:
    """Adds the label of a row's key (the smallest where a key has several), null where there is none."""
    one = labels.groupBy(F.col(label_key).alias("_k")).agg(F.min(label).alias(name))
    return df.join(one, F.col(key) == F.col("_k"), "left").drop("_k")


def entity_counts(df: DataFrame, labels: str) -> DataFrame:
    """label, n over all rows' arrays of labels."""
    return df.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
