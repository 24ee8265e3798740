"""Model evaluation from label and prediction columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.profile import ranked
from sparkloom.operators.quantiles import column_quantiles


def confusion(df: DataFrame, label: str, prediction: str, normalise: bool = False) -> DataFrame:
    """label, prediction, n; normalised: share of the label's rows, two decimals."""
    out = df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("label")), 2)) if normalise else out  # one row per cell


def binary_counts(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: tn, fp, fn, tp."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    return df.agg(F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(y & p).alias("tp"))


def argmax(scores: Column) -> Column:
    """Position (from 0) of the largest score of an array."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def roc(df: DataFrame, label: str, score: str) -> DataFrame:
    """threshold, fpr, tpr, share (of rows), one row per distinct score, highest first: rows at or above the threshold count.

    Scores are range-partitioned and shifted by partition totals, so there is no global window over rows.
    """
    rows = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    by_score = rows.groupBy(F.col(score).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    parts = by_score.repartitionByRange(F.desc("v")).withColumn("p", F.spark_partition_id())
    inner = Window.partitionBy("p").orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    shift = parts.groupBy("p").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).select("p", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("on"), F.coalesce(F.sum("pos").over(outer), F.lit(0)).alias("op"))
    total = by_score.agg(F.sum("n").alias("t"), F.sum("pos").alias("tp"))
    run = parts.withColumn("rn", F.sum("n").over(inner)).withColumn("rp", F.sum("pos").over(inner)).join(F.broadcast(shift), "p").join(F.broadcast(total))
    n, p = F.col("rn") + F.col("on"), F.col("rp") + F.col("op")
    return run.select(F.col("v").alias("threshold"), F.try_divide((n - p).cast("double"), F.col("t") - F.col("tp")).alias("fpr"), F.try_divide(p.cast("double"), F.col("tp")).alias("tpr"), (n / F.col("t")).alias("share"))


def lift(df: DataFrame, label: str, score: str) -> DataFrame:
    """share of rows by falling score against the share of positives found (gain curve) and their ratio."""
    return roc(df, label, score).select("threshold", "share", F.col("tpr").alias("gain"), F.try_divide(F.col("tpr"), F.col("share")).alias("lift"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: the area under the ROC curve by rank sums (ties count half)."""
    rows = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    ranks = ranked(rows, score).select("v", (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))
    pos = rows.groupBy(F.col(score).cast("double").alias("v")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    s = pos.join(ranks, "v").agg(F.sum(F.col("pos") * F.col("rank")).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    return s.select(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p"))).alias("auc"))


def regression_scores(df: DataFrame, label: str, prediction: str, precision: int = 3) -> DataFrame:
    """One row: mse, rmse, r2."""
    e = F.col(label) - F.col(prediction)
    s = df.agg(F.avg(e * e).alias("mse"), F.var_pop(label).alias("v"))
    return s.select(F.round("mse", precision).alias("mse"), F.round(F.sqrt("mse"), precision).alias("rmse"), F.round(1 - F.try_divide(F.col("mse"), F.col("v")), precision).alias("r2"))


def accuracy(df: DataFrame, label: str, prediction: str, precision: int = 3) -> DataFrame:
    return df.agg(F.round(F.avg(F.col(label).eqNullSafe(F.col(prediction)).cast("int")), precision).alias("accuracy"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the adjusted Rand index of two labelings, from the counts of their cells."""

    def two(c: Column) -> Column:
        c = c.cast("double")
        return c * (c - 1) / 2

    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    both = cells.agg(F.sum(two(F.col("n"))).alias("ij"), F.sum("n").alias("n"))
    rows = cells.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("i"))
    columns = cells.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("j"))
    s = both.join(F.broadcast(rows)).join(F.broadcast(columns))  # one row each
    expected = F.col("i") * F.col("j") / two(F.col("n"))
    return s.select(F.try_divide(F.col("ij") - expected, (F.col("i") + F.col("j")) / 2 - expected).alias("ari"))


def multilabel_scores(df: DataFrame, label: str, prediction: str, precision: int = 2) -> DataFrame:
    """One row, in percent: subset accuracy, and precision, recall, f1, Jaccard averaged over rows of label arrays."""
    y, p = F.array_distinct(label), F.array_distinct(prediction)
    both = F.size(F.array_intersect(y, p)).cast("double")
    exact = (F.size(y) == F.size(p)) & (both == F.size(y))
    zero = F.lit(0.0)
    parts = {
        "accuracy": exact.cast("double"),
        "precision": F.coalesce(F.try_divide(both, F.size(p)), zero),
        "recall": F.coalesce(F.try_divide(both, F.size(y)), zero),
        "f1": F.coalesce(F.try_divide(2 * both, F.size(y) + F.size(p)), zero),
        "jaccard": F.coalesce(F.try_divide(both, F.size(F.array_union(y, p))), zero),
    }
    return df.agg(*[F.round(F.avg(v) * 100, precision).alias(k) for k, v in parts.items()])


def micro_f1(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: micro F1 of 0/1 arrays; predictions are rounded, a half to 0."""
    r = F.transform(F.col(prediction), lambda x: F.bround(x))
    tp = F.sum(F.aggregate(F.zip_with(F.col(label), r, lambda a, b: (a * b).cast("double")), F.lit(0.0), lambda s, x: s + x))
    pos = F.sum(F.aggregate(F.transform(F.col(label), lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    found = F.sum(F.aggregate(F.transform(r, lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    return df.agg(F.try_divide(2 * tp, pos + found).alias("f1"))


def dummy_regression(train: DataFrame, test: DataFrame, label: str, strategy: str = "mean") -> DataFrame:
    """Scores of the constant mean or median of the training labels."""
    guess = train.agg(F.avg(label).alias("_g")) if strategy == "mean" else column_quantiles(train, {"_q": F.col(label)}, [0.5]).select(F.col("_q")[0].alias("_g"))
    return regression_scores(test.join(F.broadcast(guess)), label, "_g")


def dummy_classification(train: DataFrame, test: DataFrame, label: str, strategy: str = "most_frequent", key: str | None = None, seed: int = 42) -> DataFrame:
    """Accuracy of a baseline: most_frequent (ties the smallest), or stratified / uniform by a seeded hash of ``key``."""
    counts = train.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    if strategy == "most_frequent":
        guess = counts.agg(F.min_by("_g", F.struct((-F.col("_n")).alias("m"), F.col("_g"))).alias("_g"))
        return accuracy(test.join(F.broadcast(guess)), label, "_g")
    if counts.limit(10_001).count() > 10_000:
        raise ValueError("more than 10,000 classes")
    w = Window.orderBy("_g")  # one row per class
    weight = F.col("_n") if strategy == "stratified" else F.lit(1)
    upto = counts.withColumn("_w", weight.cast("double")).withColumn("_hi", F.sum("_w").over(w) / F.sum("_w").over(Window.partitionBy())).withColumn("_lo", F.col("_hi") - F.col("_w") / F.sum("_w").over(Window.partitionBy()))
    drawn = test.withColumn("_u", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30))
    return accuracy(drawn.join(F.broadcast(upto), (F.col("_u") >= F.col("_lo") - 1e-12) & (F.col("_u") < F.col("_hi") - 1e-12)), label, "_g")  # one row per class


def predicted_labels(scores: Column, names: list[str], upper: bool = False) -> Column:
    """Names whose score rounds to one (a half is 0), distinct."""
    named = F.zip_with(scores, F.array(*map(F.lit, names)), lambda s, n: F.when(s > 0.5, n))
    out = F.array_distinct(F.filter(named, lambda n: n.isNotNull()))
    return F.transform(out, lambda n: F.upper(n)) if upper else out


def model_name(model) -> str:
    """The class name of an estimator or model."""
    return type(model).__name__
