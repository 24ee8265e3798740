"""Classifiers, regressors and label vectors on pyspark.ml."""

from __future__ import annotations

from pyspark.ml.classification import LinearSVC, OneVsRest, RandomForestClassifier
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.stat import KolmogorovSmirnovTest
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.profile import percentage_change

CLASSIFIERS = {
    "random_forest": lambda label, seed: RandomForestClassifier(labelCol=label, seed=seed),
    "linear_svc": lambda label, seed: OneVsRest(classifier=LinearSVC(labelCol=label, maxIter=20), labelCol=label),
}
REGRESSORS = {
    "elastic_net": lambda label, seed: LinearRegression(labelCol=label, elasticNetParam=0.5, regParam=0.01),
    "random_forest_regressor": lambda label, seed: RandomForestRegressor(labelCol=label, seed=seed),
    "boosted_trees": lambda label, seed: GBTRegressor(labelCol=label, seed=seed, maxIter=20),
}


def fit(df: DataFrame, kind: str, label: str, seed: int = 42):
    """A fitted classifier or regressor by name over the column ``features``."""
    return (CLASSIFIERS | REGRESSORS)[kind](label, seed).fit(df)


def binarise(labels: Column, classes: list[str]) -> Column:
    """0/1 array over the classes in sorted order (labels out of the classes count nothing)."""
    return F.array(*[F.array_contains(labels, c).cast("int") for c in sorted(classes)])


def classes_of(df: DataFrame, labels: str, limit: int = 10_000) -> list[str]:
    """Distinct labels, sorted; ValueError beyond the limit."""
    found = [r[0] for r in df.select(F.explode(labels).alias("c")).distinct().limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"more than {limit} labels")
    return sorted(found)


def compare_results(a: DataFrame, b: DataFrame, key: str, scores: list[str], names: tuple[str, str] = ("include", "exclude")) -> DataFrame:
    """Two result tables beside each other by key, each score under both names, with the percent change from the second to the first."""
    left = a.select(key, *[F.col(s).alias(f"{s}_{names[0]}") for s in scores])
    right = b.select(key, *[F.col(s).alias(f"{s}_{names[1]}") for s in scores])
    out = left.join(right, key)
    return out.withColumns({f"{s}_change": percentage_change(F.col(f"{s}_{names[1]}"), F.col(f"{s}_{names[0]}")) for s in scores})


def show_predictions(df: DataFrame, label: str, prediction: str, text: str, key: str, n: int = 10, seed: int = 42) -> DataFrame:
    """n rows drawn by a seeded hash of the key, with text, truth and prediction."""
    return df.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed))), key).select(key, text, label, prediction).limit(n)


def lifetime_bucket(months: Column, low: float = 10, high: float = 16) -> Column:
    """short, medium or long segment lifetime."""
    return F.when(months < low, "short").when(months < high, "medium").when(months.isNotNull(), "long")


def normality(df: DataFrame, column: str) -> dict:
    """Kolmogorov-Smirnov test of a column against the normal distribution of its own mean and deviation."""
    rows = df.select(F.col(column).cast("double").alias("x")).filter("x is not null")
    m = rows.agg(F.avg("x"), F.stddev_samp("x")).head()
    r = KolmogorovSmirnovTest.test(rows, "x", "norm", float(m[0]), float(m[1])).head()
    return {"statistic": r.statistic, "p": r.pValue}
