"""Correlation, variance filters, analysis of variance, chi-square and regression, all from one-pass aggregates."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.tails import chi2_tail, f_tail
from sparkloom.operators.quantiles import quantiles


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r of every pair of columns (a before b), Pearson over the rows where both are there, in one pass."""
    pairs = list(combinations(columns, 2))
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("r")) for i, (a, b) in enumerate(pairs)]))
    return one.select(rows.alias("p")).select("p.*")


def top_correlations(df: DataFrame, columns: list[str], n: int = 5, absolute: bool = False) -> DataFrame:
    out = correlations(df, columns).filter("r is not null")
    return out.orderBy(F.desc(F.abs("r") if absolute else F.col("r")), "a", "b").limit(n)


def correlated_features(df: DataFrame, columns: list[str], threshold: float = 0.5) -> list[str]:
    """Columns whose correlation with any earlier one is above the threshold in absolute value."""
    hits = {r.b for r in correlations(df, columns).filter(F.abs("r") > threshold).collect()}  # one row per pair of columns
    return [c for c in columns if c in hits]


def pearson(df: DataFrame, x: str, y: str, precision: int = 2) -> DataFrame:
    return df.agg(F.round(F.corr(x, y), precision).alias("r"), F.round(F.covar_samp(x, y), precision).alias("covariance"))


def variances(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    row = df.agg(*[F.var_samp(c).alias(f"_{i}") for i, c in enumerate(columns)]).head()
    return dict(zip(columns, row))


def invalid_variance_features(df: DataFrame, columns: list[str], keep: str = "last") -> list[str]:
    """Columns of variance zero, and of those with equal variances all but the first or last."""
    found = variances(df, columns)
    out = [c for c in columns if found[c] == 0]
    groups: dict[float, list[str]] = {}
    for c in columns:
        if found[c]:
            groups.setdefault(found[c], []).append(c)
    for same in groups.values():
        out += same[1:] if keep == "first" else same[:-1]
    return [c for c in columns if c in out]


def filter_features(df: DataFrame, columns: list[str], threshold: float = 0.5, keep: str = "first") -> DataFrame:
    """Without the columns of invalid variance, then without correlated ones."""
    left = [c for c in columns if c not in invalid_variance_features(df, columns, keep)]
    drop = set(columns) - set(left) | set(correlated_features(df, left, threshold))
    return df.drop(*drop)


def anova(df: DataFrame, value: str, category: str) -> DataFrame:
    """One row: groups, n, eta2, f, df1, df2 of a one-way analysis of variance. Rows with a null in either are left out.

    Group counts, means and variances are combined; the rows are read once.
    """
    g = df.filter(F.col(value).isNotNull() & F.col(category).isNotNull()).groupBy(category).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v"))
    sums = g.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("ss"), F.sum((F.col("n") - 1) * F.col("v")).alias("within"))
    between = F.col("ss") - F.col("s") * F.col("s") / F.col("n")
    df1, df2 = F.col("groups") - 1, F.col("n") - F.col("groups")
    f = F.try_divide(F.try_divide(between, df1), F.try_divide(F.col("within"), df2))
    return sums.select("groups", "n", F.try_divide(between, between + F.col("within")).alias("eta2"), f.alias("f"), df1.alias("df1"), df2.alias("df2"))


def anova_test(df: DataFrame, value: str, category: str, alpha: float = 0.05) -> dict:
    """f, p (three decimals), eta2 and the decision."""
    r = anova(df, value, category).head()
    p = round(f_tail(r.f, r.df1, r.df2), 3) if r.f is not None else None
    return {"f": r.f, "p": p, "eta2": r.eta2, "reject": p is not None and p < alpha}


def levene(df: DataFrame, value: str, category: str) -> DataFrame:
    """The analysis of variance of the absolute distances to the group median (Levene's test, median centred)."""
    rows = df.filter(F.col(value).isNotNull() & F.col(category).isNotNull()).select(F.col(category).alias("c"), F.col(value).alias("x"))
    centre = quantiles(rows, "c", "x", [0.5]).select(F.col("key").alias("c"), F.col("q")[0].alias("m"))
    return anova(rows.join(centre, "c").select("c", F.abs(F.col("x") - F.col("m")).alias("z")), "z", "c")


def bartlett(df: DataFrame, value: str, category: str) -> dict:
    """Bartlett's statistic and its p from the group variances."""
    g = df.filter(F.col(value).isNotNull() & F.col(category).isNotNull()).groupBy(category).agg(F.count(value).alias("n"), F.var_samp(value).alias("v")).filter("n > 1 and v > 0")
    s = g.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum((F.col("n") - 1) * F.col("v")).alias("w"), F.sum((F.col("n") - 1) * F.log("v")).alias("l"), F.sum(1 / (F.col("n") - 1)).alias("i")).head()
    if not s.k or s.k < 2:
        return {"statistic": None, "p": None}
    rest = s.n - s.k
    statistic = (rest * math.log(s.w / rest) - s.l) / (1 + (s.i - 1 / rest) / (3 * (s.k - 1)))
    return {"statistic": statistic, "p": chi2_tail(statistic, s.k - 1)}


def chi2_cells(df: DataFrame, x: str, y: str) -> DataFrame:
    """x, y, n, expected, contribution of every cell of the contingency table (also of empty ones)."""
    cells = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy("x").agg(F.sum("n").alias("nx"))
    columns = cells.groupBy("y").agg(F.sum("n").alias("ny"))
    total = cells.agg(F.sum("n").alias("t"))
    # the full table of categories: as many rows as the result has
    grid = rows.crossJoin(columns).join(cells, ["x", "y"], "left").join(F.broadcast(total))  # total is one row
    n, e = F.coalesce("n", F.lit(0)), F.col("nx") * F.col("ny") / F.col("t")
    return grid.select("x", "y", n.alias("n"), e.alias("expected"), ((n - e) * (n - e) / e).alias("contribution"))


def chi2_test(df: DataFrame, x: str, y: str, compat: bool = False, alpha: float = 0.05) -> dict:
    """statistic, dof, p, reject. compat counts the margins as cells: the same statistic with dof r * c."""
    r = chi2_cells(df, x, y).agg(F.sum("contribution").alias("s"), F.countDistinct("x").alias("r"), F.countDistinct("y").alias("c")).head()
    dof = r.r * r.c if compat else (r.r - 1) * (r.c - 1)
    p = chi2_tail(r.s, dof) if dof and r.s is not None else None
    return {"statistic": r.s, "dof": dof, "p": p, "reject": p is not None and p < alpha}


def linear_regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: slope, intercept, r2 of y on x."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def residuals(df: DataFrame, x: str, y: str, name: str = "residual") -> DataFrame:
    fit = linear_regression(df, x, y).select(F.col("slope").alias("_a"), F.col("intercept").alias("_b"))
    return df.join(F.broadcast(fit)).withColumn(name, F.col(y) - (F.col("_b") + F.col("_a") * F.col(x))).drop("_a", "_b")


def box_cox(df: DataFrame, column: str, low: float = -2.0, high: float = 2.0, steps: int = 81) -> float:
    """The power of the Box-Cox transform of greatest likelihood on a grid, all powers in one pass; positive values only."""
    grid = [low + (high - low) * i / (steps - 1) for i in range(steps)]
    x = F.col(column).cast("double")
    made = [F.var_pop(F.log(x) if abs(p) < 1e-12 else (F.pow(x, F.lit(p)) - 1) / p).alias(f"_{i}") for i, p in enumerate(grid)]
    row = df.filter(x > 0).agg(F.count(x).alias("n"), F.sum(F.log(x)).alias("l"), *made).head()
    score = [-row.n / 2 * math.log(row[i + 2]) + (p - 1) * row.l if row[i + 2] else -math.inf for i, p in enumerate(grid)]
    return grid[max(range(steps), key=score.__getitem__)]


def box_cox_column(column: str, power: float):
    x = F.col(column).cast("double")
    return F.when(x > 0, F.log(x) if abs(power) < 1e-12 else (F.pow(x, F.lit(power)) - 1) / power)
