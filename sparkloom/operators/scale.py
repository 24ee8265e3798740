"""Scaling and its inverse, by parameters from one aggregation that may be kept and used again."""

from __future__ import annotations

from itertools import combinations_with_replacement
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.quantiles import column_quantiles


class Scaler(NamedTuple):
    """x becomes (x - shift) / factor; a factor of 0 or null leaves x - shift."""

    shift: dict[str, float]
    factor: dict[str, float]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - self.shift[c]) / (self.factor[c] or 1.0) for c in self.shift})

    def reverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * (self.factor[c] or 1.0) + self.shift[c] for c in self.shift})


def _fit(df: DataFrame, columns: list[str], shift, factor) -> Scaler:
    row = df.agg(*[shift(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(columns)], *[factor(F.col(c).cast("double")).alias(f"f{i}") for i, c in enumerate(columns)]).head()
    n = len(columns)
    return Scaler({c: row[i] or 0.0 for i, c in enumerate(columns)}, {c: row[n + i] or 0.0 for i, c in enumerate(columns)})


def min_max(df: DataFrame, columns: list[str]) -> Scaler:
    """To 0..1; a constant column becomes 0."""
    return _fit(df, columns, F.min, lambda c: F.max(c) - F.min(c))


def standard(df: DataFrame, columns: list[str], center: bool = True, reduce: bool = True) -> Scaler:
    """z-scores with the population deviation."""
    return _fit(df, columns, F.avg if center else lambda c: F.max(F.lit(0.0)), F.stddev_pop if reduce else lambda c: F.max(F.lit(1.0)))


def robust(df: DataFrame, columns: list[str], low: float = 0.25, high: float = 0.75) -> Scaler:
    """(x - median) / range between two exact quantiles."""
    row = column_quantiles(df, {c: F.col(c) for c in columns}, [low, 0.5, high]).head()
    cuts = {c: row[i] or (0.0, 0.0, 0.0) for i, c in enumerate(columns)}
    return Scaler({c: q[1] for c, q in cuts.items()}, {c: q[2] - q[0] for c, q in cuts.items()})


def log1p(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.log1p(c) for c in columns})


def expm1(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.expm1(c) for c in columns})


def log_positive(df: DataFrame, columns: list[str]) -> DataFrame:
    """ln of values above zero, others as they are."""
    return df.withColumns({c: F.when(F.col(c) > 0, F.ln(c)).otherwise(F.col(c)) for c in columns})


def polynomial(df: DataFrame, columns: list[str], degree: int = 2, interaction_only: bool = False, bias: bool = True) -> DataFrame:
    """Adds the products of columns up to a degree, named a*b; bias adds a column of ones named 1."""
    made = {"1": F.lit(1.0)} if bias else {}
    for d in range(2, degree + 1):
        for group in combinations_with_replacement(columns, d):
            if not interaction_only or len(set(group)) == d:
                product = F.col(group[0])
                for c in group[1:]:
                    product = product * F.col(c)
                made["*".join(group)] = product
    return df.withColumns(made)
