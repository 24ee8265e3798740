"""Cleaning: columns, nulls, duplicates, types, value filters. Functions take and return DataFrames."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPARE = {
    "l": lambda c, v: c < v,
    "le": lambda c, v: c <= v,
    "g": lambda c, v: c > v,
    "ge": lambda c, v: c >= v,
    "eq": lambda c, v: c == v,
    "neq": lambda c, v: ~c.eqNullSafe(v),
}


def drop_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.drop(*columns)


def column_positions(df: DataFrame, columns: Iterable[str]) -> list[int]:
    """Positions of columns; ValueError for an unknown one."""
    return [df.columns.index(c) for c in columns]


def filter_values(df: DataFrame, column: str, how: str, threshold) -> DataFrame:
    """Rows that compare as asked: l, le, g, ge, eq, neq. ``neq`` keeps nulls, the others drop them; an unknown code raises KeyError."""
    return df.filter(COMPARE[how](F.col(column), F.lit(threshold)))


def null_where_other_is_not(df: DataFrame, a: str, b: str) -> DataFrame:
    """The two columns where a is null and b is not."""
    return df.filter(F.col(a).isNull() & F.col(b).isNotNull()).select(a, b)


def null_counts(df: DataFrame, columns: Iterable[str] | None = None, precision: int = 1) -> DataFrame:
    """column, nulls, ratio (percent, rounded) of each column, in one pass. An empty input has ratio null."""
    columns = list(columns or df.columns)
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"_{i}") for i, c in enumerate(columns)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("nulls")) for i, c in enumerate(columns)]))
    return one.select("_n", rows.alias("r")).select("r.column", "r.nulls", F.round(F.try_divide(F.col("r.nulls") * 100.0, F.col("_n")), precision).alias("ratio"))


def drop_sparse_columns(df: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Without the columns whose share of nulls is above the threshold; one aggregation decides for all columns."""
    shares = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("int")).alias(f"_{i}") for i, c in enumerate(df.columns)]).head()
    return df.drop(*[c for i, c in enumerate(df.columns) if shares[i] is not None and shares[i] > threshold])


def drop_constant_columns(df: DataFrame) -> DataFrame:
    """Without the columns that hold one value (null counts as a value)."""
    marks = df.agg(*[(F.min(f"`{c}`").eqNullSafe(F.max(f"`{c}`")) & ((F.count(f"`{c}`") == 0) | (F.count(f"`{c}`") == F.count(F.lit(1))))).alias(f"_{i}") for i, c in enumerate(df.columns)]).head()
    return df.drop(*[c for i, c in enumerate(df.columns) if marks[i]])


def unique_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def distinct_counts(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """column, distinct (null counts as one value) in one aggregation."""
    columns = list(columns or df.columns)
    one = df.agg(*[(F.countDistinct(f"`{c}`") + F.max(F.col(f"`{c}`").isNull().cast("long"))).alias(f"_{i}") for i, c in enumerate(columns)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"_{i}"), F.lit(0)).alias("distinct")) for i, c in enumerate(columns)]))
    return one.select(rows.alias("r")).select("r.column", "r.distinct")


def is_low_cardinality(df: DataFrame, column: str, threshold: float = 0.5) -> DataFrame:
    """One row: distinct, total, low (distinct / total below the threshold; null counts as a value)."""
    out = df.agg((F.countDistinct(column) + F.max(F.col(column).isNull().cast("long"))).alias("distinct"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("low", F.try_divide(F.col("distinct"), F.col("total")) < threshold)


def data_loss(before: DataFrame | int, after: DataFrame | int, precision: int = 1) -> float:
    """Signed percentage of rows lost from before to after; negative when rows were gained."""
    n1, n2 = (x.count() if isinstance(x, DataFrame) else x for x in (before, after))
    return round(100 - n2 / n1 * 100, precision) if n1 else 0.0


def drop_duplicates_by(df: DataFrame, keys: Iterable[str], order: Iterable[Column]) -> DataFrame:
    """One row per key, the first in the stated order; null is a key."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(window)).filter("_r = 1").drop("_r")


def drop_duplicates_in_turn(df: DataFrame, columns: Iterable[str], order: Iterable[Column]) -> DataFrame:
    """Duplicates dropped by one column after another; the order of columns matters."""
    order = list(order)
    return reduce(lambda d, c: drop_duplicates_by(d, [c], order), columns, df)


def drop_class_of_size(df: DataFrame, target: str | list[str], members: int = 1) -> DataFrame:
    """Without the rows whose class has exactly so many members.

    The class sizes are aggregated map-side and joined back, so a class of a third of all rows is no single task.
    """
    keys = [target] if isinstance(target, str) else target
    odd = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == members).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    return df.join(odd, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]), "left_anti")


def narrow_types(df: DataFrame, yes_no: bool = True) -> DataFrame:
    """Whole-number columns cast to the narrowest type that holds them, doubles to float where that loses nothing,
    Yes/No text to boolean. One aggregation decides for all columns."""
    exprs, plan = [], []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.LongType | T.IntegerType | T.ShortType):
            plan.append((f.name, "int", len(exprs)))
            exprs += [F.min(c), F.max(c)]
        elif isinstance(f.dataType, T.DoubleType):
            plan.append((f.name, "float", len(exprs)))
            exprs += [F.bool_and(c.cast("float").cast("double").eqNullSafe(c))]
        elif isinstance(f.dataType, T.StringType) and yes_no:
            plan.append((f.name, "bool", len(exprs)))
            exprs += [F.bool_and(F.lower(c).isin("yes", "no"))]
    if not plan:
        return df
    row = df.agg(*[e.alias(f"_{i}") for i, e in enumerate(exprs)]).head()
    for name, kind, at in plan:
        c = F.col(f"`{name}`")
        if kind == "int" and row[at] is not None:
            kind = next(t for t, n in (("byte", 7), ("short", 15), ("int", 31), ("long", 63)) if -(2**n) <= row[at] and row[at + 1] < 2**n)
            df = df.withColumn(name, c.cast(kind))
        elif kind == "float" and row[at]:
            df = df.withColumn(name, c.cast("float"))
        elif kind == "bool" and row[at]:
            df = df.withColumn(name, F.lower(c) == "yes")
    return df


def translate_by_regex(column: Column, translator: Mapping[str, str]) -> Column:
    """Ordered pattern -> text replacements, one after another."""
    return reduce(lambda c, kv: F.regexp_replace(c, kv[0], kv[1]), translator.items(), column)


def row_has_any(columns: Iterable[str], values: Iterable) -> Column:
    """True where any of the columns holds one of the values (nulls do not)."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c).isin(*values), F.lit(False)) for c in columns])


def schema_difference(a: DataFrame, b: DataFrame) -> tuple[list[str], list[str]]:
    """Names only a has, names only b has."""
    return [c for c in a.columns if c not in b.columns], [c for c in b.columns if c not in a.columns]


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Union by column name; a column that a frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def prefix_columns(df: DataFrame, prefix: str, keep: Iterable[str] = ()) -> DataFrame:
    keep = set(keep)
    return df.select(*[F.col(f"`{c}`").alias(c if c in keep else prefix + c) for c in df.columns])


def type_counts(df: DataFrame) -> dict[str, int]:
    """Number of columns of each type."""
    out: dict[str, int] = {}
    for _, kind in df.dtypes:
        out[kind] = out.get(kind, 0) + 1
    return out
