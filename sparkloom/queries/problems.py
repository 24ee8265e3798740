"""Queries of the general training-data problems: schema drift and per-entity features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import drift
from sparkloom.session import materialise
from sparkloom.sources import load
from sparkloom.streaming import entity_features as ef

UNTIL = "2018-09-01 00:00:00"


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return drift.schema_changes(load(spark, folder, "benchmarking_files")).drop("series_id")


def _unified(files: DataFrame) -> DataFrame:
    kinds = materialise(drift.field_kinds(files.na.drop("any", subset=["file_id", "series_id", "data_year"])), "kinds")
    names = drift.canonical_names(materialise(drift.schema_changes(files, kinds=kinds), "changes"), kinds)
    return drift.unify(files, names, drift.column_types(kinds, names))


def p1_unified(spark: SparkSession, folder: str) -> DataFrame:
    return _unified(load(spark, folder, "benchmarking_files"))


def p1_rejects(spark: SparkSession, folder: str) -> DataFrame:
    return drift.rejects(load(spark, folder, "benchmarking_files")).select("file_id", "line_no")


def _typed_years(spark: SparkSession, folder: str) -> DataFrame:
    """The two typed years as lines of one series, so that the same operator takes them; exact copies of a row count once."""
    out = None
    for i, year in enumerate((2015, 2016), 1):
        rows = load(spark, folder, f"benchmarking_{year}").distinct()
        line = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
        part = rows.select(F.lit(i).cast("long").alias("file_id"), F.lit(1).cast("long").alias("series_id"), F.lit(year).alias("data_year"), F.col("OSEBuildingID").cast("int").alias("line_no"), line.alias("record"))
        out = part if out is None else out.unionByName(part)
    return out


def p1_typed_changes(spark: SparkSession, folder: str) -> DataFrame:
    return drift.schema_changes(_typed_years(spark, folder)).drop("series_id")


def p1_typed_unified(spark: SparkSession, folder: str) -> DataFrame:
    return _unified(_typed_years(spark, folder))


def _features(spark: SparkSession, folder: str) -> DataFrame:
    return ef.entity_features(spark, f"{folder}/olist_train_events.parquet", UNTIL)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    types = _features(spark, folder).select(F.col("entity").alias("customer_id"), F.explode("types").alias("event_type", "v"))
    recent = F.col("v.last") >= F.lit("2018-06-03 00:00:00").cast("timestamp_ntz")
    return types.filter((F.col("v.count") >= 2) & recent & (F.col("v.cents") > 0)).select("customer_id", "event_type")


def p3_features(spark: SparkSession, folder: str) -> DataFrame:
    """The feature rows; the map of types as text, in order of type: type, count, recency in days, cents."""
    one = F.transform(F.array_sort(F.map_entries("types")), lambda e: F.concat_ws(" ", e["key"], e["value"]["count"], e["value"]["recency"], e["value"]["cents"]))
    return _features(spark, folder).select(F.col("entity").alias("customer_id"), "events", "last", "cents", F.array_join(one, ";").alias("features"))


def p3_by_type(spark: SparkSession, folder: str) -> DataFrame:
    types = _features(spark, folder).select(F.col("entity").alias("customer_id"), F.explode("types").alias("event_type", "v"))
    return types.select("customer_id", "event_type", F.col("v.count").alias("n"), "v.last", F.col("v.recency").cast("long").alias("recency"), (F.col("v.cents") / 100).alias("total"))


_EVENTS_SQL = r"""
WITH clean AS (
  SELECT DISTINCT event_id, lower(trim(customer_id, e' \t')) AS customer_id, event_type, order_purchase_date AS seen,
    round(coalesce(monetary_value, 0) * 100)::BIGINT AS cents
  FROM olist_train_events
),
kept AS (
  SELECT * FROM clean WHERE customer_id NOT IN ('', 'n/a') AND event_type IS NOT NULL AND seen < TIMESTAMP '2018-09-01'
),
features AS (
  SELECT customer_id, event_type, count(DISTINCT event_id) AS n, max(seen) AS last, sum(cents) AS cents FROM kept GROUP BY ALL
)
"""


def queries() -> dict:
    return {"p1_found": p1_found, "p1_unified": p1_unified, "p1_rejects": p1_rejects, "p1_typed_changes": p1_typed_changes, "p1_typed_unified": p1_typed_unified, "p3_found": p3_found, "p3_features": p3_features, "p3_by_type": p3_by_type}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_rejects": "SELECT file_id, line_no FROM benchmarking_files WHERE record IS NULL OR NOT json_valid(record) OR json_type(CASE WHEN json_valid(record) THEN record END) <> 'OBJECT'",
        "p3_found": _EVENTS_SQL + "SELECT customer_id, event_type FROM features WHERE n >= 2 AND last >= TIMESTAMP '2018-06-03' AND cents > 0",
        "p3_features": _EVENTS_SQL
        + """SELECT customer_id, sum(n)::BIGINT AS events, max(last) AS last, sum(cents)::BIGINT AS cents,
        string_agg(concat_ws(' ', event_type, n, date_diff('day', last::DATE, DATE '2018-09-01'), cents), ';' ORDER BY event_type) AS features FROM features GROUP BY customer_id""",
        "p3_by_type": _EVENTS_SQL + "SELECT customer_id, event_type, n, last, date_diff('day', last::DATE, DATE '2018-09-01') AS recency, cents / 100 AS total FROM features",
    }
