"""Smaller operators of the inventory: scalars, curves, label vectors, stations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import geometry, scalars
from sparkloom.operators import evaluate, geo, ml, profile, rank, reshape, segment, stats
from sparkloom.registry import Registry
from sparkloom.sources import load
from sparkloom.sources.archives import detect_delimiter

query = Registry()

#: Quarters of the orders of the test tables, stated by the query whose columns they are and by its SQL.
QUARTERS = [(y, q) for y in range(1995, 2002) for q in range(1, 5)]


@query("detect_file_delimiter", """SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN c >= s AND c >= t THEN ',' WHEN s >= t THEN ';' ELSE chr(9) END AS delimiter
    FROM (SELECT doc_id, text, length(text) - length(replace(text, ',', '')) AS c, length(text) - length(replace(text, ';', '')) AS s, length(text) - length(replace(text, chr(9), '')) AS t FROM documents)""")
def detect_file_delimiter(spark, d):
    return load(spark, d, "documents").select("doc_id", detect_delimiter(F.col("text")).alias("delimiter"))


_LAG = "SELECT l_orderkey, l_linenumber, l_partkey, epoch(l_shipdate)::BIGINT - epoch(o_orderdate)::BIGINT AS s FROM lineitem JOIN orders ON o_orderkey = l_orderkey"


def _lag(spark, d):
    df = load(spark, d, "lineitem").join(load(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    s = F.unix_seconds(F.col("l_shipdate").cast("timestamp")) - F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    return df.select("l_orderkey", "l_linenumber", "l_partkey", s.alias("s"))


@query("delay_columns", f"SELECT l_orderkey, l_linenumber, l_partkey, minute(make_timestamp(s * 1000000))::INT AS minute_part, day(make_timestamp(s * 1000000))::INT AS day_part, round(s / 60.0, 6)::DOUBLE AS minutes, round(s / 86400.0, 6)::DOUBLE AS days FROM ({_LAG})")
def delay_columns(spark, d):
    s = F.col("s")
    return _lag(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", scalars.delay_minutes(s, compat=True).alias("minute_part"), scalars.delay_days(s, compat=True).alias("day_part"), F.round(scalars.delay_minutes(s), 6).alias("minutes"), F.round(scalars.delay_days(s), 6).alias("days"))


@query("convert_str_time_to_time", "SELECT o_orderkey, strftime(make_timestamp((o_orderkey % 86400) * 1000000), '%H:%M:%S') AS time FROM orders")
def convert_str_time_to_time(spark, d):
    return load(spark, d, "orders").select("o_orderkey", scalars.seconds_to_time(F.col("o_orderkey") % 86400).alias("time"))


@query("format_run_time", "SELECT o_orderkey, trim(CASE WHEN h > 0 THEN h || ' h ' ELSE '' END || CASE WHEN m > 0 THEN m || ' min ' ELSE '' END || CASE WHEN s > 0 THEN s || ' s' ELSE '' END) AS text FROM (SELECT o_orderkey, o_orderkey % 5 AS h, o_orderkey % 60 AS m, o_orderkey % 7 AS s FROM orders)")
def format_run_time(spark, d):
    k = F.col("o_orderkey")
    return load(spark, d, "orders").select("o_orderkey", scalars.run_time_text(F.concat_ws(":", k % 5, k % 60, k % 7)).alias("text"))


@query("read_number_cleaner", r"SELECT o_orderkey, reverse(regexp_replace(regexp_replace(reverse(split_part(t, '.', 1)), '(\d{3})', '\1 ', 'g'), ' $', '')) || '.' || split_part(t, '.', 2) AS text FROM (SELECT o_orderkey, o_totalprice::DECIMAL(18, 2)::VARCHAR AS t FROM orders)")
def read_number_cleaner(spark, d):
    return load(spark, d, "orders").select("o_orderkey", scalars.group_thousands(F.col("o_totalprice").cast("decimal(18,2)")).alias("text"))


@query("get_memory_usage", "SELECT doc_id, CASE WHEN n < 1000 THEN n || '.00 o' ELSE (h // 100) || '.' || lpad((h % 100)::VARCHAR, 2, '0') || ' Ko' END AS size FROM (SELECT doc_id, n_chars AS n, (n_chars + 5) // 10 AS h FROM documents WHERE n_chars IS NOT NULL)")
def get_memory_usage(spark, d):
    return load(spark, d, "documents").filter("n_chars is not null").select("doc_id", profile.size_label(F.col("n_chars")).alias("size"))


@query("kaiser_criterion", "WITH r AS (SELECT count(*) / (SELECT count(*) FROM part)::DOUBLE AS r FROM part GROUP BY p_type) SELECT count(*) AS components FROM r WHERE r > 1.0 / (SELECT count(*) FROM r)")
def kaiser_criterion(spark, d):
    part = load(spark, d, "part")
    counts = part.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return rank.kaiser(counts.join(F.broadcast(total)).select((F.col("n") / F.col("t")).alias("r")), "r")  # one row


@query("reduce_cluster_data", """WITH p AS (SELECT p_partkey, p_size FROM part),
    d AS (SELECT 0 AS centre, p_partkey, abs(p_size - 10.0)::DOUBLE AS distance FROM p UNION ALL SELECT 1, p_partkey, abs(p_size - 40.0)::DOUBLE FROM p)
    SELECT centre, p_partkey, distance, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY centre ORDER BY distance DESC, p_partkey) AS r FROM d) WHERE r <= 50""")
def reduce_cluster_data(spark, d):
    size = F.col("p_size").cast("double")
    out = rank.farthest_rows(load(spark, d, "part").select("p_partkey", "p_size"), {0: F.abs(size - 10), 1: F.abs(size - 40)}, 50, "p_partkey")
    return out.select("centre", "p_partkey", "distance", "rank")


@query("roc_decision_rule", "WITH c AS (SELECT p_size AS i, count(*) AS n FROM part GROUP BY 1), r AS (SELECT i, sum(n) OVER (ORDER BY i) / (SELECT sum(n) FROM c) AS r FROM c) SELECT min(i) AS \"index\", min(i) * 2 AS threshold FROM r WHERE r > 0.5")
def roc_decision_rule(spark, d):
    sizes = rank.length_distribution(load(spark, d, "part").select(F.array_repeat("p_size", F.col("p_size")).alias("t")), F.col("t"))
    table = sizes.select(F.col("size").cast("int").alias("i"), "cumulative", (F.col("size") * 2).cast("int").alias("t"))
    return rank.decision_index(table, "i", "cumulative", "t", 0.5)


@query("gram_matrix", "SELECT a.vec_id, b.vec_id AS other, round(exp(-0.5 * list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) ^ 2), 6) AS k FROM embeddings a CROSS JOIN embeddings b")
def gram_matrix(spark, d):
    df = load(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return ml.rbf_kernel(df, "vec_id", "embedding", 0.5).select("vec_id", "other", F.round("k", 6).alias("k"))


@query("autotag_question", "SELECT vec_id, concat_ws(' ', CASE WHEN embedding[1] > 0.5 THEN 'A' END, CASE WHEN embedding[2] > 0.5 THEN 'B' END, CASE WHEN embedding[3] > 0.5 THEN 'C' END) AS tags FROM embeddings")
def autotag_question(spark, d):
    return load(spark, d, "embeddings").select("vec_id", F.array_join(evaluate.predicted_labels(F.slice("embedding", 1, 3), ["a", "b", "c"], upper=True), " ").alias("tags"))


@query("argmax_of_logits", "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS best FROM embeddings")
def argmax_of_logits(spark, d):
    return load(spark, d, "embeddings").select("vec_id", evaluate.argmax(F.col("embedding")).alias("best"))


@query("build_polling_stations_histogram", "SELECT row_number() OVER (ORDER BY source) AS station, source, count(*) AS n FROM documents WHERE domain = 'polling' AND source IS NOT NULL GROUP BY source")
def build_polling_stations_histogram(spark, d):
    counts = load(spark, d, "documents").filter("domain = 'polling' and source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return reshape.with_row_number(counts, "i", [F.col("source")]).select((F.col("i") + 1).alias("station"), "source", "n")


@query("drop_geometry_duplicates", "SELECT count(*) AS n FROM (SELECT DISTINCT round(Longitude, 2), round(Latitude, 2) FROM benchmarking_2016 WHERE Latitude IS NOT NULL AND Longitude IS NOT NULL)")
def drop_geometry_duplicates(spark, d):
    df = load(spark, d, "benchmarking_2016").filter("Latitude is not null and Longitude is not null").select(F.array(geometry.point(F.col("Longitude"), F.col("Latitude"))).alias("p"))
    return geo.drop_duplicate_geometries(df.select(geometry.round_points(F.col("p"), 2).alias("p")), "p").agg(F.count(F.lit(1)).alias("n"))


@query("normalize_coordinates_columns_labels", "SELECT Longitude AS x, Latitude AS y FROM benchmarking_2016 WHERE Latitude IS NOT NULL AND Longitude IS NOT NULL")
def normalize_coordinates_columns_labels(spark, d):
    df = load(spark, d, "benchmarking_2016")
    a, b = geo.coordinate_columns(df)
    return geo.as_xy(df.select(a, b).na.drop(), a, b)


@query(
    "nearest_neighbor_search",
    """WITH p AS (SELECT DISTINCT OSEBuildingID AS id, Longitude AS x, Latitude AS y FROM benchmarking_2016 WHERE Latitude IS NOT NULL AND Longitude IS NOT NULL), a AS (SELECT * FROM p WHERE id % 2 = 0), b AS (SELECT * FROM p WHERE id % 2 = 1),
    d AS (SELECT a.id, b.id AS other, sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2) AS d FROM a JOIN b ON abs(a.x - b.x) <= 0.05 AND abs(a.y - b.y) <= 0.05), m AS (SELECT id, arg_min(other, (d, other)) AS other, min(d) AS d FROM d WHERE d <= 0.05 GROUP BY 1)
    SELECT id, other, round(d, 9) AS distance FROM a LEFT JOIN m USING (id)""",
)
def nearest_neighbor_search(spark, d):
    p = load(spark, d, "benchmarking_2016").filter("Latitude is not null and Longitude is not null").select(F.col("OSEBuildingID").alias("id"), F.col("Longitude").alias("x"), F.col("Latitude").alias("y")).distinct()
    early, late = p.filter("id % 2 = 0"), p.filter("id % 2 = 1").withColumnRenamed("id", "other")
    return geo.nearest(early, late, "id", "other", 0.05).select("id", "other", F.round("distance", 9).alias("distance"))


@query("shares_complete", """SELECT OSEBuildingID, round(e * 100.0 / nullif(t, 0), 1) AS e_share, round(g * 100.0 / nullif(t, 0), 1) AS g_share, round(s * 100.0 / nullif(t, 0), 1) AS s_share
    FROM (SELECT OSEBuildingID, "Electricity(kBtu)" AS e, "NaturalGas(kBtu)" AS g, "SteamUse(kBtu)" AS s, "SiteEnergyUse(kBtu)" AS t FROM benchmarking_2016)""")
def shares_complete(spark, d):
    df = load(spark, d, "benchmarking_2016").select("OSEBuildingID", *[F.col(f"`{c}`").alias(n) for c, n in (("Electricity(kBtu)", "e"), ("NaturalGas(kBtu)", "g"), ("SteamUse(kBtu)", "s"), ("SiteEnergyUse(kBtu)", "t"))])
    return reshape.shares_complete(df, ["e", "g", "s"], "t").select("OSEBuildingID", "e_share", "g_share", "s_share")


@query("centroid_deviation", """WITH a AS (SELECT c_mktsegment AS k, avg(c_acctbal) AS v FROM customer GROUP BY 1), b AS (SELECT c_mktsegment AS k, avg(c_acctbal) AS v FROM customer WHERE c_nationkey < 12 GROUP BY 1)
    SELECT round(avg(abs((b.v - a.v) * 100.0 / a.v)), 6) AS deviation FROM a JOIN b USING (k)""")
def centroid_deviation(spark, d):
    df = load(spark, d, "customer")
    a, b = (x.groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias(n)) for x, n in ((df, "a"), (df.filter("c_nationkey < 12"), "b")))
    return a.join(b, "c_mktsegment").agg(F.round(F.avg(F.abs((F.col("b") - F.col("a")) * 100.0 / F.col("a"))), 6).alias("deviation"))


@query("stratified_split", """WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) SELECT o_orderpriority, 'test' AS part, round(n * 0.2)::BIGINT AS n FROM c UNION ALL SELECT o_orderpriority, 'train', n - round(n * 0.2)::BIGINT FROM c""")
def stratified_split(spark, d):
    train, test = reshape.stratified_split(load(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey")
    parts = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return parts.groupBy("o_orderpriority", "part").agg(F.count(F.lit(1)).alias("n"))


@query("period_indicators_compat", "SELECT o_custkey, o_orderkey, CASE WHEN quarter(o_orderdate) = 1 THEN count(*) FILTER (quarter(o_orderdate) = 1) OVER (PARTITION BY o_custkey) ELSE count(*) FILTER (quarter(o_orderdate) <> 1) OVER (PARTITION BY o_custkey) END AS n FROM orders")
def period_indicators_compat(spark, d):
    df = load(spark, d, "orders").withColumn("first", F.quarter("o_orderdate") == 1)
    counts = df.groupBy("o_custkey", "first").agg(F.count(F.lit(1)).alias("n"))
    return df.join(counts, ["o_custkey", "first"]).select("o_custkey", "o_orderkey", "n")


@query("decompose_by_quarter", "SELECT o_custkey, " + ", ".join(f"count(*) FILTER (year(o_orderdate) = {y} AND quarter(o_orderdate) = {q}) AS \"{y}Q{q}_count\", round(coalesce(sum(o_totalprice) FILTER (year(o_orderdate) = {y} AND quarter(o_orderdate) = {q}), 0), 2) AS \"{y}Q{q}_sum\"" for y, q in QUARTERS) + " FROM orders GROUP BY 1")
def decompose_by_quarter(spark, d):
    return segment.period_features(load(spark, d, "orders"), "o_custkey", "o_orderdate", "o_totalprice", "quarter", periods=[f"{y}Q{q}" for y, q in QUARTERS])


@query(
    "retention_pivot",
    """WITH m AS (SELECT DISTINCT o_custkey AS c, date_trunc('month', o_orderdate)::DATE AS month FROM orders), k AS (SELECT c, month, min(month) OVER (PARTITION BY c) AS cohort FROM m),
    n AS (SELECT cohort, date_diff('month', cohort, month) + 1 AS period, count(*) AS n FROM k GROUP BY 1, 2), r AS (SELECT cohort, period, round(n / max(n) FILTER (period = 1) OVER (PARTITION BY cohort), 6) AS rate FROM n)
    SELECT cohort, """ + ", ".join(f'max(rate) FILTER (period = {p}) AS "{p}"' for p in range(1, 13)) + " FROM r GROUP BY 1",
)
def retention_pivot(spark, d):
    cells = segment.retention(load(spark, d, "orders"), "o_custkey", "o_orderdate")
    return segment.retention_matrix(cells, list(range(1, 13)))


_PAIRS = [(a, b) for i, a in enumerate(("l_quantity", "l_extendedprice", "l_discount", "l_tax")) for b in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")[i + 1 :]]


@query("print_features_reduction", "WITH r AS (" + " UNION ALL ".join(f"SELECT '{b}' AS b, corr({a}, {b}) AS r FROM lineitem" for a, b in _PAIRS) + "), k AS (SELECT 4 - count(DISTINCT b) AS k FROM r WHERE abs(r) > 0.5) SELECT 4::INT AS features, k::INT AS kept, round(100 - k / 4.0 * 100, 1)::DOUBLE AS reduction FROM k")
def print_features_reduction(spark, d):
    df = load(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    left = stats.filter_features(df, df.columns, 0.5).columns
    return spark.createDataFrame([(len(df.columns), len(left), round(100 - len(left) / len(df.columns) * 100, 1))], "features int, kept int, reduction double")


queries, oracle_sql = query.queries, query.oracle_sql
