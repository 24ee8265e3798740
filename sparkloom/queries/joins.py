"""Joins, lookups and address matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import relate
from sparkloom.registry import Registry
from sparkloom.sources import load

query = Registry()


@query("iterative_merge", "SELECT o_orderkey, c_custkey, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def iterative_merge(spark, d):
    base = load(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    nation = load(spark, d, "nation").withColumnsRenamed({"n_nationkey": "c_nationkey", "n_regionkey": "r_regionkey"})
    steps = [(load(spark, d, "customer"), "c_custkey", "inner"), (nation, "c_nationkey", "left"), (load(spark, d, "region"), "r_regionkey", "inner")]
    return relate.merge_chain(base, steps).select("o_orderkey", "c_custkey", "n_name", "r_name")


@query("merge_report", "SELECT 1 AS step, count(*) AS rows, round((count(*) - (SELECT count(*) FROM orders)) * 100.0 / (SELECT count(*) FROM orders), 2) AS change_percent FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def merge_report(spark, d):
    lines = load(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return relate.merge_report(load(spark, d, "orders"), [(lines, "o_orderkey", "inner")])


@query("join_with_prefix", "SELECT a.o_orderkey, a.o_totalprice AS a_price, l.l_linenumber AS b_line FROM orders a JOIN lineitem l ON a.o_orderkey = l.l_orderkey WHERE l.l_quantity > 45")
def join_with_prefix(spark, d):
    lines = load(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("b_line"))
    return load(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("a_price")).join(lines, "o_orderkey")


@query("join_two_keys", "SELECT a.l_partkey, a.l_suppkey, a.n, b.m FROM (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2) a LEFT JOIN (SELECT l_partkey, l_suppkey, max(l_quantity) AS m FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey")
def join_two_keys(spark, d):
    lines = load(spark, d, "lineitem")
    a = lines.groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    b = lines.filter("l_returnflag = 'R'").groupBy("l_partkey", "l_suppkey").agg(F.max("l_quantity").alias("m"))
    return a.join(b, ["l_partkey", "l_suppkey"], "left")


@query("semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_join(spark, d):
    return relate.matched_unmatched(load(spark, d, "customer").select("c_custkey"), load(spark, d, "orders").filter("o_totalprice > 300000").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")[0]


@query("anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def anti_join(spark, d):
    return relate.matched_unmatched(load(spark, d, "customer").select("c_custkey"), load(spark, d, "orders").filter("o_totalprice > 300000").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")[1]


@query("dictionary_translation", "SELECT product_category_name AS raw, coalesce(product_category_name_english, product_category_name) AS english FROM category_translation")
def dictionary_translation(spark, d):
    names = load(spark, d, "category_translation")
    base = names.select(F.col("product_category_name").alias("raw"), F.col("product_category_name").alias("english"))
    return relate.lookup(base, "english", names, "product_category_name", "product_category_name_english")


@query("merge_perfect_match", "SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON substr(s_name, 10) = substr(c_name, 10)")
def merge_perfect_match(spark, d):
    s = load(spark, d, "supplier").select("s_suppkey", F.substring("s_name", 10, 100).alias("k"))
    c = load(spark, d, "customer").select("c_custkey", F.substring("c_name", 10, 100).alias("k"))
    return s.join(c, "k").select("s_suppkey", "c_custkey")


def _streets(spark, d):
    """Street names: those of one year's building addresses, and the other year's."""
    known = load(spark, d, "benchmarking_2016").select(F.col("Address").alias("known"))
    new = load(spark, d, "benchmarking_2016").select(F.initcap(F.regexp_replace("Address", "(?i)ave\\b", "Avenue")).alias("street"))
    return new, known


@query("fuzzy_matching")
def fuzzy_matching(spark, d):
    new, known = _streets(spark, d)
    return relate.fuzzy_matching(new, known, "street", "known")


@query("compute_levenshtein_dist")
def compute_levenshtein_dist(spark, d):
    new, known = _streets(spark, d)
    return relate.top_candidates(new, known, "street", "known")


@query("complete_merge", """WITH u AS (SELECT OSEBuildingID AS id, Latitude AS lat, Longitude AS lon FROM benchmarking_2016 UNION ALL SELECT OSEBuildingID + 1000000, Latitude, Longitude FROM benchmarking_2016)
    SELECT id, lat, lon FROM (SELECT *, row_number() OVER (PARTITION BY lat, lon ORDER BY id) AS r FROM u) WHERE r = 1""")
def complete_merge(spark, d):
    a = load(spark, d, "benchmarking_2016").select(F.col("OSEBuildingID").alias("id"), F.col("Latitude").alias("lat"), F.col("Longitude").alias("lon"))
    return relate.complete_merge(a, a.withColumn("id", F.col("id") + 1000000), [F.col("id")]).select("id", "lat", "lon")


@query("build_geocoded_csv", "SELECT upper(OSEBuildingID || ' ' || Address) AS addresses, 'ST' || lpad((OSEBuildingID % 50)::VARCHAR, 3, '0') AS place_uid, Latitude AS lat, -Longitude / 10 AS lon FROM benchmarking_2016 WHERE Latitude > 0 AND Longitude < 0 AND Latitude > -Longitude / 10")
def build_geocoded_csv(spark, d):
    df = load(spark, d, "benchmarking_2016").select((F.col("OSEBuildingID") % 50).alias("station"), "Address", "OSEBuildingID", F.col("Latitude").alias("lat"), (-F.col("Longitude") / 10).alias("lon"))
    return relate.geocoded_table(df.filter("Address is not null"), "ST", "station", "Address", "OSEBuildingID")


@query("compute_geocoding_ratio", "SELECT round((1 - count(DISTINCT Address) FILTER (Latitude < 46.6)::DOUBLE / count(DISTINCT Address)) * 100, 1) AS ratio FROM benchmarking_2016")
def compute_geocoding_ratio(spark, d):
    df = load(spark, d, "benchmarking_2016")
    return relate.geocoding_ratio(df, df.filter("Latitude < 46.6"), "Address")


queries, oracle_sql = query.queries, query.oracle_sql
