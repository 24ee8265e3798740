"""Cleaning and profiling operators over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import clean, profile, reshape
from sparkloom.registry import Registry
from sparkloom.sources import load

query = Registry()


def _nulls_sql(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) - count("{c}") AS nulls, round((count(*) - count("{c}")) * 100.0 / count(*), 1) AS ratio FROM {table}""" for c in columns)


DOCUMENT_COLUMNS = ["text", "lang", "source", "author_id", "domain", "n_chars"]


@query("delete_cols", "SELECT r_regionkey FROM region")
def delete_cols(spark, d):
    return clean.drop_columns(load(spark, d, "region"), ["r_name"])


@query("filter_variable_values", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45")
def filter_variable_values(spark, d):
    return clean.filter_values(load(spark, d, "lineitem"), "l_quantity", "ge", 45).select("l_orderkey", "l_linenumber", "l_quantity")


@query("filter_variable_values_neq", "SELECT doc_id, lang FROM documents WHERE lang IS DISTINCT FROM 'en'")
def filter_variable_values_neq(spark, d):
    return clean.filter_values(load(spark, d, "documents"), "lang", "neq", "en").select("doc_id", "lang")


@query("find_non_common_null_values", "SELECT lang, text FROM documents WHERE lang IS NULL AND text IS NOT NULL")
def find_non_common_null_values(spark, d):
    return clean.null_where_other_is_not(load(spark, d, "documents"), "lang", "text")


@query("nan_count", _nulls_sql("documents", DOCUMENT_COLUMNS))
def nan_count(spark, d):
    return clean.null_counts(load(spark, d, "documents"), DOCUMENT_COLUMNS)


@query("drop_columns_with_few_data", 'SELECT OSEBuildingID, PropertyName FROM benchmarking_2016')
def drop_columns_with_few_data(spark, d):
    return clean.drop_sparse_columns(load(spark, d, "benchmarking_2016").select("OSEBuildingID", "PropertyName", "Comments"))


@query("drop_constant_columns", "SELECT OSEBuildingID, PropertyName FROM benchmarking_2016")
def drop_constant_columns(spark, d):
    return clean.drop_constant_columns(load(spark, d, "benchmarking_2016").select("OSEBuildingID", "DataYear", "PropertyName", "Comments"))


@query("get_unique_values", "SELECT DISTINCT lang FROM documents")
def get_unique_values(spark, d):
    return clean.unique_values(load(spark, d, "documents"), "lang")


@query(
    "distinct_counts",
    " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(DISTINCT {c}) + max(({c} IS NULL)::INT) AS "distinct" FROM documents""" for c in ["lang", "source", "domain", "author_id"]),
)
def distinct_counts(spark, d):
    return clean.distinct_counts(load(spark, d, "documents"), ["lang", "source", "domain", "author_id"])


@query("check_low_cardinality", "SELECT count(DISTINCT lang) + max((lang IS NULL)::INT) AS \"distinct\", count(*) AS total, (count(DISTINCT lang) + max((lang IS NULL)::INT)) / count(*) < 0.5 AS low FROM documents")
def check_low_cardinality(spark, d):
    return clean.is_low_cardinality(load(spark, d, "documents"), "lang")


@query("dropna_any", "SELECT customer_id, recency, frequency, monetary_value FROM olist_train_data WHERE customer_id IS NOT NULL AND recency IS NOT NULL AND frequency IS NOT NULL AND monetary_value IS NOT NULL")
def dropna_any(spark, d):
    return load(spark, d, "olist_train_data").select("customer_id", "recency", "frequency", "monetary_value").na.drop("any")


@query("fillna", "SELECT doc_id, coalesce(lang, 'und') AS lang FROM documents")
def fillna(spark, d):
    return load(spark, d, "documents").select("doc_id", "lang").na.fill("und", ["lang"])


@query("drop_duplicates", "SELECT DISTINCT * FROM olist_train_data")
def drop_duplicates(spark, d):
    return load(spark, d, "olist_train_data").distinct()


@query("drop_duplicates_subset", "SELECT c_custkey, c_nationkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS r FROM customer) WHERE r = 1")
def drop_duplicates_subset(spark, d):
    return clean.drop_duplicates_by(load(spark, d, "customer"), ["c_nationkey", "c_mktsegment"], [F.col("c_custkey")]).select("c_custkey", "c_nationkey", "c_mktsegment")


@query(
    "drop_duplicates_for_each_col",
    """WITH a AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part),
    b AS (SELECT * EXCLUDE (r), row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS r FROM a WHERE r = 1)
    SELECT p_partkey, p_brand, p_size FROM b WHERE r = 1""",
)
def drop_duplicates_for_each_col(spark, d):
    return clean.drop_duplicates_in_turn(load(spark, d, "part"), ["p_brand", "p_size"], [F.col("p_partkey")]).select("p_partkey", "p_brand", "p_size")


@query("filter_underpopulated_classes", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) = 5)")
def filter_underpopulated_classes(spark, d):
    return clean.drop_class_of_size(load(spark, d, "orders"), "o_custkey", 5).select("o_orderkey", "o_custkey")


@query("optimize_data_types", "SELECT l_linenumber, l_orderkey, l_quantity, l_returnflag FROM lineitem")
def optimize_data_types(spark, d):
    out = clean.narrow_types(load(spark, d, "lineitem").select("l_linenumber", "l_orderkey", "l_quantity", "l_returnflag"))
    return out.select(F.col("l_linenumber").cast("int"), F.col("l_orderkey").cast("long"), F.col("l_quantity").cast("double"), "l_returnflag")


@query("convert_string_to_boolean", "SELECT o_orderkey, lower(o_orderstatus) = 'f' AS flag FROM orders")
def convert_string_to_boolean(spark, d):
    return load(spark, d, "orders").select("o_orderkey", (F.lower("o_orderstatus") == "f").alias("flag"))


@query("translate_col_values_by_regex", "SELECT p_partkey, regexp_replace(regexp_replace(p_type, '^[A-Z]+ ', '', 'g'), '[AEIOU]', '_', 'g') AS p_type FROM part")
def translate_col_values_by_regex(spark, d):
    return load(spark, d, "part").select("p_partkey", clean.translate_by_regex(F.col("p_type"), {"^[A-Z]+ ": "", "[AEIOU]": "_"}).alias("p_type"))


@query("row_any_isin", "SELECT OSEBuildingID, YearBuilt, DataYear FROM benchmarking_2015 WHERE NOT (coalesce(YearBuilt IN (1900, 2000), false) OR coalesce(DataYear IN (1900, 2000), false))")
def row_any_isin(spark, d):
    return load(spark, d, "benchmarking_2015").filter(~clean.row_has_any(["YearBuilt", "DataYear"], [1900, 2000])).select("OSEBuildingID", "YearBuilt", "DataYear")


@query("union_of_years", "SELECT OSEBuildingID, DataYear, TotalGHGEmissions FROM (SELECT OSEBuildingID, DataYear, NULL::DOUBLE AS TotalGHGEmissions FROM benchmarking_2015 UNION ALL SELECT OSEBuildingID, DataYear, TotalGHGEmissions FROM benchmarking_2016)")
def union_of_years(spark, d):
    return clean.union_by_name(load(spark, d, "benchmarking_2015"), load(spark, d, "benchmarking_2016")).select("OSEBuildingID", "DataYear", "TotalGHGEmissions")


@query("text_clean", "SELECT OSEBuildingID, upper(left(t, 1)) || lower(substr(t, 2)) AS neighborhood FROM (SELECT OSEBuildingID, trim(replace(Neighborhood, chr(10), ' ')) AS t FROM benchmarking_2015)")
def text_clean(spark, d):
    t = F.trim(F.replace("Neighborhood", F.lit("\n"), F.lit(" ")))
    return load(spark, d, "benchmarking_2015").select("OSEBuildingID", F.concat(F.upper(F.left(t, F.lit(1))), F.lower(F.substring(t, 2, 10**6))).alias("neighborhood"))


@query(
    "measures_table",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c})::DOUBLE AS min, quantile_cont({c}, 0.25)::DOUBLE AS q1, quantile_cont({c}, 0.5)::DOUBLE AS median, quantile_cont({c}, 0.75)::DOUBLE AS q3, max({c})::DOUBLE AS max FROM lineitem"""
        for c in ["l_quantity", "l_extendedprice", "l_discount"]
    ),
)
def measures_table(spark, d):
    out = profile.measures(load(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return out.withColumn("mean", F.round("mean", 4)).withColumn("std", F.round("std", 4))


@query(
    "measures_table_text",
    """WITH c AS (SELECT p_type AS v, count(*) AS n FROM part WHERE p_type IS NOT NULL GROUP BY 1)
    SELECT sum(n)::BIGINT AS count, count(*) AS "unique", (SELECT v FROM c ORDER BY n DESC, v LIMIT 1) AS top, max(n) AS freq FROM c""",
)
def measures_table_text(spark, d):
    return profile.text_measures(load(spark, d, "part"), "p_type")


@query("central_tendency_measure", "SELECT round(avg(o_totalprice), 4) AS mean, median(o_totalprice) AS median FROM orders")
def central_tendency_measure(spark, d):
    return profile.central_tendency(load(spark, d, "orders"), "o_totalprice").withColumn("mean", F.round("mean", 4))


@query("central_tendency_mode", "WITH c AS (SELECT p_size, count(*) AS n FROM part GROUP BY 1) SELECT p_size, n FROM c WHERE n = (SELECT max(n) FROM c)")
def central_tendency_mode(spark, d):
    return profile.modes(load(spark, d, "part"), "p_size")


@query("dispersion_measure", "SELECT round(var_samp(o_totalprice), 1) AS var, round(stddev_samp(o_totalprice), 4) AS std, round(stddev_samp(o_totalprice) / avg(o_totalprice), 6) AS cv FROM orders")
def dispersion_measure(spark, d):
    return profile.dispersion(load(spark, d, "orders"), "o_totalprice").select(F.round("var", 1).alias("var"), F.round("std", 4).alias("std"), F.round("cv", 6).alias("cv"))


@query(
    "dispersion_gini",
    """WITH o AS (SELECT sum(o_totalprice) OVER (ORDER BY o_totalprice, o_orderkey) / sum(o_totalprice) OVER () AS l, count(*) OVER () AS n FROM orders)
    SELECT round(2 * (0.5 - (sum(l) - 0.5) / any_value(n)), 6) AS gini FROM o""",
)
def dispersion_gini(spark, d):
    return profile.gini(load(spark, d, "orders"), "o_totalprice").select(F.round("gini", 6).alias("gini"))


@query("shape_measure", "SELECT round(skewness(o_totalprice), 6) AS skew, round(kurtosis(o_totalprice), 6) AS kurtosis FROM orders")
def shape_measure(spark, d):
    return profile.shape(load(spark, d, "orders"), "o_totalprice").select(F.round("skew", 6).alias("skew"), F.round("kurtosis", 6).alias("kurtosis"))


@query("percentage_change", "SELECT OSEBuildingID, round((b - a) * 100.0 / nullif(a, 0), 2) AS change, round(abs(a - b) * 100.0 / nullif((a + b) / 2, 0), 2) AS diff FROM (SELECT OSEBuildingID, \"SiteEnergyUse(kBtu)\" AS a, \"Electricity(kBtu)\" AS b FROM benchmarking_2016)")
def percentage_change(spark, d):
    df = load(spark, d, "benchmarking_2016").select("OSEBuildingID", F.col("`SiteEnergyUse(kBtu)`").alias("a"), F.col("`Electricity(kBtu)`").alias("b"))
    return df.select("OSEBuildingID", profile.percentage_change(F.col("a"), F.col("b")).alias("change"), profile.percentage_difference(F.col("a"), F.col("b")).alias("diff"))


@query("get_centroids_from_categories", "SELECT c_mktsegment, round(median(c_acctbal), 4) AS c_acctbal, median(c_custkey) AS c_custkey FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1")
def get_centroids_from_categories(spark, d):
    return profile.group_medians(load(spark, d, "customer"), "c_mktsegment", ["c_acctbal", "c_custkey"]).withColumn("c_acctbal", F.round("c_acctbal", 4))


@query("plot_n_top_values", "SELECT p_type AS value, count(*) AS n, round(count(*) * 100.0 / (SELECT count(p_type) FROM part), 1) AS percent FROM part WHERE p_type IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def plot_n_top_values(spark, d):
    return profile.value_counts(load(spark, d, "part"), "p_type", top=10)


@query("count_plot", "SELECT event_type AS value, count(*) AS n, round(count(*) * 100.0 / (SELECT count(event_type) FROM olist_train_events), 1) AS percent FROM olist_train_events WHERE event_type IS NOT NULL GROUP BY 1")
def count_plot(spark, d):
    return profile.value_counts(load(spark, d, "olist_train_events"), "event_type")


@query("frequency_count", "WITH f AS (SELECT o_custkey, count(*) AS frequency FROM orders GROUP BY 1) SELECT frequency, count(DISTINCT o_custkey) AS keys, round(count(DISTINCT o_custkey) * 100.0 / (SELECT count(*) FROM f), 3) AS percent FROM f GROUP BY 1")
def frequency_count(spark, d):
    orders = load(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("frequency"))
    return profile.frequency_count(orders, "o_custkey", "frequency")


@query("gaz_and_energy_groupby", 'SELECT BuildingType, round(sum("NaturalGas(kBtu)"), 2) AS sum_a, round(sum("SiteEnergyUse(kBtu)"), 2) AS sum_b, round(sum("NaturalGas(kBtu)") * 100.0 / sum("SiteEnergyUse(kBtu)"), 2) AS ratio FROM benchmarking_2016 GROUP BY 1')
def gaz_and_energy_groupby(spark, d):
    out = profile.sum_ratio(load(spark, d, "benchmarking_2016"), "BuildingType", "`NaturalGas(kBtu)`", "`SiteEnergyUse(kBtu)`")
    return out.withColumn("sum_a", F.round("sum_a", 2)).withColumn("sum_b", F.round("sum_b", 2))


@query("contingency_table", "SELECT l_returnflag, l_linestatus, count(*) AS n, GROUPING(l_returnflag, l_linestatus)::INT AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def contingency_table(spark, d):
    return profile.contingency(load(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@query("plot_radars", "WITH s AS (SELECT l_returnflag, sum(l_tax) AS l_tax, sum(l_discount) AS l_discount FROM lineitem GROUP BY 1) SELECT l_returnflag, round(l_tax * 100.0 / (l_tax + l_discount), 1) AS l_tax, round(l_discount * 100.0 / (l_tax + l_discount), 1) AS l_discount FROM s")
def plot_radars(spark, d):
    return profile.row_shares(load(spark, d, "lineitem"), "l_returnflag", ["l_tax", "l_discount"])


_BUCKET = "CASE WHEN hi > lo THEN least(floor(({x} - lo) / ((hi - lo) / 10)) + 1, 10) ELSE 1 END::INT"


@query(
    "plot_empirical_distribution",
    f"""WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS t FROM orders)
    SELECT {_BUCKET.format(x="o_totalprice")} AS bin, count(*) AS n, round(count(*) / (any_value(t) * (any_value(hi) - any_value(lo)) / 10), 12) AS density FROM orders, e GROUP BY 1""",
)
def plot_empirical_distribution(spark, d):
    return profile.histogram(load(spark, d, "orders"), "o_totalprice").withColumn("density", F.round("density", 12))


@query(
    "plot_hist_by_cat",
    f"""WITH e AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)
    SELECT c_mktsegment, {_BUCKET.format(x="c_acctbal")} AS bin, count(*) AS n FROM customer, e GROUP BY 1, 2""",
)
def plot_hist_by_cat(spark, d):
    return profile.histogram(load(spark, d, "customer"), "c_acctbal", by="c_mktsegment").drop("density")


@query(
    "plot_hist_subplots",
    " UNION ALL ".join(f"SELECT '{c}' AS variable, {_BUCKET.format(x=c)} AS bin, count(*) AS n FROM lineitem, (SELECT min({c}) AS lo, max({c}) AS hi FROM lineitem) GROUP BY 2" for c in ["l_quantity", "l_extendedprice"]),
)
def plot_hist_subplots(spark, d):
    return profile.histograms(load(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])


@query(
    "plot_dispersion",
    """WITH q AS (SELECT c_mktsegment AS s, quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.5) AS median, quantile_cont(c_acctbal, 0.75) AS q3, avg(c_acctbal) AS mean FROM customer GROUP BY 1)
    SELECT c_mktsegment, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, round(mean, 4) AS mean,
      min(c_acctbal) FILTER (c_acctbal BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS low,
      max(c_acctbal) FILTER (c_acctbal BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS high
    FROM customer JOIN q ON s = c_mktsegment GROUP BY ALL""",
)
def plot_dispersion(spark, d):
    out = profile.box_stats(load(spark, d, "customer"), "c_mktsegment", "c_acctbal")
    return out.select("c_mktsegment", *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3", "mean")], "low", "high")


@query("plot_pie_subplots", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2")
def plot_pie_subplots(spark, d):
    return load(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("plot_time_serie", "SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1")
def plot_time_serie(spark, d):
    return profile.daily_counts(load(spark, d, "orders"), "o_orderdate")


@query(
    "plot_time_serie_subplots",
    """WITH g AS (SELECT o_orderpriority, o_orderdate::DATE AS day, count(o_totalprice) AS count, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median, max(o_totalprice) AS max, min(o_totalprice) AS min FROM orders GROUP BY 1, 2)
    SELECT *, (max(day) OVER (PARTITION BY o_orderpriority) - min(day) OVER (PARTITION BY o_orderpriority))::INT AS lifetime FROM g""",
)
def plot_time_serie_subplots(spark, d):
    out = profile.daily_by_category(load(spark, d, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice")
    return out.withColumn("mean", F.round("mean", 4)).withColumn("median", F.round("median", 4))


_SCAN = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{t}' AS type, count(*) AS rows, count(*) - count({c}) AS nulls, min({c})::VARCHAR AS min, max({c})::VARCHAR AS max FROM documents"""
    for c, t in (("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"), ("author_id", "string"), ("domain", "string"))
)


@query("data_scan", _SCAN)
def data_scan(spark, d):
    """The scan without its approximate counts of distinct values (see data_info) and without timestamps, which print differently."""
    return profile.profile(load(spark, d, "documents").drop("created_at", "ingested_at")).drop("approx_distinct")


@query("data_info")
def data_info(spark, d):
    return profile.profile(load(spark, d, "documents"))


@query("get_dummy_indicators", "SELECT o_orderkey, " + ", ".join(f"(o_orderstatus = '{v}')::INT AS {v}" for v in "FOP") + " FROM orders")
def get_dummy_indicators(spark, d):
    return reshape.indicators(load(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus")


@query("categorize_target", """WITH q AS (SELECT quantile_cont(o_totalprice, 1.0 / 3) AS a, quantile_cont(o_totalprice, 2.0 / 3) AS b FROM orders)
    SELECT o_orderkey, CASE WHEN o_totalprice <= a THEN 'low' WHEN o_totalprice <= b THEN 'medium' ELSE 'high' END AS bin FROM orders, q""")
def categorize_target(spark, d):
    return reshape.quantile_bins(load(spark, d, "orders"), "o_totalprice", 3, ["low", "medium", "high"]).select("o_orderkey", "bin")


@query(
    "quantile_bin_labels",
    """WITH q AS (SELECT quantile_cont(p_retailprice, [0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1]) AS q FROM part),
    b AS (SELECT list_filter(range(1, 9), lambda i: p_retailprice <= q[i + 1])[1] AS i, q FROM part, q) SELECT round(q[i], 2)::VARCHAR || '-' || round(q[i + 1], 2)::VARCHAR AS bin, count(*) AS n FROM b GROUP BY 1""",
)
def quantile_bin_labels(spark, d):
    return reshape.quantile_bins(load(spark, d, "part"), "p_retailprice", 8).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query("add_row_index", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS id FROM orders")
def add_row_index(spark, d):
    return reshape.with_row_number(load(spark, d, "orders"), "id", [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", "id")


@query("get_geometric_difference", "SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)")
def get_geometric_difference(spark, d):
    lines = load(spark, d, "lineitem").withColumnRenamed("l_partkey", "k")
    return reshape.difference(lines, lines.filter("l_quantity > 40"), "k")


@query("energy_shares", """SELECT OSEBuildingID, round("Electricity(kBtu)" * 100.0 / nullif("SiteEnergyUse(kBtu)", 0), 1) AS electricity_share, CASE WHEN "Electricity(kBtu)" / nullif("SiteEnergyUse(kBtu)", 0) > 0.5 THEN 1 ELSE 0 END AS mainly_electric FROM benchmarking_2016""")
def energy_shares(spark, d):
    df = load(spark, d, "benchmarking_2016")
    ratio = F.try_divide(F.col("`Electricity(kBtu)`"), F.col("`SiteEnergyUse(kBtu)`"))
    share = F.round(F.try_divide(F.col("`Electricity(kBtu)`") * 100.0, F.col("`SiteEnergyUse(kBtu)`")), 1)
    return df.select("OSEBuildingID", share.alias("electricity_share"), F.when(ratio > 0.5, 1).otherwise(0).alias("mainly_electric"))


@query("labels_until_share", """WITH c AS (SELECT event_type, count(*) AS n FROM olist_train_events WHERE event_type IS NOT NULL GROUP BY 1),
    s AS (SELECT *, sum(n) OVER (ORDER BY n DESC, event_type) / (SELECT sum(n) FROM c) AS cumulative FROM c)
    SELECT event_type, n, round(cumulative, 9) AS cumulative FROM s WHERE cumulative <= 0.5""")
def labels_until_share(spark, d):
    return reshape.labels_until_share(load(spark, d, "olist_train_events"), "event_type", 0.5).withColumn("cumulative", F.round("cumulative", 9))


queries, oracle_sql = query.queries, query.oracle_sql
