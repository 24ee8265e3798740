"""Segmentation, cohorts, behavioural features, ordered analytics, dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import scalars
from sparkloom.operators import rank, segment
from sparkloom.registry import Registry
from sparkloom.sources import load

query = Registry()

_RFM = """
WITH r AS (
  SELECT o_custkey AS customer, date_diff('day', max(o_orderdate)::DATE, (SELECT max(o_orderdate) FROM orders)::DATE) AS recency,
    count(*) AS frequency, round(sum(o_totalprice), 2) AS monetary FROM orders GROUP BY 1
),
q AS (SELECT quantile_cont(recency, [0.25, 0.5, 0.75]) AS rq, quantile_cont(frequency, [0.25, 0.5, 0.75]) AS fq, quantile_cont(monetary, [0.25, 0.5, 0.75]) AS mq FROM r),
s AS (
  SELECT r.*,
    CASE WHEN recency <= rq[1] THEN 4 WHEN recency <= rq[2] THEN 3 WHEN recency <= rq[3] THEN 2 ELSE 1 END AS rs,
    CASE WHEN frequency <= fq[1] THEN 1 WHEN frequency <= fq[2] THEN 2 WHEN frequency <= fq[3] THEN 3 ELSE 4 END AS fs,
    CASE WHEN monetary <= mq[1] THEN 1 WHEN monetary <= mq[2] THEN 2 WHEN monetary <= mq[3] THEN 3 ELSE 4 END AS ms
  FROM r, q
),
l AS (
  SELECT *, rs::VARCHAR || fs::VARCHAR AS code, rs + fs + ms AS score FROM s
),
f AS (
  SELECT *, CASE
    WHEN fs = 4 THEN CASE rs WHEN 4 THEN 'Best customers' WHEN 3 THEN 'Loyal customers' ELSE 'Former best customers' END
    WHEN fs = 3 THEN CASE rs WHEN 4 THEN 'Best customers' WHEN 1 THEN 'Former potential loyalists' ELSE 'Loyal customers' END
    WHEN fs = 2 THEN CASE rs WHEN 1 THEN 'Former potential loyalists' WHEN 2 THEN 'Average customers' ELSE 'Potential loyalists' END
    ELSE CASE rs WHEN 1 THEN 'Churned customers' WHEN 2 THEN 'About to churn' WHEN 3 THEN 'Rising customers' ELSE 'New customers' END END AS segment FROM l
)
"""


def _orders(spark, d):
    return load(spark, d, "orders")


@query("rfm_segments", _RFM + "SELECT segment, count(*) AS customers, round(avg(recency), 2) AS recency, round(avg(frequency), 2) AS frequency, round(avg(monetary), 2) AS monetary FROM f GROUP BY 1")
def rfm_segments(spark, d):
    return segment.segment_summary(segment.rfm_segments(_orders(spark, d), "o_custkey", "o_orderdate", "o_totalprice"))


@query("RFM_score", _RFM + "SELECT customer, recency, frequency, monetary, rs AS recency_score, fs AS frequency_score, ms AS monetary_score, code, score, segment FROM f")
def rfm_score(spark, d):
    return segment.rfm_segments(_orders(spark, d), "o_custkey", "o_orderdate", "o_totalprice")


_COHORT = """
WITH m AS (SELECT DISTINCT o_custkey AS c, date_trunc('month', o_orderdate)::DATE AS month FROM orders),
k AS (SELECT c, month, min(month) OVER (PARTITION BY c) AS cohort FROM m),
n AS (SELECT cohort, date_diff('month', cohort, month) + 1 AS period, count(*) AS customers FROM k GROUP BY 1, 2)
"""


@query("build_retention_matrix", _COHORT + "SELECT cohort, period, customers, round(customers / max(customers) FILTER (period = 1) OVER (PARTITION BY cohort), 6) AS rate FROM n")
def build_retention_matrix(spark, d):
    return segment.retention(_orders(spark, d), "o_custkey", "o_orderdate")


@query("plot_cohort_analysis", _COHORT + ", r AS (SELECT cohort, period, round(customers / max(customers) FILTER (period = 1) OVER (PARTITION BY cohort), 6) AS rate FROM n) SELECT cohort, period, rate, rate < 0.1 AS below FROM r")
def plot_cohort_analysis(spark, d):
    return segment.retention(_orders(spark, d), "o_custkey", "o_orderdate").select("cohort", "period", "rate", (F.col("rate") < 0.1).alias("below"))


@query(
    "seller_features",
    """SELECT l_suppkey, count(l_orderkey) AS rows, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS partners, sum(l_quantity) AS quantity,
    round(count(DISTINCT l_partkey)::DOUBLE / count(l_orderkey), 2) AS unique_share, round(1 - count(DISTINCT l_partkey)::DOUBLE / count(l_orderkey), 2) AS repeat_share FROM lineitem GROUP BY 1""",
)
def seller_features(spark, d):
    return segment.frequency_ratios(load(spark, d, "lineitem"), "l_suppkey", "l_partkey", "l_orderkey", "l_quantity")


@query(
    "recurring_products",
    """WITH n AS (SELECT o_custkey, l_partkey::VARCHAR AS i, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
    SELECT o_custkey, (sum(n) - count(*))::BIGINT AS repeated, CASE WHEN sum(n) = 1 THEN 'none' ELSE arg_min(i, (-n, i)) END AS top FROM n GROUP BY 1""",
)
def recurring_products(spark, d):
    lines = load(spark, d, "lineitem").join(_orders(spark, d), F.col("l_orderkey") == F.col("o_orderkey"))
    return segment.recurring_items(lines, "o_custkey", "l_partkey")


@query(
    "mode_by_group",
    """WITH a AS (SELECT o_custkey, month(o_orderdate)::INT AS v, count(*) AS n FROM orders GROUP BY 1, 2), b AS (SELECT o_custkey, o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1, 2)
    SELECT o_custkey, x.month, y.priority FROM (SELECT o_custkey, arg_min(v, (-n, v)) AS month FROM a GROUP BY 1) x FULL JOIN (SELECT o_custkey, arg_min(v, (-n, v)) AS priority FROM b GROUP BY 1) y USING (o_custkey)""",
)
def mode_by_group(spark, d):
    return segment.mode_by(_orders(spark, d), "o_custkey", {"month": F.month("o_orderdate"), "priority": F.col("o_orderpriority")})


@query(
    "decompose_variable_by_time_scale",
    "SELECT o_custkey, " + ", ".join(f"count(*) FILTER (year(o_orderdate) = {y}) AS \"{y}_count\", round(coalesce(sum(o_totalprice) FILTER (year(o_orderdate) = {y}), 0), 2) AS \"{y}_sum\"" for y in range(1995, 2002)) + " FROM orders GROUP BY 1",
)
def decompose_variable_by_time_scale(spark, d):
    return segment.period_features(_orders(spark, d), "o_custkey", "o_orderdate", "o_totalprice", "year", periods=[str(y) for y in range(1995, 2002)])


@query("customer_averages", "SELECT o_custkey, round(avg(o_totalprice), 4) AS mean_price, count(*) AS n, round(avg(l), 4) AS mean_lines FROM (SELECT o_custkey, o_totalprice, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS l FROM orders) GROUP BY 1")
def customer_averages(spark, d):
    lines = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("l"))
    df = _orders(spark, d).join(lines, "o_orderkey", "left").na.fill(0, ["l"])
    return df.groupBy("o_custkey").agg(F.round(F.avg("o_totalprice"), 4).alias("mean_price"), F.count(F.lit(1)).alias("n"), F.round(F.avg("l"), 4).alias("mean_lines"))


@query(
    "normalize_frequency",
    """SELECT customer_id, frequency FROM (SELECT *, ('0x' || substr(md5(customer_id || '|42'), 1, 8))::BIGINT / 4294967296.0 AS u FROM olist_train_data)
    WHERE u < CASE WHEN frequency = 1 THEN 0.2 WHEN frequency = 2 THEN 0.5 WHEN frequency > 2 THEN 1.0 ELSE 0.0 END""",
)
def normalize_frequency(spark, d):
    return segment.stratified_by_frequency(load(spark, d, "olist_train_data"), "frequency", "customer_id", (0.2, 0.5, 1.0)).select("customer_id", "frequency")


_SHARES = """
WITH c AS (SELECT p_type AS label, count(*) AS coefficient FROM part GROUP BY 1),
s AS (SELECT *, coefficient / (SELECT sum(coefficient) FROM c) AS share, row_number() OVER (ORDER BY coefficient DESC, label) AS rank FROM c),
f AS (SELECT label, coefficient, round(share, 9) AS share, round(sum(share) OVER (ORDER BY rank), 9) AS cumulative, rank::INT AS rank FROM s)
"""


def _importance(spark, d):
    counts = load(spark, d, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
    return rank.features_importance(counts, "p_type", "n").withColumn("share", F.round("share", 9)).withColumn("cumulative", F.round("cumulative", 9))


@query("get_features_importance", _SHARES + "SELECT * FROM f")
def get_features_importance(spark, d):
    return _importance(spark, d)


@query("plot_cumulative_features_importance", _SHARES + "SELECT min(rank) AS rank FROM f WHERE cumulative > 0.9")
def plot_cumulative_features_importance(spark, d):
    return rank.rank_beyond(_importance(spark, d), 0.9)


@query("subplot_feature_importance", _SHARES + "SELECT * FROM f WHERE rank <= (SELECT min(rank) FROM f WHERE cumulative > 0.5)")
def subplot_feature_importance(spark, d):
    return rank.first_ranks(_importance(spark, d), 0.5)


@query("plot_n_top_features", _SHARES + "SELECT label, coefficient FROM f ORDER BY coefficient DESC, label LIMIT 10")
def plot_n_top_features(spark, d):
    return rank.top_n(_importance(spark, d), "coefficient", 10, "label").select("label", "coefficient")


@query("feature_importance_ratio", _SHARES + "SELECT round(sum(coefficient) FILTER (rank <= 10) * 100.0 / sum(coefficient), 2) AS ratio FROM f")
def feature_importance_ratio(spark, d):
    return rank.importance_ratio(_importance(spark, d), 10)


@query(
    "elbow_criterion",
    """WITH c AS (SELECT p_size, count(*) AS n FROM part GROUP BY 1), k AS (SELECT *, sum(n) OVER (ORDER BY p_size) AS c, row_number() OVER (ORDER BY p_size) - 1 AS p FROM c),
    d AS (SELECT p, abs((c - lag(c) OVER (ORDER BY p_size)) * 100.0 / lag(c) OVER (ORDER BY p_size)) AS d FROM k)
    SELECT min(p) + 1 AS position FROM d WHERE d <= (SELECT quantile_cont(d, 0.25) FROM d)""",
)
def elbow_criterion(spark, d):
    return rank.elbow(load(spark, d, "part").groupBy("p_size").agg(F.count(F.lit(1)).alias("n")), "p_size", "n")


@query(
    "plot_questions_tokens_frequency",
    """WITH c AS (SELECT len(regexp_split_to_array(text, '\\s+')) AS size, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1)
    SELECT size, n, round(sum(n) OVER (ORDER BY size) / (SELECT sum(n) FROM c), 9) AS cumulative FROM c""",
)
def plot_questions_tokens_frequency(spark, d):
    df = load(spark, d, "documents").filter("text is not null")
    return rank.length_distribution(df, F.split("text", r"[\t\n\f\r ]+")).withColumn("cumulative", F.round("cumulative", 9))


@query("plot_n_frequent_tokens", """WITH t AS (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS token FROM documents WHERE text IS NOT NULL)
    SELECT token, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM t), 4) AS percent FROM t GROUP BY 1 ORDER BY n DESC, token LIMIT 25""")
def plot_n_frequent_tokens(spark, d):
    return rank.token_frequency(load(spark, d, "documents").filter("text is not null"), F.split("text", r"[\t\n\f\r ]+"), 25)


@query("find_aggregated_place_uid", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) > 1 AS shared FROM lineitem")
def find_aggregated_place_uid(spark, d):
    df = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    counts = df.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return df.join(counts, "l_orderkey").select("l_orderkey", "l_linenumber", (F.col("n") > 1).alias("shared"))


@query("filter_best_candidate", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def filter_best_candidate(spark, d):
    best = F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_totalprice", -F.col("o_orderkey")))
    return _orders(spark, d).groupBy("o_custkey").agg(best.alias("b")).select("o_custkey", "b.*")


@query("decompose_datetime", "SELECT o_orderkey, year(o_orderdate)::INT AS o_year, month(o_orderdate)::INT AS o_month, day(o_orderdate)::INT AS o_day, hour(o_orderdate)::INT AS o_hour, epoch(o_orderdate)::BIGINT AS o_ts FROM orders")
def decompose_datetime(spark, d):
    return scalars.decompose_datetime(_orders(spark, d), {"o_orderdate": "o"}).select("o_orderkey", "o_year", "o_month", "o_day", "o_hour", "o_ts")


_DELAY = "(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) - 60 AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


@query("eval_delivery_date", f"SELECT l_orderkey, l_linenumber, l_partkey, v::INT AS v, CASE WHEN v = 0 THEN 'matched' WHEN v > 0 THEN 'overvalued' ELSE 'undervalued' END AS verdict, greatest(v, 0)::INT AS over, least(v, 0)::INT AS under, CASE WHEN v >= 0 THEN 0 ELSE 1 END AS late FROM {_DELAY}")
def eval_delivery_date(spark, d):
    df = load(spark, d, "lineitem").join(_orders(spark, d), F.col("o_orderkey") == F.col("l_orderkey"))
    v = F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")) - 60
    df = df.select("l_orderkey", "l_linenumber", "l_partkey", v.alias("v"))
    return df.select("*", scalars.delivery_verdict(F.col("v")).alias("verdict"), *scalars.over_under(F.col("v")), scalars.late_flag(F.col("v")).alias("late"))


@query("payment_identity", "SELECT o_orderkey, round(sum(l_extendedprice), 2) AS due, abs(round(sum(l_extendedprice), 2) - o_totalprice) < 0.01 AS same FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_totalprice")
def payment_identity(spark, d):
    due = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("due"))
    return _orders(spark, d).join(due, "o_orderkey").select("o_orderkey", "due", (F.abs(F.col("due") - F.col("o_totalprice")) < 0.01).alias("same"))


@query("repeat_customers_money_share", "WITH c AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY 1) SELECT round(sum(s) FILTER (n > 10) * 100.0 / sum(s), 4) AS share FROM c")
def repeat_customers_money_share(spark, d):
    c = _orders(spark, d).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("s"))
    return c.agg(F.round(F.sum(F.when(F.col("n") > 10, F.col("s"))) * 100.0 / F.sum("s"), 4).alias("share"))


@query("unique_dates_per_customer", "SELECT o_custkey, count(DISTINCT o_orderdate::DATE) AS days FROM orders GROUP BY 1 HAVING count(*) > 1")
def unique_dates_per_customer(spark, d):
    return _orders(spark, d).groupBy("o_custkey").agg(F.countDistinct(F.to_date("o_orderdate")).alias("days"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")


@query("period_counts_side_by_side", """SELECT period, count(*) FILTER (name = 'ordered') AS ordered, count(*) FILTER (name = 'shipped') AS shipped FROM
    (SELECT 'ordered' AS name, month(o_orderdate)::INT AS period FROM orders UNION ALL SELECT 'shipped', month(l_shipdate)::INT FROM lineitem) GROUP BY 1""")
def period_counts_side_by_side(spark, d):
    a = _orders(spark, d).select(F.lit("ordered").alias("name"), F.month("o_orderdate").alias("period"))
    b = load(spark, d, "lineitem").select(F.lit("shipped").alias("name"), F.month("l_shipdate").alias("period"))
    return a.unionAll(b).groupBy("period").pivot("name", ["ordered", "shipped"]).count().na.fill(0)


@query("hour_histogram", "SELECT hour(CreationDate)::INT AS hour, count(*) AS n FROM questions WHERE CreationDate IS NOT NULL GROUP BY 1")
def hour_histogram(spark, d):
    return load(spark, d, "questions").filter("CreationDate is not null").groupBy(F.hour("CreationDate").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "self_join_answers",
    """SELECT q.Id, q.Score, year(q.CreationDate)::INT AS y, month(q.CreationDate)::INT AS m FROM (SELECT DISTINCT * FROM questions) q JOIN (SELECT DISTINCT AnswerId FROM questions WHERE AnswerScore > 0) a ON q.AnswerId = a.AnswerId
    WHERE q.CreationDate IS NOT NULL AND q.AnswerCount > 0""",
)
def self_join_answers(spark, d):
    q = load(spark, d, "questions").distinct()
    a = load(spark, d, "questions").filter("AnswerScore > 0").select("AnswerId").distinct()
    return q.join(a, "AnswerId").filter("CreationDate is not null and AnswerCount > 0").select("Id", "Score", F.year("CreationDate").alias("y"), F.month("CreationDate").alias("m"))


queries, oracle_sql = query.queries, query.oracle_sql
