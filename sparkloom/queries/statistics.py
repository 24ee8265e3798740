"""Statistics, scaling and evaluation with SQL; models rows-only."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import evaluate, ml, scale, stats, supervised
from sparkloom.registry import Registry
from sparkloom.sources import load

query = Registry()

_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PAIRS = [(a, b) for i, a in enumerate(_COLUMNS) for b in _COLUMNS[i + 1 :]]


@query("correlation_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) AS r FROM lineitem" for a, b in _PAIRS))
def correlation_matrix(spark, d):
    return stats.correlations(load(spark, d, "lineitem"), _COLUMNS).withColumn("r", F.round("r", 8))


@query("get_top_n_correlations", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) AS r FROM lineitem" for a, b in _PAIRS) + ") ORDER BY abs(r) DESC LIMIT 3")
def get_top_n_correlations(spark, d):
    return stats.top_correlations(load(spark, d, "lineitem"), _COLUMNS, 3, absolute=True).withColumn("r", F.round("r", 8))


@query("pearson_correlation", "SELECT round(corr(l_quantity, l_extendedprice), 2) AS r, round(covar_samp(l_quantity, l_extendedprice), 2) AS covariance FROM lineitem")
def pearson_correlation(spark, d):
    return stats.pearson(load(spark, d, "lineitem"), "l_quantity", "l_extendedprice")


@query("filter_correlated_features", "SELECT p_partkey, p_size FROM part")
def filter_correlated_features(spark, d):
    df = load(spark, d, "part").select("p_partkey", "p_size", (F.col("p_size") * 2.0 + 1).alias("twice"))
    return df.drop(*stats.correlated_features(df, ["p_partkey", "p_size", "twice"], 0.9))


@query("filter_invalid_variances", "SELECT p_size, copy FROM (SELECT p_size::DOUBLE AS p_size, p_partkey AS copy FROM part)")
def filter_invalid_variances(spark, d):
    df = load(spark, d, "part").select(F.col("p_size").cast("double").alias("p_size"), F.lit(1.0).alias("one"), (F.col("p_size") + 0.0).alias("again"), F.col("p_partkey").alias("copy"))
    return df.drop(*stats.invalid_variance_features(df, ["p_size", "one", "again", "copy"], keep="first"))


@query(
    "anova_correlation_ratio",
    f"""WITH g AS (SELECT c_mktsegment AS x, c_acctbal AS y, avg(c_acctbal) OVER (PARTITION BY c_mktsegment) AS m, avg(c_acctbal) OVER () AS t FROM customer),
    s AS (SELECT count(DISTINCT x) AS groups, count(*) AS n, sum((m - t) * (m - t)) AS b, sum((y - m) * (y - m)) AS w FROM g)
    SELECT groups, n, round(b / (b + w), 8) AS eta2, round((b / (groups - 1)) / (w / (n - groups)), 6) AS f, groups - 1 AS df1, n - groups AS df2 FROM s""",
)
def anova_correlation_ratio(spark, d):
    return stats.anova(load(spark, d, "customer"), "c_acctbal", "c_mktsegment").withColumn("eta2", F.round("eta2", 8)).withColumn("f", F.round("f", 6))


@query(
    "homoscedasticity_levene",
    """WITH z AS (SELECT c_mktsegment AS x, abs(c_acctbal - median(c_acctbal) OVER (PARTITION BY c_mktsegment)) AS y FROM customer),
    g AS (SELECT x, y, avg(y) OVER (PARTITION BY x) AS m, avg(y) OVER () AS t FROM z),
    s AS (SELECT count(DISTINCT x) AS groups, count(*) AS n, sum((m - t) * (m - t)) AS b, sum((y - m) * (y - m)) AS w FROM g)
    SELECT groups, n, round((b / (groups - 1)) / (w / (n - groups)), 6) AS f FROM s""",
)
def homoscedasticity_levene(spark, d):
    return stats.levene(load(spark, d, "customer"), "c_acctbal", "c_mktsegment").select("groups", "n", F.round("f", 6).alias("f"))


# five groups: the tail of F with four degrees of freedom above has a closed form
@query(
    "anova_test",
    """WITH g AS (SELECT c_mktsegment AS x, c_acctbal AS y, avg(c_acctbal) OVER (PARTITION BY c_mktsegment) AS m, avg(c_acctbal) OVER () AS t FROM customer),
    s AS (SELECT count(*) AS n, sum((m - t) * (m - t)) AS b, sum((y - m) * (y - m)) AS w FROM g), f AS (SELECT (b / 4) / (w / (n - 5)) AS f, b / (b + w) AS e, (n - 5) / 2.0 AS h FROM s),
    p AS (SELECT f, e, round(pow(2 * h / (2 * h + 4 * f), h) * (1 + h * (1 - 2 * h / (2 * h + 4 * f))), 3) AS p FROM f)
    SELECT round(f, 6) AS f, p, round(e, 8) AS eta2, p < 0.05 AS reject FROM p""",
)
def anova_test(spark, d):
    r = stats.anova_test(load(spark, d, "customer"), "c_acctbal", "c_mktsegment")
    return spark.createDataFrame([(round(r["f"], 6), r["p"], round(r["eta2"], 8), r["reject"])], "f double, p double, eta2 double, reject boolean")


@query(
    "homoscedasticity_bartlett",
    """WITH g AS (SELECT count(*) AS n, var_samp(c_acctbal) AS v FROM customer GROUP BY c_mktsegment), s AS (SELECT count(*) AS k, sum(n) AS n, sum((n - 1) * v) AS w, sum((n - 1) * ln(v)) AS l, sum(1.0::DOUBLE / (n - 1)) AS i FROM g),
    t AS (SELECT ((n - k) * ln(w / (n - k)) - l) / (1 + (i - 1.0::DOUBLE / (n - k)) / (3 * (k - 1))) AS s FROM s)
    SELECT round(s, 6) AS statistic, round(exp(-s / 2) * (1 + s / 2), 6) AS p FROM t""",
)
def homoscedasticity_bartlett(spark, d):
    r = stats.bartlett(load(spark, d, "customer"), "c_acctbal", "c_mktsegment")
    return spark.createDataFrame([(round(r["statistic"], 6), round(r["p"], 6))], "statistic double, p double")


@query(
    "chi_2_heatmap",
    """WITH c AS (SELECT l_returnflag AS x, l_linestatus AS y, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT x, sum(n) AS nx FROM c GROUP BY 1), k AS (SELECT y, sum(n) AS ny FROM c GROUP BY 1),
    g AS (SELECT x, y, coalesce(n, 0) AS n, nx * ny / (SELECT sum(n) FROM c)::DOUBLE AS e FROM r CROSS JOIN k LEFT JOIN c USING (x, y))
    SELECT x, y, n, round(e, 6) AS expected, round((n - e) * (n - e) / e, 6) AS contribution FROM g""",
)
def chi_2_heatmap(spark, d):
    return stats.chi2_cells(load(spark, d, "lineitem"), "l_returnflag", "l_linestatus").withColumn("expected", F.round("expected", 6)).withColumn("contribution", F.round("contribution", 6))


@query(
    "chi_2_test",
    """WITH c AS (SELECT o_orderstatus AS x, o_orderpriority AS y, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT x, sum(n) AS nx FROM c GROUP BY 1), k AS (SELECT y, sum(n) AS ny FROM c GROUP BY 1),
    e AS (SELECT coalesce(n, 0) AS n, nx * ny / (SELECT sum(n) FROM c)::DOUBLE AS e FROM r CROSS JOIN k LEFT JOIN c USING (x, y)), s AS (SELECT sum((n - e) * (n - e) / e) AS s, count(*) AS cells FROM e),
    p AS (SELECT s, exp(-s / 2) * (1 + s / 2 + (s / 2) ^ 2 / 2 + (s / 2) ^ 3 / 6) AS p FROM s)
    SELECT round(s, 6) AS statistic, 8::INT AS dof, round(p, 6) AS p, p < 0.05 AS reject FROM p""",
)
def chi_2_test(spark, d):
    r = stats.chi2_test(load(spark, d, "orders"), "o_orderstatus", "o_orderpriority")
    return spark.createDataFrame([(round(r["statistic"], 6), r["dof"], round(r["p"], 6), r["reject"])], "statistic double, dof int, p double, reject boolean")


@query("plot_linear_regression", "SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2 FROM lineitem")
def plot_linear_regression(spark, d):
    out = stats.linear_regression(load(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return out.select(F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 8).alias("r2"))


@query("plot_residuals", "SELECT p_partkey, round(p_retailprice - (b + a * p_size), 4) AS residual FROM part, (SELECT regr_slope(p_retailprice, p_size) AS a, regr_intercept(p_retailprice, p_size) AS b FROM part)")
def plot_residuals(spark, d):
    return stats.residuals(load(spark, d, "part"), "p_size", "p_retailprice").select("p_partkey", F.round("residual", 4).alias("residual"))


@query(
    "plot_norm_subplots",
    """WITH g AS (SELECT -2 + 4.0::DOUBLE * i / 80 AS p FROM generate_series(0, 80) t(i)), x AS (SELECT o_totalprice AS x FROM orders WHERE o_totalprice > 0),
    v AS (SELECT p, count(*) AS n, sum(ln(x)) AS l, var_pop(CASE WHEN abs(p) < 1e-12 THEN ln(x) ELSE (pow(x, p) - 1) / p END) AS v FROM g, x GROUP BY p)
    SELECT round(arg_max(p, -n / 2 * ln(v) + (p - 1) * l), 6) AS power FROM v""",
)
def plot_norm_subplots(spark, d):
    return spark.createDataFrame([(round(stats.box_cox(load(spark, d, "orders"), "o_totalprice"), 6),)], "power double")


@query("min_max_scaler", "SELECT o_orderkey, round((o_totalprice - lo) / (hi - lo), 8) AS o_totalprice FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)")
def min_max_scaler(spark, d):
    df = load(spark, d, "orders")
    return scale.min_max(df, ["o_totalprice"]).apply(df).select("o_orderkey", F.round("o_totalprice", 8).alias("o_totalprice"))


@query("standard_scaler", "SELECT o_orderkey, round((o_totalprice - m) / s, 6) AS o_totalprice FROM orders, (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders)")
def standard_scaler(spark, d):
    df = load(spark, d, "orders")
    return scale.standard(df, ["o_totalprice"]).apply(df).select("o_orderkey", F.round("o_totalprice", 6).alias("o_totalprice"))


@query("robust_scaler", "SELECT o_orderkey, round((o_totalprice - m) / (b - a), 6) AS o_totalprice FROM orders, (SELECT median(o_totalprice) AS m, quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders)")
def robust_scaler(spark, d):
    df = load(spark, d, "orders")
    return scale.robust(df, ["o_totalprice"]).apply(df).select("o_orderkey", F.round("o_totalprice", 6).alias("o_totalprice"))


@query("reverse_standardization", "SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders")
def reverse_standardization(spark, d):
    df = load(spark, d, "orders")
    s = scale.standard(df, ["o_totalprice"])
    return s.reverse(s.apply(df)).select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("log_scaler", "SELECT o_orderkey, round(ln(1 + o_totalprice), 8) AS o_totalprice FROM orders")
def log_scaler(spark, d):
    return scale.log1p(load(spark, d, "orders"), ["o_totalprice"]).select("o_orderkey", F.round("o_totalprice", 8).alias("o_totalprice"))


@query("log_scaling", "SELECT c_custkey, round(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) ELSE c_acctbal END, 8) AS c_acctbal FROM customer")
def log_scaling(spark, d):
    return scale.log_positive(load(spark, d, "customer"), ["c_acctbal"]).select("c_custkey", F.round("c_acctbal", 8).alias("c_acctbal"))


@query("polynomial_scaler", 'SELECT p_partkey, 1.0::DOUBLE AS "1", round(p_size * p_size, 4)::DOUBLE AS "p_size*p_size", round(p_size * p_retailprice, 4) AS "p_size*p_retailprice", round(p_retailprice * p_retailprice, 2) AS "p_retailprice*p_retailprice" FROM part')
def polynomial_scaler(spark, d):
    df = load(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    out = scale.polynomial(df, ["p_size", "p_retailprice"])
    return out.select("p_partkey", "1", F.round("`p_size*p_size`", 4).alias("p_size*p_size"), F.round("`p_size*p_retailprice`", 4).alias("p_size*p_retailprice"), F.round("`p_retailprice*p_retailprice`", 2).alias("p_retailprice*p_retailprice"))


_SCORED = "SELECT l_returnflag = 'R' AS y, l_extendedprice * (1 + l_discount) AS s, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS p FROM lineitem"


def _scored(spark, d):
    df = load(spark, d, "lineitem")
    return df.select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_extendedprice") * (1 + F.col("l_discount"))).alias("s"), F.when(F.col("l_quantity") > 25, 1).otherwise(0).alias("p"))


@query("get_confusion_matrix", f"SELECT count(*) FILTER (NOT y AND p = 0) AS tn, count(*) FILTER (NOT y AND p = 1) AS fp, count(*) FILTER (y AND p = 0) AS fn, count(*) FILTER (y AND p = 1) AS tp FROM ({_SCORED})")
def get_confusion_matrix(spark, d):
    return evaluate.binary_counts(_scored(spark, d), "y", "p")


@query("plot_confusion_matrix", f"SELECT y::INT AS label, p AS prediction, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY y), 2) AS share FROM ({_SCORED}) GROUP BY y, p")
def plot_confusion_matrix(spark, d):
    return evaluate.confusion(_scored(spark, d), "y", "p", normalise=True)


@query(
    "plot_roc_curve",
    f"""WITH g AS (SELECT s, count(*) AS n, sum(y::INT) AS p FROM ({_SCORED}) GROUP BY 1), c AS (SELECT s, sum(n) OVER w AS n, sum(p) OVER w AS p FROM g WINDOW w AS (ORDER BY s DESC)), t AS (SELECT sum(n) AS t, sum(p) AS tp FROM g)
    SELECT round(s, 6) AS threshold, round((n - p) / (t - tp)::DOUBLE, 8) AS fpr, round(p / tp::DOUBLE, 8) AS tpr, round(n / t::DOUBLE, 8) AS share FROM c, t""",
)
def plot_roc_curve(spark, d):
    out = evaluate.roc(_scored(spark, d), "y", "s")
    return out.select(F.round("threshold", 6).alias("threshold"), *[F.round(c, 8).alias(c) for c in ("fpr", "tpr", "share")])


@query("auc", f"WITH r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM ({_SCORED})) SELECT round((sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 8)::DOUBLE AS auc FROM r")
def auc(spark, d):
    return evaluate.auc(_scored(spark, d), "y", "s").select(F.round("auc", 8).alias("auc"))


@query(
    "plot_lift_curve",
    f"""WITH g AS (SELECT s, count(*) AS n, sum(y::INT) AS p FROM ({_SCORED}) GROUP BY 1), c AS (SELECT s, sum(n) OVER w AS n, sum(p) OVER w AS p FROM g WINDOW w AS (ORDER BY s DESC)), t AS (SELECT sum(n) AS t, sum(p) AS tp FROM g)
    SELECT round(s, 6) AS threshold, round(n / t::DOUBLE, 8) AS share, round(p / tp::DOUBLE, 8) AS gain, round((p / tp::DOUBLE) / (n / t::DOUBLE), 6) AS lift FROM c, t""",
)
def plot_lift_curve(spark, d):
    out = evaluate.lift(_scored(spark, d), "y", "s")
    return out.select(F.round("threshold", 6).alias("threshold"), F.round("share", 8).alias("share"), F.round("gain", 8).alias("gain"), F.round("lift", 6).alias("lift"))


@query("get_model_scores", "SELECT round(avg((l_extendedprice - l_quantity * 1000) ^ 2), 3) AS mse, round(sqrt(avg((l_extendedprice - l_quantity * 1000) ^ 2)), 3) AS rmse, round(1 - avg((l_extendedprice - l_quantity * 1000) ^ 2) / var_pop(l_extendedprice), 3) AS r2 FROM lineitem")
def get_model_scores(spark, d):
    df = load(spark, d, "lineitem").select("l_extendedprice", (F.col("l_quantity") * 1000).alias("p"))
    return evaluate.regression_scores(df, "l_extendedprice", "p")


@query(
    "adjusted_rand_score",
    """WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1, 2), i AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM c GROUP BY a)), j AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM c GROUP BY b)),
    t AS (SELECT sum(n) AS n, sum(n * (n - 1) / 2) AS ij FROM c)
    SELECT round((ij - i.v * j.v / (n * (n - 1) / 2)) / ((i.v + j.v) / 2 - i.v * j.v / (n * (n - 1) / 2)), 8)::DOUBLE AS ari FROM t, i, j""",
)
def adjusted_rand_score(spark, d):
    return evaluate.adjusted_rand(load(spark, d, "orders"), "o_orderstatus", "o_orderpriority").select(F.round("ari", 8).alias("ari"))


@query(
    "evaluate_text_classifier",
    """WITH q AS (SELECT [x for x in string_split(regexp_replace(Tags, '^<|>$', '', 'g'), '><') if x <> ''] AS t FROM questions WHERE Tags IS NOT NULL),
    s AS (SELECT list_distinct(t) AS y, list_distinct(t[1:2]) AS p FROM q WHERE len(t) > 0), n AS (SELECT len(y)::DOUBLE AS y, len(p)::DOUBLE AS p, len(list_intersect(y, p))::DOUBLE AS b FROM s)
    SELECT round(avg((y = p AND b = y)::INT) * 100, 2) AS accuracy, round(avg(b / p) * 100, 2) AS precision, round(avg(b / y) * 100, 2) AS recall, round(avg(2 * b / (y + p)) * 100, 2) AS f1, round(avg(b / (y + p - b)) * 100, 2) AS jaccard FROM n""",
)
def evaluate_text_classifier(spark, d):
    tags = F.filter(F.split(F.regexp_replace("Tags", "^<|>$", ""), "><"), lambda t: t != "")
    df = load(spark, d, "questions").filter("Tags is not null").select(tags.alias("y"), F.slice(tags, 1, 2).alias("p")).filter("size(y) > 0")
    return evaluate.multilabel_scores(df, "y", "p")


@query("dummy_regression", "SELECT round(avg((o_totalprice - m) ^ 2), 1) AS mse, round(sqrt(avg((o_totalprice - m) ^ 2)), 3) AS rmse FROM orders, (SELECT avg(o_totalprice) AS m FROM orders)")
def dummy_regression(spark, d):
    df = load(spark, d, "orders")
    return evaluate.dummy_regression(df, df, "o_totalprice").select(F.round("mse", 1).alias("mse"), "rmse")


@query("dummy_classification", "SELECT round(avg((o_orderpriority = m)::INT), 3) AS accuracy FROM orders, (SELECT o_orderpriority AS m FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)")
def dummy_classification(spark, d):
    df = load(spark, d, "orders")
    return evaluate.dummy_classification(df, df, "o_orderpriority")


@query("get_stopwords_from_idf", """WITH t AS (SELECT DISTINCT Id, unnest(string_split(lower(Title), ' ')) AS term FROM (SELECT DISTINCT Id, Title FROM questions WHERE Title IS NOT NULL)), c AS (SELECT term, count(*) AS df FROM t GROUP BY 1)
    SELECT term, df FROM (SELECT *, row_number() OVER (ORDER BY df DESC, term) AS r FROM c) WHERE r <= (SELECT round(count(*) - count(*) * 0.98) FROM c)""")
def get_stopwords_from_idf(spark, d):
    df = load(spark, d, "questions").filter("Title is not null").select("Id", "Title").distinct().select("Id", F.split(F.lower("Title"), " ").alias("t"))
    return ml.low_idf_words(df, "t", 0.98)


@query("tokenize_corpus", """WITH t AS (SELECT unnest(string_split(lower(Title), ' ')) AS term FROM questions WHERE Title IS NOT NULL) SELECT term, row_number() OVER (ORDER BY count(*) DESC, term) AS index FROM t GROUP BY 1""")
def tokenize_corpus(spark, d):
    df = load(spark, d, "questions").filter("Title is not null").select(F.split(F.lower("Title"), " ").alias("t"))
    return ml.vocabulary_ranks(df, "t")


@query(
    "text_to_sequences",
    """WITH q AS (SELECT Id, string_split(lower(min(Title)), ' ') AS t FROM questions WHERE Id IS NOT NULL AND Title IS NOT NULL GROUP BY 1), w AS (SELECT Id, generate_subscripts(t, 1) AS i, unnest(t) AS term FROM q),
    v AS (SELECT term, row_number() OVER (ORDER BY count(*) DESC, term) AS r FROM w GROUP BY 1), s AS (SELECT Id, string_agg(r::VARCHAR, ' ' ORDER BY i) AS s, count(*) AS n FROM w JOIN v USING (term) GROUP BY 1)
    SELECT Id, repeat('0 ', (SELECT max(len(t)) FROM q) - n) || s AS sequence FROM s""",
)
def text_to_sequences(spark, d):
    df = load(spark, d, "questions").filter("Id is not null and Title is not null").groupBy("Id").agg(F.split(F.lower(F.min("Title")), " ").alias("t"))
    longest = df.agg(F.max(F.size("t"))).head()[0] or 0  # one value
    out = ml.to_sequences(df, "Id", "t", ml.vocabulary_ranks(df, "t"), longest)
    return out.select("Id", F.array_join(F.transform("sequence", lambda x: x.cast("string")), " ").alias("sequence"))


def _parts(spark, d):
    one = load(spark, d, "olist_train_data").filter("recency between 0 and 9998 and monetary_value > 0 and frequency > 0").groupBy("customer_id").agg(F.min(F.struct("recency", "frequency", "monetary_value")).alias("r")).select("customer_id", "r.*")
    return one.select("customer_id", F.col("recency").cast("double").alias("recency"), F.ln("frequency").alias("frequency"), F.ln("monetary_value").alias("monetary"))


_RFM = ["recency", "frequency", "monetary"]


@query("Kmeans")
def kmeans_clusters(spark, d):
    return ml.kmeans(ml.assemble(_parts(spark, d), _RFM), 5)[1].groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query("get_optimal_kmeans_from_k_range")
def get_optimal_kmeans_from_k_range(spark, d):
    return spark.createDataFrame(ml.search_k(ml.assemble(_parts(spark, d), _RFM).cache(), range(2, 5)), "k int, silhouette double")


@query("CAH")
def hierarchical(spark, d):
    return ml.hierarchical(ml.assemble(_parts(spark, d), _RFM), 5).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


# the eigenvalues of a correlation matrix of three columns in closed form
@query(
    "LinearPCA",
    """WITH o AS (SELECT customer_id, min({'r': recency, 'f': frequency, 'm': monetary_value}) AS v FROM olist_train_data WHERE recency BETWEEN 0 AND 9998 AND monetary_value > 0 AND frequency > 0 GROUP BY 1),
    c AS (SELECT corr(v.r, ln(v.f)) AS a, corr(v.r, ln(v.m)) AS b, corr(ln(v.f), ln(v.m)) AS c FROM o), p AS (SELECT *, sqrt((a * a + b * b + c * c) / 3) AS p FROM c), q AS (SELECT p, acos(a * b * c / (p * p * p)) / 3 AS t FROM p),
    e AS (SELECT 1 + 2 * p * cos(t) AS x, 1 + 2 * p * cos(t + 2 * pi() / 3) AS z FROM q)
    SELECT i::INT AS component, round(v / 3, 6) AS ratio, round(s / 3, 6) AS cumulative FROM (SELECT 1 AS i, x AS v, x AS s FROM e UNION ALL SELECT 2, 3 - x - z, 3 - z FROM e UNION ALL SELECT 3, z, 3 FROM e)""",
)
def linear_pca(spark, d):
    model, _ = ml.pca(_parts(spark, d), _RFM)
    return ml.explained(spark, model).select("component", F.round("ratio", 6).alias("ratio"), F.round("cumulative", 6).alias("cumulative"))


@query("TopicModeling")
def topic_modeling(spark, d):
    df = load(spark, d, "questions").filter("Title is not null").groupBy("Id").agg(F.split(F.lower(F.min("Title")), " ").alias("t"))
    counts, model, _ = ml.topics(df, "t", k=4, max_iter=3)
    return ml.topic_words(counts, model, 5)


@query("text_vectorizer", """WITH q AS (SELECT Id, string_split(lower(min(Title)), ' ') AS t FROM questions WHERE Id IS NOT NULL AND Title IS NOT NULL GROUP BY 1),
    c AS (SELECT Id, term, count(*) AS tf FROM (SELECT Id, unnest(t) AS term FROM q) GROUP BY 1, 2), d AS (SELECT term, count(*) AS df FROM c GROUP BY 1 HAVING count(*) >= 5),
    w AS (SELECT Id, term, tf * (ln((1 + (SELECT count(*) FROM q))::DOUBLE / (1 + df)) + 1) AS w FROM c JOIN d USING (term))
    SELECT Id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY Id)), 6) AS weight FROM w""")
def text_vectorizer(spark, d):
    df = load(spark, d, "questions").filter("Id is not null and Title is not null").groupBy("Id").agg(F.split(F.lower(F.min("Title")), " ").alias("t"))
    return ml.tfidf_entries(df, "Id", "t", min_df=5).select("Id", "term", F.round("weight", 6).alias("weight"))


@query("multi_label_binarizer", "SELECT doc_id, array_to_string([(CASE WHEN c IN (source, domain) THEN 1 ELSE 0 END) for c in ['building', 'polling', 'review']], '') AS marks FROM documents")
def multi_label_binarizer(spark, d):
    marks = supervised.binarise(F.array(F.coalesce("source", F.lit("")), F.coalesce("domain", F.lit(""))), ["review", "building", "polling"])
    return load(spark, d, "documents").select("doc_id", F.array_join(F.transform(marks, lambda m: m.cast("string")), "").alias("marks"))


@query(
    "target_results",
    """WITH a AS (SELECT l_returnflag AS k, round(avg(l_tax), 6) AS s FROM lineitem GROUP BY 1), b AS (SELECT l_returnflag AS k, round(avg(l_discount), 6) AS s FROM lineitem GROUP BY 1)
    SELECT k, a.s AS s_include, b.s AS s_exclude, round((a.s - b.s) * 100.0 / b.s, 2) AS s_change FROM a JOIN b USING (k)""",
)
def target_results(spark, d):
    lines = load(spark, d, "lineitem")
    a, b = (lines.groupBy(F.col("l_returnflag").alias("k")).agg(F.round(F.avg(c), 6).alias("s")) for c in ("l_tax", "l_discount"))
    return supervised.compare_results(a, b, "k", ["s"])


@query("highlight_segment_update", "SELECT o_custkey, date_diff('month', min(o_orderdate), max(o_orderdate))::INT AS months, CASE WHEN date_diff('month', min(o_orderdate), max(o_orderdate)) < 10 THEN 'short' WHEN date_diff('month', min(o_orderdate), max(o_orderdate)) < 16 THEN 'medium' ELSE 'long' END AS lifetime FROM orders GROUP BY 1")
def highlight_segment_update(spark, d):
    a, b = F.min("o_orderdate"), F.max("o_orderdate")
    months = ((F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)).cast("int")
    return load(spark, d, "orders").groupBy("o_custkey").agg(months.alias("months")).withColumn("lifetime", supervised.lifetime_bucket(F.col("months")))


# the normal distribution by Simpson's rule, the p by the limiting distribution: enough for the decision
@query(
    "residue_normality_test",
    """WITH m AS (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s, count(*) AS n FROM customer WHERE c_acctbal IS NOT NULL), z AS (SELECT (c_acctbal - m) / s AS z, row_number() OVER (ORDER BY c_acctbal) AS i, n FROM customer, m WHERE c_acctbal IS NOT NULL),
    f AS (SELECT i, n, 0.5 + z / 600 * sum(CASE WHEN k IN (0, 200) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-0.5 * pow(z * k / 200.0, 2))) / sqrt(2 * pi()) AS p FROM z, generate_series(0, 200) g(k) GROUP BY i, n, z),
    d AS (SELECT max(greatest(i / n::DOUBLE - p, p - (i - 1) / n::DOUBLE)) AS d, any_value(n) AS n FROM f)
    SELECT round(d, 6) AS statistic, 2 * (exp(-2 * n * d * d) - exp(-8 * n * d * d) + exp(-18 * n * d * d)) < 0.05 AS reject FROM d""",
)
def residue_normality_test(spark, d):
    r = supervised.normality(load(spark, d, "customer"), "c_acctbal")
    return spark.createDataFrame([(round(r["statistic"], 6), r["p"] < 0.05)], "statistic double, reject boolean")


def _energy(spark, d):
    df = load(spark, d, "benchmarking_2016").groupBy("OSEBuildingID").agg(F.min(F.struct("PropertyGFATotal", "NumberofFloors", "YearBuilt", F.log1p("`SiteEnergyUse(kBtu)`").alias("target"))).alias("r")).select("OSEBuildingID", "r.*")
    return ml.assemble(df.na.drop().withColumn("PropertyGFATotal", F.log1p("PropertyGFATotal")), ["PropertyGFATotal", "NumberofFloors", "YearBuilt"])


@query("train_gridsearch")
def train_gridsearch(spark, d):
    estimator = supervised.REGRESSORS["elastic_net"]("target", 42)
    _, points, _ = ml.grid_search(_energy(spark, d).cache(), estimator, {"regParam": [0.01, 0.1]}, ml.regression_evaluator("target"), folds=3)
    return spark.createDataFrame([(p["regParam"], s) for p, s in points], "regParam double, rmse double")


@query("plot_learning_curve")
def plot_learning_curve(spark, d):
    estimator = supervised.REGRESSORS["elastic_net"]("target", 42)
    out = ml.learning_curve(_energy(spark, d).cache(), estimator, ml.regression_evaluator("target"), "OSEBuildingID", (0.5, 1.0))
    return spark.createDataFrame(out, "share double, train double, test double")


@query("filter_features_by_threshold")
def filter_features_by_threshold(spark, d):
    model = supervised.fit(_energy(spark, d), "random_forest_regressor", "target")
    kept = ml.select_by_importance(["PropertyGFATotal", "NumberofFloors", "YearBuilt"], model.featureImportances.toArray())
    return spark.createDataFrame([(k,) for k in kept], "feature string")


@query("segment_classifier")
def segment_classifier(spark, d):
    parts = ml.kmeans(ml.assemble(_parts(spark, d), _RFM).cache(), 4)[1].withColumn("label", F.col("cluster").cast("double")).cache()
    model = supervised.fit(parts, "random_forest", "label")
    return evaluate.accuracy(model.transform(parts), "label", "prediction")


queries, oracle_sql = query.queries, query.oracle_sql
