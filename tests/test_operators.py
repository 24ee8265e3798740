"""Literal-row cases of the quirks: nulls, ties, empty lists, edges, compat modes."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import geometry, html, scalars, tails, text
from sparkloom.operators import clean, evaluate, geo, ml, profile, quantiles, rank, relate, reshape, scale, segment, stats
from sparkloom.sources import concat_files, find_csv


def one(spark, column, value, schema):
    return spark.createDataFrame([(value,)], f"v {schema}").select(column(F.col("v")).alias("r")).head().r


def test_filter_codes_and_nulls(spark, rows):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "i int, s string")
    assert rows(clean.filter_values(df, "s", "neq", "a").select("i")) == [(2,), (3,)]
    assert rows(clean.filter_values(df, "i", "le", 2).select("i")) == [(1,), (2,)]
    with pytest.raises(KeyError):
        clean.filter_values(df, "i", "no", 2)
    assert rows(clean.null_counts(df)) == [("i", 0, 0.0), ("s", 1, 33.3)]
    assert rows(clean.null_counts(df.limit(0))) == [("i", 0, None), ("s", 0, None)]
    assert clean.drop_sparse_columns(df, 0.3).columns == ["i"]
    assert clean.data_loss(4, 3) == 25.0
    assert clean.data_loss(0, 0) == 0.0


def test_constant_columns_and_types(spark):
    df = spark.createDataFrame([(1, None, "yes", 1.5), (1, None, "No", 300.25)], "a long, b string, c string, d double")
    assert clean.drop_constant_columns(df).columns == ["c", "d"]
    assert dict(clean.narrow_types(df).dtypes) == {"a": "tinyint", "b": "string", "c": "boolean", "d": "float"}
    assert clean.narrow_types(df.limit(0)).columns == df.columns


def test_dedupe_in_turn(spark, rows):
    df = spark.createDataFrame([(1, "x", "p"), (2, "x", "q"), (3, "y", "p"), (4, None, "r"), (5, None, "s")], "i int, a string, b string")
    assert rows(clean.drop_duplicates_in_turn(df, ["a", "b"], [F.col("i")]).select("i")) == [(1,), (4,)]
    assert rows(clean.drop_class_of_size(df, "a", 1).select("i")) == [(1,), (2,), (4,), (5,)]


def test_measures(spark, rows):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (10.0,), (None,)], "x double")
    m = profile.measures(df, ["x"]).head()
    assert (m["count"], m.min, m.q1, m.median, m.q3, m.max) == (4, 1.0, 1.75, 2.0, 4.0, 10.0)
    assert rows(profile.modes(df, "x")) == [(2.0, 2)]
    assert profile.shape(df.limit(2), "x").head() == (None, None)
    x = np.sort([1.0, 2.0, 2.0, 10.0])
    lorenz = np.cumsum(x) / x.sum()
    assert profile.gini(df, "x").head().gini == pytest.approx(2 * (0.5 - (lorenz.sum() - 0.5) / 4))
    assert rows(profile.histogram(spark.createDataFrame([(5.0,)] * 3, "x double"), "x").select("bin", "n")) == [(1, 3)]


def test_rfm_edges_and_empty(spark, rows):
    orders = spark.createDataFrame([(c, datetime(2018, 1, d), 10.0) for c, d in [("a", 1), ("a", 5), ("b", 5), (None, 9)]], "c string, t timestamp_ntz, m double")
    assert rows(segment.rfm(orders, "c", "t", "m")) == [("a", 0, 2, 20.0), ("b", 0, 1, 10.0)]
    assert segment.rfm_segments(orders.limit(0), "c", "t", "m").count() == 0
    codes = spark.createDataFrame([(f"{a}{b}",) for a in "1234" for b in "1234"], "c string").select("c", segment.label_by_pattern(F.col("c")).alias("l"))
    assert dict(rows(codes)) == {
        "11": "Churned customers", "12": "Former potential loyalists", "13": "Former potential loyalists", "14": "Former best customers",
        "21": "About to churn", "22": "Average customers", "23": "Loyal customers", "24": "Former best customers",
        "31": "Rising customers", "32": "Potential loyalists", "33": "Loyal customers", "34": "Loyal customers",
        "41": "New customers", "42": "Potential loyalists", "43": "Best customers", "44": "Best customers",
    }


def test_quantiles_equal_numpy(spark):
    values = {"a": [5.0, 1.0, 1.0, 1.0, 9.0, -2.5, None], "b": [3.0], "c": [float(i * i % 701) for i in range(2000)], "hot": [7.0] * 500 + [1.0, 2.0]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [(None, 1.0), ("none", None)], "k string, v double")
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    found = {r.key: r.q for r in quantiles.quantiles(df, "k", "v", probabilities, buckets=8).collect()}
    assert set(found) == set(values)
    for k, q in found.items():
        assert q == pytest.approx(np.quantile([v for v in values[k] if v is not None], probabilities))
    assert quantiles.column_quantiles(df.limit(0), {"v": F.col("v")}, [0.5]).head().v is None


def test_period_features_modes(spark, rows):
    orders = spark.createDataFrame([("a", datetime(2017, 1, 1), 1.0), ("a", datetime(2018, 1, 1), 2.0), ("a", datetime(2018, 2, 1), 3.0)], "c string, t timestamp_ntz, m double")
    assert segment.period_features(orders, "c", "t", "m", "year").head().asDict() == {"c": "a", "2017_count": 1, "2018_count": 2, "2017_sum": 1.0, "2018_sum": 5.0}
    compat = segment.period_features(orders, "c", "t", "m", "year", compat=True)
    assert rows(compat.select("2017_count", "2018_count")) == [(1, 1), (2, 2), (2, 2)]  # rows outside a period carry the count outside


def test_ranks(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 3.0), ("c", 2.0), ("d", 0.0)], "f string, w double")
    imp = rank.features_importance(df, "f", "w", non_zero=True)
    assert [r.label for r in imp.orderBy("rank").collect()] == ["a", "b", "c"]
    assert rank.rank_beyond(imp, 0.7).head().rank == 2
    assert rank.rank_beyond(imp, 1.5).head().rank is None
    curve = spark.createDataFrame([(i, v) for i, v in enumerate([10.0, 6.0, 1.0, 0.5])], "i int, v double")
    assert rank.elbow(curve, "i", "v", None).head().position == 4
    assert rank.kaiser(spark.createDataFrame([(0.6,), (0.3,), (0.1,)], "r double"), "r").head().components == 1


def test_reshape(spark, rows):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "i int, s string")
    assert rows(reshape.indicators(df, "s")) == [(1, 1, 0), (2, 0, 0), (3, 0, 1)]
    nums = spark.createDataFrame([(i, i % 5) for i in range(50)], "i int, g int")
    assert sorted(r.n for r in reshape.with_row_number(nums, "n", [F.desc("i")]).collect()) == list(range(50))
    train, test = reshape.stratified_split(nums, "g", "i", 0.2)
    assert test.groupBy("g").count().filter("count <> 2").count() == 0
    assert train.count() + test.count() == 50
    binned = reshape.quantile_bins(spark.createDataFrame([(1.0,), (1.0,), (1.0,), (9.0,)], "x double"), "x", 3, ["low", "mid", "high"])
    assert {(r.x, r.bin) for r in binned.collect()} == {(1.0, "low"), (9.0, "high")}


def test_dates_and_numbers(spark):
    assert one(spark, lambda c: scalars.delivery_verdict(c), None, "int") == "undervalued"
    assert one(spark, lambda c: scalars.delay_days(c, compat=True), 2 * 86400, "long") == 3
    assert one(spark, lambda c: scalars.delay_days(c, compat=True), -5, "long") == 31
    assert one(spark, lambda c: scalars.delay_days(c), 2 * 86400, "long") == 2.0
    assert one(spark, scalars.run_time_text, "1:0:3.4", "string") == "1 h 3 s"
    assert one(spark, scalars.group_thousands, "1234567.891", "string") == "1 234 567.891"
    assert one(spark, scalars.group_thousands, "-100", "string") == "-100"
    assert one(spark, lambda c: scalars.group_thousands(c, compat=True), "-100", "string") == "- 100"
    assert one(spark, lambda c: scalars.strip_accents(c, lower=True), "Éçole ŒUVRE", "string") == "ecole oeuvre"
    span = spark.createDataFrame([(datetime(2018, 1, 1, 23), datetime(2018, 1, 2, 1))], "a timestamp_ntz, b timestamp_ntz")
    assert span.select(scalars.span_days(F.col("a"), F.col("b")).alias("d"), F.datediff("b", "a").alias("c")).head() == (0, 1)


@pytest.mark.parametrize("value", ['{"latitude": 46.5, "longitude": -121.1, "human_address": {"address": "1 A ST", "city": "C", "state": "W", "zip": "70"}}', '{"latitude": 46.5, "longitude": -121.1, "human_address": "{\\"address\\": \\"1 A ST\\", \\"city\\": \\"C\\", \\"state\\": \\"W\\", \\"zip\\": \\"70\\"}"}', "{'latitude': '46.5', 'human_address': '{\"address\": \"1 A ST\", \"city\": \"C\", \"state\": \"W\", \"zip\": \"70\"}', 'longitude': '-121.1'}"])
def test_address_notations(spark, value):
    r = one(spark, scalars.parse_address, value, "string")
    assert (r.latitude, r.longitude, r.zip, r.address) == (46.5, -121.1, "70", "1 A ST")


def test_text_stages(spark):
    T = "array<string>"
    assert one(spark, text.drop_digits, ["a1", "²", "12", "x"], T) == ["a", "x"]
    assert one(spark, lambda c: text.drop_single_letters(c, compat=True), ["hi", "no", "", "cat", "x", "st"], T) == ["cat"]
    assert one(spark, text.drop_single_letters, ["hi", "no", "", "x", "5"], T) == ["hi", "no", "5"]
    assert one(spark, text.drop_punctuation, ["don't", "a", "é-b2", "--"], T) == ["don", "t", "b2"]
    assert one(spark, text.drop_repeated_characters, ["aaa", "aab", ""], T) == ["aab", ""]
    assert one(spark, lambda c: text.drop_duplicate_tokens(c, keep=False), ["a", "b", "a", "c"], T) == ["b", "c"]
    assert one(spark, lambda c: text.drop_duplicate_tokens(c, keep=False), [], T) == []
    assert one(spark, lambda c: text.drop_similar_words(c, 0.7), ["table", "tables", "dog", "dog", "sun"], T) == ["sun"]
    assert one(spark, lambda c: text.drop_most_common(c, 1), ["a"] * 5 + ["b"] * 4 + ["c", "d"], T) == ["b"] * 4 + ["c", "d"]
    assert one(spark, lambda c: text.drop_most_common(c, 1), ["a"] * 5, T) == ["a"] * 5
    assert one(spark, text.n_grams, ["a"], T) == []
    assert one(spark, text.n_grams, ["a", "b", "c"], T) == [["a", "b"], ["b", "c"]]
    assert one(spark, lambda c: text.window_of(c, ["x"]), ["x", "a", "x", "x"], T) == pytest.approx((2 + 3 + 1) / 3)
    assert one(spark, lambda c: text.window_of(c, ["x"]), ["x"], T) is None
    assert one(spark, text.mean_length, [], T) is None
    assert one(spark, lambda c: text.normalize(c, domain=["c++"]), ["The", "c++", "Cats", "aaaa", "7"], T) == ["cats", "c++"]
    assert one(spark, text.parse_tags, "<a><b-c>", "string") == ["a", "b-c"]
    assert one(spark, lambda c: text.tokenize(c, lower=True), '(Hello, "World")!', "string") == ["(", "hello", ",", '"', "world", '"', ")", "!"]
    assert one(spark, text.tokenize_words, "don't stop", "string") == ["do", "n't", "stop"]
    known = {"running": "run", "cities": "citi", "glass": "glass", "relational": "relat", "hoping": "hope", "hopping": "hop", "generously": "generous", "organization": "organ", "skies": "sky", "proceed": "proceed", "beautiful": "beauti", "cry": "cri", "boys": "boy", "adjustment": "adjust", "communism": "communism", "controlled": "control", "feed": "feed", "agreed": "agre"}
    assert {w: text.stem(w) for w in known} == known
    assert text.token_set_ratio("rue de la paix", "Paix rue de la") == 100
    assert text.token_set_ratio("", "x") == 0


def test_html(spark):
    assert one(spark, html.strip_html, '<p>a &amp; b</p><script>"</p>"</script>c', "string") == "a & bc"
    assert one(spark, html.strip_html, None, "string") is None
    assert one(spark, html.resolve_entities, "&lt;x&gt; &amp;lt;", "string") == "<x> &lt;"


def test_joins(spark, rows):
    base = spark.createDataFrame([(1, "a"), (2, None)], "k int, s string")
    d = spark.createDataFrame([("a", "A"), ("a", "B"), (None, "N")], "s string, t string")
    assert rows(relate.lookup(base, "s", d, "s", "t")) == [(1, "A"), (2, None)]
    inside, outside = relate.matched_unmatched(base, spark.createDataFrame([(1,)], "k int"), "k")
    assert inside.count() + outside.count() == base.count()
    left = spark.createDataFrame([("12 rue Victor Hugot",), ("avenue Foch",), ("quai neuf",)], "s string")
    right = spark.createDataFrame([("rue Victor Hugo",), ("avenue Foch",), ("rue Victor Duruy",)], "t string")
    got = {r.a: r.b for r in relate.fuzzy_matching(left, right, "s", "t", 80).collect()}
    assert got == {"12 rue Victor Hugot": "rue Victor Hugo"}


def test_number_ranges(spark, rows):
    ranges = spark.createDataFrame([("s", 1, 1, 5, "No", "Yes"), ("s", 2, 2, 9999, "Yes", "No"), ("t", 3, 1, 9, "No", "No")], "street string, polling_station_id int, number_start int, number_stop int, even_numbers_only string, odd_numbers_only string")
    numbers = {(r.street, r.number): r.station for r in relate.expand_ranges(ranges, open_end=8).collect()}
    assert [n for s, n in sorted(numbers) if s == "s"] == [1, 2, 3, 4, 5, 6, 8]
    addresses = spark.createDataFrame([("s", 3, 9), ("s", 4, 9), ("t", 4, 9), ("s", None, 9)], "street string, number int, station int")
    assert rows(relate.redistrict(addresses, ranges, open_end=8).select("street", "number", "station")) == sorted([("s", 3, 1), ("s", 4, 2), ("t", 4, 9), ("s", None, 9)], key=repr)


def test_statistics(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 5.0), ("a", 2.0, 4.0, 5.0), ("b", 3.0, 6.5, 5.0), ("b", 5.0, 9.0, 5.0), (None, 9.0, None, 5.0)], "g string, x double, y double, z double")
    r = stats.anova(df, "x", "g").head()
    assert r.eta2 == pytest.approx(6.25 / 8.75)
    assert stats.invalid_variance_features(df, ["x", "y", "z"]) == ["z"]
    assert stats.correlated_features(df, ["x", "y"], 0.9) == ["y"]
    table = spark.createDataFrame([("a", "u")] * 6 + [("a", "v")] * 2 + [("b", "u")] * 1 + [("b", "w")] * 5, "x string, y string")
    plain, compat = stats.chi2_test(table, "x", "y"), stats.chi2_test(table, "x", "y", compat=True)
    assert (plain["dof"], compat["dof"]) == (2, 6)
    assert plain["statistic"] == compat["statistic"] and plain["p"] < compat["p"]
    assert tails.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert tails.f_tail(4.964602743730709, 1, 10) == pytest.approx(0.05, abs=1e-9)


def test_scalers(spark):
    df = spark.createDataFrame([(1.0, 7.0), (3.0, 7.0), (5.0, 7.0)], "x double, c double")
    assert [r.x for r in scale.min_max(df, ["x", "c"]).apply(df).orderBy("x").collect()] == [0.0, 0.5, 1.0]
    assert {r.c for r in scale.min_max(df, ["x", "c"]).apply(df).collect()} == {0.0}
    z = scale.standard(df, ["x"])
    assert z.factor["x"] == pytest.approx(np.std([1, 3, 5]))
    assert [r.x for r in z.reverse(z.apply(df)).orderBy("x").collect()] == pytest.approx([1.0, 3.0, 5.0])
    assert scale.polynomial(df, ["x", "c"]).columns == ["x", "c", "1", "x*x", "x*c", "c*c"]


def test_evaluation(spark):
    df = spark.createDataFrame([(1, 0.9, 1), (0, 0.8, 1), (1, 0.8, 0), (0, 0.1, 0)], "y int, s double, p int")
    assert tuple(evaluate.binary_counts(df, "y", "p").head()) == (1, 1, 1, 1)
    assert evaluate.auc(df, "y", "s").head().auc == pytest.approx((1 + 1 + 0.5 + 1) / 4)
    assert [tuple(r) for r in evaluate.roc(df, "y", "s").orderBy(F.desc("threshold")).collect()] == [(0.9, 0.0, 0.5, 0.25), (0.8, 0.5, 1.0, 0.75), (0.1, 1.0, 1.0, 1.0)]
    same = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "a string, b int")
    assert evaluate.adjusted_rand(same, "a", "b").head().ari == 1.0
    labels = spark.createDataFrame([(["a", "b"], ["a"]), ([], ["x"])], "y array<string>, p array<string>")
    assert evaluate.multilabel_scores(labels, "y", "p").head().asDict() == {"accuracy": 0.0, "precision": 50.0, "recall": 25.0, "f1": 33.33, "jaccard": 25.0}
    assert evaluate.micro_f1(spark.createDataFrame([([1, 0], [0.5, 0.6])], "y array<int>, p array<double>"), "y", "p").head().f1 == 0.0


def test_models(spark):
    rng = np.random.default_rng(1)
    pts = [(i, float(c * 10 + rng.normal()), float(c * -5 + rng.normal()), float(rng.normal())) for c in range(3) for i in range(c * 40, c * 40 + 40)]
    df = spark.createDataFrame(pts, "id int, a double, b double, c double")
    v = ml.assemble(df, ["a", "b"]).cache()
    assert ml.search_k(v, range(2, 5), best=1)[0][0] == 3
    model, out = ml.kmeans(v, 3)
    assert ml.davies_bouldin(out, model.clusterCenters()) < 0.5
    sizes = [r["count"] for r in ml.hierarchical(v, 3).groupBy("cluster").count().collect()]
    assert len(sizes) == 3 and min(sizes) >= 35
    assert len(set(ml.ward(np.array([(p[1], p[2]) for p in pts]), 3)[:40])) == 1
    fitted, _ = ml.pca(df, ["a", "b", "c"])
    assert sum(fitted.explainedVariance) == pytest.approx(1)
    words = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["a"]), (3, [])], "k int, t array<string>")
    ranks = ml.vocabulary_ranks(words, "t")
    assert {(r.term, r["index"]) for r in ranks.collect()} == {("a", 1), ("b", 2)}
    assert {r.k: r.sequence for r in ml.to_sequences(words, "k", "t", ranks, 4).collect()} == {1: [0, 1, 2, 1], 2: [0, 0, 0, 1], 3: [0, 0, 0, 0]}


def test_geometry(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (2.0, 2.0)]
    assert geometry.hull(square) == [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    ring = np.array(geometry.hull(square))
    assert geometry.contains(ring, 4.0, 2.0) and geometry.contains(ring, 1.0, 1.0) and not geometry.contains(ring, 5.0, 1.0)
    pts = spark.createDataFrame([("k", i, x, y) for i, (x, y) in enumerate(square)] + [("k", 9, None, 1.0)], "key string, id int, x double, y double")
    out = geo.outlines(pts, "key").head()
    assert out.points == 5 and len(out.outline) == 5
    assert spark.createDataFrame([(out.outline,)], "r array<struct<x:double,y:double>>").select(geometry.area(F.col("r")).alias("a")).head().a == 16.0
    covered = geo.containers(pts.na.drop(), geo.outlines(pts, "key").select("key", "outline").withColumnRenamed("key", "poly"), "id", "outline", 1.5)
    assert {r.containers for r in covered.collect()} == {"one"}
    near = geo.nearest(pts.na.drop().filter("id < 4"), pts.filter("id = 4").select(F.col("id").alias("other"), "x", "y"), "id", "other", 3.0)
    assert {r.other for r in near.collect()} == {4}
    paris = spark.createDataFrame([(48.8566, 2.3522, 45.764, 4.8357)], "a double, b double, c double, d double")
    assert paris.select(scalars.haversine(*map(F.col, "abcd"), "km").alias("k")).head().k == pytest.approx(391.5, abs=1)
    x, y = scalars.lambert93(F.col("a"), F.col("b"))
    r = paris.select(x.alias("x"), y.alias("y")).head()
    assert (r.x, r.y) == (pytest.approx(652469, abs=5), pytest.approx(6862035, abs=5))


def test_csv_folder(spark, tmp_path):
    (tmp_path / "part_2.csv").write_text("a,b\n1,x\n")
    (tmp_path / "part_10.csv").write_text("a,c\n2,y\n")
    assert find_csv("10", str(tmp_path)).endswith("part_10.csv")
    df = concat_files(spark, str(tmp_path))
    assert df.columns == ["a", "b", "c"] and df.count() == 2
    assert concat_files(spark, str(tmp_path), last=1).columns == ["a", "c"]
    with pytest.raises(FileNotFoundError):
        find_csv("none", str(tmp_path))


def test_every_known_text_is_a_candidate(spark):
    from sparkloom.functions.text import token_set_bounds, token_set_ratio

    rng = np.random.default_rng(2)
    words = ["main", "oak", "hill", "street", "st", "ave", "pine", "1st", "lake", "elm", "north", "mainn"]
    known = sorted({" ".join(rng.choice(words, rng.integers(1, 4))) for _ in range(300)} | {f"{i} Main St" for i in range(120)})
    asked = ["main street", "Main Stret", "zzz", "", "oak hil", "7 Main Street"]
    for a in asked:
        assert all(m >= token_set_ratio(a, b) for m, b in zip(token_set_bounds(known)(a), known))
    left, right = spark.createDataFrame([(a,) for a in asked], "s string"), spark.createDataFrame([(b,) for b in known], "t string")
    want = {(a, b, -s, r) for a in asked for r, (s, b) in enumerate(sorted((-token_set_ratio(a, b), b) for b in known)[:5], 1)}
    assert {tuple(r) for r in relate.top_candidates(left, right, "s", "t").collect()} == want


def test_kernel_has_every_pair(spark):
    x = {i: [float(i), i * 0.5] for i in range(50)}
    df = spark.createDataFrame(list(x.items()), "id int, v array<double>")
    rows = ml.rbf_kernel(df, "id", "v", 0.1, block=8).collect()
    assert len(rows) == 2500
    assert all(r.k == pytest.approx(np.exp(-0.1 * sum((a - b) ** 2 for a, b in zip(x[r.id], x[r.other])))) for r in rows)


def test_weights_of_every_term(spark):
    words = spark.createDataFrame([(i, ["a", f"w{i // 2}"]) for i in range(20)], "k int, t array<string>")
    got = {(r.k, r.term): r.weight for r in ml.tfidf_entries(words, "k", "t", 2).collect()}
    assert {t for _, t in got} == {"a", *[f"w{i}" for i in range(10)]} and len(got) == 40
    dense = {r.k: sorted(float(v) for v in r.features.toArray() if v) for r in ml.tfidf(words, "t", 2)[1].collect()}
    assert all(sorted(got[k, t] for t in ("a", f"w{k // 2}")) == pytest.approx(dense[k]) for k in range(20))


def test_whole_titles_become_sequences(spark, tmp_path):
    from sparkloom.queries import statistics

    title = " ".join(f"t{i}" for i in range(30))
    spark.createDataFrame([(1, title), (2, "t0")], "Id long, Title string").write.parquet(f"{tmp_path}/questions.parquet")
    got = {r.Id: r.sequence for r in statistics.text_to_sequences(spark, str(tmp_path)).collect()}
    assert sorted(map(int, got[1].split())) == list(range(1, 31)) and got[2] == "0 " * 29 + "1"


def test_ward_equals_the_plain_algorithm():
    rng = np.random.default_rng(4)
    x = np.r_[rng.normal(0, 1, (20, 2)), rng.normal(6, 1, (15, 2)), rng.normal((0, 9), 1, (9, 2))]
    groups = {i: [i] for i in range(len(x))}
    while len(groups) > 4:
        def cost(a, b):
            p, q = x[groups[a]], x[groups[b]]
            return len(p) * len(q) / (len(p) + len(q)) * ((p.mean(0) - q.mean(0)) ** 2).sum()

        a, b = min(((a, b) for a in groups for b in groups if a < b), key=lambda e: cost(*e))
        groups[a] += groups.pop(b)
    want = {frozenset(g) for g in groups.values()}
    labels = ml.ward(x, 4)
    assert {frozenset(np.flatnonzero(labels == c).tolist()) for c in set(labels)} == want
    with pytest.raises(ValueError):
        ml.ward(np.zeros((ml.WARD_LIMIT + 1, 1)), 2)


def test_clip_and_chain():
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    moved = [(x + 1, y + 1) for x, y in square]
    assert geometry.clip(square, moved) == [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]
    assert geometry.clip(square, [(x + 2, y) for x, y in square]) == [(2.0, 0.0), (2.0, 2.0)]  # a shared side
    assert geometry.clip(square, [(x + 9, y) for x, y in square]) == []
    edges = [(a, b) for a, b in zip(square, square[1:])]
    assert geometry.rings_of(edges + [((5.0, 5.0), (6.0, 6.0))]) == [[(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0), (0.0, 0.0)]]


def test_intersections_are_exact(spark, rows):
    tri = [("a", 0.0, 0.0), ("a", 4.0, 0.0), ("a", 0.0, 4.0), ("b", 4.0, 4.0), ("b", 4.0, 3.0), ("b", 3.0, 4.0), ("c", 1.0, 1.0), ("c", 3.0, 1.0), ("c", 1.0, 3.0), ("c", 3.0, 3.0), ("d", 0.1, 0.1)]
    hulls = geo.outlines(spark.createDataFrame(tri, "k string, x double, y double"), "k")
    assert ("a", "b") in rows(geo.overlapping_boxes(hulls, "k", "outline", 1.0))  # boxes overlap, the triangles do not
    got = geo.intersections(hulls, "k", "outline", 1.0).select("a", "b", "owner", "kind", F.round(geometry.area(F.col("part")), 6).alias("s"))
    assert rows(got) == [("a", "c", "c", "POLYGON", 2.0)]


def test_scalars_of_the_ellipsoid(spark):
    r = spark.createDataFrame([(50.06632, -5.71475, 58.64402, -3.07009)], "a double, b double, c double, d double").select(scalars.vincenty(*map(F.col, "abcd")).alias("m"), scalars.vincenty(F.col("a"), F.col("b"), F.col("a"), F.col("b")).alias("z")).head()
    assert r.m == pytest.approx(969954.166, abs=0.01) and r.z == 0
    x, y = scalars.lambert93(F.lit(48.85), F.lit(2.35))
    lat, lon = scalars.from_lambert93(x, y)
    back = spark.range(1).select(lat.alias("lat"), lon.alias("lon")).head()
    assert (back.lat, back.lon) == (pytest.approx(48.85, abs=1e-9), pytest.approx(2.35, abs=1e-9))
