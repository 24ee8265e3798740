import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import clusters

SCHEMA = "id string, a double, b double, c double, cluster string, leaf string"


def frame(spark, points):
    return spark.createDataFrame([(i, *p, "clash", "clash") for i, p in points], SCHEMA)


def run(spark, points, **kw):
    return {r.id: r.cluster for r in clusters.cluster(frame(spark, points), "id", [F.col("a"), F.col("b"), F.col("c")], **kw).collect()}


def shapes():
    rng = np.random.default_rng(5)
    t = rng.uniform(0, np.pi, 600)
    ring = np.c_[3 * np.cos(t), 3 * np.sin(t), np.zeros(600)] + rng.normal(0, 0.05, (600, 3))
    inner = rng.normal(0, 0.15, (300, 3))
    band = np.c_[rng.uniform(-4, 4, 500), np.full(500, -2.0), rng.normal(0, 0.05, 500)]
    return [(f"r{i}", tuple(map(float, p))) for i, p in enumerate(ring)], [(f"i{i}", tuple(map(float, p))) for i, p in enumerate(inner)], [(f"b{i}", tuple(map(float, p))) for i, p in enumerate(band)]


def test_shapes_and_isolated(spark):
    ring, inner, band = shapes()
    lonely = [("x1", (9.0, 9.0, 9.0)), ("x2", (-9.0, 5.0, 1.0)), ("x3", (0.0, 6.0, 4.0))]
    odd = [("n1", (None, 0.0, 0.0)), ("n2", (float("nan"), 0.0, 0.0)), ("n3", (float("inf"), 0.0, 0.0)), (None, (0.0, 0.0, 0.0))]
    got = run(spark, ring + inner + band + lonely + odd)
    assert set(got) == {i for i, _ in ring + inner + band + lonely}
    labels = [{got[i] for i, _ in group} for group in (ring, inner, band)]
    assert all(len(s) == 1 for s in labels) and len(set.union(*labels)) == 3 and None not in set.union(*labels)
    assert {got[i] for i, _ in lonely} == {None}
    assert labels[0] == {0}  # the heaviest cluster comes first


def test_repeated_points_and_small_inputs(spark):
    same = [(f"s{i}", (1.0, 1.0, 1.0)) for i in range(50)]
    assert set(run(spark, same).values()) == {0}
    assert set(run(spark, same[:5]).values()) == {None}
    assert run(spark, []) == {}


def leaves_of(spark, points, per_task, radius=0.3):
    names = ["a", "b", "c"]
    rows = clusters.bisect(frame(spark, points).select("id", *names), names, radius, per_task=per_task, per_round=3).collect()
    out = {}
    for r in rows:
        out.setdefault(r.leaf, []).append((r.a, r.b, r.c))
    return {k: np.array(v) for k, v in out.items()}


def test_leaves_respect_the_limit(spark):
    ring, inner, band = shapes()
    for per_task in (100, 100_000):  # split across the cluster first, or in one task
        leaves = leaves_of(spark, ring + inner + band, per_task)
        assert sum(map(len, leaves.values())) == 1400
        # the limit holds about the centre the points were assigned to, which may be a step away from their mean
        assert all(len(x) < 4 or np.sqrt(((x - x.mean(0)) ** 2).sum(1).max()) <= 0.33 for x in leaves.values())
        assert len(leaves) < 400


def test_either_way_gives_the_same_groups(spark):
    ring, inner, band = shapes()
    a, b = (run(spark, ring + inner + band, per_task=n) for n in (150, 100_000))
    assert a == b


def test_the_largest_dispersion_is_split_first():
    x = np.r_[np.zeros((50, 1)), np.full((50, 1), 10.0), np.full((5, 1), 11.0)]
    leaf = clusters.bisect_local(x, 0.1, 4)
    assert len(set(leaf)) == 3 and leaf[0] != leaf[60] and leaf[104] == 2  # 0 against the rest, then 10 against 11


def test_leaf_report(spark):
    ring, inner, band = shapes()
    got = clusters.cluster(frame(spark, ring + inner + band), "id", [F.col("a"), F.col("b"), F.col("c")])
    out = clusters.describe_leaves(got, typical=2).collect()
    assert sum(r["size"] for r in out) == 1400 and all(len(r.members) == min(2, r["size"]) for r in out)
    assert all(r.radius <= 0.25 for r in out if r["size"] >= 4)


def test_describe(spark):
    ring, inner, band = shapes()
    out = clusters.describe(clusters.cluster(frame(spark, ring + inner + band), "id", [F.col("a"), F.col("b"), F.col("c")]), typical=2)
    assert sorted(r["size"] for r in out.collect()) == [300, 500, 600]
    assert all(len(r.members) == 2 for r in out.collect())


def test_small_group_in_a_large_table(spark):
    many = spark.range(600_000).select(F.col("id").cast("string"), *[F.lit(0.0).alias(c) for c in "abc"])
    rng = np.random.default_rng(3)
    few = [(f"f{i}", tuple(map(float, p))) for i, p in enumerate(rng.normal(3, 0.02, (11, 3)))]
    rows = many.unionByName(frame(spark, few).select("id", "a", "b", "c"))
    got = {r.id: r.cluster for r in clusters.cluster(rows, "id", [F.col("a"), F.col("b"), F.col("c")]).filter("id like 'f%'").collect()}
    assert set(got.values()) == {1} and len(got) == 11
