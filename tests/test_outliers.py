"""Distances to the k-th nearest point against all pairs, and their work where many points are within the radius."""

from __future__ import annotations

import math
import random
import time

import pytest

from sparkloom.operators import geo


@pytest.mark.parametrize("k, cell", [(1, 0.1), (3, 0.1), (41, 0.2)])
def test_outlier_scores(spark, k, cell):
    rnd = random.Random(5)
    points = [(i, rnd.uniform(-1, 1), rnd.uniform(-1, 1)) for i in range(200)]
    points += [(1000 + i, 0.5 + rnd.gauss(0, 1e-5), 0.5 + rnd.gauss(0, 1e-5)) for i in range(100)] + [(2000 + i, 0.25, 0.25) for i in range(42)]
    points += [(3000, 9.0, 9.0), (3001, None, 1.0), (3002, math.nan, 1.0), (3003, -9.0, -9.0), (3004, -9.0, -9.0), (3005, 0.0, -0.0), (3006, -0.0, 0.0), (3007, math.inf, 1.0)]
    there = [(i, x, y) for i, x, y in points if x is not None and math.isfinite(x)]
    want = {i: None for i, _, _ in points}
    for i, x, y in there:
        near = sorted(d for j, u, v in there if j != i and (d := math.hypot(x - u, y - v)) <= cell)
        want[i] = near[k - 1] if len(near) >= k else None
    got = {r.id: r.score for r in geo.outlier_scores(spark.createDataFrame(points, "id int, x double, y double"), "id", cell, k).collect()}
    assert got == {i: None if w is None else pytest.approx(w, abs=1e-12) for i, w in want.items()}


def test_many_points_within_the_radius(spark):
    df = spark.range(40_000).selectExpr("id", "rand(1) * 0.05 as x", "rand(2) * 0.05 as y")
    began = time.monotonic()
    assert geo.outlier_scores(df, "id", 0.05, 3).filter("score is not null").count() == 40_000
    assert time.monotonic() - began < 60
