"""Plane geometry on rings of points: hulls, containment, distances, text form."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RING = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))


def hull(points: Sequence[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull, counter-clockwise, closed (first point again at the end); one or two points come back as they are."""
    unique = sorted(set(points))
    if len(unique) < 3:
        return unique

    def half(ordered) -> list:
        out: list = []
        for p in ordered:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    ring = half(unique) + half(reversed(unique))
    return ring + ring[:1]


def contains(ring: np.ndarray, x: float, y: float) -> bool:
    """Whether a closed ring holds a point (points on the edge count)."""
    if len(ring) < 4:
        return False
    a, b = ring[:-1], ring[1:]
    cross = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) - (b[:, 1] - a[:, 1]) * (x - a[:, 0])
    on = (np.abs(cross) < 1e-12) & (np.minimum(a[:, 0], b[:, 0]) - 1e-12 <= x) & (x <= np.maximum(a[:, 0], b[:, 0]) + 1e-12) & (np.minimum(a[:, 1], b[:, 1]) - 1e-12 <= y) & (y <= np.maximum(a[:, 1], b[:, 1]) + 1e-12)
    if on.any():
        return True
    up = (a[:, 1] > y) != (b[:, 1] > y)
    if not up.any():
        return False
    a, b = a[up], b[up]
    return bool((x < a[:, 0] + (y - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0])).sum() % 2)


def _ring(points) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in points], float).reshape(-1, 2)


@F.pandas_udf(T.BooleanType())
def _inside(rings: pd.Series, xs: pd.Series, ys: pd.Series) -> pd.Series:
    return pd.Series([r is not None and contains(_ring(r), x, y) for r, x, y in zip(rings, xs, ys)])


def inside(ring: Column, x: Column, y: Column) -> Column:
    """Point-in-polygon test of a ring column."""
    return _inside(ring, x, y)


@F.pandas_udf(RING)
def _hull_of(lists: pd.Series) -> pd.Series:
    return lists.map(lambda ps: None if ps is None else [{"x": x, "y": y} for x, y in hull([(p["x"], p["y"]) for p in ps])])


def hull_of(points: Column) -> Column:
    return _hull_of(points)


def clip(subject: Sequence[tuple[float, float]], window: Sequence[tuple[float, float]]) -> list[tuple[float, float]]:
    """The hull of what two convex, counter-clockwise, closed rings have in common: a closed ring, two points, one or none."""
    out = list(subject[:-1])
    for (ax, ay), (bx, by) in zip(window, window[1:]):
        side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in out]
        kept = []
        for i, (p, s) in enumerate(zip(out, side)):
            q, t = out[i - 1], side[i - 1]
            if s * t < 0:
                kept.append((q[0] + (p[0] - q[0]) * t / (t - s), q[1] + (p[1] - q[1]) * t / (t - s)))
            if s >= 0:
                kept.append(p)
        out = kept
    return hull(out)


@F.pandas_udf(RING)
def _overlap(left: pd.Series, right: pd.Series) -> pd.Series:
    def one(a, b):
        pairs = [[(p["x"], p["y"]) for p in ring] for ring in (a, b)]
        return [{"x": x, "y": y} for x, y in clip(*pairs)]

    return pd.Series([None if a is None or b is None else one(a, b) for a, b in zip(left, right)])


def convex_overlap(a: Column, b: Column) -> Column:
    """The shared part of two convex outlines as made by ``hull_of``."""
    return _overlap(a, b)


def rings_of(edges: Sequence[tuple[tuple, tuple]]) -> list[list[tuple]]:
    """Edges without direction chained to closed rings, each begun at its least point; edges that close no ring are left out."""
    at: dict[tuple, list[tuple]] = {}
    for a, b in sorted(edges):
        at.setdefault(a, []).append(b)
        at.setdefault(b, []).append(a)
    out = []
    for start in sorted(at):
        while at[start]:
            ring, here = [start], start
            while at[here]:
                there = min(at[here])
                at[here].remove(there)
                at[there].remove(here)
                ring.append(there)
                here = there
                if here == start:
                    break
            if len(ring) > 3 and ring[0] == ring[-1]:
                out.append(ring)
    return out


@F.pandas_udf(T.ArrayType(RING))
def _chain(lists: pd.Series) -> pd.Series:
    def one(es):
        return [[{"x": x, "y": y} for x, y in ring] for ring in rings_of([((e["a"]["x"], e["a"]["y"]), (e["b"]["x"], e["b"]["y"])) for e in es])]

    return lists.map(lambda es: None if es is None else one(es))


def chain(edges: Column) -> Column:
    """Arrays of edges (a, b) as closed rings."""
    return _chain(edges)


def kind(points: Column) -> Column:
    """POLYGON, LINESTRING or POINT, as ``wkt`` writes it; null for none."""
    closed = (F.size(points) >= 4) & (F.element_at(points, 1) == F.element_at(points, -1))
    return F.when(F.size(points) < 1, F.lit(None)).when(closed, "POLYGON").when(F.size(points) > 1, "LINESTRING").otherwise("POINT")


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def round_points(points: Column, precision: int) -> Column:
    return F.transform(points, lambda p: F.struct(F.round(p["x"], precision).alias("x"), F.round(p["y"], precision).alias("y")))


def area(ring: Column) -> Column:
    """Area of a closed ring (shoelace)."""
    pairs = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)) / 2


def edges(ring: Column) -> Column:
    """Boundary lines of a closed ring as an array of (a, b)."""
    return F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def exterior(rings: Column) -> Column:
    """The first ring of a polygon: holes filled."""
    return F.element_at(rings, 1)


def _coordinates(points: Column) -> Column:
    return F.array_join(F.transform(points, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", ")


def wkt(points: Column) -> Column:
    """Text form of a list of points: POLYGON where it is closed with at least four, LINESTRING, or POINT."""
    closed = (F.size(points) >= 4) & (F.element_at(points, 1) == F.element_at(points, -1))
    text = _coordinates(points)
    return F.when(closed, F.concat(F.lit("POLYGON (("), text, F.lit("))"))).when(F.size(points) > 1, F.concat(F.lit("LINESTRING ("), text, F.lit(")"))).otherwise(F.concat(F.lit("POINT ("), text, F.lit(")")))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2))
