"""Spatial joins by grid cells, outlines per key, nearest neighbours.

Spatial predicates are no equi joins; here both sides are put into cells of a grid, joined on the cell and then tested. The
number of cells a geometry covers is bounded by choosing the cell from its size, so there is no cross join.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import geometry
from sparkloom.operators.quantiles import column_quantiles


def coordinate_columns(df: DataFrame) -> list[str]:
    """Names that start as coordinates do: a single x or y, lat, lon, long."""
    return [c for c in df.columns if re.match(r"(?i)([xy]$|lat|long?)", c)]


def as_xy(df: DataFrame, a: str, b: str) -> DataFrame:
    """Renames two coordinate columns to x and y; the one with the larger first value is y."""
    row = df.select(a, b).na.drop("any").head()
    x, y = (b, a) if row is not None and row[0] > row[1] else (a, b)
    return df.withColumnsRenamed({x: "x", y: "y"})


def with_points(df: DataFrame, x: str = "x", y: str = "y", srid: int = 4326) -> DataFrame:
    return df.withColumn("point", geometry.point(F.col(x), F.col(y))).withColumn("srid", F.lit(srid))


def outlines(df: DataFrame, key: str, x: str = "x", y: str = "y") -> DataFrame:
    """key, points, outline: convex hull of each key's points.

    Hulls are taken per key and salt first, then of the hull points: a key with a third of all rows is spread, and what is
    collected per task is a hull. Rows with a null are left out.
    """
    rows = df.select(F.col(key), geometry.point(F.col(x), F.col(y)).alias("p")).filter(f"`{key}` is not null and p.x is not null and p.y is not null")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("p"), F.lit(64)))
    part = salted.groupBy(key, "salt").agg(F.count(F.lit(1)).alias("n"), geometry.hull_of(F.collect_set("p")).alias("h"))
    whole = part.groupBy(key).agg(F.sum("n").alias("points"), geometry.hull_of(F.flatten(F.collect_list("h"))).alias("outline"))
    return whole


def _cells(df: DataFrame, ring: str, cell: float) -> DataFrame:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])

    def span(values: Column) -> Column:
        return F.sequence(F.floor(F.array_min(values) / cell), F.floor(F.array_max(values) / cell))

    return df.withColumn("_cx", F.explode(span(xs))).withColumn("_cy", F.explode(span(ys)))


def points_in_polygons(points: DataFrame, polygons: DataFrame, ring: str, cell: float, x: str = "x", y: str = "y") -> DataFrame:
    """Pairs of points and the polygons that hold them (edge included), by equi join on grid cells, then the exact test."""
    p = points.withColumn("_cx", F.floor(F.col(x) / cell)).withColumn("_cy", F.floor(F.col(y) / cell))
    pairs = p.join(_cells(polygons, ring, cell), ["_cx", "_cy"])
    return pairs.filter(geometry.inside(F.col(ring), F.col(x), F.col(y))).drop("_cx", "_cy")


def containers(points: DataFrame, polygons: DataFrame, key: str, ring: str, cell: float) -> DataFrame:
    """Every point with ``containers``: one, many or none (uncovered)."""
    hits = points_in_polygons(points.select(key, "x", "y"), polygons, ring, cell).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    out = points.join(hits, key, "left")
    return out.withColumn("containers", F.when(F.col("_n") == 1, "one").when(F.col("_n") > 1, "many").otherwise("none")).drop("_n")


def near_pairs(a: DataFrame, b: DataFrame, key: str, other: str, radius: float) -> DataFrame:
    """key, other, distance of all pairs of points (x, y) within the radius: a lies in one cell, b in its own and the eight around it."""
    left = a.select(F.col(key), F.col("x").alias("_x"), F.col("y").alias("_y"), F.floor(F.col("x") / radius).alias("_cx"), F.floor(F.col("y") / radius).alias("_cy"))
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    right = b.select(F.col(other), F.col("x").alias("_u"), F.col("y").alias("_v")).withColumn("_i", F.explode(around)).withColumn("_j", F.explode(around))
    right = right.select(other, "_u", "_v", (F.floor(F.col("_u") / radius) + F.col("_i")).alias("_cx"), (F.floor(F.col("_v") / radius) + F.col("_j")).alias("_cy"))
    d = F.sqrt(F.pow(F.col("_x") - F.col("_u"), 2) + F.pow(F.col("_y") - F.col("_v"), 2))
    return left.join(right, ["_cx", "_cy"]).withColumn("distance", d).filter(F.col("distance") <= radius).select(key, other, "distance")


def nearest(a: DataFrame, b: DataFrame, key: str, other: str, radius: float) -> DataFrame:
    """The nearest point of b for each of a within the radius (ties the smallest key); points without one have nulls."""
    best = near_pairs(a, b, key, other, radius).groupBy(key).agg(F.min(F.struct("distance", other)).alias("m"))
    return a.join(best.select(key, F.col(f"m.{other}").alias(other), "m.distance"), key, "left")


def majority_station(pairs: DataFrame, polygon: str, station: str) -> DataFrame:
    """polygon, station, n: the station with most points in each polygon, ties the larger station (the last when sorted)."""
    counts = pairs.groupBy(polygon, station).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(polygon).agg(F.max_by(F.struct(station, "n"), F.struct("n", station)).alias("m")).select(polygon, f"m.{station}", "m.n")


def drop_duplicate_geometries(df: DataFrame, points: str) -> DataFrame:
    return df.withColumn("_w", geometry.wkt(F.col(points))).dropDuplicates(["_w"]).drop("_w")


def overlapping_boxes(df: DataFrame, key: str, ring: str, cell: float) -> DataFrame:
    """a, b (a < b): pairs of geometries whose bounding boxes overlap, found by shared grid cells."""
    box = df.select(F.col(key), F.array_min(F.transform(ring, lambda p: p["x"])).alias("x0"), F.array_max(F.transform(ring, lambda p: p["x"])).alias("x1"), F.array_min(F.transform(ring, lambda p: p["y"])).alias("y0"), F.array_max(F.transform(ring, lambda p: p["y"])).alias("y1"), F.col(ring))
    cells = _cells(box, ring, cell).drop(ring)
    right = cells.select(*[F.col(c).alias(f"_{c}") if not c.startswith("_c") else F.col(c) for c in cells.columns])
    both = cells.join(right, ["_cx", "_cy"]).filter((F.col(key) < F.col(f"_{key}")) & (F.col("x0") <= F.col("_x1")) & (F.col("_x0") <= F.col("x1")) & (F.col("y0") <= F.col("_y1")) & (F.col("_y0") <= F.col("y1")))
    return both.select(F.col(key).alias("a"), F.col(f"_{key}").alias("b")).distinct()


def intersections(df: DataFrame, key: str, ring: str, cell: float) -> DataFrame:
    """a, b, owner, kind (POLYGON or LINESTRING), part: what two convex outlines have in common, where that is more than a point.

    Pairs come from ``overlapping_boxes``; the shared part is then clipped exactly. owner is the outline with more points, b at
    equality. Outlines of fewer than three points have no inside and take no part.
    """
    solid = df.filter(F.size(ring) >= 4).select(F.col(key), F.col(ring))
    pairs = overlapping_boxes(solid, key, ring, cell)
    both = pairs.join(solid.select(F.col(key).alias("a"), F.col(ring).alias("_ra")), "a").join(solid.select(F.col(key).alias("b"), F.col(ring).alias("_rb")), "b")
    part = both.withColumn("part", geometry.convex_overlap(F.col("_ra"), F.col("_rb"))).filter(F.size("part") > 1)
    return part.select("a", "b", F.when(F.size("_ra") > F.size("_rb"), F.col("a")).otherwise(F.col("b")).alias("owner"), geometry.kind(F.col("part")).alias("kind"), "part")


def _edges(df: DataFrame, key: str, ring: str) -> DataFrame:
    """key, lo, hi: the boundary edges of closed rings, without direction."""
    e = df.select(F.col(key), F.explode(geometry.edges(F.col(ring))).alias("_e")).filter("_e.a <> _e.b")
    return e.select(key, F.least("_e.a", "_e.b").alias("lo"), F.greatest("_e.a", "_e.b").alias("hi"))


def dissolve(polygons: DataFrame, key: str, ring: str) -> DataFrame:
    """key, ring: the outlines of the union of each key's polygons, one row per ring; rows with a null key are left out.

    For polygons that meet in whole edges, as the cells of a partition of the plane do: an edge that two of them share is inside and
    goes, the others are chained. Edges cancel map-side; what meets in a task is the outline of a key.
    """
    odd = _edges(polygons.filter(F.col(key).isNotNull()), key, ring).groupBy(key, "lo", "hi").agg(F.count(F.lit(1)).alias("_n")).filter("_n % 2 = 1")
    chained = odd.groupBy(key).agg(geometry.chain(F.collect_list(F.struct(F.col("lo").alias("a"), F.col("hi").alias("b")))).alias("_r"))
    return chained.select(key, F.explode("_r").alias("ring"))


def common_limits(left: DataFrame, right: DataFrame, key: str, other: str, ring: str) -> DataFrame:
    """key, other, length: the boundary that polygons of both sides share in whole edges."""
    a, b = _edges(left, key, ring), _edges(right, other, ring)
    shared = a.join(b, ["lo", "hi"]).groupBy(key, other).agg(F.sum(geometry.distance(F.col("lo"), F.col("hi"))).alias("length"))
    return shared


def largest_common_limit(uncovered: DataFrame, known: DataFrame, key: str, other: str, ring: str) -> DataFrame:
    """key, other, length of every uncovered polygon: the known one it shares most boundary with (ties the smallest), nulls if none."""
    best = common_limits(uncovered, known, key, other, ring).groupBy(key).agg(F.min(F.struct((-F.col("length")).alias("n"), other)).alias("m"))
    return uncovered.select(key).join(best.select(key, F.col(f"m.{other}").alias(other), (-F.col("m.n")).alias("length")), key, "left")


def split_by_key(df: DataFrame, key: str) -> dict[str, DataFrame]:
    """passed: rows without the key (no common limit); failed: rows with one."""
    return {"passed": df.filter(F.col(key).isNull()), "failed": df.filter(F.col(key).isNotNull())}


def outlier_scores(df: DataFrame, key: str, cell: float, k: int = 5, levels: int = 16) -> DataFrame:
    """key, score: distance to the k-th nearest other point within a cell's reach (null, meaning far, where there are fewer).

    Stands in for a density outlier score; the quantile to drop above is the caller's. Keys are unique. Points of one place
    are compared once, with their number. Cells are halved again and again, and each place takes the smallest one around it that holds
    more than k points: its k-th nearest is within the diagonal, so only the cells up to two away are compared. A place without such
    a cell is compared within the radius.
    """
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    finite = (F.abs(x) < float("inf")) & (F.abs(y) < float("inf"))  # NaN is above all
    places = df.filter(F.col(key).isNotNull() & finite).groupBy((x + 0.0).alias("_x"), (y + 0.0).alias("_y")).agg(F.count(F.lit(1)).alias("_n"))

    def cells(level: Column) -> list[Column]:
        return [F.floor(F.col(c) / (F.lit(cell) / F.pow(F.lit(2.0), level))) for c in ("_x", "_y")]

    at = places.withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    at = at.select("_x", "_y", "_n", "_l", *[c.alias(n) for c, n in zip(cells(F.col("_l")), ("_cx", "_cy"))])
    full = at.filter("_l > 0").groupBy("_l", "_cx", "_cy").agg(F.sum("_n").alias("_m")).filter(F.col("_m") > k).drop("_m")
    # no broadcasts: the planner does not know how many rows the exploded sides have
    own = at.join(full.hint("merge"), ["_l", "_cx", "_cy"]).groupBy("_x", "_y").agg(F.max("_l").alias("_l"))
    own = places.join(own, ["_x", "_y"], "left").withColumn("_l", F.coalesce("_l", F.lit(0)))

    reach = F.when(F.col("_l") == 0, 1).otherwise(2)
    asked = own.select("_x", "_y", "_n", "_l", *[c.alias(n) for c, n in zip(cells(F.col("_l")), ("_cx", "_cy"))])
    asked = asked.withColumn("_cx", F.explode(F.sequence(F.col("_cx") - reach, F.col("_cx") + reach))).withColumn("_cy", F.explode(F.sequence(F.col("_cy") - reach, F.col("_cy") + reach)))
    others = at.select("_l", "_cx", "_cy", F.col("_x").alias("_u"), F.col("_y").alias("_v"), F.col("_n").alias("_w"))
    d = F.sqrt(F.pow(F.col("_x") - F.col("_u"), 2) + F.pow(F.col("_y") - F.col("_v"), 2))
    pairs = asked.join(others.hint("merge"), ["_l", "_cx", "_cy"]).withColumn("_d", d)
    near = pairs.filter((F.col("_d") <= cell) & ((F.col("_l") == 0) | (F.col("_d") <= 1.5 * cell / F.pow(F.lit(2.0), F.col("_l")))))
    # the place itself counts for the other points there
    near = near.groupBy("_x", "_y", "_d").agg(F.sum("_w").alias("_w"))
    upto = F.sum("_w").over(Window.partitionBy("_x", "_y").orderBy("_d").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kth = near.withColumn("_to", upto).filter(F.col("_to") > k).groupBy("_x", "_y").agg(F.min("_d").alias("score"))
    scored = df.join(kth, F.col(key).isNotNull() & (x + 0.0 == F.col("_x")) & (y + 0.0 == F.col("_y")), "left")
    return scored.drop("_x", "_y")


def filter_outliers(df: DataFrame, key: str, cell: float, k: int = 5, quantile: float = 0.9) -> DataFrame:
    """Without the points whose score is above that quantile of all scores; points without a score (nothing near) are outliers too."""
    scored = outlier_scores(df, key, cell, k)
    cut = column_quantiles(scored, {"_cut": F.col("score")}, [quantile])
    return scored.join(F.broadcast(cut)).filter(F.col("score") <= F.col("_cut")[0]).drop("_cut")  # one row
