"""Geometry over the building tables and the text sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import geometry, scalars
from sparkloom.operators import geo
from sparkloom.registry import Registry
from sparkloom.sources import load

query = Registry()


def _points(spark, d):
    df = load(spark, d, "benchmarking_2016").filter("Latitude is not null and Longitude is not null").groupBy("OSEBuildingID").agg(F.min(F.struct("Neighborhood", "Longitude", "Latitude")).alias("r")).select("OSEBuildingID", "r.*")
    return df.select(F.col("OSEBuildingID").alias("id"), F.initcap(F.trim(F.replace("Neighborhood", F.lit("\n"), F.lit("")))).alias("area"), F.col("Longitude").alias("x"), F.col("Latitude").alias("y"))


_POINTS = "SELECT DISTINCT OSEBuildingID AS id, Longitude AS x, Latitude AS y FROM benchmarking_2016 WHERE Latitude IS NOT NULL AND Longitude IS NOT NULL"


@query("get_geodesic_dist", f"SELECT id, round(2 * 6371.0088 * asin(sqrt(sin(radians(46.6 - y) / 2) ^ 2 + cos(radians(y)) * cos(radians(46.6)) * sin(radians(-121.2 - x) / 2) ^ 2)), 6) AS km FROM ({_POINTS})")
def get_geodesic_dist(spark, d):
    km = scalars.haversine(F.col("y"), F.col("x"), F.lit(46.6), F.lit(-121.2), "km")
    return _points(spark, d).select("id", F.round(km, 6).alias("km"))


#: The closed form of the projection with the fixed values of ``scalars.lambert93``.
_LAMBERT = f"""WITH p AS (SELECT id, radians(y) AS phi, radians(x + 124 - 3) AS lam FROM ({_POINTS})),
i AS (SELECT id, lam, 11754255.426 * exp(-0.7256077650 * (ln(tan(phi / 2 + pi() / 4)) - 0.08181919112 / 2 * ln((1 + 0.08181919112 * sin(phi)) / (1 - 0.08181919112 * sin(phi))))) AS r FROM p)
SELECT id, round(700000 + r * sin(0.7256077650 * lam), 3) AS x, round(12655612.050 - r * cos(0.7256077650 * lam), 3) AS y FROM i"""


@query("convert_geodetic_system", _LAMBERT)
def convert_geodetic_system(spark, d):
    x, y = scalars.lambert93(F.col("y"), F.col("x") + 124)
    return _points(spark, d).select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


#: Hull edges of each area: ordered pairs of its points with none to the right and all collinear ones between them.
_HULL = """WITH p AS (SELECT DISTINCT OSEBuildingID AS id, upper(trim(replace(Neighborhood, chr(10), ''))) AS area, Longitude AS x, Latitude AS y FROM benchmarking_2016 WHERE Latitude IS NOT NULL AND Longitude IS NOT NULL),
q AS (SELECT DISTINCT area, x, y FROM p WHERE area IS NOT NULL),
e AS (SELECT a.area, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS bb FROM q a JOIN q b ON a.area = b.area AND (a.x <> b.x OR a.y <> b.y) WHERE NOT EXISTS (SELECT 1 FROM q c WHERE c.area = a.area
  AND ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0 OR (b.x - a.x) * (c.y - a.y) = (b.y - a.y) * (c.x - a.x) AND (c.x < least(a.x, b.x) OR c.x > greatest(a.x, b.x) OR c.y < least(a.y, b.y) OR c.y > greatest(a.y, b.y))))),
h AS (SELECT area, count(*) AS corners, abs(sum(ax * bb - bx * ay)) / 2 AS size FROM e GROUP BY 1),
i AS (SELECT p.id, p.area AS own, h.area FROM p CROSS JOIN h WHERE h.corners > 2 AND NOT EXISTS (SELECT 1 FROM e WHERE e.area = h.area AND (bx - ax) * (p.y - ay) - (bb - ay) * (p.x - ax) < -1e-12))
"""


@query("transform_coordinates_to_geometry_for_each_place_uid", _HULL + "SELECT area, n AS points, CASE WHEN corners > 2 THEN corners ELSE 0 END::INT AS corners, CASE WHEN corners > 2 THEN round(size, 9) ELSE 0 END AS size FROM (SELECT area, count(*) AS n FROM p WHERE area IS NOT NULL GROUP BY 1) LEFT JOIN h USING (area)")
def transform_coordinates_to_geometry(spark, d):
    out = geo.outlines(_points(spark, d), "area")
    solid = geometry.kind(F.col("outline")) == "POLYGON"
    return out.select(F.upper("area").alias("area"), "points", F.when(solid, F.size("outline") - 1).otherwise(0).alias("corners"), F.when(solid, F.round(geometry.area(F.col("outline")), 9)).otherwise(0.0).alias("size"))


@query("outlines_as_text")
def outlines_as_text(spark, d):
    return geo.outlines(_points(spark, d), "area").select("area", geometry.wkt(F.col("outline")).alias("wkt"))


@query("spatial_filter", _HULL + "SELECT containers, count(*) AS n FROM (SELECT p.id, CASE WHEN count(i.area) = 1 THEN 'one' WHEN count(i.area) > 1 THEN 'many' ELSE 'none' END AS containers FROM p LEFT JOIN i USING (id) GROUP BY 1) GROUP BY 1")
def spatial_filter(spark, d):
    p = _points(spark, d)
    return geo.containers(p, geo.outlines(p, "area").select("area", "outline"), "id", "outline", 0.05).groupBy("containers").agg(F.count(F.lit(1)).alias("n"))


@query("rebuild_unmatched_polygons_gdf", _HULL + ", c AS (SELECT area AS polygon, own, count(*) AS n FROM i WHERE own IS NOT NULL GROUP BY 1, 2) SELECT polygon, arg_max(own, (n, own)) AS area, max(n) AS n FROM c GROUP BY 1")
def rebuild_unmatched_polygons(spark, d):
    p = _points(spark, d).withColumn("area", F.upper("area"))
    hulls = geo.outlines(p, "area").select(F.col("area").alias("polygon"), "outline")
    return geo.majority_station(geo.points_in_polygons(p, hulls, "outline", 0.05), "polygon", "area")


@query("get_geometry_nearest_neighbors", f"WITH p AS ({_POINTS}) SELECT a.id, count(*) AS near, round(min(sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2)), 9) AS nearest FROM p a JOIN p b ON a.id <> b.id AND sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2) <= 0.02 GROUP BY 1")
def get_geometry_nearest_neighbors(spark, d):
    p = _points(spark, d)
    pairs = geo.near_pairs(p, p.withColumnRenamed("id", "other"), "id", "other", 0.02).filter("id <> other")
    return pairs.groupBy("id").agg(F.count(F.lit(1)).alias("near"), F.round(F.min("distance"), 9).alias("nearest"))


@query(
    "filter_outliers",
    f"""WITH p AS ({_POINTS}), d AS (SELECT a.id, sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2) AS d, b.id AS other FROM p a JOIN p b ON a.id <> b.id AND abs(a.x - b.x) <= 0.05 AND abs(a.y - b.y) <= 0.05),
    s AS (SELECT id, d AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS r FROM d WHERE d <= 0.05) WHERE r = 3)
    SELECT id, round(score, 9) AS score FROM s WHERE score <= (SELECT quantile_cont(score, 0.9) FROM s)""",
)
def filter_outliers(spark, d):
    return geo.filter_outliers(_points(spark, d), "id", 0.05, 3, 0.9).select("id", F.round("score", 9).alias("score"))


@query("get_geometry_intersections")
def get_geometry_intersections(spark, d):
    out = geo.intersections(geo.outlines(_points(spark, d), "area"), "area", "outline", 0.1)
    return out.select("a", "b", "owner", "kind", F.round(geometry.area(F.col("part")), 9).alias("size"))


@query("overlapping_boxes", f"""WITH p AS (SELECT DISTINCT OSEBuildingID, upper(trim(replace(Neighborhood, chr(10), ''))) AS area, Longitude AS x, Latitude AS y FROM benchmarking_2016 WHERE Latitude IS NOT NULL AND Longitude IS NOT NULL AND Neighborhood IS NOT NULL),
    b AS (SELECT area, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p GROUP BY 1) SELECT a.area AS a, b.area AS b FROM b a JOIN b ON a.area < b.area AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1""")
def overlapping_boxes(spark, d):
    return geo.overlapping_boxes(geo.outlines(_points(spark, d).withColumn("area", F.upper("area")), "area"), "area", "outline", 0.1)


@query("transform_polygons_as_lines", _HULL + "SELECT area, round(sqrt((ax - bx) ^ 2 + (ay - bb) ^ 2), 9) AS length FROM e JOIN h USING (area) WHERE corners > 2 UNION ALL SELECT area, round(sqrt((ax - bx) ^ 2 + (ay - bb) ^ 2), 9) FROM e JOIN h USING (area) WHERE corners = 2 AND (ax, ay) < (bx, bb)")
def transform_polygons_as_lines(spark, d):
    out = geo.outlines(_points(spark, d), "area").filter(F.size("outline") > 1)
    return out.select("area", F.explode(geometry.edges(F.col("outline"))).alias("e")).select(F.upper("area").alias("area"), F.round(geometry.distance(F.col("e.a"), F.col("e.b")), 9).alias("length"))


@query("distance_to_box_edge", f"SELECT id, round(46.9 - y, 6) AS north, round(-121.0 - x, 6) AS east FROM ({_POINTS})")
def distance_to_box_edge(spark, d):
    return _points(spark, d).select("id", F.round(46.9 - F.col("y"), 6).alias("north"), F.round(-121.0 - F.col("x"), 6).alias("east"))


queries, oracle_sql = query.queries, query.oracle_sql
