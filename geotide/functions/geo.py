"""Geographic scalar functions as Spark Columns (JVM-side, codegen friendly).

Points are two double columns (lat, lon).  A line is
``array<struct<lon:double, lat:double>>``.  Nothing here leaves the JVM: all
formulas are built from ``pyspark.sql.functions`` and higher-order functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for equal results)
# ---------------------------------------------------------------------------
# Mean Earth radius used for sphere distances (metres).
EARTH_RADIUS_M = 6371008.7714
# WGS84 ellipsoid: semi-major axis (metres) and flattening.
WGS84_A = 6378137.0
WGS84_F = 1.0 / 298.257223563
# Web-mercator sphere radius (metres) and latitude limit.
MERCATOR_R = 6378137.0
MERCATOR_MAX_LAT = 85.0511287798066
# Metres per degree used for hotspot radius conversion.
METRES_PER_DEGREE_RADIUS = 111000.0
# Default walking speed (m/s) when a client's speed is unknown or not positive.
WALKING_SPEED_MS = 1.4
# Bounding-box buffer in degrees around origin/destination.
BBOX_BUFFER_DEG = 0.01
# ---------------------------------------------------------------------------

DEG2RAD = 0.017453292519943295

POINT_TYPE = T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])
LINE_TYPE = T.ArrayType(POINT_TYPE)


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def rad(x) -> Column:
    return _c(x) * F.lit(DEG2RAD)


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance on the mean-radius sphere, in metres."""
    p1, p2 = rad(lat1), rad(lat2)
    dphi = rad(lat2) - rad(lat1)
    dlmb = rad(lon2) - rad(lon1)
    h = F.pow(F.sin(dphi / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlmb / 2), 2)
    return F.lit(2.0 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def planar_deg(lat1, lon1, lat2, lon2) -> Column:
    """Planar distance in degrees (what a KNN operator on lon/lat ranks by)."""
    dx = _c(lon1) - _c(lon2)
    dy = _c(lat1) - _c(lat2)
    return F.sqrt(dx * dx + dy * dy)


def geodesic_m(lat1, lon1, lat2, lon2) -> Column:
    """Ellipsoidal (WGS84) distance in metres, Andoyer-Lambert closed form.

    Agrees with an iterative geodesic solver to well under a metre at city
    scale; returns 0 for identical points.
    """
    f = WGS84_F
    b1 = F.atan(F.lit(1 - f) * F.tan(rad(lat1)))
    b2 = F.atan(F.lit(1 - f) * F.tan(rad(lat2)))
    dl = rad(lon2) - rad(lon1)
    h = F.pow(F.sin((b2 - b1) / 2), 2) + F.cos(b1) * F.cos(b2) * F.pow(F.sin(dl / 2), 2)
    sigma = F.lit(2.0) * F.asin(F.sqrt(F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0))))
    p = (b1 + b2) / 2
    q = (b2 - b1) / 2
    s2 = F.pow(F.sin(sigma / 2), 2)
    c2 = F.pow(F.cos(sigma / 2), 2)
    x = (sigma - F.sin(sigma)) * F.pow(F.sin(p), 2) * F.pow(F.cos(q), 2) / c2
    y = (sigma + F.sin(sigma)) * F.pow(F.cos(p), 2) * F.pow(F.sin(q), 2) / s2
    d = F.lit(WGS84_A) * (sigma - F.lit(f / 2) * (x + y))
    return F.when(sigma == 0, F.lit(0.0)).otherwise(d)


def mercator_x(lon) -> Column:
    return F.lit(MERCATOR_R) * rad(lon)


def mercator_y(lat) -> Column:
    la = F.least(F.greatest(_c(lat), F.lit(-MERCATOR_MAX_LAT)), F.lit(MERCATOR_MAX_LAT))
    return F.lit(MERCATOR_R) * F.log(F.tan(F.lit(3.141592653589793 / 4) + rad(la) / 2))


def make_point(lon, lat) -> Column:
    return F.struct(_c(lon).cast("double").alias("lon"), _c(lat).cast("double").alias("lat"))


def _segments(path: Column) -> Column:
    """array<struct<a:point, b:point>> of consecutive vertex pairs."""
    n = F.size(path)
    return F.when(n >= 2, F.arrays_zip(F.slice(path, 1, n - 1).alias("a"),
                                       F.slice(path, 2, n - 1).alias("b"))) \
        .otherwise(F.array().cast(T.ArrayType(T.StructType([
            T.StructField("a", POINT_TYPE), T.StructField("b", POINT_TYPE)]))))


def path_length_m(path, metric: str = "geodesic") -> Column:
    """Total length of a line (G5).  ``metric`` is 'geodesic' or 'sphere'."""
    fn = geodesic_m if metric == "geodesic" else haversine_m
    segs = _segments(_c(path))
    return F.aggregate(segs, F.lit(0.0),
                       lambda acc, s: acc + fn(s["a"]["lat"], s["a"]["lon"], s["b"]["lat"], s["b"]["lon"]))


def line_centroid(path) -> Column:
    """Length-weighted centroid of a line (planar, in degrees).

    Each segment contributes its midpoint weighted by its planar length; a
    line whose vertices are all equal (zero length) yields its first vertex,
    and an empty line yields null.
    """
    p = _c(path)
    segs = _segments(p)
    acc0 = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def step(acc, s):
        ln = planar_deg(s["a"]["lat"], s["a"]["lon"], s["b"]["lat"], s["b"]["lon"])
        return F.struct((acc["w"] + ln).alias("w"),
                        (acc["x"] + ln * (s["a"]["lon"] + s["b"]["lon"]) / 2).alias("x"),
                        (acc["y"] + ln * (s["a"]["lat"] + s["b"]["lat"]) / 2).alias("y"))

    tot = F.aggregate(segs, acc0, step)
    first = F.element_at(p, 1)
    return F.when(F.size(p) == 0, F.lit(None).cast(POINT_TYPE)) \
        .when(tot["w"] > 0, F.struct((tot["x"] / tot["w"]).alias("lon"), (tot["y"] / tot["w"]).alias("lat"))) \
        .otherwise(first)


def point_to_path_m(lat, lon, path) -> Column:
    """Distance from a point to a line in web-mercator metres.

    The point is projected onto every segment (clamped to the segment), the
    smallest distance wins.  A single-vertex line is a point; an empty or null
    line gives +infinity.
    """
    p = _c(path)
    px, py = mercator_x(lon), mercator_y(lat)

    def seg_dist(s):
        ax, ay = mercator_x(s["a"]["lon"]), mercator_y(s["a"]["lat"])
        bx, by = mercator_x(s["b"]["lon"]), mercator_y(s["b"]["lat"])
        dx, dy = bx - ax, by - ay
        l2 = dx * dx + dy * dy
        t = F.when(l2 == 0, F.lit(0.0)).otherwise(
            F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - ax) * dx + (py - ay) * dy) / l2)))
        qx, qy = ax + t * dx, ay + t * dy
        return F.sqrt((px - qx) * (px - qx) + (py - qy) * (py - qy))

    def vert_dist(v):
        vx, vy = mercator_x(v["lon"]), mercator_y(v["lat"])
        return F.sqrt((px - vx) * (px - vx) + (py - vy) * (py - vy))

    inf = F.lit(float("inf"))
    n = F.coalesce(F.size(p), F.lit(0))
    return F.when(p.isNull() | (n <= 0), inf) \
        .when(n == 1, vert_dist(F.element_at(p, 1))) \
        .otherwise(F.array_min(F.transform(_segments(p), seg_dist)))


def wkt_point(lon, lat) -> Column:
    return F.format_string("POINT(%s %s)", _c(lon).cast("string"), _c(lat).cast("string"))


def wkt_linestring(path) -> Column:
    """Print a line as WKT (sinks only)."""
    pts = F.transform(_c(path), lambda v: F.concat_ws(" ", v["lon"].cast("string"), v["lat"].cast("string")))
    return F.concat(F.lit("LINESTRING("), F.array_join(pts, ", "), F.lit(")"))


def parse_wkt_linestring(wkt) -> Column:
    """Parse ``LINESTRING(x y, x y, ...)`` into a line; malformed text -> null."""
    body = F.regexp_extract(_c(wkt), r"^\s*LINESTRING\s*\((.*)\)\s*$", 1)
    parts = F.split(F.trim(body), r"\s*,\s*")
    pts = F.transform(parts, lambda s: F.split(F.trim(s), r"\s+"))
    return F.when(F.length(body) == 0, F.lit(None).cast(LINE_TYPE)).otherwise(
        F.transform(pts, lambda xy: F.struct(
            xy.getItem(0).try_cast("double").alias("lon"),
            xy.getItem(1).try_cast("double").alias("lat"))))


def geojson_point(lon, lat) -> Column:
    """GeoJSON text of a point."""
    return F.to_json(F.struct(F.lit("Point").alias("type"),
                              F.array(_c(lon).cast("double"), _c(lat).cast("double")).alias("coordinates")))


def bbox(lat1, lon1, lat2, lon2, buffer_deg: float = BBOX_BUFFER_DEG) -> Column:
    """Bounding box of two points with a buffer (F23): struct(south, west, north, east)."""
    return F.struct(
        (F.least(_c(lat1), _c(lat2)) - F.lit(buffer_deg)).alias("south"),
        (F.least(_c(lon1), _c(lon2)) - F.lit(buffer_deg)).alias("west"),
        (F.greatest(_c(lat1), _c(lat2)) + F.lit(buffer_deg)).alias("north"),
        (F.greatest(_c(lon1), _c(lon2)) + F.lit(buffer_deg)).alias("east"))
