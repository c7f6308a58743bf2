import math

from pyspark.sql import functions as F

from geotide.functions import geo


def _one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_haversine_one_degree_latitude(spark):
    d = _one(spark, geo.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)))
    assert abs(d - geo.EARTH_RADIUS_M * math.pi / 180) < 1e-6


def test_geodesic_close_to_known(spark):
    # one degree of latitude at the equator on WGS84 is 110574.4 m
    d = _one(spark, geo.geodesic_m(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)))
    assert abs(d - 110574.4) < 2.0
    assert _one(spark, geo.geodesic_m(F.lit(59.3), F.lit(18.0), F.lit(59.3), F.lit(18.0))) == 0.0


def _line(pts):
    return F.array(*[geo.make_point(F.lit(x), F.lit(y)) for x, y in pts]).cast(geo.LINE_TYPE)


def test_point_to_path(spark):
    line = _line([(18.0, 59.3), (18.01, 59.3)])
    on = _one(spark, geo.point_to_path_m(F.lit(59.3), F.lit(18.005), line))
    assert on < 1e-6
    beyond = _one(spark, geo.point_to_path_m(F.lit(59.3), F.lit(18.02), line))
    end = _one(spark, geo.point_to_path_m(F.lit(59.3), F.lit(18.02), _line([(18.01, 59.3)])))
    assert abs(beyond - end) < 1e-6 and beyond > 1000
    empty = _one(spark, geo.point_to_path_m(F.lit(59.3), F.lit(18.0), F.array().cast(geo.LINE_TYPE)))
    assert math.isinf(empty)


def test_line_centroid_and_length(spark):
    c = _one(spark, geo.line_centroid(_line([(0.0, 0.0), (2.0, 0.0), (2.0, 2.0)])))
    assert abs(c["lon"] - 1.5) < 1e-12 and abs(c["lat"] - 0.5) < 1e-12
    same = _one(spark, geo.line_centroid(_line([(1.0, 1.0), (1.0, 1.0)])))
    assert same["lon"] == 1.0 and same["lat"] == 1.0
    ln = _one(spark, geo.path_length_m(_line([(0.0, 0.0), (0.0, 1.0), (0.0, 2.0)])))
    assert abs(ln - 2 * 110574.4) < 5.0


def test_wkt_roundtrip(spark):
    line = _line([(18.0, 59.3), (18.5, 59.25)])
    back = _one(spark, geo.parse_wkt_linestring(geo.wkt_linestring(line)))
    assert [(p["lon"], p["lat"]) for p in back] == [(18.0, 59.3), (18.5, 59.25)]
    assert _one(spark, geo.parse_wkt_linestring(F.lit("garbage"))) is None
