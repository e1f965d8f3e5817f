import struct

from pyspark.sql import functions as F

from geoq.functions import crs
from geoq.functions import geometry as G
from geoq.functions import wkb as W
from geoq.operators import osm as OSM


def test_wkb_round_trip_and_big_endian(spark):
    df = spark.createDataFrame([("POLYGON ((0 0, 4 0, 4 3, 0 3, 0 0), (1 1, 1 2, 2 2, 1 1))",),
                                ("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))",),
                                ("POINT (1.5 -2)",), ("LINESTRING (0 0, 3 4, 5 5)",)], "w string")
    g = df.select("w", G.geom_from_wkt("w").alias("g"))
    out = W.with_geom_from_wkb(W.with_wkb(g, "g", "b"), "b", "g2").select("w", G.as_wkt("g2").alias("w2")).collect()
    assert all(r.w == r.w2 for r in out)
    be = struct.pack(">BIdd", 0, 1, 7.0, 8.0)
    r = W.with_geom_from_wkb(spark.createDataFrame([(bytearray(be),)], "b binary"), "b", "g") \
        .select(G.x("g").alias("x"), G.y("g").alias("y")).first()
    assert (r.x, r.y) == (7.0, 8.0)


def test_utm_reference_points(spark):
    df = spark.createDataFrame([(9.19, 45.4642), (9.0, 45.0)], "lon double, lat double")
    x, y = crs.lonlat_to_utm(F.col("lon"), F.col("lat"), 32)
    got = [(round(r[0], 3), round(r[1], 3)) for r in df.select(x, y).collect()]
    assert got == [(514853.496, 5034536.796), (500000.0, 4982950.4)]


def test_web_mercator_round_trip(spark):
    df = spark.createDataFrame([(12.4964, 41.9028)], "lon double, lat double")
    x, y = crs.transform_xy(F.col("lon"), F.col("lat"), 4326, 3857)
    r = df.select(x.alias("x"), y.alias("y")).first()
    lon, lat = crs.transform_xy(F.lit(r.x), F.lit(r.y), 3857, 4326)
    b = spark.range(1).select(lon.alias("lon"), lat.alias("lat")).first()
    assert abs(b.lon - 12.4964) < 1e-9 and abs(b.lat - 41.9028) < 1e-9


def test_relation_two_outer_one_inner(spark):
    nodes = spark.createDataFrame([(i, float(x), float(y), {}) for i, (x, y) in enumerate(
        [(0, 0), (10, 0), (10, 10), (0, 10), (20, 0), (30, 0), (30, 10), (20, 10), (2, 2), (4, 2), (4, 4), (2, 4)])],
        "id long, x double, y double, tags map<string,string>")
    ways = spark.createDataFrame([(100, [0, 1, 2, 3, 0], {}), (101, [4, 5, 6, 7, 4], {}), (102, [8, 9, 10, 11, 8], {}),
                                  (103, [0, 1, 2], {"building": "yes"})], "id long, nd array<long>, tags map<string,string>")
    rels = spark.createDataFrame([(1, [(100, "w", "outer"), (101, "w", "outer"), (102, "w", "inner")],
                                   {"type": "multipolygon", "building": "yes"})],
                                 "id long, members array<struct<ref:long,type:string,role:string>>, tags map<string,string>")
    b = OSM.buildings(nodes, ways, rels).select("feature_id", G.geom_type("geometry").alias("t"),
                                                F.size(F.col("geometry").parts).alias("np"),
                                                G.area("geometry").alias("a")).collect()
    assert [(r.feature_id, r.t, r.np, r.a) for r in b] == [("r1", "MULTIPOLYGON", 2, 200.0)]   # hole dropped, way 103 (3 points) dropped


def test_tags_match_modes(spark):
    df = spark.createDataFrame([({"a": "1", "b": "x"},), ({"a": "2"},), ({"b": "y"},)], "tags map<string,string>")
    anyc = df.where(OSM.tags_match("tags", {"a": "1", "b": True}, "any")).count()
    allc = df.where(OSM.tags_match("tags", {"a": ["1", "2"], "b": True}, "all")).count()
    assert (anyc, allc, df.where(OSM.tags_match("tags", None)).count()) == (2, 1, 3)


def test_simplify_and_clean(spark):
    from geoq.functions.buffer import _dp
    import numpy as np
    pts = np.array([(0, 0), (1, 0.1), (2, -0.1), (3, 5), (4, 6), (5, 7), (6, 8.1), (7, 9)], dtype=float)
    out = _dp(pts, 1.0)
    assert tuple(out[0]) == (0, 0) and tuple(out[-1]) == (7, 9) and len(out) < len(pts)
    df = spark.createDataFrame([("POLYGON ((0 0, 0 0, 0 3, 4 3, 4 0))",), ("POLYGON ((0 0, 1 1, 0 0))",)], "w string")
    r = df.select(G.as_wkt(G.clean_rings(G.geom_from_wkt("w"))).alias("c")).collect()
    assert r[0].c == "POLYGON ((0 0, 4 0, 4 3, 0 3, 0 0))" and r[1].c == "POLYGON EMPTY"
    from geoq.functions.buffer import with_simplified
    line = spark.createDataFrame([("LINESTRING (0 0, 1 0.1, 2 -0.1, 3 5, 4 6, 5 7, 6 8.1, 7 9)",)], "w string") \
        .select(G.geom_from_wkt("w").alias("g"))
    s = with_simplified(line, "g", 1.0).select(G.num_points("simplified").alias("n"), G.x("simplified").alias("x")).first()
    assert s.n == len(out) and s.x == 0.0
