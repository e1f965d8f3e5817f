import math

from pyspark.sql import functions as F

from geoq.functions import buffer as B
from geoq.functions import geometry as G
from geoq.operators import overlay as OV

L_SHAPE = [(0, 0), (40, 0), (40, 15), (12, 15), (12, 50), (0, 50), (0, 0)]


def test_buffer_kernel_matches_reference_values():
    # values from the fixture table (checked there with JTS)
    assert abs(B.buffer_area_of_rings([[L_SHAPE]], 10, 8) - 3110.18064403) < 1e-6
    assert abs(B.buffer_area_of_rings([[L_SHAPE]], 10, 16) - 3112.06856132) < 1e-6
    rect = [(0, 0), (4, 0), (4, 3), (0, 3), (0, 0)]
    assert abs(B.buffer_area_of_rings([[rect]], 10, 16) - 465.65484905) < 1e-6


def test_convex_closed_form_equals_kernel(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 4.0, 3.0), (2, 10.0, 5.0, 37.0, 61.0)], "id int, a double, b double, c double, d double")
    df = df.select("id", G.box("a", "b", "c", "d").alias("g"))
    got = {r.id: r.buffer_area for r in B.with_buffer_area(df, "g", 10.0, 16).collect()}
    assert abs(got[1] - 465.65484905) < 1e-6
    exp2 = B.buffer_area_of_rings([[[(10, 5), (37, 5), (37, 61), (10, 61), (10, 5)]]], 10, 16)
    assert abs(got[2] - exp2) < 1e-6


def test_buffer_vs_jts_on_notched_polygons(spark):
    from tests.conftest import jts
    J = jts(spark)
    reader = J.io.WKTReader()
    wkt = "POLYGON ((0 0, 22000 0, 22000 9000, 9000 12000, 18000 21000, 0 18000, 0 0), (2000 2000, 2000 5000, 5000 5000, 5000 2000, 2000 2000))"
    ours = B.buffer_area_of_rings([[[(0, 0), (22000, 0), (22000, 9000), (9000, 12000), (18000, 21000), (0, 18000), (0, 0)],
                                    [(2000, 2000), (2000, 5000), (5000, 5000), (5000, 2000), (2000, 2000)]]], 10, 8)
    ref = reader.read(wkt).buffer(10.0, 8).getArea()
    assert abs(ours - ref) / ref < 1e-9


def test_union_and_difference_area(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 4.0, 3.0), (2, 2.0, 1.0, 6.0, 5.0)], "id int, a double, b double, c double, d double")
    polys = df.select("id", G.box("a", "b", "c", "d").alias("geometry"))
    assert abs(OV.union_area(polys, tile=2.0).first()["area"] - 24.0) < 1e-9
    b = polys.where("id = 1")
    o = polys.where("id = 2")
    assert abs(OV.difference_area(b, o, tile=1.5).first()["area"] - 8.0) < 1e-9


def test_union_area_matches_jts(spark):
    from geoq.plans import fixtures as FX
    from tests.conftest import SF_SMALL, jts
    J = jts(spark)
    polys = FX.poly_nation(spark, SF_SMALL).where("id <> 3")
    wkts = [r.w for r in polys.select(G.as_wkt("geometry").alias("w")).collect()]
    reader = J.io.WKTReader()
    geoms = [reader.read(w) for w in wkts]
    u = geoms[0]
    for g in geoms[1:]:
        u = u.union(g)
    ours = OV.union_area(polys).first()["area"]
    assert abs(ours - u.getArea()) / u.getArea() < 1e-12
    for tile in (3000.0, 50000.0):
        assert abs(OV.union_area(polys, tile=tile).first()["area"] - u.getArea()) / u.getArea() < 1e-12


def test_point_buffer_polygon_area(spark):
    r = spark.range(1).select(G.area(G.buffer_point(F.lit(0.0), F.lit(0.0), 100.0, 8)).alias("a")).first()
    assert abs(r.a - B.point_buffer_area(100.0, 8)) < 1e-6
    assert abs(B.point_buffer_area(1.0, 10000) - math.pi) < 1e-6


def test_buffer_of_any_geometry_vs_jts(spark):
    """Repeated vertices, several turns, lines, points, parts, empty and null."""
    from tests.conftest import jts
    reader = jts(spark).io.WKTReader()
    wkts = ["POLYGON ((0 0, 4 0, 4 3, 0 3, 0 0))", "POLYGON ((0 0, 4 0, 4 0, 4 3, 0 3, 0 0, 0 0))", "POINT (3 4)",
            "LINESTRING (0 0, 30 0, 30 40, 5 10)", "LINESTRING (0 0, 0 0, 10 0)", "MULTIPOINT ((0 0), (5 0), (100 100))",
            "MULTILINESTRING ((0 0, 30 0), (10 -20, 10 20), (200 0, 260 80))",
            "MULTIPOLYGON (((0 0, 40 0, 40 15, 12 15, 12 50, 0 50, 0 0)), ((45 0, 60 0, 60 20, 45 0)))", None]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(wkts)], "id int, w string") \
        .select("id", F.when(F.col("w").isNotNull(), G.geom_from_wkt("w")).alias("g"))
    got = {r.id: r.buffer_area for r in B.with_buffer_area(df, "g", 10.0, 8).collect()}
    assert len(got) == len(wkts) and got[len(wkts) - 1] is None
    for i, w in enumerate(wkts[:-1]):
        ref = reader.read(w).buffer(10.0, 8).getArea()
        assert abs(got[i] - ref) / ref < 2e-3, (w, got[i], ref)
    assert abs(got[0] - got[1]) < 1e-9


def test_star_is_not_convex(spark):
    star = [(math.cos(4 * math.pi * k / 5), math.sin(4 * math.pi * k / 5)) for k in range(5)]
    w = "POLYGON ((" + ", ".join(f"{x} {y}" for x, y in [*star, star[0]]) + "))"
    df = spark.createDataFrame([(w,), ("POLYGON ((0 0, 4 0, 4 3, 0 3, 0 0))",)], "w string").select(G.geom_from_wkt("w").alias("g"))
    assert [r.c for r in df.select(B.is_convex("g").alias("c")).collect()] == [False, True]


def test_buffer_of_a_long_boundary():
    """Memory grows with the pairs that overlap, not with all pairs."""
    n = 4000
    ring = [(1000 * math.cos(2 * math.pi * k / n) * (1 + 0.01 * (k % 2)), 1000 * math.sin(2 * math.pi * k / n) * (1 + 0.01 * (k % 2)))
            for k in range(n)]
    area = B.buffer_area_of_rings([[ring + ring[:1]]], 1.0, 2)
    assert abs(area - math.pi * 1011 ** 2) / area < 0.02


def _random_polygons(reader, r, n, whole):
    """Valid stars, many in one dense spot, some twice, some side by side."""
    wkts = [f"POLYGON (({x} 0, {x + 10} 0, {x + 10} 10, {x} 10, {x} 0))" for x in range(0, 40, 10)]
    while len(wkts) < n:
        cx, cy = (r.random() * 1000, r.random() * 1000) if r.random() < .5 else (500 + r.random() * 20, 500 + r.random() * 20)
        rad = r.choice([5, 20, 100])
        turns = sorted(r.random() * 2 * math.pi for _ in range(r.randrange(3, 12)))
        pts = [(cx + rad * (.3 + .7 * r.random()) * math.cos(t), cy + rad * (.3 + .7 * r.random()) * math.sin(t)) for t in turns]
        pts = [(round(x), round(y)) for x, y in pts] if whole else pts
        w = "POLYGON ((" + ", ".join(f"{x} {y}" for x, y in [*pts, pts[0]]) + "))"
        g = reader.read(w)
        if g.isValid() and g.getArea() > 0:
            wkts.append(w)
    return wkts + wkts[:20]


def test_tiled_overlay_matches_jts(spark):
    """Whole and fractional coordinates, tiles that are cut again, copies."""
    import random

    from tests.conftest import jts
    reader = jts(spark).io.WKTReader()
    border = "POLYGON ((100 100, 900 50, 950 900, 300 800, 100 100), (400 400, 400 600, 600 600, 600 400, 400 400))"
    b = spark.createDataFrame([(0, border)], "id int, w string").select("id", G.geom_from_wkt("w").alias("geometry"))
    for seed, whole, tile in ((1, True, None), (2, False, None), (3, True, 37.0)):
        wkts = _random_polygons(reader, random.Random(seed), 150, whole)
        union = reader.read(wkts[0])
        for w in wkts[1:]:
            union = union.union(reader.read(w))
        df = spark.createDataFrame(list(enumerate(wkts)), "id int, w string").select("id", G.geom_from_wkt("w").alias("geometry"))
        assert abs(OV.union_area(df, tile=tile).first()["area"] / union.getArea() - 1) < 1e-11
        rest = reader.read(border).difference(union).getArea()
        assert abs(OV.difference_area(b, df, tile=tile).first()["area"] / rest - 1) < 1e-11


def test_overlay_rows_are_linear_in_edges(spark):
    """Pieces a tile pass makes, per edge, at two sizes."""
    import numpy as np
    per_edge = []
    for n in (400, 6400):
        r = np.random.default_rng(n)
        side = 50.0 * n ** 0.5
        x, y = r.uniform(0, side, n), r.uniform(0, side, n)
        ax, ay, bx, by = x, y, x + r.uniform(-60, 60, n), y + r.uniform(-60, 60, n)
        s = max((OV.PER_TILE * side * side / n) ** 0.5, 60.0)
        grid = OV.Grid(-100.0, -100.0, s, int(side / s) + 9, int(side / s) + 9)
        zero = np.zeros(n, np.int64)
        t = {"pr": zero, "pc": zero, "role": zero, "kind": zero, "ax": ax, "ay": ay, "bx": bx, "by": by,
             "lo": np.minimum(ay, by), "hi": np.maximum(ay, by), "w": np.ones(n)}
        per_edge.append(sum(len(p["r"]) for p in OV.split_edges(t, grid)) / n)
    assert per_edge[1] < 1.2 * per_edge[0] < 6


def test_overlay_of_nothing(spark):
    none = spark.createDataFrame([], "id int, w string").select("id", G.geom_from_wkt("w").alias("geometry"))
    square = spark.createDataFrame([(1, "POLYGON ((0 0, 4 0, 4 3, 0 3, 0 0))")], "id int, w string").select("id", G.geom_from_wkt("w").alias("geometry"))
    assert OV.union_area(none).first()["area"] is None
    assert OV.difference_area(square, none).first()["area"] == 12.0
    assert OV.difference_area(square, square).first()["area"] == 0.0
