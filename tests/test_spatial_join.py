import random

import pytest
from pyspark.sql import functions as F

from geoq.functions import geometry as G
from geoq.operators import spatial_join as SJ


def _pts(spark, n, seed, scale=1000):
    rnd = random.Random(seed)
    return spark.createDataFrame([(i, float(rnd.randint(0, scale)), float(rnd.randint(0, scale))) for i in range(n)],
                                 "id long, x double, y double")


@pytest.mark.parametrize("cell", [None, 7.0, 50.0, 400.0])
def test_distance_join_equals_brute_force(spark, cell):
    a, b = _pts(spark, 300, 1), _pts(spark, 200, 2)
    got = SJ.candidate_pairs(a, b, "dwithin", distance=60.0, left_geom=("x", "y"), right_geom=("x", "y"),
                             left_cols=["id"], right_cols=["id"], cell_size=cell) \
        .select("l.id", "r.id").collect()
    al, bl = a.collect(), b.collect()
    exp = {(p.id, q.id) for p in al for q in bl if (p.x - q.x) ** 2 + (p.y - q.y) ** 2 <= 3600}
    assert sorted(map(tuple, got)) == sorted(exp)


def test_polygon_join_multilevel_equals_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(40):
        x, y = rnd.randint(0, 900), rnd.randint(0, 900)
        w, h = (rnd.randint(5, 60), rnd.randint(5, 60)) if i % 10 else (900, 700)   # a few huge boxes
        rows.append((i, float(x), float(y), float(x + w), float(y + h)))
    polys = spark.createDataFrame(rows, "id long, a double, b double, c double, d double") \
        .select("id", G.box("a", "b", "c", "d").alias("geometry"))
    pts = _pts(spark, 400, 4)
    got = SJ.candidate_pairs(pts, polys, "intersects", left_geom=("x", "y"), left_cols=["id"], right_cols=["id"],
                             cell_size=20.0, max_span=4).select("l.id", "r.id").collect()
    exp = {(p.id, r[0]) for p in pts.collect() for r in rows if r[1] <= p.x <= r[3] and r[2] <= p.y <= r[4]}
    assert sorted(map(tuple, got)) == sorted(exp)
    # extent x extent: box-box intersects across levels, each pair once
    got2 = SJ.candidate_pairs(polys, polys, "intersects", left_cols=["id"], right_cols=["id"], cell_size=20.0,
                              max_span=4).select("l.id", "r.id").collect()
    exp2 = {(p[0], q[0]) for p in rows for q in rows if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]}
    assert sorted(map(tuple, got2)) == sorted(exp2)


def test_sjoin_left_semi_anti(spark):
    pts = _pts(spark, 200, 5)
    polys = spark.createDataFrame([(1, 0.0, 0.0, 500.0, 500.0)], "id long, a double, b double, c double, d double") \
        .select(F.col("id").alias("pid"), G.box("a", "b", "c", "d").alias("geometry"))
    inside = {r.id for r in pts.collect() if 0 < r.x < 500 and 0 < r.y < 500}
    semi = {r.id for r in SJ.sjoin(pts, polys, "within", "semi", left_geom=("x", "y"), left_key="id").collect()}
    anti = {r.id for r in SJ.sjoin(pts, polys, "within", "anti", left_geom=("x", "y"), left_key="id").collect()}
    left = SJ.sjoin(pts, polys, "within", "left", left_geom=("x", "y"), left_key="id", right_cols=["pid"]).collect()
    assert semi == inside and anti == {r.id for r in pts.collect()} - inside
    assert len(left) == 200 and {r.id for r in left if r.pid is not None} == inside


def test_no_cartesian_product_in_plan(spark):
    a, b = _pts(spark, 50, 6), _pts(spark, 50, 7)
    p = SJ.candidate_pairs(a, b, "dwithin", distance=10.0, left_geom=("x", "y"), right_geom=("x", "y"))
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_salted_join_on_hot_cell_equals_unsalted(spark):
    # a third of the points share one cell (a hot key): salting spreads the
    # probe side over sub-keys and replicates the other side, same pairs
    import random as _r
    rnd = _r.Random(9)
    rows = [(i, float(rnd.randint(0, 1000)), float(rnd.randint(0, 1000))) for i in range(300)]
    rows += [(1000 + i, 500.0 + rnd.random(), 500.0 + rnd.random()) for i in range(150)]
    a = spark.createDataFrame(rows, "id long, x double, y double")
    b = _pts(spark, 100, 10)
    kw = dict(distance=25.0, left_geom=("x", "y"), right_geom=("x", "y"), left_cols=["id"], right_cols=["id"],
              cell_size=50.0)
    plain = sorted(map(tuple, SJ.candidate_pairs(a, b, "dwithin", **kw).select("l.id", "r.id").collect()))
    salted = sorted(map(tuple, SJ.candidate_pairs(a, b, "dwithin", salt=4, **kw).select("l.id", "r.id").collect()))
    assert plain == salted and len(plain) > 0


def _join(a, b, **kw):
    j = SJ.candidate_pairs(a, b, "dwithin", left_geom=("x", "y"), right_geom=("x", "y"), left_cols=["id"], right_cols=["id"], **kw)
    return sorted(map(tuple, j.select("l.id", "r.id").collect()))


@pytest.mark.parametrize("cell", [0.1, 0.0125, 1 / 3, 5.0])
def test_small_cells_lose_no_pair(spark, cell):
    """(x + d) - (x - d) differs from row to row; levels must not."""
    rnd = random.Random(11)
    rows = [(i, rnd.uniform(0, 30), rnd.uniform(0, 30)) for i in range(250)]
    a = spark.createDataFrame(rows, "id long, x double, y double")
    d = 0.1
    exp = sorted((p[0], q[0]) for p in rows for q in rows if (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 <= d * d)
    assert _join(a, a, distance=d, cell_size=cell) == exp


def test_degree_coordinates_spread_over_cells(spark):
    rnd = random.Random(12)
    rows = [(i, 9.0 + rnd.random() / 10, 45.0 + rnd.random() / 10) for i in range(400)]
    a = spark.createDataFrame(rows, "id long, x double, y double")
    d = 0.0001
    exp = sorted((p[0], q[0]) for p in rows for q in rows if (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 <= d * d)
    assert _join(a, a, distance=d) == exp


def test_distance_zero_is_an_equality_join(spark):
    rows = [(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 1.0, 2.0), (4, 1.0, 2.5)]
    a = spark.createDataFrame(rows, "id long, x double, y double")
    assert _join(a, a, distance=0.0) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3), (4, 4)]


def test_rewritten_path_is_read_anew(spark, tmp_path):
    path = str(tmp_path / "boxes")
    pts = spark.createDataFrame([(i, float(i), 0.5) for i in range(100)], "id long, x double, y double")

    def pairs(size):
        spark.createDataFrame([(1, float(size))], "id long, s double").select(
            "id", G.box(F.lit(0.0), F.lit(0.0), F.col("s"), F.lit(1.0)).alias("geometry")).write.mode("overwrite").parquet(path)
        return SJ.candidate_pairs(pts, spark.read.parquet(path), "intersects", left_geom=("x", "y"), left_cols=["id"],
                                  right_cols=["id"]).count()
    assert pairs(1) == 2 and pairs(100) == 100


def test_multi_part_predicates(spark):
    """Every part counts, not the first alone (expected values by JTS)."""
    from tests.conftest import jts
    square = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))"
    others = ["MULTIPOLYGON (((12 0, 13 0, 13 1, 12 0)), ((4 4, 5 4, 5 5, 4 4)))", "MULTIPOINT ((20 20), (3 3))",
              "MULTILINESTRING ((20 20, 30 30), (1 1, 2 2))", "MULTIPOLYGON (((12 0, 13 0, 13 1, 12 0)), ((14 4, 15 4, 15 5, 14 4)))",
              "MULTIPOINT ((20 20), (13 14))"]
    reader = jts(spark).io.WKTReader()
    a = reader.read(square)
    exp = [(a.intersects(b), round(a.distance(b), 9), a.isWithinDistance(b, 2.0)) for b in map(reader.read, others)]
    df = spark.createDataFrame([(i, square, o) for i, o in enumerate(others)], "i int, a string, b string") \
        .select("i", G.geom_from_wkt("a").alias("a"), G.geom_from_wkt("b").alias("b"))
    for x, y in (("a", "b"), ("b", "a")):
        got = df.select(G.intersects(x, y).alias("i1"), F.round(G.distance(x, y), 9).alias("d"),
                        G.dwithin(x, y, F.lit(2.0)).alias("w"), "i").orderBy("i").collect()
        assert [(r.i1, r.d, r.w) for r in got] == exp
