"""What steps do beside their results: rows compared, sides broadcast, formulas repeated, partitions read."""

import random

from pyspark.sql import functions as F

from geoq.functions import geometry as G
from geoq.functions import sql as S
from geoq.operators import network as NW
from geoq.operators import spatial_join as SJ
from geoq.sources.tables import read_table


def _points(spark, n, seed, scale):
    rnd = random.Random(seed)
    return spark.createDataFrame([(i, rnd.randint(0, scale) * 1.0, rnd.randint(0, scale) * 1.0) for i in range(n)],
                                 "id long, x double, y double")


def test_one_match_is_enough_for_semi_and_anti_joins(spark, monkeypatch):
    """Rows with a match in a share of the right side meet no more."""
    a, b = _points(spark, 150, 1, 100), _points(spark, 400, 2, 100)
    lone = spark.createDataFrame([(500, 900.0, 900.0), (None, 1.0, 1.0), (3, 2.0, 2.0)], a.schema)
    a = a.unionByName(lone)
    sizes, pairs = [], SJ.candidate_pairs
    monkeypatch.setattr(SJ, "candidate_pairs", lambda l, r, *x, **k: sizes.append((l.count(), r.count())) or pairs(l, r, *x, **k))
    kw = dict(distance=30.0, left_geom=("x", "y"), right_geom=("x", "y"), left_key="id")
    right = [(q.x, q.y) for q in b.collect()]
    near = {p.id for p in a.collect() if any((p.x - x) ** 2 + (p.y - y) ** 2 <= 900 for x, y in right)} - {None}
    semi = sorted(r.id for r in SJ.sjoin(a, b, "dwithin", "semi", **kw).collect())
    assert semi == sorted(p.id for p in a.collect() if p.id in near)
    (first, some), (second, others) = sizes
    assert some + others == 400 and first == 153 and second < 20
    anti = [r.id for r in SJ.sjoin(a, b, "dwithin", "anti", **kw).collect()]
    assert sorted(map(str, anti)) == sorted(str(p.id) for p in a.collect() if p.id not in near)


def test_distance_test_over_few_and_many_edges(spark):
    """The first edges are compared without a lambda."""
    rnd = random.Random(4)
    lines = [(k, [(rnd.randint(0, 99) * 1.0, rnd.randint(0, 99) * 1.0) for _ in range(k)]) for k in range(1, 9)]
    df = spark.createDataFrame(lines, "id long, c array<struct<x double, y double>>").select("id", G.linestring(F.col("c")).alias("g"))
    both = df.crossJoin(_points(spark, 60, 5, 99).select("x", "y"))
    got = both.select(G.near_segs(F.col("x"), F.col("y"), G.part_segments("g"), 20.0).alias("a"), G.dwithin("g", G.point("x", "y"), 20.0).alias("b"))
    assert all(r.a == r.b for r in got.collect()) and got.where("a").count() > 20


def test_lines_and_polygons_meet_as_by_the_geometry_predicate(spark):
    """F11, F15."""
    rnd = random.Random(6)
    rows = [(i, *(rnd.randint(0, 60) * 1.0 for _ in range(4))) for i in range(120)]
    lines = spark.createDataFrame(rows, "id long, a double, b double, c double, d double").select(
        "id", G.linestring(F.array(G.xy("a", "b"), G.xy("c", "d"))).alias("geometry"))
    holed = G.polygon(F.array(*[F.array(*[G.xy(F.lit(x), F.lit(y)) for x, y in r]) for r in (
        [(0, 0), (40, 0), (40, 40), (0, 40), (0, 0)], [(10, 10), (30, 10), (30, 30), (10, 30), (10, 10)])]))
    polys = spark.range(1).select(F.lit(1).alias("pid"), holed.alias("geometry")).unionByName(
        spark.range(1).select(F.lit(2).alias("pid"), G.box(F.lit(45.0), F.lit(5.0), F.lit(55.0), F.lit(60.0)).alias("geometry")))
    got = SJ.candidate_pairs(lines, polys, "intersects", left_cols=["id"], right_cols=["pid"]).select("l.id", "r.pid").collect()
    want = lines.crossJoin(polys.withColumnRenamed("geometry", "g2")).where(G.intersects("geometry", "g2")).select("id", "pid").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 20


def test_looked_up_broadcasts_nothing(spark):
    """in a loop broadcasts add up on the driver."""
    rows = spark.range(20).select((F.col("id") % 3).alias("node"), "id")
    table = spark.range(3).select(F.col("id").alias("node"), (F.col("id") * 2).alias("v"))
    for found in (NW.looked_up(rows, "node", table), NW.looked_up_many(rows, table.withColumnRenamed("v", "to"))):
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == 20


def test_transform_names_its_arguments_once_per_step():
    """Nested lambdas share nothing, so a formula's length is its cost."""
    assert S.FUNCTIONS["ST_Transform"][2].count("atanh(") <= 10


def test_geometry_tables_are_read_in_parts_by_size(spark, tmp_path):
    """the longest task does not grow with the table."""
    spark.range(200_000).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    few = read_table(spark, str(tmp_path), "orders").rdd.getNumPartitions()
    more = read_table(spark, str(tmp_path), "orders", bytes_each=10_000)
    assert more.rdd.getNumPartitions() > few and more.count() == 200_000
