"""Transforms in SQL, and areas far from the origin."""

import math

import pytest
from pyspark.sql import functions as F

from geoq.functions import crs
from geoq.functions import geometry as G


@pytest.mark.parametrize("to", [3857, 3301, 32632, 32735])
def test_sql_transform_is_the_column_transform(spark, to):
    from geoq.functions.sql import register
    register(spark)
    wkt = "POLYGON ((9 45, 9.001 45, 9.001 45.002, 9 45))" if to == 32632 else "LINESTRING (24.5 58.1, 25 58.4)"
    spark.createDataFrame([(wkt,)], "w string").select(G.geom_from_wkt("w", 4326).alias("g")).createOrReplaceTempView("geoq_t")
    a = spark.sql(f"SELECT ST_Transform(g, 4326, {to}) AS t, g FROM geoq_t").select("t", crs.transform("g", 4326, to).alias("c")).first()
    assert a.t.srid == a.c.srid == to and a.t.gtype == a.c.gtype
    for p, q in zip([v for r in a.t.parts[0] for v in r], [v for r in a.c.parts[0] for v in r]):
        assert math.isclose(p.x, q.x, abs_tol=1e-6) and math.isclose(p.y, q.y, abs_tol=1e-6)


def test_sql_transform_there_and_back(spark):
    from geoq.functions.sql import register
    register(spark)
    b = spark.sql("SELECT ST_Transform(ST_Transform(ST_Point(9.5, 45.25), 4326, 3857), 3857, 4326) AS g").first().g
    assert b.srid == 4326 and abs(b.parts[0][0][0].x - 9.5) < 1e-12 and abs(b.parts[0][0][0].y - 45.25) < 1e-12
    with pytest.raises(Exception, match="unsupported transform"):
        spark.sql("SELECT ST_Transform(ST_Point(9.5, 45.25), 3301, 4326) AS g").collect()


def test_sql_contains_is_within_turned_round(spark):
    from geoq.functions.sql import register
    register(spark)
    r = spark.sql("""SELECT ST_Contains(big, small) AS a, ST_Contains(small, big) AS b, ST_Contains(big, ST_Point(5, 5)) AS c
        FROM (SELECT ST_MakeEnvelope(0, 0, 10, 10) AS big, ST_MakeEnvelope(2, 2, 3, 3) AS small)""").first()
    assert (r.a, r.b, r.c) == (True, False, True)


def test_area_far_from_the_origin(spark):
    """A unit square a hundred million units away keeps its area, in both APIs."""
    from geoq.functions.sql import register
    register(spark)
    g = spark.sql("SELECT ST_MakeEnvelope(1e8 + 0.25, 3e8 + 0.25, 1e8 + 1.25, 3e8 + 1.25) AS g")
    r = g.select(G.area("g").alias("a"), F.expr("ST_Area(g)").alias("b")).first()
    assert r.a == r.b == 1.0
