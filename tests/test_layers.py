"""Stored layers: order along a curve, box filters in the reader, catalog."""

import glob
import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from geoq.functions import geometry as G
from geoq.sources import tables as TB
from geoq.sources import vector as V


def _boxes(spark, n=20000):
    r = random.Random(1)
    rows = [(k, r.uniform(0, 1000), r.uniform(0, 1000)) for k in range(n)]
    return rows, spark.createDataFrame(rows, "id long, x double, y double").select(
        "id", G.box(F.col("x"), F.col("y"), F.col("x") + 2, F.col("y") + 3).alias("geometry")).repartition(4)


def _groups(path, box):
    """(row groups that a box filter cannot skip, all row groups)."""
    x0, y0, x1, y1 = box
    meet = total = 0
    for f in glob.glob(path + "/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            st = {group.column(c).path_in_schema: group.column(c).statistics for c in range(group.num_columns)}
            total += 1
            meet += (st["bbox.minx"].min <= x1 and st["bbox.maxx"].max >= x0 and st["bbox.miny"].min <= y1 and st["bbox.maxy"].max >= y0)
    return meet, total


def test_box_filter_leaves_most_of_an_ordered_layer_unread(spark, tmp_path):
    rows, df = _boxes(spark)
    box = (100.0, 100.0, 160.0, 160.0)
    plain, ordered = str(tmp_path / "plain"), str(tmp_path / "ordered")
    V.write_geoparquet(df, plain)
    V.write_geoparquet(df, ordered, ordered=True, partitions=16)
    expected = {k for k, x, y in rows if x <= 160 and x + 2 >= 100 and y <= 160 and y + 3 >= 100}
    for path in (plain, ordered):
        read = V.read_geoparquet(spark, path, box=box)
        assert {r.id for r in read.select("id").collect()} == expected
        plan = read.select("id")._jdf.queryExecution().executedPlan().toString()
        assert "bbox.minx" in plan[plan.index("PushedFilters"):]
    assert _groups(plain, box)[0] == _groups(plain, box)[1]
    meet, total = _groups(ordered, box)
    assert total >= 16 and meet <= total / 4
    V.write_geoparquet(df.limit(0), str(tmp_path / "none"), ordered=True)
    assert V.read_geoparquet(spark, str(tmp_path / "none")).count() == 0


def test_curve_places_interleave_bits(spark):
    df = spark.createDataFrame([(0.0, 0.0), (65535.0, 0.0), (0.0, 65535.0), (65535.0, 65535.0), (1.0, 2.0), (-5.0, 99999.0), (None, 1.0)], "x double, y double")
    got = [r[0] for r in df.select(V.curve_place(F.col("x"), F.col("y"), (0, 0, 65535, 65535))).collect()]
    assert got[:6] == [0, 0x55555555, 0xAAAAAAAA, 0xFFFFFFFF, 0b1001, 0xAAAAAAAA] and got[6] is not None


def test_layers_into_tables(spark, tmp_path):
    _, df = _boxes(spark, 300)
    V.write_geoparquet(df, str(tmp_path / "a"), srid=32632)
    assert not TB.table_exists(spark, "geoq_layer_none")
    for form, source, args in (("geoparquet", "a", {}), ("geojson", "b", {"lines": True}), ("csv", "c", {})):
        if form == "geojson":
            V.write_geojson(df, str(tmp_path / source))
        if form == "csv":
            df.select("id", G.as_wkt("geometry").alias("geometry_wkt")).write.option("header", True).csv(str(tmp_path / source))
        t = V.load_layer(spark, str(tmp_path / source), "geoq_layer", form, **args)
        assert TB.table_exists(spark, "geoq_layer") and "geometry" in TB.list_columns(spark, "geoq_layer")
        area = t.agg(F.count(F.lit(1)).alias("n"), F.sum(G.area("geometry")).alias("a")).first()
        assert area.n == 300 and abs(area.a - 1800) < 1e-6
    V.load_table(df.select(F.col("id").alias("key"), "geometry"), "geoq_loaded", ["key"], geom="geometry")
    loaded = spark.table("geoq_loaded")
    assert [r.id for r in loaded.orderBy("key").select("id").collect()] == list(range(1, 301))
    assert loaded.where(V.meets_box((0, 0, 1000, 1000))).count() == 300
    V.save_table(df.select("id"), "geoq_ids", empty_first=True)
    V.save_table(df.select("id"), "geoq_ids", mode="append")
    assert spark.table("geoq_ids").count() == 600
    for name in ("geoq_layer", "geoq_loaded", "geoq_ids"):
        spark.sql(f"DROP TABLE {name}")


def test_boundary_by_name(spark):
    df = spark.createDataFrame([("Milan, Italy", 1), ("ROME", 2), ("Pinerolo", 3)], "name string, id int")
    for name, expected in (("milan", [1]), ("Rome, Italy", [2]), ("nowhere", [])):
        assert [r.id for r in TB.boundary(spark, df, name).collect()] == expected
