import os

from pyspark.sql import functions as F

from geoq.functions import geometry as G


def _polys(spark):
    df = spark.createDataFrame([(1, "POLYGON ((0 0, 4 0, 4 3, 0 3, 0 0))", "a"),
                                (2, "MULTIPOLYGON (((10 10, 12 10, 12 12, 10 10)), ((20 20, 21 20, 21 21, 20 20)))", "b")],
                               "id int, w string, name string")
    return df.select("id", "name", G.geom_from_wkt("w").alias("geometry"))


def test_geoparquet_round_trip(spark, tmp_path):
    from geoq.sources.vector import read_geoparquet, write_geoparquet
    path = str(tmp_path / "gp")
    write_geoparquet(_polys(spark), path, srid=32632)
    assert os.path.exists(os.path.join(path, "_geo.json"))
    back = read_geoparquet(spark, path).select("id", G.area("geometry").alias("a"), G.srid("geometry").alias("s"),
                                               "bbox.maxx").orderBy("id").collect()
    assert [(r.id, r.a, r.s, r.maxx) for r in back] == [(1, 12.0, 32632, 4.0), (2, 2.5, 32632, 21.0)]


def test_geojson_round_trip(spark, tmp_path):
    from geoq.sources.vector import read_geojson, write_geojson
    path = str(tmp_path / "gj")
    write_geojson(_polys(spark), path)
    lines = spark.read.text(path).collect()
    fc = '{"type":"FeatureCollection","features":[' + ",".join(r.value for r in lines) + "]}"
    f = tmp_path / "fc.geojson"
    f.write_text(fc)
    back = read_geojson(spark, str(f)).select(F.col("properties")["name"].alias("n"), G.area("geometry").alias("a")) \
        .orderBy("n").collect()
    assert [(r.n, r.a) for r in back] == [("a", 12.0), ("b", 2.5)]


def test_osm_xml_reader(spark, tmp_path):
    from geoq.sources.osm_xml import read_osm_xml
    from geoq.operators import osm as OSM
    xml = """<?xml version="1.0"?><osm version="0.6">
<node id="1" lon="0" lat="0"/><node id="2" lon="4" lat="0"/><node id="3" lon="4" lat="3"/>
<node id="4" lon="0" lat="3"><tag k="amenity" v="bench"/></node>
<way id="10"><nd ref="1"/><nd ref="2"/><nd ref="3"/><nd ref="4"/><nd ref="1"/><tag k="building" v="yes"/></way>
<relation id="100"><member type="way" ref="10" role="outer"/><tag k="type" v="multipolygon"/></relation>
</osm>"""
    p = tmp_path / "t.osm"
    p.write_text(xml)
    nodes, ways, rels = read_osm_xml(spark, str(p))
    assert nodes.count() == 4 and ways.first().nd == [1, 2, 3, 4, 1] and rels.first().members[0].type == "w"
    b = OSM.buildings(nodes, ways, rels).select("feature_id", G.area("geometry").alias("a")).collect()
    assert [(r.feature_id, r.a) for r in b] == [("w10", 12.0)]


def test_tiles_and_tables(spark, tmp_path):
    from geoq.operators.raster import RasterMeta, to_pixels, to_tiles
    from geoq.sources.tiles import read_tiles, write_tiles
    from geoq.sources.tables import resolve_column
    from geoq.sources.vector import describe_layer
    px = spark.createDataFrame([(1, r, c, float(r * 10 + c)) for r in range(5) for c in range(7)],
                               "band int, row long, col long, value double")
    meta = RasterMeta(width=7, height=5, ulx=0.0, uly=50.0, px=10.0, py=-10.0, nodata=-1.0, tile=4)
    write_tiles(to_tiles(px, meta), meta, str(tmp_path / "tiles"))
    t, m2 = read_tiles(spark, str(tmp_path / "tiles"))
    back = sorted(tuple(r) for r in to_pixels(t, m2).select("row", "col", "value").collect())
    assert back == sorted((r, c, float(r * 10 + c)) for r in range(5) for c in range(7))
    assert resolve_column(px, ["COD_REG", "Band"]) == "band"
    assert describe_layer(_polys(spark))["srid"] == [0]


def test_csv_log_and_runtime_stats(spark, tmp_path):
    from geoq.operators.aggregates import runtime_stats
    from geoq.sources.tables import read_csv
    from geoq.sources.vector import append_csv_log
    rows = [("UC3", "spark", "3.1", "sf0.1", float(t), i) for i, t in enumerate([5.0, 1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "use_case string, technology string, operation_description string, "
                                     "test_dataset string, execution_time_s double, run int")
    path = str(tmp_path / "log")
    append_csv_log(df, path)
    back = read_csv(spark, path, df.schema)
    r = runtime_stats(back).first()
    assert (r.avg_execution_time_s, r.num_runs) == (2.0, 3)


def test_geojson_reads_its_own_output(spark, tmp_path):
    from geoq.sources.vector import read_geojson, write_geojson
    path = str(tmp_path / "nd")
    write_geojson(_polys(spark).repartition(2), path)
    back = read_geojson(spark, path, lines=True).select(F.col("properties")["name"].alias("n"), G.area("geometry").alias("a"),
                                            G.geom_type("geometry").alias("t")).orderBy("n").collect()
    assert [(r.n, r.a, r.t) for r in back] == [("a", 12.0, "POLYGON"), ("b", 2.5, "MULTIPOLYGON")]


def test_geoparquet_headers(spark, tmp_path):
    import json

    import pyarrow as pa
    import pyarrow.parquet as pq

    from geoq.functions.wkb import with_wkb
    from geoq.sources import store
    from geoq.sources.vector import read_geoparquet, write_geoparquet
    path = str(tmp_path / "own")
    write_geoparquet(_polys(spark), path, srid=3857)
    covering = json.loads(store.read_text(spark, f"{path}/_geo.json"))["columns"]["geometry"]["covering"]["bbox"]
    stored = spark.read.parquet(path).select("bbox.*").columns
    assert {c[1] for c in covering.values()} <= set(stored)
    assert store.read_text(spark, f"{path}/nothing.json") is None
    # a file of another tool: the CRS is in the footer
    rows = with_wkb(_polys(spark), "geometry", "w").select("id", F.col("w").alias("geometry")).toPandas()
    geo = {"version": "1.1.0", "primary_column": "geometry", "columns": {"geometry": {"encoding": "WKB", "crs": {"id": {"authority": "EPSG", "code": 32632}}}}}
    table = pa.Table.from_pandas(rows, preserve_index=False).replace_schema_metadata({"geo": json.dumps(geo)})
    (tmp_path / "other").mkdir()
    pq.write_table(table, tmp_path / "other" / "a.parquet")
    back = read_geoparquet(spark, str(tmp_path / "other")).select(G.srid("geometry").alias("s"), G.area("geometry").alias("a")).orderBy("a").collect()
    assert [(r.s, r.a) for r in back] == [(32632, 2.5), (32632, 12.0)]


def test_partial_tiles_and_repeated_pixels(spark):
    from geoq.operators.raster import RasterMeta, tile_spans, to_pixels, to_tiles
    meta = RasterMeta(width=3, height=2, ulx=0.0, uly=2.0, px=1.0, py=-1.0, nodata=-9.0, tile=2)
    px = spark.createDataFrame([(1, 0, 0, 5.0), (1, 0, 0, 6.0), (1, 1, 0, 1.0), (1, 1, 1, 2.0), (1, 0, 2, 3.0)],
                               "band int, row long, col long, value double")
    back = {(r.row, r.col): r.value for r in to_pixels(to_tiles(px, meta), meta).collect()}
    assert back == {(0, 0): 6.0, (0, 1): -9.0, (1, 0): 1.0, (1, 1): 2.0, (0, 2): 3.0, (1, 2): -9.0}
    far = spark.createDataFrame([(1,)], "id int").select("id", G.box(-1e6, -1e6, 1e6, 1e6).alias("geometry"))
    assert tile_spans(far, meta).count() == 2  # the raster's tiles, no more


def test_histogram_edges(spark):
    from geoq.operators.aggregates import histogram, percent_of_total, with_row_id
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 10, 44, 200, -5)] + [(None,), (float("nan"),)], "v double")
    counts = {r.bin: r["count"] for r in histogram(df, "v", 44, 0, 44).collect()}
    assert sum(counts.values()) == 4 and counts[43] == 1
    same = histogram(spark.createDataFrame([(7.0,)] * 3, "v double"), "v", 4).collect()
    assert sum(r["count"] for r in same) == 3 and (same[0].bin_lo, max(r.bin_hi for r in same)) == (6.5, 7.5)
    assert sum(r["count"] for r in histogram(df.limit(0), "v", 4).collect()) == 0
    shares = percent_of_total(spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string"), "k").collect()
    assert {r.k: r.pct for r in shares} == {"a": 50.0, "b": 25.0, None: 25.0}
    ids = with_row_id(spark.range(1000).selectExpr("(id * 37) % 1000 as v"), ["v"]).collect()
    assert {r.v + 1: r.row_id for r in ids} == {k: k for k in range(1, 1001)}


def test_components_say_when_they_are_not_done(spark):
    import pytest

    from geoq.operators.network import connected_components
    nodes = spark.range(64)
    edges = spark.range(63).selectExpr("id as u", "id + 1 as v")
    with pytest.raises(RuntimeError):
        connected_components(nodes, edges, max_rounds=2)
    assert {r.component for r in connected_components(nodes, edges).collect()} == {0}


def test_rewritten_tables_are_seen(spark, tmp_path):
    """A table that is written anew between two queries."""
    from geoq.plans.queries import QUERIES
    from tests.conftest import SF_SMALL
    for name in ("orders", "customer", "nation"):
        spark.read.parquet(f"{SF_SMALL}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    first = QUERIES["raster_pixels_roundtrip"](spark, str(tmp_path)).count()
    rows = spark.read.parquet(f"{SF_SMALL}/orders.parquet").where("o_orderkey < 500")
    rows.write.mode("overwrite").parquet(str(tmp_path / "orders.parquet"))
    second = QUERIES["raster_pixels_roundtrip"](spark, str(tmp_path)).count()
    assert first > second > 0 and second == 500


def test_geojson_form_is_the_callers(spark, tmp_path):
    import pytest

    from geoq.sources.vector import read_geojson
    row = '{"id":1,"type":"Feature","properties":{"name":"a"},"geometry":{"type":"Point","coordinates":[1,2]}}'
    (tmp_path / "lines.json").write_text("\n".join([row] * 5))
    (tmp_path / "one.json").write_text('{"features":[' + ",".join([row] * 3) + '],"type":"FeatureCollection"}')
    (tmp_path / "none.json").write_text('{"type":"FeatureCollection","features":[]}')
    lines, one, none = (str(tmp_path / f"{n}.json") for n in ("lines", "one", "none"))
    assert read_geojson(spark, lines, lines=True).where("geometry.parts[0][0][0].y = 2").count() == 5
    assert read_geojson(spark, one).where("geometry.parts[0][0][0].y = 2").count() == 3
    assert read_geojson(spark, none).count() == 0
    for path, form in ((lines, False), (one, True)):
        with pytest.raises(Exception, match="lines="):
            read_geojson(spark, path, lines=form).collect()


def test_sql_predicates_of_any_geometry(spark):
    """SQL functions against the Column functions, pair by pair."""
    import random

    from geoq.functions.sql import register
    register(spark)
    r = random.Random(7)
    wkts = ["POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 4 6, 6 6, 6 4, 4 4))", "POLYGON ((1 1, 3 1, 3 3, 1 3, 1 1))",
            "POLYGON ((-20 -20, 30 -20, 30 30, -20 30, -20 -20))", "POLYGON ((12 0, 15 0, 15 5, 12 5, 12 0))", "LINESTRING (4 4, 6 6)",
            "LINESTRING (0 0, 10 10)", "POINT (5 5)", "POINT (0 5)", "MULTIPOINT ((1 1), (50 50))",
            "MULTIPOLYGON (((20 20, 22 20, 22 22, 20 22, 20 20)), ((1 1, 2 1, 2 2, 1 2, 1 1)))"]
    for _ in range(6):
        x, y = r.randrange(12), r.randrange(12)
        wkts.append(f"LINESTRING ({x} {y}, {r.randrange(12)} {r.randrange(12)}, {r.randrange(12)} {r.randrange(12)})")
    g = spark.createDataFrame(list(enumerate(wkts)), "id int, w string").select("id", G.geom_from_wkt("w").alias("g")).cache()
    pairs = g.select(F.col("id").alias("i"), F.col("g").alias("a")).crossJoin(g.select(F.col("id").alias("j"), F.col("g").alias("b")))
    pairs.createOrReplaceTempView("geoq_pairs")
    sql = spark.sql("""SELECT i, j, a, b, ST_Intersects(a, b) AS x, ST_Within(a, b) AS w, ST_Distance(a, b) AS d, ST_DWithin(a, b, 3) AS n
        FROM geoq_pairs""")
    rows = sql.select("i", "j", "x", "w", "d", "n", G.intersects("a", "b").alias("x2"), G.within("a", "b").alias("w2"),
                      G.distance("a", "b").alias("d2"), G.dwithin("a", "b", F.lit(3.0)).alias("n2")).collect()
    for q in rows:
        assert (q.x, q.w, q.n) == (q.x2, q.w2, q.n2) and abs(q.d - q.d2) < 1e-9, (wkts[q.i], wkts[q.j], q)
    by = {(q.i, q.j): q for q in rows}
    assert by[0, 2].w and not by[2, 0].w and by[0, 3].d == 2.0 and by[1, 0].x and not by[4, 0].w
    env = spark.sql("SELECT ST_AsText(ST_Envelope(g)) AS e FROM (SELECT a AS g FROM geoq_pairs WHERE i = 5 LIMIT 1)").first()["e"]
    assert env == "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))"
