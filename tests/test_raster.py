"""Scan-line clips and area-weighted resampling."""

import math

import numpy as np
from pyspark.sql import functions as F

from geoq.functions import geometry as G
from geoq.operators import raster as RS


def _raster(spark, n, tile, px=1.0, py=-1.0, ulx=0.0, uly=None):
    meta = RS.RasterMeta(width=n, height=n, ulx=ulx, uly=n * abs(py) if uly is None else uly, px=px, py=py, nodata=-1.0, tile=tile)
    pixels = spark.range(n * n).select(F.lit(1).alias("band"), F.floor(F.col("id") / n).alias("row"), (F.col("id") % n).alias("col"),
                                       (F.col("id") % 97).cast("double").alias("value"))
    return RS.to_tiles(pixels, meta), meta


def _brute(meta, rings_by_part):
    """Pixels by a test of every centre: even-odd per part, boundary included."""
    y, x = np.mgrid[0:meta.height, 0:meta.width]
    x, y = meta.ulx + (x + .5) * meta.px, meta.uly + (y + .5) * meta.py
    hit = np.zeros(x.shape, bool)
    for rings in rings_by_part:
        odd = np.zeros(x.shape, bool)
        for ring in rings:
            for (ax, ay), (bx, by) in zip(ring, ring[1:]):
                cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
                hit |= (cross == 0) & (x >= min(ax, bx)) & (x <= max(ax, bx)) & (y >= min(ay, by)) & (y <= max(ay, by))
                if ay != by:
                    odd ^= ((ay <= y) != (by <= y)) & (x < ax + (y - ay) * (bx - ax) / (by - ay))
        hit |= odd
    return {(int(r), int(c)) for r, c in zip(*np.nonzero(hit))}


def _wkt(parts):
    return "MULTIPOLYGON (" + ", ".join("(" + ", ".join("(" + ", ".join(f"{x} {y}" for x, y in ring) + ")" for ring in rings) + ")" for rings in parts) + ")"


def test_clip_equals_a_test_of_every_pixel(spark):
    shapes = [
        [[[(2, 2), (20, 2), (20, 18), (2, 18), (2, 2)], [(5.5, 5.5), (5.5, 9.5), (9.5, 9.5), (9.5, 5.5), (5.5, 5.5)]]],
        [[[(0.5, 0.5), (10.5, 10.5), (20.5, 0.5), (10.5, 30.5), (0.5, 0.5)]]],  # vertices and edges on centres
        [[[(3, 3), (12, 4), (8, 9), (3, 3)]], [[(8, 3), (15, 3), (15, 12), (8, 12), (8, 3)]]],  # parts that overlap
        [[[(-50, -50), (90, -50), (90, 90), (-50, 90), (-50, -50)]]],  # beyond the raster
        [[[(4.1, 4.1), (4.2, 4.1), (4.2, 4.2), (4.1, 4.1)]]],  # between centres
    ]
    df = spark.createDataFrame([(i, _wkt(s)) for i, s in enumerate(shapes)], "id int, w string").select("id", G.geom_from_wkt("w").alias("geometry"))
    for tile, px, py, uly in ((7, 1.0, -1.0, None), (64, 1.0, -1.0, None), (8, 1.0, 1.0, 0.0)):
        tiles, meta = _raster(spark, 32, tile, px, py, uly=uly)
        got: dict = {}
        for r in RS.clip_pixels(tiles, df, meta).collect():
            assert (r.row, r.col) not in got.setdefault(r.id, {})
            got[r.id][r.row, r.col] = r.value
        for i, parts in enumerate(shapes):
            assert set(got.get(i, {})) == _brute(meta, parts), (i, tile)
            assert all(v == (r * 32 + c) % 97 for (r, c), v in got.get(i, {}).items())


def test_zonal_stats_of_a_long_boundary(spark):
    import time
    n = 5000
    ring = [(128 + (100 + 20 * (k % 2)) * math.cos(2 * math.pi * k / n), 128 + (100 + 20 * (k % 2)) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    ring.append(ring[0])
    df = spark.createDataFrame([(1, _wkt([[ring]])), (2, "POLYGON ((900 900, 901 900, 901 901, 900 900))")], "id int, w string") \
        .select("id", G.geom_from_wkt("w").alias("geometry")).cache()
    df.count()
    tiles, meta = _raster(spark, 256, 256)
    tiles = tiles.cache()
    tiles.count()
    RS.zonal_stats(tiles, df, meta).collect()
    began = time.time()
    got = {r.id: r for r in RS.zonal_stats(tiles, df, meta).collect()}
    took = time.time() - began
    inside = _brute(meta, [[ring]])
    assert got[1]["count"] == len(inside) and got[1]["sum"] == sum((r * 256 + c) % 97 for r, c in inside)
    assert got[2]["count"] == 0 and got[2]["sum"] is None
    assert took < 10, took
    assert {r.id for r in RS.zonal_stats(tiles, df, meta, keep_empty=False).collect()} == {1}


def test_lines_and_points_take_the_centres_they_touch(spark):
    tiles, meta = _raster(spark, 8, 4)
    df = spark.createDataFrame([(1, "LINESTRING (0.5 0.5, 3.5 3.5)"), (2, "POINT (2.5 6.5)"), (3, "POINT (2.4 6.5)")], "id int, w string") \
        .select("id", G.geom_from_wkt("w").alias("geometry"))
    got = {(r.id, r.row, r.col) for r in RS.clip_pixels(tiles, df, meta).collect()}
    assert got == {(1, 7, 0), (1, 6, 1), (1, 5, 2), (1, 4, 3), (2, 1, 2)}


def test_resampling_weights_by_area(spark):
    meta = RS.RasterMeta(width=3, height=1, ulx=0.0, uly=1.0, px=2.0, py=-1.0, nodata=-9.0, tile=4)
    px = spark.createDataFrame([(1, 0, c, v) for c, v in enumerate((0.0, 6.0, 12.0))], "band int, row long, col long, value double")
    out, new = RS.resample_average(px, meta, 1, 2)
    assert {(r.row, r.col): r.value for r in out.collect()} == {(0, 0): 2.0, (0, 1): 10.0}
    assert (new.width, new.height, new.px, new.py) == (2, 1, 3.0, -1.0)
    r = np.random.default_rng(1)
    h, w, oh, ow = 7, 9, 4, 13
    v = r.integers(0, 5, (h, w)).astype(float)
    meta = RS.RasterMeta(width=w, height=h, ulx=0.0, uly=0.0, px=1.0, py=-1.0, nodata=0.0, tile=4)
    px = spark.createDataFrame([(1, i, j, float(v[i, j])) for i in range(h) for j in range(w)], "band int, row long, col long, value double")
    wr = np.array([[max(0.0, min((i + 1) / h, (k + 1) / oh) - max(i / h, k / oh)) for i in range(h)] for k in range(oh)])
    wc = np.array([[max(0.0, min((j + 1) / w, (k + 1) / ow) - max(j / w, k / ow)) for j in range(w)] for k in range(ow)])
    out, _ = RS.resample_average(px, meta, oh, ow)
    got = {(x.row, x.col): x.value for x in out.collect()}
    assert len(got) == oh * ow
    for (i, j), value in got.items():
        weights = np.outer(wr[i], wc[j]) * (v != 0)
        if weights.sum() < 1e-12:
            assert value is None
        else:
            assert abs(value - (weights * v).sum() / weights.sum()) < 1e-9
