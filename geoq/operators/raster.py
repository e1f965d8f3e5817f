"""Rasters as tables (J-series).

*Tile table* (storage layout, one row per band x tile): ``band, tile_row,
tile_col, data array<double>`` with ``tile x tile`` pixels in row-major
order, pixels outside the raster filled with nodata.  *Pixel view*:
``band, row, col, value``.  The affine transform, size and nodata value
are a small :class:`RasterMeta` (the GeoTIFF header), not data.

Vector x raster work (clip, zonal statistics) tests no pixel against an
edge: edges are turned into runs of columns per row of pixel centres (scan
lines), the runs are equi-joined with the tiles that they meet (a normal
shuffle/broadcast join chosen by AQE on measured sizes), and values are
slices of the tiles' arrays.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoq.functions import geometry as G


@dataclass(frozen=True)
class RasterMeta:
    width: int
    height: int
    ulx: float
    uly: float
    px: float          # pixel width (> 0)
    py: float          # pixel height (< 0 for north-up)
    nodata: float | None = None
    tile: int = 256
    srid: int = 0

    @property
    def pixel_area(self) -> float:
        return abs(self.px * self.py)

    def bounds(self):
        x0, x1 = self.ulx, self.ulx + self.width * self.px
        y0, y1 = self.uly + self.height * self.py, self.uly
        return min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1)


def to_tiles(pixels: DataFrame, meta: RasterMeta) -> DataFrame:
    """Pixel view -> tile table (``raster2pgsql -t TxT``).  Each group
    is one tile.  Every tile is built alike in one sorted pass: its pixels
    and a nodata filler for each place are sorted by place, and the last entry
    of a place counts.  A pixel given several times has its largest value."""
    t = meta.tile
    nod = F.lit(meta.nodata if meta.nodata is not None else float("nan"))
    idx = ((F.col("row") % t) * t + F.col("col") % t).cast("int")
    grouped = (pixels.groupBy("band", F.floor(F.col("row") / t).alias("tile_row"),
                              F.floor(F.col("col") / t).alias("tile_col"))
               .agg(F.array_sort(F.collect_list(F.struct(idx.alias("i"), F.col("value").cast("double").alias("v")))).alias("px")))
    filler = F.transform(F.sequence(F.lit(0), F.lit(t * t - 1)), lambda i: F.struct(i.alias("i"), F.lit(None).cast("double").alias("v")))
    # nulls sort first, so a filler is last only where no pixel was given
    placed = F.transform(F.array(F.array_sort(F.concat("px", filler))), lambda a: F.filter(
        a, lambda e, k: (k == F.size(a) - 1) | (F.get(a, k + 1).i != e.i)))[0]
    data = F.transform(placed, lambda e: F.coalesce(e.v, nod))
    return grouped.select("band", "tile_row", "tile_col", data.alias("data"))


def to_pixels(tiles: DataFrame, meta: RasterMeta) -> DataFrame:
    """J1 inverse: tile table -> pixel view (pixels outside the raster dropped)."""
    t = meta.tile
    p = tiles.select("band", "tile_row", "tile_col", F.posexplode("data").alias("i", "value"))
    row = F.col("tile_row") * t + F.floor(F.col("i") / t)
    col = F.col("tile_col") * t + F.col("i") % t
    return (p.select("band", row.cast("bigint").alias("row"), col.cast("bigint").alias("col"), "value")
            .where((F.col("row") < meta.height) & (F.col("col") < meta.width)))


def pixel_centres(df: DataFrame, meta: RasterMeta) -> DataFrame:
    return df.withColumn("x", F.lit(meta.ulx) + (F.col("col") + 0.5) * meta.px) \
             .withColumn("y", F.lit(meta.uly) + (F.col("row") + 0.5) * meta.py)


def info(tiles: DataFrame, meta: RasterMeta) -> DataFrame:
    """Metadata, bounds, covered area; read from tile keys only."""
    x0, y0, x1, y1 = meta.bounds()
    return tiles.agg(F.countDistinct("band").alias("bands"), F.count(F.lit(1)).alias("n_tiles")).select(
        F.lit(meta.width).cast("bigint").alias("width"), F.lit(meta.height).cast("bigint").alias("height"),
        F.col("bands").cast("bigint").alias("bands"), F.col("n_tiles").cast("bigint").alias("n_tiles"),
        F.lit(x0).alias("minx"), F.lit(y0).alias("miny"), F.lit(x1).alias("maxx"), F.lit(y1).alias("maxy"),
        F.lit(meta.pixel_area).alias("pixel_area"),
        F.lit(meta.pixel_area * meta.width * meta.height / 1e6).alias("area_km2"))


def window(pixels: DataFrame, meta: RasterMeta, col_off: int, row_off: int, width: int, height: int):
    """Window read; returns (pixels re-indexed to the window, new meta
    with the shifted transform ``window_transform``)."""
    w = (pixels.where((F.col("row") >= row_off) & (F.col("row") < row_off + height)
                      & (F.col("col") >= col_off) & (F.col("col") < col_off + width))
         .withColumn("row", F.col("row") - row_off).withColumn("col", F.col("col") - col_off))
    h2 = max(0, min(height, meta.height - row_off))
    w2 = max(0, min(width, meta.width - col_off))
    return w, replace(meta, width=w2, height=h2, ulx=meta.ulx + col_off * meta.px, uly=meta.uly + row_off * meta.py)


def window_tiles(tiles: DataFrame, meta: RasterMeta, col_off, row_off, width, height) -> DataFrame:
    """Tile-key prefilter of a window (only overlapping tiles are read)."""
    t = meta.tile
    return tiles.where((F.col("tile_row") >= row_off // t) & (F.col("tile_row") <= (row_off + height - 1) // t)
                       & (F.col("tile_col") >= col_off // t) & (F.col("tile_col") <= (col_off + width - 1) // t))


def mask_nodata(value, nodata):
    """masked_equal(band, nodata) -> NULL."""
    value = F.col(value) if isinstance(value, str) else value
    return value if nodata is None else F.when(value != F.lit(nodata), value)


def resample_average(pixels: DataFrame, meta: RasterMeta, out_rows: int, out_cols: int) -> tuple[DataFrame, RasterMeta]:
    """Average resampling to an out_rows x out_cols grid; returns (pixels,
    new meta with the scaled transform).  An output cell is the mean of the
    valid pixels under it, weighted by the area that they share; a pixel that
    straddles cells counts in each (at most as many as a pixel is wide).  A
    cell without a valid pixel is NULL.  Both sizes are compared as whole
    numbers, in units of 1/height and 1/width of a cell, so weights are exact."""
    def cells(place, size, out):
        """(cell, shared length) along one axis; a pixel spans [place * out,
        (place + 1) * out) where a cell spans [cell * size, (cell + 1) * size)."""
        lo, hi = F.col(place) * out, (F.col(place) + 1) * out
        return F.transform(F.sequence(F.floor(lo / F.lit(size)), F.floor((hi - 1) / F.lit(size))), lambda k: F.struct(
            k.cast("bigint").alias("cell"), (F.least(hi, (k + 1) * size) - F.greatest(lo, k * size)).alias("part")))
    v = mask_nodata("value", meta.nodata)
    p = (pixels.select("band", v.alias("v"), F.explode(cells("row", meta.height, out_rows)).alias("r"), "col").where("v is not null")
         .select("band", "v", "r", F.explode(cells("col", meta.width, out_cols)).alias("c")))
    weight = F.col("r.part") * F.col("c.part")
    seen = p.groupBy("band", F.col("r.cell").alias("row"), F.col("c.cell").alias("col")).agg(
        (F.sum(F.col("v") * weight) / F.sum(weight)).alias("value"))
    # cells that have pixels, but none of them valid, stay as NULL
    every = pixels.select("band", F.explode(cells("row", meta.height, out_rows)["cell"]).alias("row"), "col") \
        .select("band", "row", F.explode(cells("col", meta.width, out_cols)["cell"]).alias("col")).distinct()
    new = replace(meta, width=out_cols, height=out_rows, px=meta.px * meta.width / out_cols, py=meta.py * meta.height / out_rows)
    return every.join(seen, ["band", "row", "col"], "left"), new


def mosaic(rasters) -> DataFrame:
    """Merge pixel views, later input wins per (band, row, col)."""
    out = None
    for prio, r in enumerate(rasters):
        r = r.select("band", "row", "col", "value", F.lit(prio).alias("_prio"))
        out = r if out is None else out.unionByName(r)
    return out.groupBy("band", "row", "col").agg(F.max_by("value", "_prio").alias("value"))


def polygon_spans(polys: DataFrame, meta: RasterMeta, key="id", geom="geometry") -> DataFrame:
    """Runs of pixels whose centres lie in a polygon or on its boundary:
    (key, row, c0, c1), disjoint per row.

    Scan lines: an edge gives one crossing for every row of pixel centres that
    it passes, so rows grow with the length of the boundary in pixels; sorted
    crossings of a row are paired (even-odd per part).  Level edges and
    vertices on a row's line add the pixels that they touch.  Lines and points
    have such touches and the centres on their edges only."""
    g = F.col(geom)
    seg = polys.select(F.col(key).alias("_key"), G.is_polygonal(g).alias("_poly"), F.inline_outer(G.part_segments(g))) \
        .select("_key", "_poly", F.col("p").alias("_part"), F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by")) \
        .where("ax is not null")
    last_row = F.lit(meta.height - 1).cast("bigint")

    def row_of(y):
        return F.floor((y - F.lit(meta.uly)) / F.lit(meta.py) - 0.5)
    # rows about the edge; which of them it passes is decided on the centre itself
    ra, rb = row_of(F.col("ay")), row_of(F.col("by"))
    first, last = F.greatest(F.least(ra, rb) - 1, F.lit(0)), F.least(F.greatest(ra, rb) + 2, last_row)
    lines = seg.where(last >= first).withColumn("row", F.explode(F.sequence(first, last))) \
        .withColumn("y", F.lit(meta.uly) + (F.col("row") + 0.5) * meta.py)
    passes = (F.col("ay") <= F.col("y")) != (F.col("by") <= F.col("y"))
    x = F.col("ax") + (F.col("y") - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))
    level = (F.col("ay") == F.col("y")) & (F.col("by") == F.col("y"))

    def mark(crossing, x0, x1):
        return F.struct(F.lit(crossing).alias("crossing"), x0.alias("x0"), x1.alias("x1"))
    marks = F.array(
        F.when(passes, F.when(F.col("_poly"), mark(True, x, x)).otherwise(mark(False, x, x))),
        F.when(level, mark(False, F.least("ax", "bx"), F.greatest("ax", "bx"))),
        F.when(~level & (F.col("ay") == F.col("y")), mark(False, F.col("ax"), F.col("ax"))),
        F.when(~level & (F.col("by") == F.col("y")), mark(False, F.col("bx"), F.col("bx"))))
    m = (lines.select("_key", "_part", "row", F.explode_outer(F.array_compact(marks)).alias("m")).where("m is not null")
         .select("_key", "_part", "row", "m.*").repartition("_key", "row"))
    w = Window.partitionBy("_key", "row", "_part", "crossing").orderBy("x0")
    m = m.select("_key", "row", "x0", F.when(F.col("crossing"), F.lead("x0").over(w)).otherwise(F.col("x1")).alias("x1"),
                 (~F.col("crossing") | (F.row_number().over(w) % 2 == 1)).alias("opens")).where("opens and x1 is not null")
    c0 = F.greatest(F.ceil((F.col("x0") - F.lit(meta.ulx)) / F.lit(meta.px) - 0.5), F.lit(0))
    c1 = F.least(F.floor((F.col("x1") - F.lit(meta.ulx)) / F.lit(meta.px) - 0.5), F.lit(meta.width - 1))
    m = m.select("_key", "row", c0.alias("c0"), c1.alias("c1")).where("c0 <= c1")
    # pixels that an earlier run of the row has are left out
    before = F.max("c1").over(Window.partitionBy("_key", "row").orderBy("c0", "c1").rowsBetween(Window.unboundedPreceding, -1))
    return (m.withColumn("c0", F.greatest("c0", F.coalesce(before + 1, F.col("c0")))).where("c0 <= c1")
            .select(F.col("_key").alias(key), "row", "c0", "c1"))


def tile_spans(polys: DataFrame, meta: RasterMeta, key="id", geom="geometry") -> DataFrame:
    """Per polygon and tile that it meets: (key, tile_row, tile_col, spans),
    each span a place in the tile's array and a number of pixels."""
    t = meta.tile
    s = polygon_spans(polys, meta, key, geom)
    s = s.withColumn("tile_col", F.explode(F.sequence(F.floor(F.col("c0") / t), F.floor(F.col("c1") / t))))
    a = F.greatest(F.col("c0"), F.col("tile_col") * t)
    b = F.least(F.col("c1"), F.col("tile_col") * t + t - 1)
    span = F.struct(((F.col("row") % t) * t + a % t).cast("int").alias("at"), (b - a + 1).cast("int").alias("n"))
    return (s.withColumn("tile_row", F.floor(F.col("row") / t)).groupBy(key, "tile_row", "tile_col")
            .agg(F.collect_list(span).alias("spans")))


def _clipped(tiles: DataFrame, polys: DataFrame, meta: RasterMeta, key, geom) -> DataFrame:
    return tile_spans(polys, meta, key, geom).join(tiles, ["tile_row", "tile_col"])


def clip_pixels(tiles: DataFrame, polys: DataFrame, meta: RasterMeta, key="id", geom="geometry") -> DataFrame:
    """Pixels whose centre lies in (or on the boundary of) a polygon.
    Returns (key, band, row, col, value).  Scan-line spans are joined with the
    tiles that they meet; pixels are slices of the tiles' arrays."""
    t = meta.tile
    cut = F.flatten(F.transform("spans", lambda s: F.transform(
        F.slice("data", s["at"] + 1, s["n"]), lambda v, k: F.struct((s["at"] + k).alias("i"), v.alias("value")))))
    p = _clipped(tiles, polys, meta, key, geom).select(key, "band", "tile_row", "tile_col", F.inline(cut))
    return p.select(key, "band", (F.col("tile_row") * t + F.floor(F.col("i") / t)).cast("bigint").alias("row"),
                    (F.col("tile_col") * t + F.col("i") % t).cast("bigint").alias("col"), "value")


def zonal_stats(tiles: DataFrame, polys: DataFrame, meta: RasterMeta, key="id", geom="geometry",
                valid_min: float | None = None, valid_max: float | None = None, keep_empty: bool = True) -> DataFrame:
    """Per-polygon sum / count / mean / min / max of valid pixels
    (nodata and values outside the open range (valid_min, valid_max)
    ignored).  ``keep_empty`` keeps polygons without pixels (count 0, NULL
    stats) as the Python path does; the SQL path drops them."""
    values = F.flatten(F.transform("spans", lambda s: F.slice("data", s["at"] + 1, s["n"])))
    px = _clipped(tiles, polys, meta, key, geom).select(key, F.explode(values).alias("value"))
    v = mask_nodata("value", meta.nodata)
    if valid_min is not None:
        v = F.when(v > valid_min, v)
    if valid_max is not None:
        v = F.when(v < valid_max, v)
    st = px.groupBy(key).agg(F.sum(v).alias("sum"), F.count(v).alias("count"), F.avg(v).alias("mean"),
                             F.min(v).alias("min"), F.max(v).alias("max"))
    if keep_empty:
        st = polys.select(key).join(st, key, "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return st
