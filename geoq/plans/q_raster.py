"""Raster queries (J-series, UC2 raster clip, UC5 zonal statistics)."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoq.operators import aggregates as AG
from geoq.operators import raster as RS
from geoq.plans import fixtures as FX
from geoq.plans.queries import _polygonal, query


def _valid(c="value"):
    return F.col(c) != 0.0


@query("raster_tiles_summary")
def raster_tiles_summary(spark, sf):
    """Pixels -> 32x32 tiles; per tile count and sum of valid pixels."""
    tiles, meta = FX.raster_tiles(spark, sf)
    valid = F.filter("data", lambda v: v != F.lit(meta.nodata))
    return tiles.select("band", F.col("tile_row").cast("bigint").alias("tile_row"),
                        F.col("tile_col").cast("bigint").alias("tile_col"),
                        F.size(valid).cast("bigint").alias("n_valid"),
                        F.aggregate(valid, F.lit(0.0), lambda a, b: a + b).alias("sum_valid"))


@query("raster_pixels_roundtrip")
def raster_pixels_roundtrip(spark, sf):
    """J1 inverse: tiles -> pixel view."""
    tiles, meta = FX.raster_tiles(spark, sf)
    return RS.to_pixels(tiles, meta).select("row", "col", "value")


@query("raster_mosaic")
def raster_mosaic(spark, sf):
    """Mosaic of two rasters over their joint extent, the later one wins
    where both cover."""
    from geoq.sources.tables import read_table
    a = FX.raster_band(spark, sf)
    k = F.col("o_orderkey")
    b = (read_table(spark, sf, "orders")
         .select(F.lit(1).alias("band"), ((k - k % 100) / 100 + 3).cast("bigint").alias("row"),
                 (k % 100 + 50).cast("bigint").alias("col"), ((k * 17) % 50).cast("double").alias("value")))
    return RS.mosaic([a, b]).select("row", "col", "value")


@query("raster_info")
def raster_info(spark, sf):
    """Raster metadata and bounds (tile keys only)."""
    tiles, meta = FX.raster_tiles(spark, sf)
    return RS.info(tiles, meta)


@query("band_read")
def band_read(spark, sf):
    """Read band 1."""
    tiles, meta = FX.raster_tiles(spark, sf)
    px = RS.to_pixels(tiles.where(F.col("band") == 1), meta)
    return px.agg(F.count(F.lit(1)).alias("n_pixels"), F.sum("value").alias("sum_value"))


@query("raster_window")
def raster_window(spark, sf):
    """Window(col_off=10, row_off=20, 30, 40) with its transform."""
    tiles, meta = FX.raster_tiles(spark, sf)
    px = RS.to_pixels(RS.window_tiles(tiles, meta, 10, 20, 30, 40), meta)
    w, m2 = RS.window(px, meta, 10, 20, 30, 40)
    return w.select("row", "col", "value", F.lit(m2.ulx).alias("ulx"), F.lit(m2.uly).alias("uly"))


@query("nodata_mask")
def nodata_mask(spark, sf):
    """NODATA masked, count and mean of the rest."""
    _, meta = FX.raster_tiles(spark, sf)
    v = RS.mask_nodata("value", meta.nodata)
    return FX.raster_band(spark, sf).agg(F.count(v).alias("n_valid"), F.round(F.avg(v), 6).alias("mean_valid"))


@query("resample_average")
def resample_average(spark, sf):
    """Average resampling to (height/5) x 10 (heights need not divide)."""
    _, meta = FX.raster_tiles(spark, sf)
    r, _ = RS.resample_average(FX.raster_band(spark, sf), meta, meta.height // 5, 10)
    return r.select("row", "col", F.round("value", 6).alias("value"))


@query("resample_50x50")
def resample_50x50(spark, sf):
    """Average resampling to 50 x 50 with the new transform."""
    _, meta = FX.raster_tiles(spark, sf)
    r, new = RS.resample_average(FX.raster_band(spark, sf), meta, 50, 50)
    return r.select("row", "col", F.round("value", 6).alias("value"), F.lit(new.px).alias("px"), F.round(F.lit(new.py), 6).alias("py"))


@query("class_counts")
def class_counts(spark, sf):
    """J8 (+ D17): classes present, pixel count and percent of valid pixels."""
    return AG.percent_of_total(FX.raster_band(spark, sf).where(_valid()), "value") \
        .withColumnRenamed("value", "class")


@query("pixel_histogram")
def pixel_histogram(spark, sf):
    """Histogram with integer edges 0..50 (last edge inclusive)."""
    return AG.histogram(FX.raster_band(spark, sf), "value", 50, 0, 50)


@query("class_mask")
def class_mask(spark, sf):
    """Np.isin(data, 1..11) as a column, counted."""
    m = F.col("value").isin([float(c) for c in range(1, 12)])
    return FX.raster_band(spark, sf).agg(F.count(F.when(m, 1)).alias("n_in_mask"),
                                         F.count(F.when(~m, 1)).alias("n_outside"))


@query("class_area_ha")
def class_area_ha(spark, sf):
    """Area per class in hectares (count * pixel area / 1e4)."""
    _, meta = FX.raster_tiles(spark, sf)
    return (FX.raster_band(spark, sf).where(_valid()).groupBy(F.col("value").alias("class"))
            .agg((F.count(F.lit(1)) * meta.pixel_area / 1e4).alias("area_ha")))


def _clip_poly(spark, sf):
    return FX.poly_nation(spark, sf).where(F.col("id") == 12).select("id", "geometry")


@query("raster_clip")
def raster_clip(spark, sf):
    """Raster clipped to a polygon (pixel centres inside or on it)."""
    tiles, meta = FX.raster_tiles(spark, sf)
    return RS.clip_pixels(tiles, _clip_poly(spark, sf), meta).select("row", "col", "value")


@query("raster_clip_sum")
def raster_clip_sum(spark, sf):
    """J13 / UC2: SUM of the clipped raster (population of a city)."""
    tiles, meta = FX.raster_tiles(spark, sf)
    p = RS.clip_pixels(tiles, _clip_poly(spark, sf), meta)
    v = RS.mask_nodata("value", meta.nodata)
    return p.agg(F.sum(v).alias("total"), F.count(v).alias("n_pixels"))


@query("zonal_stats_sum")
def zonal_stats_sum(spark, sf):
    """J14 / UC5: population per municipality: sum of valid pixels
    (0 < v < 1e10) per polygon, polygons without pixels kept."""
    tiles, meta = FX.raster_tiles(spark, sf)
    z = RS.zonal_stats(tiles, _polygonal(spark, sf).select("id", "geometry"), meta, valid_min=0.0, valid_max=1e10)
    return z.select("id", "sum", F.col("count").cast("bigint").alias("count"))


@query("zonal_mean")
def zonal_mean(spark, sf):
    """Zonal mean excluding NODATA."""
    tiles, meta = FX.raster_tiles(spark, sf)
    z = RS.zonal_stats(tiles, _polygonal(spark, sf).select("id", "geometry"), meta)
    return z.select("id", F.round("mean", 6).alias("mean"), F.col("min").alias("min"), F.col("max").alias("max"))


@query("region_total")
def region_total(spark, sf):
    """Total over all zones and number of zones with pixels."""
    tiles, meta = FX.raster_tiles(spark, sf)
    z = RS.zonal_stats(tiles, _polygonal(spark, sf).select("id", "geometry"), meta, valid_min=0.0, valid_max=1e10,
                       keep_empty=False)
    return z.agg(F.sum("sum").alias("total"), F.count(F.lit(1)).alias("n_zones"))
