"""Spatial operators composed from the cell join (C-series)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoq.operators.spatial_join import candidate_pairs


def count_in_polygons(polys: DataFrame, points: DataFrame, *, poly_key="id", poly_geom="geometry",
                      point_xy=("x", "y"), point_geom=None, predicate="within",
                      cell_size=None, out_col="cnt") -> DataFrame:
    """C4 / C14: polygon-preserving join + count (``LEFT JOIN .. ST_Within ..
    GROUP BY polygon``).  Counts are aggregated before the join back, so the
    polygon side is never widened by the point payload."""
    pgeom = point_xy if point_geom is None else point_geom
    pairs = candidate_pairs(points, polys, predicate, left_geom=pgeom, right_geom=poly_geom,
                            left_cols=[point_xy[0]] if point_geom is None else [point_geom],
                            right_cols=[poly_key], cell_size=cell_size)
    counts = pairs.groupBy(F.col(f"r.{poly_key}").alias(poly_key)).agg(F.count(F.lit(1)).alias(out_col))
    return (polys.join(counts, poly_key, "left")
            .withColumn(out_col, F.coalesce(F.col(out_col), F.lit(0)).cast("bigint")))


def filter_within(df: DataFrame, poly, poly_bbox, geom="geometry") -> DataFrame:
    """Rows whose geometry lies within a literal polygon.  The bbox
    test comes first so Parquet can skip row groups when a bbox column is
    stored."""
    from geoq.functions import geometry as G
    x0, y0, x1, y1 = poly_bbox
    b = G.bbox(F.col(geom))
    return df.where((b.minx >= x0) & (b.maxx <= x1) & (b.miny >= y0) & (b.maxy <= y1)
                    & G.within(F.col(geom), poly))


def filter_intersects(df: DataFrame, poly, poly_bbox, geom="geometry") -> DataFrame:
    """B12 with a literal polygon."""
    from geoq.functions import geometry as G
    x0, y0, x1, y1 = poly_bbox
    b = G.bbox(F.col(geom))
    return df.where((b.minx <= x1) & (b.maxx >= x0) & (b.miny <= y1) & (b.maxy >= y0)
                    & G.intersects(F.col(geom), poly))
