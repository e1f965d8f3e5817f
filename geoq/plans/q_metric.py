"""Use cases over layers that hold WKB in degrees: decoded and transformed to
a metric CRS within the query."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoq.functions import crs
from geoq.functions import geometry as G
from geoq.functions.wkb import with_geom_from_wkb
from geoq.operators import spatial_join as SJ
from geoq.plans import fixtures as FX
from geoq.plans.queries import DJOIN_D, query

METRIC = 32632


def _metric(layer, *cols):
    """``cols`` and the geometry in the metric CRS, from WKB in degrees."""
    g = with_geom_from_wkb(layer.select(*cols, "wkb"), "wkb", "lonlat", 4326)
    return g.select(*cols, crs.transform("lonlat", 4326, METRIC).alias("geometry"))


@query("top10_area_utm")
def top10_area_utm(spark, sf):
    """UC3.1: ten largest footprints by area in UTM 32N (tie-break on id)."""
    b = _metric(FX.wkb_in_degrees(FX.footprints(spark, sf)), "id")
    top = b.select("id", G.area("geometry").alias("area")).orderBy(F.desc("area"), "id").limit(10)
    return top.select(F.col("id").alias("feature_id"), F.round("area", 2).alias("area_sqm"))


@query("distance_anti_utm")
def distance_anti_utm(spark, sf):
    """UC3.3: restaurants not within 2500 m (UTM 32N) of any bus stop."""
    def metric_points(points):
        g = with_geom_from_wkb(FX.wkb_in_degrees(FX.with_point(points)).select("id", "wkb"), "wkb", "lonlat", 4326)
        lonlat = g.select("id", G.x("lonlat").alias("lon"), G.y("lonlat").alias("lat"))
        x, y = crs.transform_xy(F.col("lon"), F.col("lat"), 4326, METRIC)
        return lonlat.select("id", x.alias("x"), y.alias("y"))

    far = SJ.sjoin(metric_points(FX.pts_customer(spark, sf)), metric_points(FX.pts_supplier(spark, sf)), "dwithin", "anti",
                   distance=DJOIN_D, left_geom=("x", "y"), right_geom=("x", "y"), left_key="id")
    return far.select(F.col("id").alias("cust_id"), F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("transform_length_sql")
def transform_length_sql(spark, sf):
    """``ST_Length(ST_Transform(...))`` of streets, in SQL."""
    from geoq.functions.sql import register
    register(spark)
    lines = with_geom_from_wkb(FX.wkb_in_degrees(FX.line_orders(spark, sf)), "wkb", "geometry", 4326)
    lines.select("id", "highway", "geometry").createOrReplaceTempView("geoq_lonlat_lines")
    return spark.sql(f"""SELECT highway, count(*) AS n, round(sum(ST_Length(ST_Transform(geometry, 4326, {METRIC}))), 2) AS length_m
        FROM geoq_lonlat_lines GROUP BY highway""")
