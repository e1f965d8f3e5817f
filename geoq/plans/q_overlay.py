"""Overlay / buffer area queries (D9, H12, UC3.2, UC4.3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoq.operators import overlay as OV
from geoq.plans import fixtures as FX
from geoq.plans.queries import _polygonal, query


@query("union_area_parks")
def union_area_parks(spark, sf):
    """Area of the union of all parks (overlapping rectangles)."""
    return OV.union_area(FX.parks(spark, sf)).select(F.round("area", 3).alias("union_area"))


@query("union_area_polygons")
def union_area_polygons(spark, sf):
    """Area of the union of the overlapping notched polygons (holes)."""
    return OV.union_area(_polygonal(spark, sf)).select(F.round("area", 3).alias("union_area"))


@query("non_park_area")
def non_park_area(spark, sf):
    """UC4.3: area of the city boundary not covered by parks
    (ST_Area(ST_Difference(boundary, ST_Union_Agg(parks))))."""
    boundary = FX.poly_nation(spark, sf).where(F.col("id") == 12).select("geometry")
    return OV.difference_area(boundary, FX.parks(spark, sf)).select(F.round("area", 3).alias("non_park_area_sqm"))


BUF_R, BUF_Q = 10.0, 8


@query("total_buffered_area")
def total_buffered_area(spark, sf):
    """UC3.2: SUM(ST_Area(ST_Buffer(geom, 10))) over building footprints."""
    from geoq.functions.buffer import with_buffer_area
    b = with_buffer_area(FX.footprints(spark, sf), "geometry", BUF_R, BUF_Q)
    return b.agg(F.round(F.sum("buffer_area"), 3).alias("total_buffered_area"))


@query("buffered_area_polygons")
def buffered_area_polygons(spark, sf):
    """H12 on non-convex polygons with holes (union of the buffer pieces)."""
    from geoq.functions.buffer import with_buffer_area
    b = with_buffer_area(_polygonal(spark, sf).select("id", "geometry"), "geometry", BUF_R, BUF_Q)
    return b.select("id", F.round("buffer_area", 6).alias("buffer_area"))


@query("point_buffers")
def point_buffers(spark, sf):
    """H12 on points: ST_Buffer(point, 100) as 32-gon; total area and vertices."""
    from geoq.functions import geometry as G
    p = FX.pts_customer(spark, sf).select(G.buffer_point("x", "y", 100.0, BUF_Q).alias("g"))
    return p.agg(F.round(F.sum(G.area("g")), 3).alias("total_area"),
                 F.sum(G.num_points("g")).cast("bigint").alias("n_vertices"))


@query("wkb_round_trip")
def wkb_round_trip(spark, sf):
    """H2: ST_AsWKB -> ST_GeomFromWKB round trip of polygons and lines."""
    from geoq.functions import geometry as G
    from geoq.functions.wkb import with_geom_from_wkb, with_wkb
    p = _polygonal(spark, sf).select("id", "geometry")
    w = with_wkb(p, "geometry", "wkb").select("id", "wkb")
    g = with_geom_from_wkb(w, "wkb", "g").select("id", F.length("wkb").cast("bigint").alias("wkb_bytes"), "g")
    return g.select("id", "wkb_bytes", G.area("g").alias("area"), G.num_points("g").cast("bigint").alias("num_points"))


@query("simplify_lines")
def simplify_lines(spark, sf):
    """ST_Simplify of the OSM way rings (tolerance 2000 m); vertex
    counts before/after and the kept end points."""
    from geoq.functions import geometry as G
    from geoq.functions.buffer import with_simplified
    from geoq.operators import osm as OSM
    w = OSM.way_coords(FX.osm_ways(spark, sf), FX.osm_nodes(spark, sf), min_points=2)
    g = w.select(F.col("id").alias("way_id"), G.linestring(F.col("coords")).alias("geometry"))
    s = with_simplified(g, "geometry", 2000.0)
    return s.select("way_id", G.num_points("geometry").cast("bigint").alias("n_before"),
                    G.num_points("simplified").cast("bigint").alias("n_after"),
                    F.round(G.length("simplified"), 6).alias("length_after"))


@query("clean_rings")
def clean_rings_q(spark, sf):
    """Ring cleaning of the OSM way polygons (repeated vertices
    dropped, rings closed and oriented, short rings dropped)."""
    from geoq.functions import geometry as G
    from geoq.operators import osm as OSM
    w = OSM.way_coords(FX.osm_ways(spark, sf), FX.osm_nodes(spark, sf), min_points=1)
    g = w.select(F.col("id").alias("way_id"), G.polygon(F.array("coords")).alias("geometry"))
    c = g.select("way_id", G.clean_rings("geometry").alias("g"))
    return c.select("way_id", F.size(F.col("g").parts).cast("bigint").alias("n_parts"),
                    G.num_points("g").cast("bigint").alias("num_points"), G.area("g").alias("area"),
                    G.is_simple("g").alias("is_simple"))
