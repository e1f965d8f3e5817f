"""OSM queries: feature assembly (K), tag operators (B5, B6, B9, I3) and
the UC1&2 / UC3.1 building queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoq.functions import geometry as G
from geoq.operators import osm as OSM
from geoq.operators import spatial_join as SJ
from geoq.plans import fixtures as FX
from geoq.plans.queries import query


def _elements(spark, sf):
    return FX.osm_nodes(spark, sf), FX.osm_ways(spark, sf), FX.osm_relations(spark, sf)


def _boundary(spark, sf):
    return FX.poly_nation(spark, sf).where(F.col("id") == 12).select("geometry")


@query("osm_required_ids")
def osm_required_ids(spark, sf):
    """K1: ids needed to build buildings (semi-join reduction)."""
    n, w, r = _elements(spark, sf)
    way_ids, node_ids = OSM.required_ids(n, w, r)
    return way_ids.select(F.lit("way").alias("kind"), "id").unionByName(
        node_ids.select(F.lit("node").alias("kind"), "id"))


@query("osm_way_geometries")
def osm_way_geometries(spark, sf):
    """K2: way geometry from ordered node refs (>= 4 points, ring closed)."""
    n, w, _ = _elements(spark, sf)
    c = OSM.way_coords(w, n).select("id", OSM.close_ring("coords").alias("ring"))
    g = G.polygon(F.array("ring"))
    return c.select(F.col("id").alias("way_id"), F.size("ring").cast("bigint").alias("num_points"),
                    G.area(g).alias("area"))


@query("osm_relation_geometries")
def osm_relation_geometries(spark, sf):
    """K3: multipolygon relations -> polygon with holes / multipolygon."""
    n, w, r = _elements(spark, sf)
    g = F.col("geometry")
    return OSM.relation_polygons(r, w, n).select(
        F.col("id").alias("rel_id"), G.geom_type(g).alias("gtype"), F.size(g.parts).cast("bigint").alias("n_parts"),
        F.size(G.rings(g)).cast("bigint").alias("n_rings"), G.area(g).alias("area"))


@query("osm_buildings")
def osm_buildings(spark, sf):
    """K4 / UC1&2: all buildings = relation polygons + unused building ways."""
    n, w, r = _elements(spark, sf)
    g = F.col("geometry")
    return OSM.buildings(n, w, r).select("feature_id", G.geom_type(g).alias("gtype"), G.area(g).alias("area"))


@query("top10_area")
def top10_area(spark, sf):
    """F1 / UC3.1: ten largest buildings by area (tie-break on id)."""
    n, w, r = _elements(spark, sf)
    b = OSM.buildings(n, w, r).select("feature_id", G.area("geometry").alias("area_sqm"))
    return b.orderBy(F.desc("area_sqm"), "feature_id").limit(10)


@query("osm_extract_in_boundary")
def osm_extract_in_boundary(spark, sf):
    """K5 (B5 + B12): buildings intersecting the boundary polygon."""
    n, w, r = _elements(spark, sf)
    b = OSM.buildings(n, w, r).where(OSM.tags_match("tags", {"building": True}))
    return SJ.sjoin(b.select("feature_id", "geometry"), _boundary(spark, sf), "intersects", "semi",
                    left_key="feature_id").select("feature_id")


@query("osm_drop_metadata_tags")
def osm_drop_metadata_tags(spark, sf):
    """K6: ignore_metadata_tags."""
    w = FX.osm_ways(spark, sf)
    t = OSM.drop_metadata_tags("tags")
    return w.select(F.col("id").alias("way_id"), F.array_join(F.array_sort(F.map_keys(t)), ",").alias("keys"))


@query("osm_tags_to_columns")
def osm_tags_to_columns(spark, sf):
    """K7: explode_tags=True (one column per key)."""
    w = FX.osm_ways(spark, sf).select(F.col("id").alias("way_id"), "tags")
    return OSM.explode_tags(w, ["highway", "status", "building"])


@query("osm_regional_extract")
def osm_regional_extract(spark, sf):
    """K8: polygon extract with complete ways and their relations."""
    n, w, r = _elements(spark, sf)
    nodes, ways, rels = OSM.regional_extract(n, w, r, _boundary(spark, sf))
    return (nodes.select(F.lit("node").alias("kind"), "id")
            .unionByName(ways.select(F.lit("way").alias("kind"), "id"))
            .unionByName(rels.select(F.lit("relation").alias("kind"), "id")))


@query("tags_filter")
def tags_filter(spark, sf):
    """Tags filter {highway: [..], building: True}, keys OR-ed."""
    w = FX.osm_ways(spark, sf)
    return w.where(OSM.tags_match("tags", {"highway": ["2-HIGH", "3-MEDIUM"], "building": True}, "any")) \
        .select(F.col("id").alias("way_id"))


@query("tags_filter_all")
def tags_filter_all(spark, sf):
    """B5 with the keys AND-ed."""
    w = FX.osm_ways(spark, sf)
    return w.where(OSM.tags_match("tags", {"status": "F", "highway": ["1-URGENT", "5-LOW"]}, "all")) \
        .select(F.col("id").alias("way_id"))


@query("map_lookup")
def map_lookup(spark, sf):
    """B6: "landuse" in x and x["landuse"] == value, as try_element_at."""
    w = FX.osm_ways(spark, sf)
    return w.where(F.map_contains_key("tags", "highway") & (F.try_element_at("tags", F.lit("highway")) == "5-LOW")) \
        .select(F.col("id").alias("way_id"))


@query("list_to_string")
def list_to_string(spark, sf):
    """List-valued cells as text."""
    w = FX.osm_ways(spark, sf)
    return w.select(F.col("id").alias("way_id"), F.array_join(F.col("nd").cast("array<string>"), ",").alias("refs"))


@query("map_list_functions")
def map_list_functions(spark, sf):
    """Map / list functions on element tables."""
    w = FX.osm_ways(spark, sf)
    return w.select(F.col("id").alias("way_id"), F.size("tags").cast("bigint").alias("n_tags"),
                    F.try_element_at("tags", F.lit("status")).alias("status"),
                    F.size("nd").cast("bigint").alias("n_refs"), F.try_element_at("nd", F.lit(1)).alias("first_ref"),
                    F.array_max("nd").alias("max_ref"))
