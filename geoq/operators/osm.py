"""OpenStreetMap feature assembly as table jobs (K-series).

Input: three element tables ``nodes(id, x, y, tags)``, ``ways(id, nd
array<bigint>, tags)``, ``relations(id, members array<struct<ref, type,
role>>, tags)`` -- e.g. from :func:`geoq.sources.osm.read_osm_xml`.  The
row-at-a-time callbacks and in-memory dict caches of a single-process
reader become joins keyed by element id: every collection below is per
way (bounded by the way's node count) or per relation (its member list).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoq.functions import geometry as G


def has_key(tags, key) -> "F.Column":
    return F.map_contains_key(tags, key)


def tags_match(tags, spec: dict | None, mode: str = "any"):
    """``{key: True | value | [values]}``; ``None``/``{}`` matches all.
    ``mode='any'`` ORs the keys, ``'all'`` ANDs them."""
    tags = F.col(tags) if isinstance(tags, str) else tags
    if not spec:
        return F.lit(True)
    conds = []
    for k, v in spec.items():
        val = F.try_element_at(tags, F.lit(k))
        if v is True:
            conds.append(has_key(tags, k))
        elif isinstance(v, (list, tuple, set)):
            conds.append(F.coalesce(val.isin(list(v)), F.lit(False)))
        else:
            conds.append(F.coalesce(val == F.lit(v), F.lit(False)))
    out = conds[0]
    for c in conds[1:]:
        out = (out | c) if mode == "any" else (out & c)
    return out


# Metadata tag keys dropped by ``ignore_metadata_tags``.
METADATA_TAGS = ["source", "created_by"]


def drop_metadata_tags(tags, keys=METADATA_TAGS):
    """K6."""
    tags = F.col(tags) if isinstance(tags, str) else tags
    ks = F.array(*[F.lit(k) for k in keys])
    return F.map_filter(tags, lambda k, v: ~F.array_contains(ks, k))


def explode_tags(df: DataFrame, keys, tags="tags") -> DataFrame:
    """K7: one column per tag key (``explode_tags=True``)."""
    return df.select("*", *[F.try_element_at(F.col(tags), F.lit(k)).alias(k) for k in keys]).drop(tags)


def building_relations(relations: DataFrame) -> DataFrame:
    return relations.where((F.try_element_at("tags", F.lit("type")) == "multipolygon") & has_key("tags", "building"))


def required_ids(nodes: DataFrame, ways: DataFrame, relations: DataFrame):
    """K1: ways tagged ``building`` plus way members of building
    multipolygon relations; nodes referenced by those ways.  Returns
    (way_ids, node_ids) DataFrames (distinct)."""
    rel_ways = (building_relations(relations).select(F.explode("members").alias("m"))
                .where(F.col("m.type") == "w").select(F.col("m.ref").alias("id")))
    way_ids = ways.where(has_key("tags", "building")).select("id").unionByName(rel_ways).distinct()
    node_ids = (ways.join(way_ids, "id", "left_semi").select(F.explode("nd").alias("id")).distinct())
    return way_ids, node_ids


def way_coords(ways: DataFrame, nodes: DataFrame, min_points: int = 4) -> DataFrame:
    """K2: ordered node refs -> coordinates; refs without a node are
    skipped; ways with fewer than ``min_points`` usable points dropped.
    Returns (id, coords array<struct<x,y>>) with coords in node order."""
    refs = ways.select("id", F.posexplode("nd").alias("pos", "node_id"))
    pts = refs.join(nodes.select(F.col("id").alias("node_id"), "x", "y"), "node_id")
    c = (pts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("c"))
         .select("id", F.transform("c", lambda e: G.xy(e.x, e.y)).alias("coords")))
    return c.where(F.size("coords") >= min_points)


def close_ring(coords):
    coords = F.col(coords) if isinstance(coords, str) else coords
    first, last = coords[0], F.element_at(coords, -1)
    closed = (first.x == last.x) & (first.y == last.y)
    return F.when(closed, coords).otherwise(F.concat(coords, F.array(first)))


def relation_polygons(relations: DataFrame, ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """K3: building multipolygon relations -> geometry.  Role ``outer``
    rings are shells, any other role a hole; one shell gives a polygon with
    holes, several shells a multipolygon without holes (rings are not
    stitched across ways).  Returns (id, tags, geometry, used_ways) where
    used_ways lists every member way present in ``ways``."""
    rels = building_relations(relations)
    mem = (rels.select(F.col("id").alias("rel_id"), F.posexplode("members").alias("mpos", "m"))
           .where(F.col("m.type") == "w")
           .select("rel_id", "mpos", F.col("m.ref").alias("way_id"), F.col("m.role").alias("role")))
    present = mem.join(ways.select(F.col("id").alias("way_id")), "way_id", "left_semi")
    rings = way_coords(ways.join(present.select(F.col("way_id").alias("id")).distinct(), "id", "left_semi"), nodes)
    m = present.join(rings.select(F.col("id").alias("way_id"), close_ring("coords").alias("ring")), "way_id", "left")
    agg = m.groupBy("rel_id").agg(
        F.array_sort(F.collect_list(F.when((F.col("role") == "outer") & F.col("ring").isNotNull(),
                                           F.struct("mpos", "ring")))).alias("outer"),
        F.array_sort(F.collect_list(F.when((F.col("role") != "outer") & F.col("ring").isNotNull(),
                                           F.struct("mpos", "ring")))).alias("inner"))
    outers = F.transform("outer", lambda e: e.ring)
    inners = F.transform("inner", lambda e: e.ring)
    geom = (F.when(F.size(outers) == 1, G.polygon(F.concat(F.array(outers[0]), inners)))
            .when(F.size(outers) > 1, G.multipolygon(F.transform(outers, lambda o: F.array(o)))))
    return (agg.select(F.col("rel_id").alias("id"), geom.alias("geometry")).where(F.col("geometry").isNotNull())
            .join(rels.select("id", "tags"), "id"))


def buildings(nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    """K4: relation polygons plus building ways not used by any building
    relation (a member way counts as used even when its relation yields no
    geometry).  Output: feature_id ('r<id>' / 'w<id>'), tags, geometry."""
    rels = building_relations(relations)
    used = (rels.select(F.explode("members").alias("m")).where(F.col("m.type") == "w")
            .select(F.col("m.ref").alias("id")).join(ways.select("id"), "id", "left_semi"))
    rp = relation_polygons(relations, ways, nodes)
    bw = ways.where(has_key("tags", "building")).join(used, "id", "left_anti")
    wp = way_coords(bw, nodes).join(bw.select("id", "tags"), "id")
    wp = wp.select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("feature_id"), "tags",
                   G.polygon(F.array(close_ring("coords"))).alias("geometry"))
    rp = rp.select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("feature_id"), "tags", "geometry")
    return rp.unionByName(wp)


def regional_extract(nodes: DataFrame, ways: DataFrame, relations: DataFrame, boundary: DataFrame):
    """K8: ``osmium extract --polygon`` with complete ways: nodes inside the
    boundary polygon(s) (cell join, boundary inclusive), ways with any such
    node, all nodes of those ways, relations with any selected way member.
    Returns (node_ids, way_ids, relation_ids)."""
    from geoq.operators.spatial_join import sjoin
    inside = sjoin(nodes.select("id", "x", "y"), boundary.select("geometry"), "intersects", "semi",
                   left_geom=("x", "y"), left_key="id").select("id")
    way_ids = (ways.select("id", F.explode("nd").alias("node_id"))
               .join(inside.select(F.col("id").alias("node_id")), "node_id", "left_semi").select("id").distinct())
    node_ids = (ways.join(way_ids, "id", "left_semi").select(F.explode("nd").alias("id"))
                .unionByName(inside).distinct())
    rel_ids = (relations.select("id", F.explode("members").alias("m"))
               .where(F.col("m.type") == "w")
               .join(way_ids.select(F.col("id").alias("ref")), F.col("m.ref") == F.col("ref"), "left_semi")
               .select("id").distinct())
    return node_ids, way_ids, rel_ids
