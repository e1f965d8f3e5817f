"""Street network (L) and clustering (M) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoq.operators import network as NW
from geoq.operators.cluster import dbscan
from geoq.plans import fixtures as FX
from geoq.plans.queries import query


@query("graph_build")
def graph_build(spark, sf):
    """L1: drive network from OSM ways, split at shared nodes, two-way
    unless the way is one-way (status F)."""
    ways, nodes = FX.osm_ways(spark, sf), FX.osm_nodes(spark, sf)
    oneway = F.try_element_at("tags", F.lit("status")) == "F"
    e = NW.build_graph(ways, nodes, NW.DRIVE, oneway)
    return e.select("u", "v", "key", "way_id", F.round("length", 6).alias("length"))


@query("graph_build_largest")
def graph_build_largest(spark, sf):
    """L1 with ``retain_all=False``: some nodes are not in the extract (ways
    are cut there); of the rest the largest connected part."""
    ways, nodes = FX.osm_ways(spark, sf), FX.osm_nodes(spark, sf).where(F.col("id") % 50 != 7)
    oneway = F.try_element_at("tags", F.lit("status")) == "F"
    e = NW.build_graph(ways, nodes, NW.DRIVE, oneway, retain_all=False)
    return e.select("u", "v", "key", "way_id", F.round("length", 6).alias("length"))


@query("graph_nodes")
def graph_nodes_q(spark, sf):
    """L2: nodes table of the built graph."""
    ways, nodes = FX.osm_ways(spark, sf), FX.osm_nodes(spark, sf)
    e = NW.build_graph(ways, nodes, NW.DRIVE)
    return NW.graph_nodes(e, nodes).select("id", "x", "y")


@query("undirected_edges")
def undirected_edges(spark, sf):
    """L3: to_undirected() node pairs."""
    return NW.undirected(FX.street_edges(spark, sf))


@query("connected_components")
def connected_components(spark, sf):
    """Connected components (label = smallest node id)."""
    return NW.connected_components(FX.graph_nodes(spark, sf).select("id"), FX.graph_edges(spark, sf)) \
        .select(F.col("id").alias("node_id"), "component")


@query("component_count")
def component_count(spark, sf):
    """number_connected_components."""
    cc = NW.connected_components(FX.graph_nodes(spark, sf).select("id"), FX.graph_edges(spark, sf))
    return cc.agg(F.countDistinct("component").alias("n_components"))


@query("degree_distribution")
def degree_distribution(spark, sf):
    """Degree histogram."""
    return NW.degree_distribution(FX.graph_nodes(spark, sf), FX.street_edges(spark, sf))


@query("edge_length_stats")
def edge_length_stats(spark, sf):
    """Edge length count / total / mean / min / max."""
    e = FX.street_edges(spark, sf)
    return e.agg(F.count(F.lit(1)).alias("n"), F.sum("length").cast("bigint").alias("total"),
                 F.round(F.avg("length"), 6).alias("mean"), F.min("length").alias("min"), F.max("length").alias("max"))


@query("network_stats")
def network_stats(spark, sf):
    """basic_stats of the street graph."""
    return NW.network_stats(FX.graph_nodes(spark, sf), FX.street_edges(spark, sf))


def _sources(spark, sf):
    return FX.graph_nodes(spark, sf).where(F.col("kind") == "BUILDING").select(F.col("id").alias("src"))


@query("shortest_paths")
def shortest_paths(spark, sf):
    """Shortest path lengths from every BUILDING customer to every
    reachable node (batched single-source searches)."""
    d = NW.shortest_paths(FX.graph_edges(spark, sf), _sources(spark, sf), with_path=False)
    return d.select(F.col("src").alias("source"), F.col("node").alias("target"), F.col("dist").cast("bigint").alias("dist"))


@query("shortest_path_pairs")
def shortest_path_pairs(spark, sf):
    """The shortest path of each (origin, destination): ends of three
    streets in a row, and some customers to the next one."""
    e = FX.graph_edges(spark, sf)
    a, b, c = (e.select(F.col("u").alias(f"u{k}"), F.col("v").alias(f"v{k}")) for k in range(3))
    ends = a.join(b.hint("merge"), F.col("v0") == F.col("u1")).join(c.hint("merge"), F.col("v1") == F.col("u2")).select(F.col("u0").alias("src"), F.col("v2").alias("dst"))
    far = FX.graph_nodes(spark, sf).where(F.col("id") % 50 == 0).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    p = NW.shortest_path_pairs(e, ends.unionByName(far))
    return p.select("src", "dst", F.col("dist").cast("bigint").alias("dist"), F.col("hops").cast("bigint").alias("n_edges"),
                    F.array_join(F.col("path").cast("array<string>"), "-").alias("path"))


@query("route_edges")
def route_edges(spark, sf):
    """Route from each source to its farthest reachable node (ties:
    smallest id) expanded to edge rows."""
    from pyspark.sql import Window
    e = FX.graph_edges(spark, sf)
    d = NW.shortest_paths(e, _sources(spark, sf))
    w = Window.partitionBy("src").orderBy(F.desc("dist"), "node")
    far = d.withColumn("rk", F.row_number().over(w)).where("rk = 1").select(F.col("src").alias("route"), "path")
    und = e.select("u", "v", "length", F.col("edge_id").alias("key"))
    und = und.unionByName(und.select(F.col("v").alias("u"), F.col("u").alias("v"), "length", "key"))
    return NW.route_edges(far, und)


@query("project_graph")
def project_graph(spark, sf):
    """Graph nodes (lon/lat) projected to their UTM zone (32N here)."""
    from geoq.functions import crs
    n = FX.lonlat_customer(spark, sf)
    zone = crs.utm_zone_of(n, "lon")
    x, y = crs.lonlat_to_utm(F.col("lon"), F.col("lat"), zone)
    return n.select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), F.lit(zone).alias("zone"))


DB_EPS, DB_MIN = 2500.0, 5


@query("dbscan")
def dbscan_q(spark, sf):
    """DBSCAN labels (eps 2500 m, min_samples 5)."""
    return dbscan(FX.pts_part(spark, sf), DB_EPS, DB_MIN)


@query("dbscan_summary")
def dbscan_summary(spark, sf):
    """M1: number of clusters and noise points."""
    lab = dbscan(FX.pts_part(spark, sf), DB_EPS, DB_MIN)
    return lab.agg(F.countDistinct(F.when(F.col("label") >= 0, F.col("label"))).alias("n_clusters"),
                   F.count(F.when(F.col("label") < 0, 1)).alias("n_noise"))


@query("k_shortest_paths")
def k_shortest_paths(spark, sf):
    """10 shortest simple paths from each BUILDING customer to its
    farthest reachable node (ties: smallest id)."""
    from pyspark.sql import Window
    e = FX.graph_edges(spark, sf)
    d = NW.shortest_paths(e, _sources(spark, sf), with_path=False)
    w = Window.partitionBy("src").orderBy(F.desc("dist"), "node")
    pairs = d.withColumn("rk", F.row_number().over(w)).where("rk = 1 AND dist > 0").select("src", F.col("node").alias("dst"))
    return NW.k_shortest_paths(e, pairs, k=10).select("src", "dst", "rank", "cost", F.size("path").alias("n_nodes"))
