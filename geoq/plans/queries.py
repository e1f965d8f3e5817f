"""Registered queries: one per operator of the inventory, each reading the
driver tables (through the derived geometry views) at ``sf_dir``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoq.functions import geometry as G
from geoq.operators import spatial_join as SJ
from geoq.plans import fixtures as FX
from geoq.operators.aggregates import join_scalars

QUERIES: dict = {}


def query(name):
    """Register a query; the wrapper applies the library's session defaults
    (only those the session leaves unset) before building the plan."""
    import functools

    def deco(fn):
        @functools.wraps(fn)
        def run(spark, sf):
            from geoq.session import configure
            configure(spark)
            return fn(spark, sf)
        QUERIES[name] = run
        return fn
    return deco


def _polygonal(spark, sf) -> DataFrame:
    return FX.poly_nation(spark, sf).where(G.is_polygonal("geometry"))


@query("points_per_polygon")
def points_per_polygon(spark: SparkSession, sf: str) -> DataFrame:
    """UC4.1 restaurants per neighbourhood (C4): polygon-preserving
    point-in-polygon count, empty polygons count 0."""
    from geoq.operators.spatial import count_in_polygons
    polys = _polygonal(spark, sf)
    pts = FX.pts_customer(spark, sf)
    return count_in_polygons(polys, pts, poly_key="id", point_xy=("x", "y")).select(
        F.col("id").cast("bigint").alias("neighborhood_id"), F.col("cnt").alias("restaurant_count"))


# ---------------------------------------------------------------- C: spatial joins

def _pip_pairs(spark, sf):
    pts = FX.pts_customer(spark, sf)
    return SJ.candidate_pairs(pts, _polygonal(spark, sf), "within", left_geom=("x", "y"),
                              left_cols=["id"], right_cols=["id"])


@query("pip_inner_join")
def pip_inner_join(spark, sf):
    """Point-in-polygon inner join (sensors x cities)."""
    return _pip_pairs(spark, sf).select(F.col("l.id").alias("point_id"), F.col("r.id").cast("bigint").alias("polygon_id"))


@query("pip_left_join")
def pip_left_join(spark, sf):
    """Every point, with its polygon or NULL (gpd.sjoin how='left')."""
    pts = FX.pts_customer(spark, sf)
    j = SJ.sjoin(pts, _polygonal(spark, sf).select(F.col("id").alias("polygon_id"), "geometry"), "within", "left",
                 left_geom=("x", "y"), left_key="id", right_cols=["polygon_id"])
    return j.select(F.col("id").alias("point_id"), F.col("polygon_id").cast("bigint").alias("polygon_id"))


@query("pip_anti_join")
def pip_anti_join(spark, sf):
    """Points within no polygon (LEFT JOIN .. WHERE NULL)."""
    pts = FX.pts_customer(spark, sf)
    return SJ.sjoin(pts, _polygonal(spark, sf), "within", "anti", left_geom=("x", "y"), left_key="id") \
        .select(F.col("id").alias("point_id"))


DJOIN_D = 2500.0


@query("distance_join")
def distance_join(spark, sf):
    """All customer-supplier pairs within 2500 m, with their distance."""
    p = SJ.candidate_pairs(FX.pts_customer(spark, sf), FX.pts_supplier(spark, sf), "dwithin", distance=DJOIN_D,
                           left_geom=("x", "y"), right_geom=("x", "y"), left_cols=["id", "x", "y"],
                           right_cols=["id", "x", "y"])
    return p.select(F.col("l.id").alias("cust_id"), F.col("r.id").alias("supp_id"),
                    F.round(F.sqrt(G.point_dist_sq("l.x", "l.y", "r.x", "r.y")), 3).alias("dist"))


@query("distance_anti_join")
def distance_anti_join(spark, sf):
    """C6 / UC3.3: restaurants NOT within 2500 m of any bus stop."""
    return SJ.sjoin(FX.pts_customer(spark, sf), FX.pts_supplier(spark, sf), "dwithin", "anti",
                    distance=DJOIN_D, left_geom=("x", "y"), right_geom=("x", "y"), left_key="id") \
        .select(F.col("id").alias("cust_id"), "x", "y")


NEAR_HOSP_D, NEAR_STREET_D = 1000.0, 200.0


@query("streets_trees_near_hospitals")
def streets_trees_near_hospitals(spark, sf):
    """C7 / UC4.2: streets within 1000 m of a hospital (semi join), trees
    within 200 m of those streets (semi join), two scalar aggregates."""
    streets = FX.line_orders(spark, sf)
    from geoq.session import cut_lineage
    # the CTE streets_near_hospitals is used twice: materialise it once
    near = cut_lineage(SJ.sjoin(streets, FX.pts_supplier(spark, sf), "dwithin", "semi", distance=NEAR_HOSP_D,
                                right_geom=("x", "y"), left_key="id").select("id", "geometry"))
    trees = SJ.sjoin(FX.pts_part(spark, sf), near.select("id", "geometry"), "dwithin", "semi",
                     distance=NEAR_STREET_D, left_geom=("x", "y"), left_key="id")
    a = trees.agg(F.count(F.lit(1)).alias("total_tree_count"))
    b = near.agg(F.round(F.sum(G.length("geometry")), 3).alias("total_street_length_m"))
    return join_scalars(a, b)


NEAREST_MAX = 5000.0


@query("nearest_within")
def nearest_within(spark, sf):
    """sjoin_nearest(max_distance=5000): nearest supplier per customer, ties kept."""
    from geoq.operators.nearest import nearest
    n = nearest(FX.pts_customer(spark, sf), FX.pts_supplier(spark, sf), NEAREST_MAX)
    return n.select(F.col("left_id").alias("cust_id"), F.col("right_id").alias("supp_id"), "dist_sq")


@query("nearest_any_distance")
def nearest_any_distance(spark, sf):
    """C8 without a limit: nearest supplier of every part, ties kept."""
    from geoq.operators.nearest import nearest
    n = nearest(FX.pts_part(spark, sf), FX.pts_supplier(spark, sf))
    return n.select(F.col("left_id").alias("part_id"), F.col("right_id").alias("supp_id"), "dist_sq")


@query("distinct_nodes_near_edges")
def distinct_nodes_near_edges(spark, sf):
    """COUNT(DISTINCT node) within 100 m of any edge."""
    near = SJ.sjoin(FX.pts_part(spark, sf), FX.line_orders(spark, sf), "dwithin", "semi", distance=100.0,
                    left_geom=("x", "y"), left_key="id")
    return near.agg(F.countDistinct("id").alias("n_nodes"))


@query("intersects_join")
def intersects_join(spark, sf):
    """Streets x polygons, ST_Intersects (boundary inclusive)."""
    p = SJ.candidate_pairs(FX.line_orders(spark, sf), _polygonal(spark, sf), "intersects",
                           left_cols=["id", "geometry"], right_cols=["id", "geometry"])
    return p.select(F.col("l.id").alias("line_id"), F.col("r.id").cast("bigint").alias("polygon_id"))


@query("bbox_join")
def bbox_join(spark, sf):
    """C11 / N1 candidates: envelope-intersects join."""
    p = SJ.candidate_pairs(FX.line_orders(spark, sf), _polygonal(spark, sf), "bbox_intersects",
                           left_cols=["id", "geometry"], right_cols=["id", "geometry"])
    return p.select(F.col("l.id").alias("line_id"), F.col("r.id").cast("bigint").alias("polygon_id"))


@query("proximity_by_batch")
def proximity_by_batch(spark, sf):
    """Node-edge pairs within 50 m, counted per batch of 1000 edges
    (one distributed join instead of a driver loop over batches)."""
    p = SJ.candidate_pairs(FX.pts_part(spark, sf), FX.line_orders(spark, sf), "dwithin", distance=50.0,
                           left_geom=("x", "y"), left_cols=["id"], right_cols=["id"])
    return (p.groupBy(F.floor(F.col("r.id") / 1000).cast("bigint").alias("batch"))
            .agg(F.count(F.lit(1)).alias("pairs")))


@query("lines_per_polygon")
def lines_per_polygon(spark, sf):
    """C14: per-polygon counts joined back by key, missing = 0."""
    polys = _polygonal(spark, sf)
    p = SJ.candidate_pairs(FX.line_orders(spark, sf), polys, "intersects",
                           left_cols=["id", "geometry"], right_cols=["id", "geometry"])
    cnt = p.groupBy(F.col("r.id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return (polys.select("id").join(cnt, "id", "left")
            .select(F.col("id").cast("bigint").alias("polygon_id"),
                    F.coalesce("n", F.lit(0)).cast("bigint").alias("n_lines")))


# ---------------------------------------------------------------- B: spatial filters

BOX = (20000.0, 20000.0, 60000.0, 60000.0)


@query("filter_within_box")
def filter_within_box(spark, sf):
    """Lines fully within a bbox polygon (ST_Within(geom, bbox))."""
    from geoq.operators.spatial import filter_within
    return filter_within(FX.line_orders(spark, sf), G.box(*BOX), BOX).select(F.col("id").alias("line_id"))


@query("filter_intersects_polygon")
def filter_intersects_polygon(spark, sf):
    """Features intersecting a boundary polygon taken from a table
    (boundary = polygon 12); a one-row side of the cell join."""
    boundary = FX.poly_nation(spark, sf).where(F.col("id") == 12).select("geometry")
    return SJ.sjoin(FX.line_orders(spark, sf), boundary, "intersects", "semi", left_key="id") \
        .select(F.col("id").alias("line_id"))


@query("filter_bbox")
def filter_bbox(spark, sf):
    """Envelope-only filter, four comparisons on the bbox struct."""
    b = F.col("bbox")
    x0, y0, x1, y1 = BOX
    return FX.line_orders(spark, sf).where((b.minx <= x1) & (b.maxx >= x0) & (b.miny <= y1) & (b.maxy >= y0)) \
        .select(F.col("id").alias("line_id"))


@query("filter_within_distance")
def filter_within_distance(spark, sf):
    """Points within 10 km of (50000, 50000): dist^2 <= r^2."""
    return FX.pts_customer(spark, sf).where(G.point_dist_sq("x", "y", F.lit(50000.0), F.lit(50000.0)) <= 1e8) \
        .select(F.col("id").alias("point_id"))


# ---------------------------------------------------------------- H: geometry functions

@query("polygon_measures")
def polygon_measures(spark, sf):
    """H6, H7 (perimeter, length 0), H14, H15, H17, H18 on the polygons."""
    g = F.col("geometry")
    c = G.centroid(g)
    b = G.bbox(g)
    return _polygonal(spark, sf).select(
        F.col("id").cast("bigint").alias("id"), G.geom_type(g).alias("gtype"),
        G.area(g).alias("area"), F.round(G.perimeter(g), 6).alias("perimeter"), G.length(g).alias("length"),
        F.round(G.length(G.boundary(g)), 6).alias("boundary_length"),
        F.round(G.x(c), 6).alias("cx"), F.round(G.y(c), 6).alias("cy"),
        b.minx.alias("minx"), b.miny.alias("miny"), b.maxx.alias("maxx"), b.maxy.alias("maxy"),
        G.num_points(g).cast("bigint").alias("num_points"), F.size(G.rings(g)).cast("bigint").alias("num_rings"))


@query("line_measures")
def line_measures(spark, sf):
    """H7 length, H14 bounds, H15 centroid of lines, H17 accessors."""
    g = F.col("geometry")
    c = G.centroid(g)
    b = F.col("bbox")
    return FX.line_orders(spark, sf).select(
        F.col("id"), F.round(G.length(g), 6).alias("length"), G.area(g).alias("area"),
        F.round(G.x(c), 6).alias("cx"), F.round(G.y(c), 6).alias("cy"),
        b.minx.alias("minx"), b.miny.alias("miny"), b.maxx.alias("maxx"), b.maxy.alias("maxy"),
        G.x(g).alias("x0"), G.y(g).alias("y0"), G.num_points(g).cast("bigint").alias("num_points"))


@query("point_polygon_distance")
def point_polygon_distance(spark, sf):
    """H8: point-polygon distance (0 inside) for every pair closer than 5 km."""
    p = SJ.candidate_pairs(FX.pts_customer(spark, sf), _polygonal(spark, sf), "dwithin", distance=5000.0,
                           left_geom=("x", "y"), left_cols=["id", "x", "y"], right_cols=["id", "geometry"])
    return p.select(F.col("l.id").alias("point_id"), F.col("r.id").alias("polygon_id"),
                    F.round(G.distance(G.point("l.x", "l.y"), F.col("r.geometry")), 3).alias("dist"))


# the other query modules register themselves on import
from geoq.plans import q_basic  # noqa: E402,F401
from geoq.plans import q_osm  # noqa: E402,F401
from geoq.plans import q_raster  # noqa: E402,F401
from geoq.plans import q_network  # noqa: E402,F401
from geoq.plans import q_overlay  # noqa: E402,F401
from geoq.plans import q_metric  # noqa: E402,F401


@query("candidate_join_back")
def candidate_join_back(spark, sf):
    """Envelope candidates between nodes and edges, joined back to
    the edge attributes by key, then the exact distance test (10 m); node
    count per highway class."""
    edges = FX.line_orders(spark, sf)
    cand = SJ.candidate_pairs(FX.pts_part(spark, sf), edges, "bbox_intersects", distance=10.0,
                              left_geom=("x", "y"), left_cols=["id", "x", "y"], right_cols=["id"])
    cand = cand.select(F.col("l.id").alias("node_id"), F.col("l.x").alias("x"), F.col("l.y").alias("y"),
                       F.col("r.id").alias("id"))
    j = cand.join(edges.select("id", "highway", G.part_segments("geometry").alias("segs")), "id")
    near = j.where(G.near_segs(F.col("x"), F.col("y"), F.col("segs"), 10.0))
    return near.groupBy("highway").agg(F.countDistinct("node_id").alias("n_nodes"))
