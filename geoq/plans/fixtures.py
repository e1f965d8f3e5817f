"""Geometry derived deterministically from the driver tables.

All coordinates are integer-valued doubles in a planar metre system of
about 100 km x 100 km, so squared distances, orientation signs and
twice-areas are exact.  Every view is a projection of a base table (no
shuffle) except the polygon assembly over the 25-row ``nation`` table and
the way-node ordering window.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoq.functions import geometry as G
from geoq.sources.tables import read_table

# Fixed values of the derived fixtures (multipliers / moduli of the
# coordinate hashes, polygon template, line offsets).
P_MOD_X, P_MOD_Y = 100003, 100019
CUST_MUL = (7919, 104729)
SUPP_MUL = (15485863, 32452843)
PART_MUL = (27644437, 86028121)
# notched shell then a square hole (ring, seq, ox, oy)
NATION_TEMPLATE = [
    (0, 0, 0, 0), (0, 1, 22000, 0), (0, 2, 22000, 9000), (0, 3, 9000, 12000), (0, 4, 18000, 21000),
    (0, 5, 0, 18000), (0, 6, 0, 0),
    (1, 0, 2000, 2000), (1, 1, 2000, 5000), (1, 2, 5000, 5000), (1, 3, 5000, 2000), (1, 4, 2000, 2000),
]
NATION_GRID = 20000
FAR_NATION, FAR_SHIFT = 24, 500000
NON_POLYGON_NATION = 3
#: Bytes of ``orders`` whose streets or footprints are one task's work.
GEOMETRY_BYTES = 4 << 20
RASTER_COLS, PIXEL, RASTER_TOP = 100, 1000.0, 100000.0


_MEMO: dict = {}


def _files(spark: SparkSession, sf: str) -> tuple:
    """The tables' files as they are now: name, time and size of each."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sf)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for st in fs.listStatus(folder):
        size = st.getLen() if st.isFile() else fs.getContentSummary(st.getPath()).toString()
        out.append((st.getPath().getName(), st.getModificationTime(), size))
    return tuple(sorted(out))


def memo(fn):
    """Fixture views are lazy DataFrames: their expression trees are sent to
    the JVM once, not on every query, for as long as the files stay as they
    are."""
    @functools.wraps(fn)
    def w(spark, sf, *a, **k):
        key = (fn.__name__, spark.sparkContext.applicationId, id(spark), sf, a, tuple(sorted(k.items())))
        files = _files(spark, sf)
        if key not in _MEMO or _MEMO[key][0] != files:
            _MEMO[key] = files, fn(spark, sf, *a, **k)
        return _MEMO[key][1]
    return w


def _hashed_xy(key, mul):
    return (((F.col(key) * mul[0]) % P_MOD_X).cast("double"), ((F.col(key) * mul[1]) % P_MOD_Y).cast("double"))


@memo
def pts_customer(spark: SparkSession, sf: str) -> DataFrame:
    x, y = _hashed_xy("c_custkey", CUST_MUL)
    return read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), x.alias("x"), y.alias("y"), F.col("c_mktsegment").alias("kind"))


@memo
def pts_supplier(spark: SparkSession, sf: str) -> DataFrame:
    x, y = _hashed_xy("s_suppkey", SUPP_MUL)
    return read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), x.alias("x"), y.alias("y"))


@memo
def pts_part(spark: SparkSession, sf: str) -> DataFrame:
    x, y = _hashed_xy("p_partkey", PART_MUL)
    return read_table(spark, sf, "part").select(F.col("p_partkey").alias("id"), x.alias("x"), y.alias("y"))


def with_point(df: DataFrame, srid=0) -> DataFrame:
    return df.withColumn("geometry", G.point("x", "y", srid))


@memo
def poly_nation_vertices(spark: SparkSession, sf: str) -> DataFrame:
    tmpl = F.array(*[F.struct(F.lit(r).alias("ring"), F.lit(q).alias("seq"), F.lit(ox).alias("ox"),
                              F.lit(oy).alias("oy")) for r, q, ox, oy in NATION_TEMPLATE])
    k = F.col("n_nationkey")
    return (read_table(spark, sf, "nation").select(k, F.inline(tmpl))
            .where((F.col("ring") == 0) | (k % 5 == 2))
            .select(k.cast("bigint").alias("id"), "ring", "seq",
                    ((k % 5) * NATION_GRID + F.col("ox") + F.when(k == FAR_NATION, FAR_SHIFT).otherwise(0))
                    .cast("double").alias("x"),
                    (((k - k % 5) / 5) * NATION_GRID + F.col("oy")).cast("double").alias("y")))


@memo
def poly_nation(spark: SparkSession, sf: str, non_polygon_id: bool = True) -> DataFrame:
    """25 polygons (id, name, region, geometry, bbox), one projection of the
    nation table (the template is a literal, so no shuffle).  Polygon 3 is
    tagged as a non-polygon (gtype POINT) for the type-filter tests."""
    k = F.col("n_nationkey")
    dx = (k % 5) * NATION_GRID + F.when(k == FAR_NATION, FAR_SHIFT).otherwise(0)
    dy = ((k - k % 5) / 5) * NATION_GRID

    def ring(r):
        pts = sorted((q, ox, oy) for rr, q, ox, oy in NATION_TEMPLATE if rr == r)
        return F.array(*[G.xy((dx + ox).cast("double"), (dy + oy).cast("double")) for _, ox, oy in pts])
    rings = F.when(k % 5 == 2, F.array(ring(0), ring(1))).otherwise(F.array(ring(0)))
    g = G.polygon(rings)
    if non_polygon_id:
        g = F.when(k == NON_POLYGON_NATION, g.withField("gtype", F.lit("POINT"))).otherwise(g)
    return (read_table(spark, sf, "nation")
            .select(k.cast("bigint").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"),
                    g.alias("geometry"))
            .withColumn("bbox", G.bbox("geometry")))


@memo
def line_orders(spark: SparkSession, sf: str) -> DataFrame:
    """3-vertex streets; ``highway`` = o_orderpriority."""
    k = F.col("o_orderkey")
    x0 = ((k * CUST_MUL[0]) % P_MOD_X).cast("double")
    y0 = ((k * CUST_MUL[1]) % P_MOD_Y).cast("double")
    x1 = x0 + (k % 7 * 40 + 20)
    y1 = y0 + (k % 5 * 30 - 60)
    x2 = x1 + (k % 3 * 50 - 50)
    y2 = y1 + (40 + k % 11 * 10)
    coords = F.array(G.xy(x0, y0), G.xy(x1, y1), G.xy(x2, y2))
    return (read_table(spark, sf, "orders", bytes_each=GEOMETRY_BYTES)
            .select(k.alias("id"), F.col("o_orderpriority").alias("highway"), F.col("o_custkey").alias("cust"),
                    G.linestring(coords).alias("geometry"))
            .withColumn("bbox", G.bbox("geometry")))


@memo
def osm_way_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered node refs: way = order, node = part (window on l_orderkey)."""
    from pyspark.sql import Window
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return (read_table(spark, sf, "lineitem")
            .select(F.col("l_orderkey").alias("way_id"), F.col("l_partkey").alias("node_id"),
                    (F.row_number().over(w) - 1).cast("bigint").alias("pos"),
                    "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
            .select("way_id", "node_id", "pos"))


@memo
def osm_members(spark: SparkSession, sf: str) -> DataFrame:
    """Relation = customer (building relation when o_custkey % 3 = 0),
    member = its orders, role from o_orderstatus."""
    return (read_table(spark, sf, "orders")
            .select(F.col("o_custkey").alias("rel_id"), F.col("o_orderkey").alias("way_id"),
                    F.when(F.col("o_orderstatus") == "F", "outer").otherwise("inner").alias("role")))


@memo
def raster_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """One-band class raster: 100 columns, value 0..49, 0 = nodata."""
    k = F.col("o_orderkey")
    return read_table(spark, sf, "orders").select(
        ((k - k % RASTER_COLS) / RASTER_COLS).cast("bigint").alias("row"),
        (k % RASTER_COLS).cast("bigint").alias("col"),
        ((k * 31) % 50).cast("double").alias("value"))


@memo
def lonlat_customer(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    return read_table(spark, sf, "customer").select(
        c.alias("id"),
        (F.lit(6.0) + ((c * CUST_MUL[0]) % 10007).cast("double") * 6.0 / 10007.0).alias("lon"),
        (F.lit(44.0) + ((c * CUST_MUL[1]) % 10009).cast("double") * 2.0 / 10009.0).alias("lat"))


def wkb_in_degrees(df: DataFrame) -> DataFrame:
    """A planar layer as a source would give it: WKB in degrees (9 E, 45 N and
    up to 1.3 degrees on) in place of ``geometry``."""
    from geoq.functions.wkb import with_wkb
    lonlat = df.withColumn("geometry", G.map_coords(F.col("geometry"), lambda x, y: F.lit(9.0) + x / 80000.0,
                                                    lambda x, y: F.lit(45.0) + y / 110000.0))
    return with_wkb(lonlat, "geometry", "wkb", pinned=True).drop("geometry", "bbox")


# ---------------------------------------------------------------- OSM elements

@memo
def osm_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """node(id, x, y, tags): parts placed by the part coordinate hash."""
    x, y = _hashed_xy("p_partkey", PART_MUL)
    return read_table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), x.alias("x"), y.alias("y"),
        F.create_map(F.lit("brand"), F.col("p_brand")).alias("tags"))


@memo
def osm_ways(spark: SparkSession, sf: str) -> DataFrame:
    """way(id, nd, tags): an order with its parts as ordered node refs
    (order of l_linenumber, l_partkey, l_suppkey, l_extendedprice);
    ``building=yes`` on urgent orders, two metadata tags on every way."""
    # dealt out before they are gathered, so that a task has the lists of few ways
    li = read_table(spark, sf, "lineitem").repartition("l_orderkey")
    nd = (li.groupBy(F.col("l_orderkey").alias("id"))
          .agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")))
               .alias("refs"))
          .select("id", F.transform("refs", lambda r: r.l_partkey).alias("nd")))
    o = read_table(spark, sf, "orders")
    base = F.create_map(F.lit("highway"), F.col("o_orderpriority"), F.lit("status"), F.col("o_orderstatus"),
                        F.lit("source"), F.lit("tpch"), F.lit("created_by"), F.lit("gen"))
    bld = F.when(F.col("o_orderpriority") == "1-URGENT", F.create_map(F.lit("building"), F.lit("yes"))) \
        .otherwise(F.create_map().cast("map<string,string>"))
    ways = o.select(F.col("o_orderkey").alias("id"), F.map_concat(base, bld).alias("tags"))
    return ways.join(nd, "id", "left").select(
        "id", F.coalesce("nd", F.array().cast("array<bigint>")).alias("nd"), "tags")


@memo
def osm_relations(spark: SparkSession, sf: str) -> DataFrame:
    """relation(id, members, tags): a customer with its orders as way
    members (role outer when o_orderstatus = 'F'), ``type=multipolygon``,
    ``building=yes`` for the BUILDING segment."""
    o = read_table(spark, sf, "orders")
    mem = (o.groupBy(F.col("o_custkey").alias("id"))
           .agg(F.array_sort(F.collect_list(F.struct(
               F.col("o_orderkey").alias("ref"), F.lit("w").alias("type"),
               F.when(F.col("o_orderstatus") == "F", "outer").otherwise("inner").alias("role")))).alias("members")))
    c = read_table(spark, sf, "customer")
    tags = F.map_concat(F.create_map(F.lit("type"), F.lit("multipolygon")),
                        F.when(F.col("c_mktsegment") == "BUILDING", F.create_map(F.lit("building"), F.lit("yes")))
                        .otherwise(F.create_map().cast("map<string,string>")))
    return c.select(F.col("c_custkey").alias("id"), tags.alias("tags")).join(mem, "id")


@memo
def raster_meta(spark: SparkSession, sf: str, tile: int = 32):
    """Header of the class raster (height follows the orders table)."""
    from geoq.operators.raster import RasterMeta
    n = read_table(spark, sf, "orders").agg(F.max("o_orderkey")).first()[0]
    return RasterMeta(width=RASTER_COLS, height=int(n) // RASTER_COLS + 1, ulx=0.0, uly=RASTER_TOP,
                      px=PIXEL, py=-PIXEL, nodata=0.0, tile=tile)


@memo
def raster_band(spark: SparkSession, sf: str) -> DataFrame:
    return raster_pixels(spark, sf).select(F.lit(1).alias("band"), "row", "col", "value")


@memo
def raster_tiles(spark: SparkSession, sf: str, tile: int = 32):
    from geoq.operators.raster import to_tiles
    meta = raster_meta(spark, sf, tile)
    return to_tiles(raster_band(spark, sf), meta), meta


# ---------------------------------------------------------------- street graph

#: Every so many streets is in the thin graph.
STREET_EVERY = 20


@memo
def street_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Street graph on customers, every order a street: an edge from an
    order's customer to one that a hash names among all customers, with an
    integer length."""
    n = read_table(spark, sf, "customer").agg(F.count(F.lit(1)).alias("n_customers"))
    o = read_table(spark, sf, "orders").crossJoin(F.broadcast(n))  # one row
    u = F.col("o_custkey")
    return o.select(F.col("o_orderkey").alias("edge_id"), u.alias("u"),
                    ((u * 7 + F.col("o_orderkey") % 3) % F.col("n_customers")).alias("v"),
                    (1 + (F.col("o_orderkey") * 17) % 97).alias("length"))


@memo
def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The thin street graph of components and paths: some of the streets."""
    return street_edges(spark, sf).where(F.col("edge_id") % STREET_EVERY == 0)


def graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return pts_customer(spark, sf).select("id", "x", "y", "kind")


# ---------------------------------------------------------------- footprints

@memo
def footprints(spark: SparkSession, sf: str) -> DataFrame:
    """Axis-aligned rectangular footprints, one per order (buildings);
    ``kind`` = order priority, parks are the 3-MEDIUM ones."""
    k = F.col("o_orderkey")
    x0 = ((k * CUST_MUL[0]) % P_MOD_X).cast("double")
    y0 = ((k * CUST_MUL[1]) % P_MOD_Y).cast("double")
    w = (20 + (k * 13) % 180).cast("double")
    h = (20 + (k * 29) % 140).cast("double")
    return (read_table(spark, sf, "orders", bytes_each=GEOMETRY_BYTES)
            .select(k.alias("id"), F.col("o_orderpriority").alias("kind"), G.box(x0, y0, x0 + w, y0 + h).alias("geometry")))


@memo
def parks(spark: SparkSession, sf: str) -> DataFrame:
    return footprints(spark, sf).where(F.col("kind") == "3-MEDIUM")
