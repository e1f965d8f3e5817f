"""OSM XML element tables (A7) with Spark's XML reader and explicit
schemas (schema inference turns a single ``<tag>`` into a struct instead of
an array)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TAG = T.ArrayType(T.StructType([T.StructField("_k", T.StringType()), T.StructField("_v", T.StringType())]))
NODE = T.StructType([T.StructField("_id", T.LongType()), T.StructField("_lon", T.DoubleType()),
                     T.StructField("_lat", T.DoubleType()), T.StructField("tag", _TAG)])
WAY = T.StructType([T.StructField("_id", T.LongType()),
                    T.StructField("nd", T.ArrayType(T.StructType([T.StructField("_ref", T.LongType())]))),
                    T.StructField("tag", _TAG)])
REL = T.StructType([T.StructField("_id", T.LongType()),
                    T.StructField("member", T.ArrayType(T.StructType([
                        T.StructField("_type", T.StringType()), T.StructField("_ref", T.LongType()),
                        T.StructField("_role", T.StringType())]))),
                    T.StructField("tag", _TAG)])


def _tags(c="tag"):
    return F.coalesce(F.map_from_entries(F.transform(F.col(c), lambda t: F.struct(t._k, t._v))),
                      F.create_map().cast("map<string,string>"))


def read_osm_xml(spark: SparkSession, path: str):
    """-> (nodes(id, x=lon, y=lat, tags), ways(id, nd, tags),
    relations(id, members(ref, type, role), tags)); member type is
    abbreviated to n / w / r."""
    rd = spark.read.format("xml")
    nodes = rd.option("rowTag", "node").schema(NODE).load(path).select(
        F.col("_id").alias("id"), F.col("_lon").alias("x"), F.col("_lat").alias("y"), _tags().alias("tags"))
    ways = rd.option("rowTag", "way").schema(WAY).load(path).select(
        F.col("_id").alias("id"), F.transform(F.coalesce("nd", F.array()), lambda n: n._ref).alias("nd"),
        _tags().alias("tags"))
    rels = rd.option("rowTag", "relation").schema(REL).load(path).select(
        F.col("_id").alias("id"), F.transform(F.coalesce("member", F.array()), lambda m: F.struct(
            m._ref.alias("ref"), F.substring(m._type, 1, 1).alias("type"), m._role.alias("role"))).alias("members"),
        _tags().alias("tags"))
    return nodes, ways, rels
