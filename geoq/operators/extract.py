"""Batch extraction (A21): features of every (city, feature type), each task's
output in a partition of its own, tasks that are already there left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoq.operators.osm import tags_match
from geoq.operators.spatial_join import candidate_pairs
from geoq.session import stored

_KEYS = ["city", "feature_type"]
#: Beside the partitions: the tasks that found nothing and so have none.
_EMPTY = "_empty_tasks"


def _present(spark: SparkSession, path: str) -> DataFrame:
    """(city, feature_type) of the partitions that lie at ``path`` now, and of
    the tasks known to be empty.  One listing; as many entries as tasks."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(base, "city=*/feature_type=*")) if fs.exists(base) else []
    unescape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    rows = []
    for st in found or []:
        p = st.getPath()
        rows.append(tuple(unescape(x.getName().split("=", 1)[1]) for x in (p.getParent(), p)))
    there = spark.createDataFrame(rows, "city string, feature_type string")
    if fs.exists(jvm.org.apache.hadoop.fs.Path(base, _EMPTY)):
        there = there.unionByName(spark.read.schema("city string, feature_type string").parquet(f"{path}/{_EMPTY}"))
    return there.distinct()


def extracted(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What lies at ``path``: the features' columns, city and feature_type."""
    fields = [*schema.fields, T.StructField("city", T.StringType()), T.StructField("feature_type", T.StringType())]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def extract_many(features: DataFrame, cities: DataFrame, tasks, path: str, *, xy=("x", "y"), tags: str = "tags",
                 geom: str = "geometry") -> DataFrame:
    """Writes the features of every city (``city``, ``geom``) that pass a
    task's tag filter (name, filter or None) to ``path/city=../feature_type=..``
    and returns the tasks done now: (city, feature_type, n_features).

    Tasks whose partition is there are skipped by an anti join before anything
    is matched, so a second run writes nothing and a removed partition comes
    back alone.  A run that dies has committed nothing or whole partitions,
    and partitions are replaced, never added to.  All tasks are one job: each
    feature is matched with the cities once; the rows are rebalanced by task,
    so a large city becomes several files, not one slow task."""
    spark = features.sparkSession
    names = F.array(*[F.lit(name) for name, _ in tasks])
    todo = stored(cities.select("city", F.explode(names).alias("feature_type")).distinct()
                  .join(_present(spark, path), _KEYS, "left_anti"), n=F.count(F.lit(1)))
    none = todo.limit(0).select(*_KEYS, F.lit(0).cast("bigint").alias("n_features"))
    if not todo.measured["n"]:
        return none
    open_cities = cities.join(todo.select("city").distinct(), "city", "left_semi")
    matching = F.array(*[F.when(tags_match(tags, spec) if spec else F.lit(True), F.lit(name)) for name, spec in tasks])
    typed = features.withColumn("feature_type", F.explode(F.array_compact(matching)))
    pairs = candidate_pairs(typed, open_cities, "within", left_geom=xy, left_cols=typed.columns, right_cols=["city"], right_geom=geom)
    rows = pairs.select("l.*", "r.city").join(todo, _KEYS, "left_semi").hint("rebalance", *_KEYS)
    rows.select(*features.columns, *_KEYS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy(*_KEYS).parquet(path)
    counts = extracted(spark, path, features.schema).groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n_features"))
    done = stored(todo.join(counts, _KEYS, "left").select(*_KEYS, F.coalesce("n_features", F.lit(0)).alias("n_features")))
    done.where("n_features = 0").select(*_KEYS).coalesce(1).write.mode("append").parquet(f"{path}/{_EMPTY}")
    return done
