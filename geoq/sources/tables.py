"""Parquet tables (A1) and small helpers around the catalog."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str, min_partitions: int | None = None,
               bytes_each: int | None = None) -> DataFrame:
    """Scan ``<sf_dir>/<name>.parquet``; column pruning and filters reach
    the Parquet reader through Catalyst (both pass through the round-robin
    repartition below).

    A file with a single row group is one input split, so everything up to
    the first shuffle would run in one task.  When the scan yields fewer
    splits than the cluster's parallelism the rows are spread round-robin;
    a large input (many splits) is left untouched.  ``bytes_each``: a
    partition for every so many bytes of files, for tables whose rows become
    geometry, as that takes far more time than reading them."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    target = min_partitions or spark.sparkContext.defaultParallelism
    if bytes_each:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.join(sf_dir, f"{name}.parquet"))
        size = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
        target = max(target, size // bytes_each)
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df


def register_tables(spark: SparkSession, sf_dir: str, names) -> None:
    """Expose tables as temp views for SQL users."""
    for n in names:
        read_table(spark, sf_dir, n).createOrReplaceTempView(n)


def resolve_column(df: DataFrame, candidates) -> str | None:
    """First column of a priority list present in ``df``."""
    cols = {c.lower(): c for c in df.columns}
    for c in candidates:
        if c.lower() in cols:
            return cols[c.lower()]
    return None


def table_exists(spark: SparkSession, name: str) -> bool:
    """Whether a table or view of that name is known."""
    return spark.catalog.tableExists(name)


def list_columns(spark: SparkSession, name: str) -> list[str]:
    """Column names of a table or view, in order."""
    return [c.name for c in spark.catalog.listColumns(name)]


def boundary(spark: SparkSession, boundaries: DataFrame, name: str, name_col: str = "name") -> DataFrame:
    """The boundaries of a place, by its name whatever the case; a name
    with parts (``Milan, Italy``) is looked up by the first."""
    wanted = name.split(",")[0].strip().lower()
    return boundaries.where(F.lower(F.trim(F.split(F.col(name_col), ",")[0])) == wanted)


def read_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A3: CSV with a header; an explicit schema avoids the extra
    inference pass (``inferSchema`` reads the data twice)."""
    r = spark.read.option("header", True)
    return r.schema(schema).csv(path) if schema is not None else r.option("inferSchema", True).csv(path)
