"""Raster tile tables on Parquet."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from geoq.operators.raster import RasterMeta
from geoq.sources import store


def write_tiles(tiles: DataFrame, meta: RasterMeta, path: str, mode: str = "overwrite") -> None:
    """Tile table + header (``_raster.json``: size, transform, nodata)."""
    tiles.write.mode(mode).partitionBy("band").parquet(path)
    store.write_text(tiles.sparkSession, f"{path}/_raster.json", json.dumps(asdict(meta)))


def read_tiles(spark: SparkSession, path: str):
    """(tiles DataFrame, RasterMeta)."""
    header = store.read_text(spark, f"{path}/_raster.json")
    if header is None:
        raise FileNotFoundError(f"{path}/_raster.json")
    meta = RasterMeta(**json.loads(header))
    return spark.read.parquet(path), meta
