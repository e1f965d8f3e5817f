"""Shared helpers of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoq.session import checkpoint_dir

#: ASCII white space that separates words: space and \x09-\x0D.  ``bytes.split()``
#: splits on exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/geoq-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage
    and survives the loss of executors, as ``checkpoint()`` does, but columnar
    and compressed, unless ``options`` of the writer say otherwise."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id bigint, text string)`` of any input; a null text is empty."""
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"),
                     F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def id_remainder(column, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t)
                                       for c, t in zip(columns, schema.types)], schema=schema)


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


#: Bits of a filter over 64-bit keys: a fixed size, however many keys there are.
FILTER_BITS = 26


class KeyFilter:
    """A bit set over the top bits of 64-bit hashes.  It passes every key of
    ``keys`` and few others, so that rows which surely have no partner need
    not be shuffled; exact joins follow.  At most ``2**FILTER_BITS / 64`` rows
    come to the driver to build it."""

    def __init__(self, keys: DataFrame, column: str):
        slot = f"shiftrightunsigned(`{column}`, {64 - FILTER_BITS})"
        words = (keys.select(F.expr(f"shiftright({slot}, 6)").alias("w"), F.expr(f"shiftleft(1L, cast({slot} & 63 as int))").alias("b"))
                 .groupBy("w").agg(F.bit_or("b").alias("b")).where("w is not null").toArrow())
        self.bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
        self.bits[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)

    def passes(self, keys: np.ndarray) -> np.ndarray:
        slot = keys.view(np.uint64) >> np.uint64(64 - FILTER_BITS)
        return ((self.bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)
