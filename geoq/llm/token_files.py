"""Token-id output: ORC files with row indexes and Bloom filters on ids."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoq.llm.common import batch_of, byte_texts, id_and_text
from geoq.llm.encoders import ByteLevelEncoder, encoder, slices

END_ID = 2


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID,
                      id_col: str = "doc_id", text_col: str = "text", stripe_bytes: int = 64 << 20,
                      index_rows: int = 1000) -> None:
    """Writes the ids of all documents as ORC, in ascending ``doc_id`` order.

    Every file holds one range of ids, so file, stripe and row-index
    statistics prune on ``doc_id``; a Bloom filter on ``doc_id`` serves point
    lookups; ids are integers, which ORC run-length encodes; stripes are read
    in parallel.  Columns: ``part`` (the file's number in id order), ``doc_id``,
    ``part_start`` (ids before the document in its file), ``n_tokens``, ``ids``.

    The texts are range-partitioned and sorted before they are encoded, so the
    larger id arrays are never shuffled.  Null ids come first; rows of one id
    lie side by side, in the order of their texts' hashes, and may span files;
    a null or empty text holds the end id alone; other columns are dropped."""
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("part_start", pa.int64()),
                        ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def encode(batches):
        enc, part, start = encoder(ByteLevelEncoder, vocabulary), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts = byte_texts(batch.column(1))
            for at, to in slices(texts):
                coded = [x + end for x in enc.encode(texts[at:to])]
                n = np.array([len(x) // 4 for x in coded], np.int64)
                edges = np.concatenate([[0], np.cumsum(n)])
                ids = pa.ListArray.from_arrays(pa.array(edges, pa.int32()),
                                               pa.array(np.frombuffer(b"".join(coded), "<i4"), pa.int32()))
                yield batch_of(schema, np.full(len(n), part, np.int32), batch.column(0).slice(at, len(n)),
                               start + edges[:-1], n, ids)
                start += int(edges[-1])

    ordered = (id_and_text(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
               .repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text"))
    (ordered.mapInArrow(encode, "part int, doc_id bigint, part_start bigint, n_tokens bigint, ids array<int>")
     .write.option("orc.bloom.filter.columns", "doc_id").option("orc.stripe.size", str(stripe_bytes))
     .option("orc.row.index.stride", str(index_rows)).option("compression", "zstd").orc(path))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows: ``part, doc_id, part_start, n_tokens, ids``."""
    return spark.read.schema("part int, doc_id bigint, part_start bigint, n_tokens bigint, ids array<int>").orc(path)


def id_checksums(tokens: DataFrame) -> DataFrame:
    """The rows of ``read_token_files`` with ``ids_crc32`` in place of the ids."""
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("part_start", pa.int64()),
                        ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def sums(batches):
        for b in batches:
            ids = b.column(4)
            flat, edges = ids.values.to_numpy().view("<u4"), ids.offsets.to_numpy().tolist()
            yield batch_of(schema, *b.columns[:4], [zlib.crc32(flat[i:j].data) for i, j in zip(edges, edges[1:])])

    return tokens.select("part", "doc_id", "part_start", "n_tokens", "ids").mapInArrow(
        sums, "part int, doc_id bigint, part_start bigint, n_tokens bigint, ids_crc32 bigint")


def with_starts(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """Replaces ``part`` and ``part_start`` by ``start``, the ids of all
    documents before, from one number per file of ``tokens``."""
    sizes = tokens.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    return (rows.join(before, "part").withColumn("start", F.col("before") + F.col("part_start"))
            .drop("part", "part_start", "before"))
