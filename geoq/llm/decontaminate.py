"""Benchmark decontamination: containment search with MinHash sketches.

A test item of ``n`` shingles counts as contained in a document that holds at
least ``ceil(threshold * n)`` of them, so at most ``n - ceil(threshold * n)``
may be missing.  Items are partitioned by size; the partition fixes how many
of an item's smallest hashes its sketch keeps (the most that may be missing,
plus the hits asked for).  A document that contains the item must then hold
that many of the sketch, however long it is: the search loses nothing, and
long documents need no sketch of their own.  Candidates are verified by
counting equal shingles, as words.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoq.llm.common import KeyFilter, batch_of, byte_texts, id_and_text, materialise
from geoq.llm.shingles import shingle_hashes, words_of

SHINGLE, THRESHOLD = 5, 0.75
#: Size partitions: (least number of shingles, sketch hits asked for).
SIZE_CLASSES = [(1, 1), (8, 2), (32, 4), (128, 8)]


def item_shingles(items: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD, id_col: str = "item_id",
                  text_col: str = "text") -> DataFrame:
    """One row per distinct shingle of an item: ``item_id, length`` (words in
    the shingle: ``k``, or all of a shorter item), ``hash, shingle, n_shingles,
    in_sketch, needed``."""
    schema = pa.schema([("item_id", pa.int64()), ("length", pa.int32()), ("hash", pa.int64()), ("shingle", pa.binary()),
                        ("n_shingles", pa.int64()), ("in_sketch", pa.bool_()), ("needed", pa.int32())])

    def cut(batches):
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), byte_texts(b.column(1))):
                words = words_of(text)
                length = min(k, len(words))
                if not length:
                    continue
                distinct = {b" ".join(words[i:i + length]): h
                            for i, h in enumerate(shingle_hashes(words, length).view(np.int64).tolist())}
                n = len(distinct)
                hits = next(h for least, h in reversed(SIZE_CLASSES) if n >= least)
                may_miss = n - math.ceil(threshold * n)
                rows = sorted(distinct.items(), key=lambda x: (x[1], x[0]))  # smallest hashes first
                kept = min(n, may_miss + hits)
                yield batch_of(schema, [item] * n, [length] * n, [h for _, h in rows], [s for s, _ in rows], [n] * n,
                               [i < kept for i in range(n)], [kept - may_miss] * n)

    return id_and_text(items, id_col, text_col).withColumnRenamed("doc_id", "item_id").mapInArrow(
        cut, "item_id bigint, length int, hash bigint, shingle binary, n_shingles bigint, in_sketch boolean, needed int")


def contained_items(docs: DataFrame, items: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD,
                    id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
                    item_text_col: str = "text") -> DataFrame:
    """``doc_id, row_key, item_id, n_shingles, shared, containment``: every
    item of which a document holds ``threshold`` or more of the shingles.

    ``row_key`` is ``xxhash64(id, text)``; rows equal in both are one document.
    Null and empty texts hold nothing, and null or empty items are held by
    nothing; an item of fewer than ``k`` words is one shingle of that many
    words; repeated items are reported under each id (rows that share an item
    id and a text are one); an empty table gives no rows; other columns are
    ignored.  Documents are mapped once; only shingles that pass the filter
    are shuffled."""
    shingles = materialise(item_shingles(items, k, threshold, item_id_col, item_text_col).dropDuplicates(), "item-shingles")
    lengths = sorted(r["length"] for r in shingles.select("length").distinct().collect())  # at most k numbers
    wanted = KeyFilter(shingles, "hash")
    schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("hash", pa.int64()), ("shingle", pa.binary())])

    def find(batches):
        for b in batches:
            for doc, text, key in zip(b.column(0).to_pylist(), byte_texts(b.column(1)), b.column(2).to_pylist()):
                words = words_of(text)
                for length in lengths:
                    h = shingle_hashes(words, length)
                    hit = np.flatnonzero(wanted.passes(h))
                    if len(hit):
                        found = {b" ".join(words[i:i + length]): v
                                 for i, v in zip(hit.tolist(), h[hit].view(np.int64).tolist())}
                        n = len(found)
                        yield batch_of(schema, [doc] * n, [key] * n, list(found.values()), list(found))

    rows = id_and_text(docs, id_col, text_col).withColumn("row_key", F.xxhash64("doc_id", "text"))
    hits = materialise(rows.mapInArrow(find, "doc_id bigint, row_key bigint, hash bigint, shingle binary")
                       .dropDuplicates(["row_key", "shingle"]), "benchmark-hits")
    # the search: enough of an item's sketch
    sketch = shingles.where("in_sketch").select("item_id", "hash", "needed")
    candidates = (hits.select("row_key", "hash").distinct().join(sketch, "hash").groupBy("row_key", "item_id", "needed")
                  .agg(F.countDistinct("hash").alias("found")).where(F.col("found") >= F.col("needed"))
                  .select("row_key", "item_id"))
    # the check: equal shingles, counted
    shared = (candidates.join(shingles.select("item_id", "shingle", "n_shingles"), "item_id")
              .join(hits.select("doc_id", "row_key", "shingle"), ["row_key", "shingle"])
              .groupBy("doc_id", "row_key", "item_id", "n_shingles").agg(F.countDistinct("shingle").alias("shared")))
    return (shared.withColumn("containment", F.col("shared") / F.col("n_shingles"))
            .where(F.col("containment") >= threshold))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that contain no item, with all their columns."""
    found = contained_items(docs, items, id_col=id_col, text_col=text_col, **options).select("row_key").distinct()
    key = F.xxhash64(F.col(id_col).cast("bigint"), F.coalesce(F.col(text_col), F.lit("")))
    return docs.join(found, key == found["row_key"], "left_anti")
