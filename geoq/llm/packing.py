"""Best-fit packing (bulk-synchronous best fit).

Documents are cut into pieces of at most ``capacity`` tokens and packed into
as few sequences as best fit finds.  Sizes and gaps are whole numbers up to
``capacity``, so the range-sorted pieces and the range-sorted gaps are runs of
equal values, and one synchronous step matches a whole run: every piece of the
current length asks for its successor gap (the smallest that is large enough),
rank decides who gets which of the equal gaps, the matched gaps shrink, and the
rest of the run asks again; what finds no gap opens sequences.  The steps work
on the runs (a count per length: at most ``capacity`` numbers, however many
documents there are); every piece then finds its sequence and offset from its
length and its rank among the pieces of that length, which Spark computes
without a global sort: rank within its partition plus the counts of the
partitions before.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoq.llm.common import batch_of, byte_texts, id_and_text, materialise
from geoq.llm.encoders import WordEncoder, encoder, slices

CAPACITY = 2048
END_ID = 0

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, local_rank bigint"
_PACKED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece, with its partition and its rank among the pieces of
    its length in that partition.  Written to the shared folder, so that ranks
    never change when a task is repeated."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64()), ("part", pa.int32()), ("local_rank", pa.int64())])

    def cut(batches):
        enc, part = encoder(WordEncoder, vocabulary), TaskContext.get().partitionId()
        ranks = [0] * (capacity + 1)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), byte_texts(batch.column(1))
            rows: list[list] = [[] for _ in range(7)]
            for at, to in slices(texts):
                for doc, data in zip(ids[at:to], enc.encode(texts[at:to])):
                    data += end
                    for k, i in enumerate(range(0, len(data), 4 * capacity)):
                        piece = data[i:i + 4 * capacity]
                        n = len(piece) // 4
                        for column, value in zip(rows, (doc, k, i // 4, n, zlib.crc32(piece), part, ranks[n])):
                            column.append(value)
                        ranks[n] += 1
            yield batch_of(schema, *rows)

    return materialise(id_and_text(docs, id_col, text_col).mapInArrow(cut, _PIECES), "pieces")


def plan_best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """``(length, first rank, first sequence, offset)`` runs from the number of
    pieces of each length.  Ranks of a run go to consecutive sequences.  A
    superstep takes one run of equal gaps, so there are as many runs as there
    are (length, gap) matches: a number that depends on ``capacity``, not on
    the number of documents."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> [(first sequence, how many)]
    order: list[int] = []                        # the gaps in use, ascending
    plan, opened = [], 0

    def put(gap: int, first: int, many: int) -> None:
        if gap == 0:
            return
        if gap not in gaps:
            gaps[gap] = []
            bisect.insort(order, gap)
        runs = gaps[gap]
        if runs and runs[-1][0] + runs[-1][1] == first:
            runs[-1] = (runs[-1][0], runs[-1][1] + many)
        else:
            runs.append((first, many))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(order, length)  # the successor among the gaps
            if at == len(order):
                # no gap is large enough: open as few sequences as hold the rest
                many = -(-left // (capacity // length))
                put(capacity, opened, many)
                opened += many
                continue
            gap = order[at]
            first, many = gaps[gap].pop(0)
            take = min(many, left)
            if take < many:
                gaps[gap].insert(0, (first + take, many - take))
            if not gaps[gap]:
                del gaps[gap]
                order.remove(gap)
            plan.append((length, rank, first, capacity - gap))
            put(gap - length, first, take)
            rank, left = rank + take, left - take
    return plan


def best_fit(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Sequence and offset of each of ``token_pieces``'s rows."""
    counts = materialise(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    totals = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_best_fit(totals, capacity)
    # keys of the plan in ascending (length, rank): a rank fits 40 bits
    plan.sort(key=lambda p: (p[0], p[1]))
    keys = np.array([p[0] << 40 | p[1] for p in plan], np.int64)
    firsts = np.array([p[2] for p in plan], np.int64)
    offsets = np.array([p[3] for p in plan], np.int64)
    before = counts.select("part", "length", (F.sum("n").over(
        Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = pieces.join(before, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local_rank")).alias("rank"))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches):
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = np.searchsorted(keys, length << 40 | rank, "right") - 1
            yield batch_of(schema, *b.columns[:5], firsts[at] + rank - (keys[at] & ((1 << 40) - 1)), offsets[at])

    return ranked.mapInArrow(place, _PACKED)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` tokens.

    One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id,
    offset``.  A null or empty text is one piece with the end id alone; a
    document longer than ``capacity`` is cut into full pieces and a rest; ties
    in length go by rank, repeated rows are packed each; an empty table gives
    no rows; other columns are ignored."""
    return best_fit(token_pieces(docs, vocabulary, capacity, end_id, id_col, text_col), capacity)
