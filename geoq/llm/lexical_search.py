"""Ranked lexical search over a K2-treap of the term-document grid.

The index is a table of blocks.  A block holds a range of documents, its terms
in order, and a grid of impacts (one row a term, one column a document) as a
compressed quadtree: a cell is cut into halves of its terms and of its
documents, only non-empty cells are kept as four bits a cell in level order,
and each cell's greatest impact as the difference to its parent's.  As rows
are far more than columns, the upper levels halve terms only.  The last cells
are one term by ``LEAF`` documents and list their impacts.  Blocks are built by
the tasks that read the documents; no text or posting is shuffled.  Parts of a
block are stored compressed, one block a row group, and opened one block at a
time: neither Spark nor a task holds more of the index than a batch of packed
blocks, however many a task gets.

A search walks down the paths of all of an item's rows together, best first
over ranges of documents: a range's bound is the weighted sum of its cells'
maxima, and it is left alone when it cannot reach the item's k-th best
document any more.  Scores are whole numbers, so the result is exact.

Score of a document: the sum over the item's terms, with repeats, of the
term's weight times ``(SCALE * tf) div (1000 * tf + 12 * m)``; see
``term_weight`` and ``length_norm``.  Equal scores go by the smaller doc_id.

Nulls: a null text has no terms; a null doc_id takes no part in ties but by
its place last.  Texts may have any length.  Repeated rows are documents of
their own.  An empty table, an item without known terms and documents of score
0 give no rows.  Other columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import math
from array import array
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoq.llm.common import byte_texts, materialise

#: Documents and postings a block holds at most; documents of a last cell (at most 256).
BLOCK_DOCS, BLOCK_POSTINGS, LEAF = 2048, 1 << 19, 64
#: Fixed values of the score: scale, tf factor, length factor, share of the length in percent.
SCALE, TF_FACTOR, LENGTH_FACTOR, LENGTH_SHARE = 1_000_000_000, 1000, 12, 25
#: Texts of a batch that are bytes at once.
TEXTS_AT_ONCE = 64
#: Items searched for at once, and their terms together.
ITEMS_AT_ONCE, TERMS_AT_ONCE = 4096, 1_000_000

# bytes of terms: letters (A-Z lower-cased), digits and everything outside ASCII
_TERM_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
_COUNT = np.array([bin(x).count("1") for x in range(16)], np.uint8)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


def length_norm(n: int, docs: int, total: int) -> int:
    return 100 - LENGTH_SHARE + (LENGTH_SHARE * n * docs) // total


def impact(tf, norm):
    """Of one document and term, or of arrays of them."""
    return SCALE * tf // (TF_FACTOR * tf + LENGTH_FACTOR * norm)


def term_weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")


def _few_texts(column: pa.Array):
    """The bytes of a column's texts, a few at a time."""
    for at in range(0, len(column), TEXTS_AT_ONCE):
        yield from byte_texts(column.slice(at, TEXTS_AT_ONCE))


def collection_size(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Documents with at least one term, and all their terms with repeats."""
    def counted(batches):
        for batch in batches:
            sizes = [len(terms_of(t)) for t in _few_texts(batch.column(0))]
            yield pa.RecordBatch.from_pydict({"docs": pa.array([sum(n > 0 for n in sizes)], pa.int64()), "terms": pa.array([sum(sizes)], pa.int64())})
    row = docs.select(F.col(text_col).alias("text")).where("text is not null") \
        .mapInArrow(counted, "docs bigint, terms bigint").agg(F.sum("docs"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


def _bits(n: int) -> int:
    return max(n - 1, 0).bit_length()


def _plan(n_terms: int, n_docs: int) -> list[tuple[int, int]]:
    """(term bits, document bits) that each level takes, from the top."""
    rows, cols = _bits(n_terms), _bits(-(-n_docs // LEAF))
    both = min(rows, cols)
    return [(1, 0)] * (rows - both) + [(0, 1)] * (cols - both) + [(1, 1)] * both


def build_block(rows: np.ndarray, cols: np.ndarray, impacts: np.ndarray, n_terms: int, n_docs: int) -> dict:
    """Quadtree of one block: four bits a cell and the difference of maxima,
    level by level from the top; then the last cells' sizes, places, impacts."""
    code, groups = np.zeros(len(rows), np.int64), cols // LEAF
    row_bit, col_bit = _bits(n_terms), _bits(-(-n_docs // LEAF))
    plan = _plan(n_terms, n_docs)
    for takes_row, takes_col in plan:
        code <<= 2
        if takes_row:
            row_bit -= 1
            code |= ((rows >> row_bit) & 1) << 1
        if takes_col:
            col_bit -= 1
            code |= (groups >> col_bit) & 1
    order = np.lexsort((cols, code))
    code, values = code[order], impacts[order]
    starts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(code)])))
    cells, best = code[starts], np.maximum.reduceat(values, starts)
    masks, less = [], []
    for _ in plan:
        above = cells >> 2
        first = np.flatnonzero(np.concatenate(([True], above[1:] != above[:-1])))
        top = np.maximum.reduceat(best, first)
        parent = np.cumsum(np.concatenate(([0], (above[1:] != above[:-1]).astype(np.int64))))
        masks.append(np.bitwise_or.reduceat((1 << (cells & 3)).astype(np.uint8), first))
        less.append((top[parent] - best).astype(np.uint32))
        cells, best = above[first], top
    return {"top": int(best[0]), "cells": b"".join(m.tobytes() for m in reversed(masks)), "less": b"".join(d.tobytes() for d in reversed(less)),
            "sizes": sizes.astype(np.uint16).tobytes(), "places": (cols[order] % LEAF).astype(np.uint8).tobytes(), "impacts": values.astype(np.uint32).tobytes()}


_BLOCK = "n_docs int, doc_ids binary, terms binary, dfs binary, top int, cells binary, less binary, sizes binary, places binary, impacts binary"
_BLOCK_ARROW = pa.schema([("n_docs", pa.int32()), ("doc_ids", pa.binary()), ("terms", pa.binary()), ("dfs", pa.binary()), ("top", pa.int32()),
                          ("cells", pa.binary()), ("less", pa.binary()), ("sizes", pa.binary()), ("places", pa.binary()), ("impacts", pa.binary())])
#: How the index is written: one block a row group (the writer looks at its size
#: only after a hundred rows), and packed parts as they are.
_STORED = {"compression": "uncompressed", "parquet.block.row.count.limit": "1", "parquet.enable.dictionary": "false"}
_LAST = np.iinfo(np.int64).max


def _packed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + (pa.compress(data, "zstd", asbytes=True) if data else b"")


def _unpacked(data: pa.Buffer) -> bytes:
    size = int.from_bytes(data.slice(0, 8).to_pybytes(), "little")
    return pa.decompress(data.slice(8), size, "zstd", asbytes=True) if size else b""


def _rows_of(batches):
    """The rows of an index, or of some of its columns, unpacked one by one."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: _unpacked(c[i].as_buffer()) if pa.types.is_binary(c.type) or pa.types.is_large_binary(c.type) else c[i].as_py()
                   for name, c in zip(batch.schema.names, batch.columns)}


class _Held:
    """The documents of a block to be, their terms by number."""

    def __init__(self):
        self.docs, self.lengths, self.sizes = array("q"), array("q"), array("q")
        self.numbers: dict[bytes, int] = defaultdict(itertools.count().__next__)
        self.terms, self.tfs = array("i"), array("i")  # a number for each posting

    def add(self, doc: int | None, counts: Counter, length: int) -> None:
        self.docs.append(_LAST if doc is None else doc)
        self.lengths.append(length)
        self.sizes.append(len(counts))
        self.terms.extend(map(self.numbers.__getitem__, counts))
        self.tfs.extend(counts.values())

    def block(self, n_all: int, l_all: int) -> dict:
        """Documents in order of their ids, terms in order of their bytes."""
        order = np.argsort(np.frombuffer(self.docs, np.int64), kind="stable")
        col_of = np.empty(len(order), np.int32)
        col_of[order] = np.arange(len(order), dtype=np.int32)
        terms = sorted(self.numbers)
        row_of = np.empty(len(terms), np.int32)
        row_of[list(map(self.numbers.__getitem__, terms))] = np.arange(len(terms), dtype=np.int32)
        rows = row_of[np.frombuffer(self.terms, np.int32)]
        norms = np.repeat(np.array([length_norm(n, n_all, l_all) for n in self.lengths], np.int64), self.sizes)
        impacts = impact(np.frombuffer(self.tfs, np.int32).astype(np.int64), norms).astype(np.int32)
        tree = build_block(rows, np.repeat(col_of, self.sizes), impacts, len(terms), len(order))
        return {"n_docs": len(order), "doc_ids": np.frombuffer(self.docs, np.int64)[order].tobytes(), "terms": b" ".join(terms),
                "dfs": np.bincount(rows, minlength=len(terms)).astype(np.uint32).tobytes(), **tree}


def build_index(docs: DataFrame, size: tuple[int, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index as a table with one row a block; write it once, search it
    often.  ``size`` is the documents' ``collection_size``."""
    def block(held):
        whole = {k: _packed(v) if isinstance(v, bytes) else v for k, v in held.block(*size).items()}
        return pa.RecordBatch.from_pylist([whole], schema=_BLOCK_ARROW)

    def blocks(batches):
        held = _Held()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), _few_texts(batch.column(1))):
                terms = terms_of(text)
                if not terms:
                    continue
                counts = Counter(terms)
                if held.docs and (len(held.docs) >= BLOCK_DOCS or len(held.terms) + len(counts) > BLOCK_POSTINGS):
                    full, held = block(held), _Held()
                    yield full
                held.add(doc, counts, len(terms))
        if held.docs:
            yield block(held)

    return _texts(docs, id_col, text_col).mapInArrow(blocks, _BLOCK)


class Block:
    """One block of the index, opened for searches."""

    def __init__(self, row: dict):
        self.doc_ids = np.frombuffer(row["doc_ids"], np.int64)
        self.rows = {t: i for i, t in enumerate(row["terms"].split(b" "))}
        self.plan = _plan(len(self.rows), len(self.doc_ids))
        self.row_left = np.cumsum([0] + [-r for r, _ in self.plan]) + _bits(len(self.rows)) - 1
        self.col_left = [sum(c for _, c in self.plan[level:]) for level in range(len(self.plan) + 1)]
        cells, less = np.frombuffer(row["cells"], np.uint8), np.frombuffer(row["less"], np.uint32)
        self.levels, best, c, d = [], np.array([row["top"]], np.int64), 0, 0
        for _ in self.plan:
            mask = cells[c:c + len(best)]
            counts = _COUNT[mask].astype(np.int64)
            first = np.cumsum(counts) - counts
            below = np.repeat(best, counts)
            c, best = c + len(mask), below - less[d:d + len(below)]
            d += len(below)
            self.levels.append((mask, first, best))  # best: of the level below
        self.top = row["top"]
        self.places = np.frombuffer(row["places"], np.uint8).astype(np.int64)
        self.impacts = np.frombuffer(row["impacts"], np.uint32).astype(np.int64)
        self.ends = np.cumsum(np.frombuffer(row["sizes"], np.uint16).astype(np.int64))

    def _below(self, level: int, cells: np.ndarray, bit: np.ndarray):
        """(has, cell) of each cell's part ``bit`` (0 to 3)."""
        mask, first, _ = self.levels[level]
        m = mask[cells]
        has = (m >> bit) & 1 == 1
        return has, first[cells] + _COUNT[m & ((1 << bit) - 1)]

    def search(self, query: dict[bytes, int], best: list, k: int) -> None:
        """Offers this block's documents to ``best``, a heap of the k best
        ``(score, -doc_id)`` so far."""
        known = [(self.rows[t], w) for t, w in query.items() if w and t in self.rows]
        if not known:
            return
        rows, weights = np.array([r for r, _ in known], np.int64), np.array([w for _, w in known], np.int64)
        cells = np.zeros(len(rows), np.int64)
        ranges = [(-int(weights.sum()) * self.top, 0, 0, 0, rows, weights, cells)]  # -bound, first range of the level, level, tie break
        made = 0
        while ranges:
            bound, group, level, _, rows, weights, cells = heapq.heappop(ranges)
            if len(best) == k:
                score, other = best[0]
                if -bound < score:
                    return
                if -bound == score and -int(self.doc_ids[min(self._first_doc(group, level), len(self.doc_ids) - 1)]) < other:
                    continue
            if level == len(self.plan):
                self._score(group, weights, cells, best, k)
                continue
            takes_row, takes_col = self.plan[level]
            row_bit = 0
            if takes_row:
                row_bit = ((rows >> self.row_left[level]) & 1) << 1
            for half in range(1 + takes_col):
                has, below = self._below(level, cells, np.broadcast_to(np.asarray(row_bit | half), cells.shape))
                if has.any():
                    w, at = weights[has], below[has]
                    made += 1
                    heapq.heappush(ranges, (-int((w * self.levels[level][2][at]).sum()), group * 2 + half if takes_col else group,
                                            level + 1, made, rows[has], w, at))

    def _first_doc(self, group: int, level: int) -> int:
        return (group << self.col_left[level]) * LEAF

    def _score(self, group: int, weights: np.ndarray, cells: np.ndarray, best: list, k: int) -> None:
        scores = np.zeros(LEAF, np.int64)
        for w, cell in zip(weights.tolist(), cells.tolist()):
            at = slice(self.ends[cell - 1] if cell else 0, self.ends[cell])
            scores[self.places[at]] += w * self.impacts[at]
        for place in np.flatnonzero(scores).tolist():
            entry = (int(scores[place]), -int(self.doc_ids[group * LEAF + place]))
            if len(best) < k:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)


def _document_counts(index: DataFrame, wanted: set[bytes]) -> dict[bytes, int]:
    """How many documents hold each of ``wanted``."""
    def found(batches):
        for row in _rows_of(batches):
            counts = np.frombuffer(row["dfs"], np.uint32)
            hits = [(t, int(counts[i])) for i, t in enumerate(row["terms"].split(b" ")) if t in wanted]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in hits], pa.binary()), pa.array([n for _, n in hits], pa.int64())], names=["term", "n"])
    rows = index.select("terms", "dfs").mapInArrow(found, "term binary, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    return {bytes(r["term"]): r["n"] for r in rows.collect()}


def _item_groups(items: DataFrame, item_col: str, text_col: str):
    """Items with their terms, in groups of a bounded size."""
    group, terms = [], 0
    for row in items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where("text is not null").toLocalIterator():
        counts = Counter(terms_of(row["text"].encode()))
        if counts:
            group.append((row["item"], counts))
            terms += len(counts)
        if len(group) >= ITEMS_AT_ONCE or terms >= TERMS_AT_ONCE:
            yield group
            group, terms = [], 0
    if group:
        yield group


def search_index(index: DataFrame, size: tuple[int, int], items: DataFrame, k: int = 20, item_col: str = "item_id",
                 text_col: str = "text") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the k best documents of each item,
    or all with a score above 0 if fewer.  Items are gone through in groups of
    at most ``ITEMS_AT_ONCE``, each against all blocks."""
    spark, schema = index.sparkSession, items.schema[item_col].dataType.simpleString()
    found = spark.createDataFrame([], f"item_no bigint, item_id {schema}, doc_id bigint, score bigint")
    done = 0
    for group in _item_groups(items, item_col, text_col):
        dfs = _document_counts(index, set().union(*(c for _, c in group)))
        queries = [{t: term_weight(size[0], dfs[t]) * n for t, n in counts.items() if t in dfs} for _, counts in group]

        def searched(batches, queries=queries, first=done):
            best = [[] for _ in queries]
            for block in map(Block, _rows_of(batches)):
                for query, heap in zip(queries, best):
                    block.search(query, heap, k)
                del block  # before the next is opened
            rows = [(first + i, -d, s) for i, heap in enumerate(best) for s, d in heap]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["item_no", "doc_id", "score"])

        names = spark.createDataFrame([(done + i, item) for i, (item, _) in enumerate(group)], f"item_no bigint, item_id {schema}")
        hits = index.mapInArrow(searched, "item_no bigint, doc_id bigint, score bigint")
        best = Window.partitionBy("item_no").orderBy(F.desc("score"), "doc_id")
        top = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        found = found.unionByName(top.join(F.broadcast(names), "item_no").select("item_no", "item_id", "rank", "doc_id", "score"), allowMissingColumns=True) \
            if done else top.join(F.broadcast(names), "item_no").select("item_no", "item_id", "rank", "doc_id", "score")
        done += len(group)
    if not done:
        found = found.withColumn("rank", F.lit(0))
    unknown = F.when(F.col("doc_id") != _LAST, F.col("doc_id"))
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), unknown.alias("doc_id"), "score")


def search_documents(docs: DataFrame, items: DataFrame, k: int = 20, *, id_col: str = "doc_id", text_col: str = "text",
                     item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Index of ``docs``, written, then searched for every row of ``items``."""
    size = collection_size(docs, text_col)
    index = materialise(build_index(docs, size, id_col, text_col), "lexical-index", **_STORED)
    return search_index(index, size, items, k, item_col, item_text_col)
