"""Line de-duplication by windows of lines.

A run of lines may go when it has ``MIN_WORDS`` words or more and is several
lines, or one long one.  Of every line the shortest such run that begins with
it and the shortest that ends with it are hashed (windows).  They cover every
longer run that may go, so each run of lines that occurs earlier (smaller
document id, then place) goes whole, whatever stands around it; its bytes are
compared with the first occurrence's before.

A long line is worth several: a line of ``LONG_LINE`` words or more is itself
cut into sentences, and so are runs of sentences met inside it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoq.llm.common import KeyFilter, batch_of, byte_texts, materialise

#: Words that make a line long, and least words of a run that may go.
LONG_LINE, MIN_WORDS = 30, 16

#: 1 for the white space between words, and for the ends of sentences.
_SPACE = bytes(b in b" \t\n\v\f\r" for b in range(256))
_END = bytes(b in b".!?" for b in range(256))
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _units(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """``(text's number, start, end, words, after a space, hash)`` of each
    line, or sentence of a long line, in text order.  One byte separates
    units; an empty text has none."""
    data = b"\n".join(texts)
    text_starts = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    d = np.frombuffer(data, np.uint8)
    space = np.frombuffer(b"\1" + data.translate(_SPACE), np.uint8)
    word_starts = np.flatnonzero(space[1:] < space[:-1])
    lines = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(d == 10) + 1])
    long = np.diff(np.searchsorted(word_starts, np.append(lines, len(d)))) >= LONG_LINE
    # a space after the end of a sentence, in a long line
    cuts = np.flatnonzero(np.frombuffer(data.translate(_END), np.uint8)) + 1
    cuts = cuts[cuts < len(d)]
    cuts = cuts[d[cuts] == 32] + 1
    cuts = cuts[long[np.searchsorted(lines, cuts - 1, "right") - 1]]
    start = np.concatenate([lines, cuts])
    order = np.argsort(start, kind="stable")
    start, spaced = start[order], order >= len(lines)
    end = np.append(start[1:] - 1, len(d))
    text = np.searchsorted(text_starts, start, "right") - 1
    some = np.fromiter(map(bool, texts), bool, len(texts))[text]
    text, start, end, spaced = text[some], start[some], end[some], spaced[some]
    words = np.searchsorted(word_starts, end) - np.searchsorted(word_starts, start)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(data[i:j]) for i, j in zip(start.tolist(), end.tolist())), np.uint64, len(start))
    return text, start - text_starts[text], end - text_starts[text], words, spaced, h


def _chunks(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """``(text's number, start, end, hash)`` of the windows of all texts, in
    text order; ``end`` leaves out the separator after."""
    empty = np.zeros(0, np.int64)
    if not any(texts):
        return empty, empty, empty, empty
    doc, start, end, words, spaced, h = _units(texts)
    n = len(doc)
    # shortest runs from each unit on and up to each unit: words enough, and two units or a long one
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(words)])
    each, short = np.arange(n), (words < LONG_LINE).astype(np.int64)
    last = np.maximum(np.searchsorted(total[1:], total[:-1] + MIN_WORDS), each + short)
    first = np.minimum(np.searchsorted(total[:-1], total[1:] - MIN_WORDS, "right") - 1, each - short)
    ahead, behind = last < n, first >= 0
    first, last = np.concatenate([each[ahead], first[behind]]), np.concatenate([last[ahead], each[behind]])
    runs = np.unique((first * n + last)[doc[first] == doc[last]])
    first, last = runs // n, runs % n
    # a run has the hash h[i] + sum(g[i + k] * P**k), k > 0, from sums over all units; g tells the separators apart
    power, inverse = _powers(_P, n + 1), _powers(_P_INVERSE, n + 1)
    g = h + spaced.astype(np.uint64) * _Q
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(g * power[:n], dtype=np.uint64)])
    chunk = h[first] + (sums[last + 1] - sums[first + 1]) * inverse[first] + (last - first).astype(np.uint64) * _Q
    chunk ^= chunk >> np.uint64(29)
    return doc[first], start[first], end[last], chunk.view(np.int64)


def line_chunks(text: bytes) -> set[tuple[int, int]]:
    """``(start, end)`` of a text's windows."""
    _, start, end, _ = _chunks([text])
    return set(zip(start.tolist(), end.tolist()))


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name += "_"
    return name


_REPEATED = "key bigint, start int, end int, first_key bigint, first_start int"


def _repeated(occurrences: DataFrame) -> DataFrame:
    """Every occurrence of a chunk but the first, with the place of the first:
    one pass over sorted rows that holds the first of the current chunk."""
    schema = pa.schema([("key", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("first_key", pa.int64()), ("first_start", pa.int32())])

    def follow(batches):
        held = None  # hash, key and start of the current chunk's first
        for b in batches:
            h, key, start, end = (b.column(i).to_numpy() for i in (0, 2, 3, 4))
            if not len(h):
                continue
            fresh = np.concatenate([[True], h[1:] != h[:-1]])
            at = np.maximum.accumulate(np.where(fresh, np.arange(len(h)), 0))
            first_key, first_start = key[at], start[at]
            if held is not None:
                same = h == held[0]
                first_key[same], first_start[same] = held[1], held[2]
            other = (first_key != key) | (first_start != start)
            if other.any():
                yield batch_of(schema, key[other], start[other], end[other], first_key[other], first_start[other])
            held = h[-1], first_key[-1], first_start[-1]

    return (occurrences.repartition("hash").sortWithinPartitions("hash", "doc", "key", "start").mapInArrow(follow, _REPEATED))


def _passages(key: pa.Array, spans: pa.ListArray) -> tuple | None:
    """``key, start, end, first_key, first_start`` of the passages that the
    listed windows of each key make up; None of no windows."""
    start, end, first_key, first_start = (spans.flatten().field(i).to_numpy() for i in range(4))
    if not len(start):
        return None
    row = np.repeat(np.arange(len(key)), np.diff(spans.offsets.to_numpy()))
    shift = start.astype(np.int64) - first_start
    order = np.lexsort((start, shift, first_key, row))
    start, end, first_key, shift, row = (x[order] for x in (start, end, first_key, shift, row))
    alike = np.concatenate([[False], (row[1:] == row[:-1]) & (first_key[1:] == first_key[:-1]) & (shift[1:] == shift[:-1])])
    # the furthest end so far among windows alike: those of later groups lie higher
    base = np.cumsum(~alike) * (int(end.max()) + 2)
    furthest = np.maximum.accumulate(end + base)
    fresh = np.flatnonzero(~alike | np.concatenate([[True], start[1:] + base[1:] > furthest[:-1]]))
    last = np.append(fresh[1:], len(row)) - 1
    return (key.take(pa.array(row[fresh])), start[fresh], (furthest - base)[last].astype(np.int32), first_key[fresh],
            (start[fresh] - shift[fresh]).astype(np.int32))


def _merged(repeated: DataFrame) -> DataFrame:
    """Overlapping windows of a document whose firsts overlap alike are one
    passage, compared once."""
    schema = pa.schema([("key", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("first_key", pa.int64()), ("first_start", pa.int32())])

    def merge(batches):
        for b in batches:
            found = _passages(b.column(0), b.column(1))
            if found is not None:
                yield batch_of(schema, *found)

    return (repeated.groupBy("key").agg(F.collect_list(F.struct("start", "end", "first_key", "first_start")).alias("spans"))
            .mapInArrow(merge, _REPEATED))


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, with repeated runs of lines taken
    out of the text, and a last column ``removed``: the byte ranges of the
    original text that went, as ``array<struct<start, end>>``.

    Null and empty texts stay as they are; a text all of whose lines repeat
    becomes empty.  Rows equal in id and text count as one document, and each
    is cut alike; among equal passages the smallest id keeps its copy (null
    ids first), then the earliest place.  An empty table gives no rows.  Only
    window hashes, and the texts that hold repeated windows, are shuffled."""
    columns, key, listed = docs.columns, _free(docs, "_row_key"), _free(docs, "_spans")
    keyed = docs.withColumn(key, F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))))
    found = pa.schema([("hash", pa.int64()), ("doc", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])

    def chunks(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                row, start, end, h = _chunks([t or b"" for t in byte_texts(some.column(1))])
                yield batch_of(found, h, some.column(0).take(pa.array(row)), some.column(2).take(pa.array(row)),
                               start.astype(np.int32), end.astype(np.int32))

    occurrences = keyed.select(F.col(id_col).cast("bigint"), text_col, key).mapInArrow(
        chunks, "hash bigint, doc bigint, key bigint, start int, end int")
    passages = materialise(_merged(materialise(_repeated(occurrences), "repeated-chunks")), "repeated-passages")

    # the first copies' bytes
    quoted = pa.schema([("first_key", pa.int64()), ("first_start", pa.int32()), ("length", pa.int32()), ("passage", pa.binary())])
    asked = passages.withColumn("length", F.col("end") - F.col("start"))
    wanted = (asked.select("first_key", "first_start", "length").distinct().groupBy("first_key")
              .agg(F.collect_list(F.struct("first_start", "length")).alias("spans")))
    has_first = KeyFilter(passages, "first_key")

    def holds(key_filter, at):
        def keep(batches):
            for b in batches:
                yield b.filter(pa.array(key_filter.passes(b.column(at).to_numpy())))
        return keep

    def quote(batches):
        for b in batches:
            for first_key, text, spans in zip(b.column(0).to_pylist(), byte_texts(b.column(1)), b.column(2).to_pylist()):
                yield batch_of(quoted, [first_key] * len(spans), [s["first_start"] for s in spans], [s["length"] for s in spans],
                               [text[s["first_start"]:s["first_start"] + s["length"]] for s in spans])

    texts = keyed.select(F.col(key).alias("first_key"), F.col(text_col).alias("text"))
    quotes = (texts.mapInArrow(holds(has_first, 0), texts.schema).dropDuplicates(["first_key"]).join(wanted, "first_key")
              .select("first_key", "text", "spans").mapInArrow(quote, "first_key bigint, first_start int, length int, passage binary"))
    cuts = (asked.join(quotes, ["first_key", "first_start", "length"]).groupBy(F.col("key").alias(key))
            .agg(F.collect_list(F.struct("start", "end", "passage")).alias(listed)))

    # documents without a repeated passage pass as they are
    removed, text_at, has_cut = _free(docs, "removed"), columns.index(text_col), KeyFilter(passages, "key")
    removed_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    schema = docs.limit(0).withColumn(removed, F.expr("cast(array() as array<struct<start: int, end: int>>)")).schema
    key_at = len(columns)

    def others(batches):
        for b in batches:
            some = b.filter(pa.array(~has_cut.passes(b.column(key_at).to_numpy())))
            none = pa.array([[]] * some.num_rows, removed_type)
            yield pa.RecordBatch.from_arrays([*some.columns[:key_at], none], names=[*columns, removed])

    def cut(batches):
        for b in batches:
            new, gone = [], []
            for text, spans in zip(byte_texts(b.column(text_at)), b.column(key_at).to_pylist()):
                goes = sorted((s["start"], s["end"] + 1) for s in spans or []
                              if text[s["start"]:s["end"]] == s["passage"])  # byte comparison
                merged: list[list[int]] = []
                for i, j in goes:
                    if merged and i <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], j)
                    else:
                        merged.append([i, j])
                if merged:
                    edges = [0, *(x for m in merged for x in m), len(text)]
                    kept = b"".join(text[i:j] for i, j in zip(edges[::2], edges[1::2]))
                    if merged[-1][1] > len(text) and kept.endswith((b"\n", b" ")):
                        kept = kept[:-1]  # the separator before a removed end
                    text = kept
                new.append(text if text is None else text.decode())
                gone.append([{"start": i, "end": j} for i, j in merged])
            arrays = list(b.columns[:key_at])
            arrays[text_at] = pa.array(new, arrays[text_at].type)
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(gone, removed_type)], names=[*columns, removed])

    untouched = keyed.mapInArrow(others, schema)
    touched = (keyed.mapInArrow(holds(has_cut, key_at), keyed.schema).join(cuts, key, "left")
               .select(*columns, listed).mapInArrow(cut, schema))
    return untouched.unionByName(touched)
