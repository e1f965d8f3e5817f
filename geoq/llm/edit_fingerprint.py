"""Document fingerprints from a randomised edit embedding.

A walker goes over a text's characters.  At step j, standing on character c, it
puts c out and moves on if a random bit r(j, c) says so; all texts share the
bits.  Two walkers that are on the same character at the same step stay
together, and after an edit they soon meet again, so the number of steps at
which two walks differ (Hamming distance) follows the edit distance.  Instead
of single steps a walker takes the whole wait on a character from a table.

A fingerprint samples steps of ``WALKS`` walks.  Steps are drawn per octave
(from 2^o to 2^(o+1)), the same ones for all texts; a text keeps its last
``OCTAVES`` octaves, which hold all but a sixteenth of its steps.  Each sampled
character becomes a hex digit by a random function of its place, '.' lies
after the text's end.  ``likeness`` is the share of equal digits, weighted by
the steps that they stand for, over those that either text reaches: 1 for
equal texts, about 1/16 more than the share of like characters by chance.

Near pairs: bands of sampled digits meet in a shuffle; every fingerprint of a
band is compared with the band's leaders and joins one or becomes a leader,
first within parts of a band, so that a very common band is no single task's
work, then the parts' leaders among each other.  Links are verified on the
whole fingerprints, and components of links are classes.

Nulls: a null text is empty; all empty texts share one fingerprint; their
likeness is 1 to each other and 0 to others.  Texts have any length.  Rows
with the same id are ordered by a hash of their text; null ids come last.  An
empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoq.llm.common import materialise

#: Walks, octaves kept and steps sampled per octave and walk; steps of the first octave (log2).
WALKS, OCTAVES, SAMPLES, FIRST = 4, 4, 16, 5
#: Steps after which the random bits repeat (log2), and classes of characters they tell apart (log2).
PERIOD, CLASSES = 13, 6
#: Characters that are walked over at once; greatest octave that is sampled.
CELLS, LAST = 1 << 19, 40
#: Bands a fingerprint is dealt out by, and digits of each.
BANDS, BAND_DIGITS, PARTS, LIKE = 16, 6, 16, 0.75
_SEED = 20_24
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


class Walkers:
    """The random functions, the same in every task."""

    def __init__(self, walks: int = WALKS, samples: int = SAMPLES, seed: int = _SEED):
        random = np.random.default_rng(seed)
        self.walks, self.samples = walks, samples
        self.classes = random.integers(1, 1 << 62, walks, np.int64) | 1
        # steps a walker stays on a character of a class that it reaches at a step
        self.stay = np.minimum(random.geometric(0.5, (walks, 1 << CLASSES, 1 << PERIOD)), 255).astype(np.uint8).ravel()
        self.steps, self.cache = {}, {}
        for octave in range(LAST):
            low, high = (0, 1 << FIRST) if octave == 0 else (1 << (FIRST + octave - 1), 1 << (FIRST + octave))
            span = (high - low) // samples or 1  # one step of each of the octave's equal parts
            self.steps[octave] = low + span * np.arange(samples) + random.integers(0, span, (walks, samples))
        self.digit = random.integers(1, 1 << 62, (LAST, walks, samples), np.int64) | 1

    def arrivals(self, texts: list[np.ndarray]) -> np.ndarray:
        """Step at which each walk reaches each character (and the end), for
        texts of falling length, side by side: (place, text, walk)."""
        lengths = np.array([len(t) for t in texts])
        longest = int(lengths[0])
        chars = np.zeros((longest, len(texts)), np.uint32)
        for i, t in enumerate(texts):
            chars[:len(t), i] = t
        kinds = ((chars * np.uint32(0x9E3779B1)) >> np.uint32(32 - CLASSES)).astype(np.int32) << PERIOD
        kinds = kinds[:, :, None] + (np.arange(self.walks, dtype=np.int32) << (PERIOD + CLASSES))
        at = np.zeros((longest + 1, len(texts), self.walks), np.int32)  # texts of up to 2**30 characters
        alive = np.searchsorted(-lengths, -np.arange(longest), "left").tolist()  # texts longer than a place
        now, wrap, stay = at[0], np.int32((1 << PERIOD) - 1), self.stay
        for place in range(longest):
            n = alive[place]
            here = now[:n]
            index = here & wrap
            index += kinds[place, :n]
            now = at[place + 1]
            np.add(here, stay.take(index), out=now[:n])
        return at

    def fingerprint(self, text: np.ndarray, at: np.ndarray) -> str:
        """Last octave (two hex digits), then the sampled digits from the last
        octave kept to the first; each octave walk by walk."""
        steps = int(at[-1].max()) if len(text) else 0
        last = max((steps - 1).bit_length() - FIRST, 0) if steps else 0
        octaves = range(last, max(last - OCTAVES, -1), -1)
        digits = np.full((len(octaves), self.walks, self.samples), ord("."), np.uint8)
        if len(text):
            wanted, factors = self._sampled(last, octaves)
            for walk in range(self.walks):
                place = at[:, walk].searchsorted(wanted[walk], "right") - 1
                chars = text[np.minimum(place, len(text) - 1)].astype(np.int64) + 1
                values = _HEX[((chars * factors[walk]) >> 40) & 15]
                digits[:, walk] = np.where(place < len(text), values, ord(".")).reshape(len(octaves), -1)
        return f"{last:02x}:" + digits.tobytes().decode()

    def _sampled(self, last: int, octaves) -> tuple[list, list]:
        """Steps and factors of some octaves in a row, per walk."""
        if last not in self.cache:
            self.cache[last] = tuple([np.concatenate([of[o][walk] for o in octaves]) for walk in range(self.walks)] for of in (self.steps, self.digit))
        return self.cache[last]

    def fingerprints(self, texts: list[str]) -> list[str]:
        points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        order = sorted(range(len(points)), key=lambda i: -len(points[i]))
        out, first = [""] * len(points), 0
        while first < len(order):
            n = max(CELLS // max(len(points[order[first]]), 1), 1)
            some = order[first:first + n]
            if len(points[some[0]]) == 0:
                at = np.zeros((1, len(some), self.walks), np.int32)
            else:
                at = self.arrivals([points[i] for i in some])
            for k, i in enumerate(some):
                out[i] = self.fingerprint(points[i], np.ascontiguousarray(at[:len(points[i]) + 1, k]))
            first += n
        return out


_WALKERS: Walkers | None = None


def walkers() -> Walkers:
    global _WALKERS
    if _WALKERS is None:
        _WALKERS = Walkers()
    return _WALKERS


def likeness(a: str, b: str, walks: int = WALKS, samples: int = SAMPLES) -> float:
    """Weighted share of equal digits, 0 to 1."""
    if a == b:
        return 1.0
    size = walks * samples
    last_a, last_b, top = int(a[:2], 16), int(b[:2], 16), max(int(a[:2], 16), int(b[:2], 16))
    same = total = 0.0
    for octave in range(top, max(top - OCTAVES, -1), -1):
        weight = 2.0 ** (octave - top) * (2 if octave == 0 else 1)
        da, db = (f[3 + (last - octave) * size:3 + (last - octave + 1) * size] if last >= octave > last - OCTAVES else ""
                  for f, last in ((a, last_a), (b, last_b)))
        if not da or not db:  # only one of the texts goes so far
            total += weight * sum(c != "." for c in da or db)
            continue
        for x, y in zip(da, db):
            if x == y:
                if x != ".":
                    same += weight
                    total += weight
            else:
                total += weight
    return same / total if total else 0.0


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_chars, fingerprint)`` of every row: a map, no shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def mapped(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()),
                                              pa.array(walkers().fingerprints(texts), pa.string())], names=["doc_id", "n_chars", "fingerprint"])
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")) \
        .mapInArrow(mapped, f"doc_id {kind}, n_chars bigint, fingerprint string")


# ---------------------------------------------------------------- neighbours

def _edited(text: str, other: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + other[:half]


_ROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                  ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
                  ("part", pa.int32()), ("edge", pa.int32()), ("text", pa.string())])
_ROW_SQL = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
            "near_next double, part int, edge int, text string")


def _compared(ids: list, texts: list[str], part: int) -> list[tuple]:
    """Rows of all but the last text, each with the one after it."""
    edited = [_edited(t, o) for t, o in zip(texts, texts[1:])]
    prints = walkers().fingerprints(texts + edited)
    own, changed = prints[:len(texts)], prints[len(texts):]
    return [(i, len(t), hashlib.sha256(e.encode()).hexdigest(), f, c, likeness(f, c), likeness(f, g), part, None, None)
            for i, t, e, f, c, g in zip(ids, texts, edited, own, changed, own[1:])]


def _put(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ROW.types)] if rows else
                                      [pa.array([], t) for t in _ROW.types], schema=_ROW)


def _neighbours(batches):
    """Rows in falling order of ids, each compared with the next; a part's
    first (edge 0) and last row (edge 1) go out with their texts."""
    last = None
    for batch in batches:
        parts = batch.column(2).to_pylist()
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rows = []
        if last is None and ids:
            rows.append((ids[0], None, None, None, None, None, None, parts[0], 0, texts[0]))
        elif ids:
            ids, texts = [last[0], *ids], [last[1], *texts]
        if ids:
            rows += _compared(ids, texts, parts[0])
            last = (ids[-1], texts[-1], parts[0])
            yield _put(rows)
    if last:
        yield _put([(last[0], None, None, None, None, None, None, last[2], 1, last[1])])


def _across(batches):
    """Last row of a part beside the first row of the next."""
    for batch in batches:
        rows = []
        for doc, text, other in zip(*(c.to_pylist() for c in batch.columns)):
            rows += _compared([doc, None], [text, other], 0)
        yield _put(rows)


def fingerprint_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document beside the next one by falling id (after the last, the
    first): its fingerprint, that of the text whose second half is replaced by
    the beginning of the next, and both likenesses.  One shuffle by ranges of
    ids; within a range texts pass by in order, and only the ranges' first and
    last rows are paired in a second step."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    dealt = texts.withColumn("tie", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialise(dealt.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(_neighbours, _ROW_SQL), "neighbours")
    # parts that hold rows, in order: one number each
    parts = sorted(r[0] for r in rows.where("edge = 0").select("part").collect())
    after = rows.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, after int")
    firsts = rows.where("edge = 0").select(F.col("part").alias("after"), F.col("text").alias("other"))
    pairs = rows.where("edge = 1").select("part", "doc_id", "text").join(F.broadcast(after), "part").join(firsts, "after")
    ends = pairs.select("doc_id", "text", "other").mapInArrow(_across, _ROW_SQL)
    out = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return rows.where("edge is null").select(*out).unionByName(ends.select(*out))


# ---------------------------------------------------------------- near pairs

def _bands(fingerprint: str, bands: int = BANDS, digits: int = BAND_DIGITS) -> list[str]:
    """Keys of sampled digits: per band, places of the last two octaves (texts
    whose lengths lie on two sides of an octave share the lower one)."""
    last, size = int(fingerprint[:2], 16), WALKS * SAMPLES
    keys = []
    for depth in range(min(2, last + 1)):
        block = fingerprint[3 + depth * size:3 + (depth + 1) * size]
        for band in range(bands):
            random = np.random.default_rng([_SEED, last - depth, band])
            places = random.integers(0, size, digits)
            key = "".join(block[p] for p in places)
            if "." not in key:
                keys.append(f"{last - depth}/{band}/{key}")
    return keys


def _led(threshold: float, keep_leaders: bool):
    """Streams bands (sorted by key): each fingerprint joins the first leader
    that it is like, or leads."""
    out = pa.schema([("a", pa.string()), ("b", pa.string()), ("key", pa.string())])

    def led(batches):
        key, leaders = None, []
        for batch in batches:
            rows = []
            for k, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != key:
                    key, leaders = k, []
                for leader in leaders:
                    if leader == f:
                        break
                    if likeness(leader, f) >= threshold:
                        rows.append((leader, f, None))
                        break
                else:
                    leaders.append(f)
                    if keep_leaders:
                        rows.append((f, f, k))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=out)
    return led


def near_fingerprints(prints: DataFrame, threshold: float = LIKE, parts: int = PARTS) -> DataFrame:
    """``(a, b)``: verified links between distinct fingerprints of the column
    ``fingerprint``.  Links join near fingerprints into classes; two members
    of a class need no link of their own."""
    def dealt(batches):
        for batch in batches:
            pairs = [(k, f) for f in batch.column(0).to_pylist() for k in dict.fromkeys(_bands(f))]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in range(2)], names=["key", "fingerprint"])

    bands = prints.select("fingerprint").distinct().mapInArrow(dealt, "key string, fingerprint string")
    part = F.pmod(F.xxhash64("fingerprint"), F.lit(parts))
    first = materialise(bands.withColumn("part", part).repartition("key", "part").sortWithinPartitions("key", "part", "fingerprint")
                        .select(F.concat_ws("/", "key", "part").alias("key"), "fingerprint").mapInArrow(_led(threshold, True), "a string, b string, key string"), "leaders")
    leaders = first.where("key is not null").select(F.regexp_replace("key", "/[0-9]+$", "").alias("key"), F.col("a").alias("fingerprint"))
    second = leaders.repartition("key").sortWithinPartitions("key", "fingerprint").mapInArrow(_led(threshold, False), "a string, b string, key string")
    return first.where("key is null").select("a", "b").unionByName(second.select("a", "b")).distinct()


def fingerprint_classes(prints: DataFrame, threshold: float = LIKE) -> DataFrame:
    """``(fingerprint, class_id, n_links)`` of distinct fingerprints; a class is
    a component of links, named after its smallest fingerprint."""
    links = materialise(near_fingerprints(prints, threshold), "near-fingerprints")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    nodes = prints.select("fingerprint").distinct()
    label = materialise(nodes.withColumn("class_id", F.col("fingerprint")), "classes")
    while True:
        seen = both.join(label.select(F.col("fingerprint").alias("b"), "class_id"), "b").groupBy(F.col("a").alias("fingerprint")).agg(F.min("class_id").alias("least"))
        step = label.join(seen, "fingerprint", "left").select("fingerprint", F.least("class_id", F.coalesce("least", "class_id")).alias("class_id"), F.col("class_id").alias("old"))
        step = materialise(step, "classes")
        jump = step.select(F.col("fingerprint").alias("class_id"), F.col("class_id").alias("further"))  # pointer jumping
        ahead = materialise(step.join(jump, "class_id", "left").select("fingerprint", F.coalesce("further", "class_id").alias("class_id"), "old"), "classes")
        changed = ahead.where("class_id != old").count()
        label = ahead.select("fingerprint", "class_id")
        if not changed:
            break
    counts = both.groupBy(F.col("a").alias("fingerprint")).agg(F.count(F.lit(1)).alias("n_links"))
    return label.join(counts, "fingerprint", "left").select("fingerprint", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
