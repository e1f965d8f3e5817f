"""Spelling variants: words one letter apart, found through a bit-sliced index.

A group of words of one length is sliced by position: for every (position,
letter) a bit set over the group's words.  A query word is run once over the
slices.  Three recurrences, each working on all words of the group at a time,
keep the words that agree so far (``zero``) and those that agree but for one
letter: replaced (same position), missing from the query (slices one position
on) or missing from the word (slices one position back).

Groups come from the pigeonhole rule: a word is cut into three parts, of which
one error leaves two as they are, so that near words share two parts in place.
Every word is indexed under its three pairs of parts and asked under those of
its own length and of one letter more and less.  The position of the first
difference, read off ``zero``, says which of the three reports a pair, so no
pair is counted twice.  A pair of parts that very many words share is dealt
out as a grid of blocks of at most about ``CHUNK`` words a side.

Nulls: a null text has no words, a null id counts as ''.  Words may have any
length.  Equal counts are broken by code-point order.  An empty table gives no
rows; repeated rows count every time; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoq.llm.common import byte_texts, materialise

#: Least letters and occurrences of a word; one run in so many loses a letter.
LEAST_LETTERS, LEAST_COUNT, DROP_ONE_IN = 5, 3, 97
#: Words of a group that one task indexes; counts held before they are put out.
CHUNK, HELD = 8192, 200_000


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least_letters: int = LEAST_LETTERS,
                least_count: int = LEAST_COUNT, drop_one_in: int = DROP_ONE_IN) -> DataFrame:
    """``(word, n)``: letter runs of whole texts, A-Z lower-cased.  A run whose
    crc32 with its document's id is divisible by ``drop_one_in`` first loses
    the letter that the crc32 names.  Counted per task before the shuffle."""
    out = pa.schema([("word", pa.string()), ("n", pa.int64())])
    run = re.compile(f"[a-zÀ-ÿ]{{{least_letters},}}")  # shorter ones never become words

    def put(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], schema=out)

    def counted(batches):
        counts = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1))):
                runs = Counter(run.findall(text.lower().decode()))
                start = zlib.crc32(f"{doc}:".encode())
                for word, n in runs.items():
                    h = zlib.crc32(word.encode(), start)
                    if h % drop_one_in == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < least_letters:
                            continue
                    counts[word] += n
                if len(counts) >= HELD:
                    yield put(counts)
                    counts = Counter()
        yield put(counts)

    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"), F.col(text_col).alias("text")).where("text is not null")
    return texts.mapInArrow(counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _parts(length: str) -> list[str]:
    """Pairs of parts of a word, as they lie in a word of ``length`` letters:
    error in the last, the middle, the first part."""
    third = f"cast(({length} + 1) div 3 as int)"
    return [f"substr(word, 1, {length} - {third})", f"concat(substr(word, 1, {third}), ' ', right(word, {third}))",
            f"right(word, {length} - {third})"]


def _keys(words: DataFrame, change: int, indexed: bool) -> DataFrame:
    length = f"(m + {change})"
    each = ", ".join(f"struct({k} as kind, xxhash64({length}, {k}, {part}) as key)" for k, part in enumerate(_parts(length)))
    return words.select("word", "n", F.expr(length).alias("size"), F.lit(not indexed).alias("asks"), F.expr(f"inline(array({each}))"))


def _groups(words: DataFrame, chunk: int) -> DataFrame:
    """Index and query rows, keyed by group and by the block of the group."""
    words = words.withColumn("m", F.char_length("word"))
    index = _keys(words, 0, True)
    asks = _keys(words, 0, False).unionByName(_keys(words, -1, False)).unionByName(_keys(words, 1, False))
    hot = index.groupBy("key").agg(F.count(F.lit(1)).alias("words")).where(F.col("words") > chunk) \
        .select("key", F.ceil(F.col("words") / chunk).cast("int").alias("blocks"))
    every = "sequence(0, coalesce(blocks, 1) - 1)"
    own = "array(cast(pmod(xxhash64(word), coalesce(blocks, 1)) as int))"
    return (index.unionByName(asks).join(hot, "key", "left")
            .withColumn("here", F.explode(F.expr(f"if(asks, {every}, {own})")))
            .withColumn("there", F.explode(F.expr(f"if(asks, {own}, {every})"))).drop("blocks"))


class SlicedWords:
    """Bit sets over words of one length by (position, letter)."""

    def __init__(self, words: list[str]):
        self.words, self.all, self.slices = words, (1 << len(words)) - 1, {}
        self.size = len(words[0])
        for i, word in enumerate(words):
            bit = 1 << i
            for place in enumerate(word):
                self.slices[place] = self.slices.get(place, 0) | bit

    def near(self, query: str, kind: int | None = None) -> int:
        """Words that differ from ``query`` by exactly one inserted, deleted or
        replaced letter; with ``kind``, only those whose first difference lies
        in the last (0), middle (1) or first part (2)."""
        at, size, m = self.slices.get, self.size, len(query)
        first = (size + 1) // 3
        cuts = {first: None, size - first: None}
        zero, one = self.all, 0
        for j, letter in enumerate(query):
            if j in cuts:
                cuts[j] = zero
            here = at((j, letter), 0)
            if size == m:
                one = (one & here) | (zero & ~here)
            elif size > m:
                one = (one | zero) & at((j + 1, letter), 0)
            else:
                one = (one & at((j - 1, letter), 0)) | zero
            zero &= here
            if not (zero or one):
                return 0
        found = one | zero if size == m + 1 else one
        if kind is None or not found:
            return found
        upto_first, upto_last = (zero if cuts[c] is None else cuts[c] for c in (first, size - first))
        return found & (upto_last, upto_first & ~upto_last, ~upto_first)[kind]


def _matched(batches):
    out = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best", pa.struct([("less", pa.int64()), ("word", pa.string())]))])
    group, words, counts, index, rows = None, [], [], None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for key, here, there, size, kind, asks, word, n in zip(*columns):
            if (key, here, there, size, kind) != group:
                group, words, counts, index = (key, here, there, size, kind), [], [], None
            if not asks:
                words.append(word)
                counts.append(n)
                continue
            if not words or words == [word]:
                continue
            index = index or SlicedWords(words)
            found, hits = index.near(word, kind), []
            while found:
                bit = found & -found
                hits.append(bit.bit_length() - 1)
                found ^= bit
            if hits:
                less, best = min((-counts[i], words[i]) for i in hits)
                rows.append((word, len(hits), {"less": less, "word": best}))
        if len(rows) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), out.types)], schema=out)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), out.types)], schema=out)


def near_words(words: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """``(word, n_near, best_n, best)`` of distinct ``(word, n)``: how many words
    are near, and the most frequent of them.  Words without any are left out."""
    dealt = _groups(words, chunk).select("key", "here", "there", "size", "kind", "asks", "word", "n") \
        .repartition("key", "here", "there").sortWithinPartitions("key", "here", "there", "size", "kind", "asks")
    found = dealt.mapInArrow(_matched, "word string, n_near bigint, best struct<less: bigint, word: string>")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best")) \
        .select("word", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.word").alias("best"))


def follow_forms(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of ``(word, n, form)`` with every form at least twice as
    frequent as its word: counts double along a chain, so the largest count
    bounds its length, and every round doubles the steps taken."""
    links = materialise(forms.where("form is not null").select("word", F.col("form").alias("root")), "forms")
    top, least = forms.agg(F.max("n"), F.min("n")).first()
    steps, longest = 1, (max(top // least, 1).bit_length() if top else 0)
    while steps < longest:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = materialise(links.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "forms")
        steps *= 2
    return links


def spelling_forms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least_letters: int = LEAST_LETTERS,
                   least_count: int = LEAST_COUNT, drop_one_in: int = DROP_ONE_IN, ratio: int = 2, chunk: int = CHUNK) -> DataFrame:
    """Every word with its near words: ``(word, n, n_near, form, form_n, root)``.
    A word's form is its most frequent near word if that is ``ratio`` (2 or
    more) times as frequent; the root is where forms lead."""
    if ratio < 2 or least_count < 1:
        raise ValueError("ratio must be 2 or more and least_count 1 or more")
    words = materialise(count_words(docs, id_col, text_col, least_letters=least_letters, least_count=least_count, drop_one_in=drop_one_in), "words")
    near = words.join(near_words(words, chunk=chunk), "word", "left")
    is_form = F.col("best_n") >= ratio * F.col("n")
    forms = materialise(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"),
                                    F.when(is_form, F.col("best_n")).alias("form_n")), "near-words")
    return forms.join(follow_forms(forms), "word", "left").withColumn("root", F.coalesce("root", "word"))
