"""Language-model scoring with a probabilistic suffix tree over words.

Every word is a symbol, and so is the end of a text.  A context is the last
one to ``DEPTH`` words.  It becomes a state if it was met ``MIN_COUNT`` times in
training and its next-word distribution diverges from that of the context one
word shorter, or if it is the shorter context of a state.  A state holds the
next words that followed it ``MIN_NEXT`` times; the weight of the others goes to
the shorter context, down to the smoothed word frequencies.  A token is scored
in the state of the longest suffix of what precedes it.

Words and runs of words are known by 64-bit hashes: a context of ``d`` words and
a transition of a context of ``d - 1`` words are both runs of ``d``.  The tree
grows with the corpus; it lies in parts by ranges of hashes, and no task holds
it.  A stretch of texts (a block) is stored once as numbers with its own
dictionary.  In each round the blocks send every part the distinct keys they
have there with their own counts or sums, sorted and packed; the part adds up
what all blocks sent and answers each of them in the order of its keys.  So one
round's answers decide exactly which longer runs are counted in the next.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoq.llm.common import batch_of, byte_texts, id_and_text, materialise
from geoq.llm.shingles import words_of

#: Least training occurrences of a context, and of a word after it.
MIN_COUNT, MIN_NEXT, DEPTH = 5, 2, 3
#: Least divergence of a state from its parent (nats), weight of the parent.
MIN_DIVERGENCE, PARENT_WEIGHT = 0.02, 20.0
#: Added to every count of the base model.
ADDED = 0.1
#: Tokens of a block, and of the stretches in which its runs are hashed; least
#: number of parts.
BLOCK_TOKENS, TOKENS_AT_ONCE, LEAST_PARTS = 2_000_000, 400_000, 64
#: Bits of a symbol in a tree held in memory (``SuffixTree``).
_BITS = 14
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

#: What is asked and answered; runs and contexts are numbered by depth besides.
_TEXTS, _WORDS, _RUNS, _CONTEXTS, _NEEDED = 0, 10, 20, 30, 40
#: Types of what is asked besides the keys, and of what is answered: counts of
#: words; counts of runs, and whether the block is the first that asked; sums
#: over transitions of counts and of divergence, and whether it suffices;
#: whether a longer state needs this context.
_ASKED = {_WORDS: (np.int64,), _RUNS: (np.int64,), _CONTEXTS: (np.int64, np.float64), _NEEDED: (np.uint8,)}
_ANSWERED = {_WORDS: (np.int64,), _RUNS: (np.int64, np.uint8), _CONTEXTS: (np.int64, np.uint8), _NEEDED: (np.uint8,)}
#: A block's texts (step 0), what it asks of a part, or the part's answer; n is
#: the tokens of a block.  Sums of a whole part come as block -1.
_ROW = "block bigint, step int, part int, data array<binary>, n bigint, v bigint"
_ROW_SCHEMA = pa.schema([("block", pa.int64()), ("step", pa.int32()), ("part", pa.int32()), ("data", pa.list_(pa.binary())),
                         ("n", pa.int64()), ("v", pa.int64())])
_TEXT_TYPES = (np.int64, np.uint8, np.uint8, np.int64, np.int32, np.uint64, np.int64)


def _squeezed(x: np.ndarray) -> bytes:
    """Byte planes, compressed: small numbers and differences take little."""
    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def _expanded(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_pylist([dict(zip(_ROW_SCHEMA.names, r)) for r in rows], _ROW_SCHEMA)


class _Places(dict):
    """Word -> its number in a block; the end of a text, b"", is 0."""

    def __init__(self):
        super().__init__({b"": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _blocks(rows: DataFrame) -> DataFrame:
    """Texts as numbers: per block its documents, their tokens, and the hashes
    and training counts of its dictionary."""

    def finish(block, places, ids, held, tokens):
        lengths = np.array([len(t) for t in tokens], np.int64)
        flat = np.concatenate(tokens)
        counts = np.bincount(flat[np.repeat(~np.array(held), lengths)], minlength=len(places))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, places), np.uint64, len(places))
        known = [x is not None for x in ids]
        columns = ([x or 0 for x in ids], known, held, lengths, flat, hashes, counts)
        data = [_squeezed(np.asarray(x, kind)) for x, kind in zip(columns, _TEXT_TYPES)]
        return pa.RecordBatch.from_pylist([dict(zip(_ROW_SCHEMA.names, (block, _TEXTS, 0, data, len(flat), 0)))], _ROW_SCHEMA)

    def encode(batches):
        part, made = TaskContext.get().partitionId(), 0
        places, ids, held, tokens, size = _Places(), [], [], [], 0
        end = np.zeros(1, np.int32)
        for b in batches:
            for doc, text, out in zip(b.column(0).to_pylist(), byte_texts(b.column(1)), b.column(2).to_pylist()):
                words = words_of(text)
                tokens.append(np.concatenate([np.fromiter(map(places.__getitem__, words), np.int32, len(words)), end]))
                ids.append(doc)
                held.append(out)
                size += len(words) + 1
                if size >= BLOCK_TOKENS:
                    yield finish((part << 24) + made, places, ids, held, tokens)
                    places, ids, held, tokens, size, made = _Places(), [], [], [], 0, made + 1
        if ids:
            yield finish((part << 24) + made, places, ids, held, tokens)

    return rows.mapInArrow(encode, _ROW)


def _shifted(x: np.ndarray) -> np.ndarray:
    """Each token's value of the token before."""
    return np.concatenate([x[:1], x[:-1]])


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in order, the number among them of each of ``x``, places
    of ``x`` by hash, and where each hash begins there."""
    bits = np.uint64(max(1, len(x).bit_length()))
    # places in the low bits of what is sorted; hashes alike above them are rare
    packed = (x >> bits << bits) | np.arange(len(x), dtype=np.uint64)
    packed.sort()
    at = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    ordered = x[at]
    if (ordered[1:] < ordered[:-1]).any():
        at = np.argsort(x, kind="stable")
        ordered = x[at]
    new = np.ones(len(x), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    starts, number = np.flatnonzero(new), np.empty(len(x), np.int32)
    number[at] = np.cumsum(new) - 1
    return ordered[starts], number, at, starts


def _among(keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _smoothed(n, weight, shorter, total):
    """Probability after a state of a word that followed it ``n`` times."""
    return (n + weight * shorter) / (total + PARENT_WEIGHT)


class SuffixTree:
    """A small tree held in memory: states by depth, with their totals and
    transition counts."""

    def __init__(self, root: np.ndarray):
        self.root = root
        self.levels: list[tuple[np.ndarray, ...]] = []  # contexts, totals, parent's weight, keys, counts

    def add(self, contexts: np.ndarray, totals: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> None:
        """Adds a depth; its distributions smooth those of the next."""
        at, _ = _among(keys >> _BITS, contexts)
        explicit = np.bincount(at, counts, len(contexts)) if len(contexts) else np.zeros(0)
        self.levels.append((contexts, totals, PARENT_WEIGHT + totals - explicit, keys, counts))

    def next_given(self, codes: np.ndarray, following: np.ndarray, depth: int) -> np.ndarray:
        """Probabilities of symbols after contexts of ``depth`` symbols: in the
        longest suffix that is a state."""
        p = self.root[following]
        alive = np.ones(len(codes), bool)
        for d in range(1, min(depth, len(self.levels)) + 1):
            contexts, totals, weight, keys, counts = self.levels[d - 1]
            code = codes & ((1 << (_BITS * d)) - 1)
            at, there = _among(code, contexts)
            alive &= there
            some = np.flatnonzero(alive)
            if not len(some):
                break
            where, seen = _among(code[some] << _BITS | following[some], keys)
            n = np.where(seen, counts[where] if len(counts) else 0, 0)
            p[some] = _smoothed(n, weight[at[some]], p[some], totals[at[some]])
        return p


class _Block:
    """A block's tokens, with what the parts have answered so far.  A level
    ``d`` has the runs of ``d + 1`` words that end at tokens and can be
    transitions of contexts of ``d`` words, level 0 the words."""

    def __init__(self, rows: pa.Table, base):
        held: dict[int, list] = {}
        for r in sorted(rows.select(["step", "part", "data"]).to_pylist(), key=lambda r: (r["step"], r["part"])):
            held.setdefault(r["step"], []).append(r["data"])
        self.base = base
        ids, known, held_out, self.lengths, self.tokens, self.hashes, self.trained = (
            _expanded(x, kind) for x, kind in zip(held.pop(_TEXTS)[0], _TEXT_TYPES))
        self.ids, self.held_out = pa.array(ids, mask=known == 0), held_out.astype(bool)
        self.answers = {step: [np.concatenate([_expanded(x[k], kind) for x in parts])
                               for k, kind in enumerate(_ANSWERED[step // 10 * 10])] for step, parts in held.items()}
        self.by_hash = np.argsort(self.hashes)
        self.levels: list[dict] = []
        self.contexts: list[dict] = [{}]

    def answer(self, step: int, of: int) -> list[np.ndarray]:
        """Parts of which nothing was asked give no answer."""
        return self.answers[step] if of else [np.zeros(0, kind) for kind in _ANSWERED[step // 10 * 10]]

    def words(self):
        """Keys and counts to ask for."""
        return self.hashes[self.by_hash], [self.trained[self.by_hash]]

    def count_words(self) -> None:
        self.c = np.empty(len(self.hashes), np.int64)
        self.c[self.by_hash] = self.answer(_WORDS, len(self.hashes))[0]
        first = np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.before = np.minimum(np.arange(len(self.tokens)) - first, DEPTH)
        self.n, self.hash = self.c[self.tokens], self.hashes[self.tokens]
        self.p = self.base(self.n.astype(np.float64))
        self.levels.append({"n": self.c, "keys": self.hashes, "run": self.hash, "number": self.tokens, "order": self.by_hash})

    def add_level(self) -> None:
        """The next level's runs: those whose context was met ``MIN_COUNT``
        times, and which without their first word were ``MIN_NEXT`` times."""
        d, above = len(self.levels), self.levels[-1]
        total = _shifted(self.n)
        at = np.flatnonzero((self.before >= d) & (total >= MIN_COUNT) & (self.n >= MIN_NEXT))
        hashes = np.empty(len(at), np.uint64)
        for k in range(0, len(at), TOKENS_AT_ONCE):
            some = at[k:k + TOKENS_AT_ONCE]
            x = above["run"][some - 1] * _P + self.hash[some]
            x = (x ^ (x >> np.uint64(31))) * _Q
            hashes[k:k + TOKENS_AT_ONCE] = x ^ (x >> np.uint64(29))
        keys, number, by_key, starts = _distinct(hashes)
        run, numbers = np.zeros(len(self.tokens), np.uint64), np.full(len(self.tokens), -1, np.int32)
        run[at], numbers[at] = hashes, number
        level = {"keys": keys, "run": run, "number": numbers, "total": total, "order": np.arange(len(keys)), "at": at,
                 "by_key": by_key, "starts": starts, "last": at[by_key[starts]]}
        if d > 1:
            del above["run"], above["by_key"], above["starts"]
        self.levels.append(level)

    def runs(self):
        """Keys and training counts of the last level to ask for."""
        level = self.levels[-1]
        trained = ~np.repeat(self.held_out, self.lengths)[level["at"]][level["by_key"]]
        n = np.add.reduceat(trained.astype(np.int64), level["starts"]) if len(trained) else np.zeros(0, np.int64)
        return level["keys"], [n]

    def count_runs(self) -> None:
        level = self.levels[-1]
        level["n"], own = self.answer(_RUNS + len(self.levels) - 1, len(level["keys"]))
        level["own"] = own.astype(bool)
        self.n = np.zeros(len(self.tokens), np.int64)
        self.n[level["at"]] = level["n"][level["number"][level["at"]]]

    def add_contexts(self) -> None:
        """The contexts of the last level: level above's runs met often."""
        above = self.levels[-2]
        often = above["order"][above["n"][above["order"]] >= MIN_COUNT]
        self.contexts.append({"keys": above["keys"][often], "often": often, "total": above["n"]})

    def sums(self, d: int):
        """Keys of contexts of ``d`` words, and sums over those of their
        transitions that this block was the first to ask for: of counts, and of
        divergence from the context one word shorter."""
        above, level, context = self.levels[d - 1], self.levels[d], self.contexts[d]
        some = np.flatnonzero(level["own"] & (level["n"] >= MIN_NEXT))
        last, n = level["last"][some], level["n"][some]
        share = n / level["total"][last]
        of, size = above["number"][last - 1], len(above["keys"])
        sums = np.bincount(of, n, size).astype(np.int64), np.bincount(of, share * np.log(share / self.p[last]), size)
        return context["keys"], [x[context["often"]] for x in sums]

    def weigh_contexts(self) -> None:
        """Weight of the shorter context; 0 where none was met with a next word."""
        d, context = len(self.contexts) - 1, self.contexts[-1]
        held, diverges = self.answer(_CONTEXTS + d, len(context["often"]))
        size = len(context["total"])
        context["weight"], context["diverges"] = np.zeros(size), np.zeros(size, bool)
        total = context["total"][context["often"]]
        context["weight"][context["often"]] = np.where(held > 0, PARENT_WEIGHT + (total - held), 0)
        context["diverges"][context["often"]] = diverges

    def smooth(self, d: int, states: np.ndarray) -> None:
        """Tokens' probabilities after contexts of ``d`` words that are states."""
        level, context = self.levels[d], self.contexts[d]
        at = np.flatnonzero((self.before >= d) & (level["total"] >= MIN_COUNT))
        of = self.levels[d - 1]["number"][at - 1]
        at, of = at[states[of]], of[states[of]]
        n = np.zeros(len(at), np.int64)
        some = np.flatnonzero(level["number"][at] >= 0)
        n[some] = level["n"][level["number"][at[some]]]
        self.p[at] = _smoothed(np.where(n >= MIN_NEXT, n, 0), context["weight"][of], self.p[at], context["total"][of])

    def needed(self):
        """Keys of contexts that do not diverge, and whether a longer one of
        this block that does needs them; their depths and numbers."""
        needed = [np.zeros(len(c["total"]), bool) for c in self.contexts[1:DEPTH]]
        for d in range(2, DEPTH + 1):
            last = self.levels[d - 1]["last"][self.contexts[d]["diverges"]]
            for k in range(1, d):
                needed[k - 1][self.levels[k - 1]["number"][last]] = True
        asked = [np.flatnonzero((c["weight"] > 0) & ~c["diverges"]) for c in self.contexts[1:DEPTH]]
        keys = np.concatenate([self.levels[k]["keys"][x] for k, x in enumerate(asked)])
        order = np.argsort(keys)
        return keys[order], [np.concatenate([x[y] for x, y in zip(needed, asked)])[order]], asked, order

    def scores(self, schema: pa.Schema) -> pa.Table:
        keys, _, asked, order = self.needed()
        needed = np.empty(len(keys), bool)
        needed[order] = self.answer(_NEEDED, len(keys))[0]
        starts = np.cumsum(self.lengths) - self.lengths
        c = self.c[self.tokens]
        self.p = self.base(c.astype(np.float64))
        known, base = np.add.reduceat((c > 0).astype(np.int64), starts), np.add.reduceat(np.log10(self.p), starts)
        for d in range(1, DEPTH + 1):
            states = self.contexts[d]["diverges"].copy()
            if d < DEPTH:
                states[asked[d - 1]] = needed[:len(asked[d - 1])]
                needed = needed[len(asked[d - 1]):]
            self.smooth(d, states)
        return pa.Table.from_batches([batch_of(schema, self.ids, self.held_out, self.lengths, known, base,
                                               np.add.reduceat(np.log10(self.p), starts))])


def _advanced(rows: pa.Table, base, rounds: int):
    """A block as of a round, and what it then asks: ``(step, keys, values)``.
    Words come first, then in each round a level's runs with the contexts of the
    level above, at last what longer states need."""
    block = _Block(rows, base)
    if rounds == 0:
        return block, [(_WORDS, *block.words())]
    block.count_words()
    for d in range(1, DEPTH + 1):
        block.add_level()
        if rounds == d:
            return block, [(_RUNS + d, *block.runs())] + ([(_CONTEXTS + d - 1, *block.sums(d - 1))] if d > 1 else [])
        if d > 1:
            block.weigh_contexts()
            if rounds <= DEPTH + 1:
                block.smooth(d - 1, block.contexts[-1]["weight"] > 0)
        block.count_runs()
        block.add_contexts()
    if rounds == DEPTH + 1:
        return block, [(_CONTEXTS + DEPTH, *block.sums(DEPTH))]
    block.weigh_contexts()
    return block, [(_NEEDED, *block.needed()[:2])] if rounds == DEPTH + 2 else []


#: Has Spark delete a job's shuffle files when the job has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _stored(df: DataFrame, name: str) -> DataFrame:
    """``materialise``, leaving no shuffle files."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        return materialise(df, name)
    finally:
        conf.set(_CLEANUP, before)


def _answers(blocks: DataFrame, parts: int, base, rounds: int) -> DataFrame:
    """One round: what the blocks ask, and the parts' answers."""

    def ask(rows: pa.Table) -> pa.Table:
        block, out = rows.column("block")[0].as_py(), []
        edges = np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)
        for step, keys, values in _advanced(rows, base, rounds)[1]:
            ends = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
            for part, (i, j) in enumerate(zip(ends, ends[1:])):
                if i < j:
                    some = [np.diff(keys[i:j], prepend=np.uint64(0))] + [
                        x[i:j].astype(kind) for x, kind in zip(values, _ASKED[step // 10 * 10])]
                    out.append((block, step, part, [_squeezed(x) for x in some], 0, 0))
        return _table(out)

    def answer(rows: pa.Table) -> pa.Table:
        step, part, kind = rows.column("step")[0].as_py(), rows.column("part")[0].as_py(), rows.column("step")[0].as_py() // 10 * 10
        asked = sorted(rows.select(["block", "data"]).to_pylist(), key=lambda r: r["block"])
        keys = [np.cumsum(_expanded(r["data"][0], np.uint64), dtype=np.uint64) for r in asked]
        values = [np.concatenate([_expanded(r["data"][k], t) for r in asked]) for k, t in enumerate(_ASKED[kind], 1)]
        distinct, number, by_key, starts = _distinct(np.concatenate(keys))
        sums = [np.bincount(number, x, len(distinct)) for x in values]
        given = [sums[0].astype(_ANSWERED[kind][0])[number]]
        out = []
        if kind == _WORDS:
            out.append((-1, step, part, [], int(sums[0].sum()), int((sums[0] > 0).sum())))
        elif kind == _RUNS:
            given.append(np.zeros(len(number), np.uint8))
            given[1][by_key[starts]] = 1
        elif kind == _CONTEXTS:
            given.append(((sums[0] > 0) & (sums[1] >= MIN_DIVERGENCE))[number].astype(np.uint8))
        else:
            given = [(sums[0] > 0)[number].astype(np.uint8)]
        at = 0
        for r, own in zip(asked, keys):
            out.append((r["block"], step, part, [_squeezed(x[at:at + len(own)]) for x in given], 0, 0))
            at += len(own)
        return _table(out)

    def ask_each(batches):
        for b in batches:
            for k in range(b.num_rows):
                yield from ask(pa.Table.from_batches([b.slice(k, 1)])).to_batches()

    # at first a block is one row
    asked = blocks.groupBy("block").applyInArrow(ask, _ROW) if rounds else blocks.mapInArrow(ask_each, _ROW)
    return _stored(asked.groupBy("step", "part").applyInArrow(answer, _ROW), f"answers-{rounds}")


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``
    of every row: log10 probabilities of its whole text under smoothed word
    frequencies and under the suffix tree, both learnt from the rows for which
    ``held_out`` (a condition on ``doc_id``) does not hold.

    A null or empty text is the end token alone.  Repeated rows count and are
    scored each; a null id is decided by ``held_out``, null counting as false.
    Without training rows every token has the same base probability.  An empty
    table gives no rows; other columns are ignored."""
    rows = id_and_text(docs, id_col, text_col).withColumn("out", F.coalesce(held_out, F.lit(False)))
    blocks = _stored(_blocks(rows), "blocks")
    tokens = blocks.agg(F.sum("n")).first()[0] or 0
    parts = max(LEAST_PARTS, 2 * -(-tokens // BLOCK_TOKENS))
    n = v = 0

    def base(c):
        return (c + ADDED) / (n + ADDED * (v + 1))

    for rounds in range(DEPTH + 3):
        answers = _answers(blocks, parts, base, rounds)
        if rounds == 0:
            n, v = (x or 0 for x in answers.where("block < 0").agg(F.sum("n"), F.sum("v")).first())
        blocks = blocks.unionByName(answers.where("block >= 0"))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("base_score", pa.float64()), ("score", pa.float64())])

    def score(rows: pa.Table) -> pa.Table:
        return _advanced(rows, base, DEPTH + 3)[0].scores(schema)

    out = blocks.groupBy("block").applyInArrow(
        score, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score")
