"""N-gram Jaccard join with prefixes under several global token orders.

Two sets with Jaccard similarity of at least ``t`` must share one of the first
``n - ceil(t * n) + 1`` tokens of each, whatever the global order of tokens.
Every order puts frequent shingles last (by a class of their frequency) and
breaks ties by a hash of its own.  The prefixes of the first order are dealt
out by token; a pair that meets there must also share a prefix token under
each of the other orders, and is then verified on the whole sets.

No group is expanded into pairs.  Equal sets are one node.  Of the nodes that
share a token, each is first compared with the most typical one alone (that
with the fewest rare shingles), and links join nodes into components.  Only
tokens whose nodes still lie in several components are looked at again, and
there only pairs from different components that pass the length and position
filters; a frequent token's nodes are dealt out as pairs of blocks.  Pairs
that are never compared lie in one component already, so components are exact.

Before whole sets are fetched, a bound drops most pairs that merely share a
passage: every set's hashes are counted in at least as many buckets as it has
shingles (a byte each, against eight for a shingle, so that the counts of long
sets tell as much as those of short ones), and two sets have at most the sum of
the smaller counts in common.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoq.llm.common import KeyFilter, batch_of, byte_texts, id_and_text, materialise
from geoq.llm.shingles import document_shingles, mix, words_of

SHINGLE, PERCENT = 5, 75
#: Global orders; shingles per stretch in which repeats are counted, least
#: count in a stretch that is noted; most frequent shingles known to the orders
#: (any order is exact).
ORDERS, COUNT_AT_ONCE, LOCAL_COUNT, MAX_FREQUENT = 3, 5_000_000, 2, 1_000_000
#: A shingle is frequent in one document in so many, but at least so many documents.
FREQUENT_SHARE, FREQUENT_LEAST = 100_000, 4
#: Nodes of a token that are compared in one block; least buckets of a profile
#: (a power of two); a counter that is full bounds nothing.
BLOCK, PROFILE, FULL = 1024, 64, 255
#: Pairs within a cell that are looked at in one step.
PAIRS_AT_ONCE = 1_000_000

_SIGNATURE = "kind int, doc_id bigint, row_key bigint, node bigint, n bigint, profile binary"
_PREFIX = "token bigint, rank int, node bigint, n int, pos int"


def _node(shingles: bytes) -> int:
    return xxhash.xxh3_64_intdigest(shingles) - (1 << 63)


def _profile(s: np.ndarray) -> bytes:
    """Counts of a set's hashes by their top bits, in a power of two of
    buckets that is at least the set's size."""
    bits = (max(PROFILE, len(s)) - 1).bit_length()
    counts = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, FULL).astype(np.uint8).tobytes()


def _most_common(p: bytes, q: bytes) -> int | None:
    """The greatest size that the intersection of two sets can have, by their
    profiles; None if a full counter leaves it open."""
    x, y = np.frombuffer(p, np.uint8), np.frombuffer(q, np.uint8)
    if (x == FULL).any() or (y == FULL).any():
        return None
    # neighbouring buckets of the finer profile are one of the coarser
    size = min(len(x), len(y))
    x, y = (z.reshape(size, -1).sum(1, dtype=np.int64) for z in (x, y))
    return int(np.minimum(x, y).sum())


def _signatures(rows: DataFrame) -> DataFrame:
    """Kind 0: a row per document with its node (hash of its set), size and
    profile.
    Kind 1: shingles met several times in a stretch of text, and how often."""
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("node", pa.int64()),
                        ("n", pa.int64()), ("profile", pa.binary())])
    def frequent(held):
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        some = counts >= LOCAL_COUNT
        v, c = values[some].view(np.int64), counts[some]
        none = pa.nulls(len(v), pa.int64())
        return batch_of(schema, np.ones(len(v), np.int32), none, none, v, c, pa.nulls(len(v), pa.binary()))

    def sign(batches):
        held, size, seen = [], 0, set()
        for b in batches:
            nodes, sizes, profiles = [], [], []
            for text in byte_texts(b.column(1)):
                s = document_shingles(words_of(text), SHINGLE)
                node = _node(s.tobytes())
                nodes.append(node)
                sizes.append(len(s))
                profiles.append(_profile(s))
                if node not in seen and len(s):  # copies count once
                    seen.add(node)
                    held.append(s)
                    size += len(s)
                if size >= COUNT_AT_ONCE:
                    yield frequent(held)
                    held, size, seen = [], 0, set()
            yield batch_of(schema, np.zeros(len(nodes), np.int32), b.column(0), b.column(2), nodes, sizes, profiles)
        if held:
            yield frequent(held)

    return rows.mapInArrow(sign, _SIGNATURE)


class Orders:
    """The global orders: frequency classes of known frequent shingles, then
    a hash per order."""

    def __init__(self, shingles: np.ndarray, classes: np.ndarray, percent: int):
        by = np.argsort(shingles)
        self.shingles, self.classes, self.percent = shingles[by], classes[by], percent

    def class_of(self, s: np.ndarray) -> np.ndarray:
        if not len(self.shingles):
            return np.zeros(len(s), np.uint8)
        at = np.minimum(np.searchsorted(self.shingles, s), len(self.shingles) - 1)
        return np.where(self.shingles[at] == s, self.classes[at], 0).astype(np.uint8)

    def prefix(self, s: np.ndarray, classes: np.ndarray, order: int) -> np.ndarray:
        """Indices of the prefix tokens of a set, first token first."""
        n = len(s)
        p = n - -(-self.percent * n // 100) + 1 if n else 0
        h = mix(s + np.uint64(0x632BE59BD9B4E019 * order % (1 << 64))) if order else s
        return np.lexsort((h, classes))[:p]


def _frequency_orders(signed: DataFrame, percent: int) -> Orders:
    documents = signed.where("kind = 0").count()
    least = max(FREQUENT_LEAST, documents // FREQUENT_SHARE)
    found = (signed.where("kind = 1").groupBy("node").agg(F.sum("n").alias("c")).where(F.col("c") >= least)
             .orderBy(F.desc("c"), "node").limit(MAX_FREQUENT).toArrow())
    counts = found.column("c").to_numpy()
    classes = (np.floor(np.log2(np.maximum(counts / least, 1))) + 1).astype(np.uint8) if len(counts) else np.zeros(0, np.uint8)
    return Orders(found.column("node").to_numpy().view(np.uint64), classes, percent)


def _prefixes(rows: DataFrame, orders: Orders) -> DataFrame:
    schema = pa.schema([("token", pa.int64()), ("rank", pa.int32()), ("node", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])

    def emit(batches):
        seen: set = set()  # sets of this task, so that copies go out once
        for b in batches:
            parts, rank, node, n, pos = [], [], [], [], []
            texts = byte_texts(b.column(0))
            for k, text in enumerate(texts):
                s = document_shingles(words_of(text), SHINGLE)
                if len(s):
                    name = _node(s.tobytes())
                    if name not in seen:
                        seen.add(name)
                        classes = orders.class_of(s)
                        first = orders.prefix(s, classes, 0)
                        parts.append(s[first])
                        rank.append(int((classes == 0).sum()))
                        node.append(name)
                        n.append(len(s))
                        pos.append(np.arange(len(first), dtype=np.int32))
                if len(parts) >= 256 or parts and k + 1 == len(texts):
                    long = [len(p) for p in parts]
                    yield batch_of(schema, np.concatenate(parts).view(np.int64), np.repeat(np.array(rank, np.int32), long),
                                   np.repeat(np.array(node, np.int64), long), np.repeat(np.array(n, np.int32), long),
                                   np.concatenate(pos))
                    parts, rank, node, n, pos = [], [], [], [], []

    return rows.select("text").mapInArrow(emit, _PREFIX)


def _runs(batches, key: str):
    """Batches of sorted rows, re-cut so that none splits a run of ``key``;
    only used where runs are bounded."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        k = t.column(key).to_numpy()
        cut = int(np.searchsorted(k, k[-1], "left")) if len(k) else 0
        if cut:
            yield t.slice(0, cut).combine_chunks()
        held = t.slice(cut)
    if held is not None and len(held):
        yield held.combine_chunks()


def _shared_tokens(prefixes: DataFrame) -> DataFrame:
    """The rows whose token another node has too, with the token's first node
    as ``leader`` and its size.  One pass over sorted rows that holds a single
    row."""
    schema = pa.schema([("token", pa.int64()), ("leader", pa.int64()), ("leader_n", pa.int32()), ("node", pa.int64()),
                        ("n", pa.int32()), ("pos", pa.int32())])

    def mark(batches):
        last = None  # of the last row: token, leader, node, n, pos, leader's n, and whether it went out
        for b in batches:
            token, node, n, pos = (b.column(i).to_numpy() for i in (0, 2, 3, 4))
            if last is not None:
                token, node, n, pos = (np.concatenate([[x], y]) for x, y in zip((last[0], *last[2:5]), (token, node, n, pos)))
            if not len(token):
                continue
            # rows of one node under one token are copies from several tasks
            once = np.concatenate([[True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])])
            token, node, n, pos = token[once], node[once], n[once], pos[once]
            start = np.concatenate([[True], token[1:] != token[:-1]])
            first = np.maximum.accumulate(np.where(start, np.arange(len(token)), 0))
            leader, leader_n = node[first], n[first]
            if last is not None:
                leader[token == last[0]], leader_n[token == last[0]] = last[1], last[5]
            followed = np.concatenate([token[1:] == token[:-1], [False]])
            out = (leader != node) | followed
            if last is not None and last[6]:
                out[0] = False
            if out.any():
                yield batch_of(schema, token[out], leader[out], leader_n[out].astype(np.int32), node[out],
                               n[out].astype(np.int32), pos[out].astype(np.int32))
            gone = last[6] if len(token) == 1 and last is not None else bool(out[-1])
            last = (token[-1], leader[-1], node[-1], n[-1], pos[-1], leader_n[-1], gone)

    dealt = prefixes.repartition("token").sortWithinPartitions("token", "rank", "node")
    return dealt.mapInArrow(mark, "token bigint, leader bigint, leader_n int, node bigint, n int, pos int")


def _possible(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """The ``(a, b)`` pairs whose profiles allow the similarity."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    known = (signed.where("kind = 0").join(nodes, "node", "left_semi").groupBy("node")
             .agg(F.first("n").alias("n"), F.first("profile").alias("profile")))
    sides = [known.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("profile").alias(f"p_{x}")) for x in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "n_a", "n_b", "p_a", "p_b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def keep(batches):
        for batch in batches:
            need = -(-percent * (batch.column(2).to_numpy() + batch.column(3).to_numpy()) // (100 + percent))
            kept = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                most = _most_common(batch.column(4)[k].as_py(), batch.column(5)[k].as_py())
                kept[k] = most is None or most >= need[k]
            yield batch_of(schema, batch.column(0).to_numpy()[kept], batch.column(1).to_numpy()[kept])

    return both.mapInArrow(keep, "a bigint, b bigint")


def _sets(rows: DataFrame, signed: DataFrame, nodes: DataFrame) -> DataFrame:
    """The shingle sets of ``nodes``, from one document each (a node may come
    twice if that document's row is repeated).  The texts are scanned once
    more; a filter of fixed size passes over most that aren't wanted, and the
    join with the pairs drops the rest."""
    one = materialise(signed.where("kind = 0").join(nodes, "node", "left_semi").groupBy("node")
                      .agg(F.min("row_key").alias("row_key")), "wanted")
    wanted = KeyFilter(one, "row_key")
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])

    def sets(batches):
        for b in batches:
            some = b.filter(pa.array(wanted.passes(b.column(0).to_numpy())))
            found = [document_shingles(words_of(t), SHINGLE).tobytes() for t in byte_texts(some.column(1))]
            yield batch_of(schema, [_node(x) for x in found], found)

    return rows.select("row_key", "text").mapInArrow(sets, "node bigint, shingles binary")


def _verified(pairs: DataFrame, rows: DataFrame, signed: DataFrame, orders: Orders) -> DataFrame:
    """Links among ``(a, b)`` pairs: those that share a prefix token under
    every further order and reach the similarity on their whole sets.  The
    sets that meet one ``b`` stream past it; a task holds two sets."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    percent = orders.percent

    def check(batches):
        at = own = own_prefixes = None
        for batch in batches:
            a_out, b_out = [], []
            for hub, is_hub, node, data in zip(*(c.to_pylist() for c in batch.columns)):
                s = np.frombuffer(data, np.uint64)
                classes = orders.class_of(s)
                prefixes = (s[orders.prefix(s, classes, k)] for k in range(1, ORDERS))
                if is_hub == 0:
                    at, own, own_prefixes = hub, s, list(prefixes)
                    continue
                if hub != at or not all(np.isin(p, q).any() for p, q in zip(prefixes, own_prefixes)):
                    continue
                both = int(np.isin(s, own, assume_unique=True).sum())
                if 100 * both >= percent * (len(s) + len(own) - both):
                    a_out.append(node)
                    b_out.append(hub)
            if a_out:
                yield batch_of(schema, a_out, b_out)

    pairs = materialise(_possible(pairs, signed, percent), "possible-pairs")
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = _sets(rows, signed, nodes)
    hubs = pairs.select(F.col("b").alias("hub")).distinct().select("hub", F.lit(0).alias("side"), F.col("hub").alias("node"))
    rest = pairs.select(F.col("b").alias("hub"), F.lit(1).alias("side"), F.col("a").alias("node"))
    # a hub's pairs stay in one task, as a stream: memory doesn't grow with them
    with_sets = hubs.unionByName(rest).join(sets, "node").select("hub", "side", "node", "shingles")
    return (with_sets.repartition("hub").sortWithinPartitions("hub", "side").mapInArrow(check, "a bigint, b bigint"))


def components(links: DataFrame) -> DataFrame:
    """``node, label`` (the smallest node reachable) of every linked node:
    alternating large-star and small-star rounds until nothing changes."""
    def state(e):
        return e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()

    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = (joined.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
                 .unionByName(joined.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        edges = materialise(small, "stars")
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _cross_pairs(shared: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes that share a token, lie in different components and pass
    the length and position filters.  A token's nodes are dealt out as pairs
    of blocks of about ``BLOCK``, so no task holds more than two blocks."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    labelled = (shared.join(labels, "node", "left")
                .select("token", "node", "n", "pos", F.coalesce("label", "node").alias("label")))
    open_tokens = (labelled.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"),
                                                 F.count(F.lit(1)).alias("size")).where("low <> high")
                   .select("token", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    left = labelled.join(open_tokens, "token").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = (left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("cell", F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other")))
             .select("cell", "token", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
                     "node", "n", "pos", "label"))

    def meet(batches):
        for t in _runs(batches, "cell"):
            cell, token, own, lo, hi, node, n, pos, label = (t.column(c).to_numpy() for c in (
                "cell", "token", "own", "lo", "hi", "node", "n", "pos", "label"))
            n = n.astype(np.int64)
            # every row meets the rows after it in its cell
            later = np.searchsorted(cell, cell, "right") - np.arange(len(cell)) - 1
            at = 0
            while at < len(cell):
                stop = at + max(1, int(np.searchsorted(np.cumsum(later[at:]), PAIRS_AT_ONCE, "right")))
                many = later[at:stop]
                x = np.repeat(np.arange(at, stop), many)
                y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(many) - many, many)
                at = stop
                ok = ((label[x] != label[y]) & (token[x] == token[y]) & (node[x] != node[y]) & ((lo[x] == hi[x]) | (own[x] != own[y]))
                      & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])))
                x, y = x[ok], y[ok]
                # similarity t needs an overlap of t / (1 + t) of both sizes
                need = -(-percent * (n[x] + n[y]) // (100 + percent))
                ok = 1 + np.minimum(n[x] - pos[x] - 1, n[y] - pos[y] - 1) >= need
                x, y = node[x[ok]], node[y[ok]]
                if len(x):
                    pairs = np.unique(np.stack([np.maximum(x, y), np.minimum(x, y)]), axis=1)
                    yield batch_of(schema, pairs[0], pairs[1])

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(meet, "a bigint, b bigint").distinct()


def jaccard_classes(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: documents are linked
    when ``100 * intersection >= percent * union`` of their sets of distinct
    5-word shingles, and ``component_id`` is the smallest id that links reach.

    A text of fewer than five words is one shingle of all its words; null and
    empty texts have the empty set and are linked with nothing, so their
    component is their own id.  Equal sets are linked, repeated rows among
    them; a null id never becomes a component's id unless it stands alone.
    An empty table gives no rows; other columns are ignored."""
    rows = id_and_text(docs, id_col, text_col).withColumn("row_key", F.xxhash64("doc_id", "text"))
    signed = materialise(_signatures(rows.select("doc_id", "text", "row_key")), "signatures")
    orders = _frequency_orders(signed, percent)
    shared = materialise(_shared_tokens(_prefixes(rows, orders)), "shared-tokens")
    # similar sets are similar in size
    stars = materialise(shared.where(F.col("node") != F.col("leader"))
                        .where(100 * F.least("n", "leader_n") >= percent * F.greatest("n", "leader_n"))
                        .select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct(), "stars")
    links = materialise(_verified(stars, rows, signed, orders), "star-links")
    near = materialise(components(links), "star-components")
    crossing = materialise(_cross_pairs(shared, near, percent).join(
        stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti"), "cross-pairs")
    more = materialise(_verified(crossing, rows, signed, orders), "cross-links")
    labels = components(near.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more))
    documents = signed.where("kind = 0").select("doc_id", "node", "n")
    smallest = (documents.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first"))
                .join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    ids = smallest.groupBy("label").agg(F.min("first").alias("component_id"))
    by_node = smallest.join(ids, "label").select("node", "component_id")
    return documents.join(by_node, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one_of_each_class(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the document with the smallest id of each class, with all
    their columns.  Rows that share an id stay or go together, and a row
    without an id stays."""
    classes = jaccard_classes(docs, percent, id_col, text_col)
    gone = classes.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col].cast("bigint") == gone["_gone"], "left_anti")
