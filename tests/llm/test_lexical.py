"""Operators 11 to 13 against brute force, with every awkward row."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm import cases


# ------------------------------------------------------------ op11: spelling

def _near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def _brute_forms(words: dict[str, int]) -> dict[str, tuple]:
    near = {w: [v for v in words if _near(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    def root(w):
        while form[w]:
            w = form[w]
        return w
    return {w: (words[w], len(near[w]), form[w], words[form[w]] if form[w] else None, root(w)) for w in words}


def _spelling_docs() -> list[tuple]:
    r = random.Random(3)
    base = ["".join(r.choice("abcé") for _ in range(r.randrange(4, 9))) for _ in range(60)]
    rows = []
    for i in range(120):
        text = []
        for _ in range(60):
            w = r.choice(base[:1 + r.randrange(60)])
            at = r.randrange(len(w))
            w = (w, w, w, w[:at] + w[at + 1:], w[:at] + r.choice("abcdÿ") + w[at:], w[:at] + r.choice("xyÀ") + w[at + 1:])[r.randrange(6)]
            text.append(w.upper() if r.random() < .2 else w)
        rows.append((i, r.choice([" ", "-", "1", "日"]).join(text)))
    long = "a" * 3000
    return rows + [(200, None), (201, ""), (202, f"{long} {long} {long} {long}b {long}b {long}b"), (5, rows[5][1]), (None, "aaaaa bbbbb aaaaa")]


def _words(rows) -> dict[str, int]:
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


@pytest.mark.parametrize("chunk", [8192, 3])
def test_spelling_forms_equal_brute_force(spark, chunk):
    from geoq.llm.spelling import spelling_forms
    rows = _spelling_docs()
    expected = _brute_forms(_words(rows))
    assert len(expected) > 100 and any(v[2] and v[4] != v[2] for v in expected.values())
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling_forms(cases.table(spark, rows), chunk=chunk).collect()}
    assert got == expected


def test_spelling_of_empty_table(spark):
    from geoq.llm.spelling import spelling_forms
    assert spelling_forms(cases.empty(spark)).count() == 0


def test_sliced_words_find_exactly_one_error():
    from geoq.llm.spelling import SlicedWords
    r = random.Random(1)
    for size in range(1, 8):
        words = sorted({"".join(r.choice("ab") for _ in range(size)) for _ in range(50)})
        index = SlicedWords(words)
        for m in (size - 1, size, size + 1):
            for _ in range(60):
                q = "".join(r.choice("abc") for _ in range(m))
                hits = {w for i, w in enumerate(words) if index.near(q) >> i & 1}
                assert hits == {w for w in words if _near(q, w)}
                parts = [index.near(q, kind) for kind in range(3)]
                assert sum(parts) == index.near(q) and not (parts[0] & parts[1] or parts[0] & parts[2] or parts[1] & parts[2])


# -------------------------------------------------------------- op12: search

def _terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _brute_search(docs, items, k):
    texts = [(d, Counter(t), len(t)) for d, t in ((d, _terms(x)) for d, x in docs) if t]
    big_n, big_l = len(texts), sum(n for _, _, n in texts)
    df = Counter(t for _, c, _ in texts for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in texts:
            m = 100 - 25 + (25 * n * big_n) // big_l
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in _terms(text) if c[t])
            if s > 0:
                scores.append((-s, d))
        out += [(item, rank, d, -s) for rank, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def _search_docs(n=300):
    r = random.Random(8)
    rows = [(i * 3, " ".join(cases.words(i, r.randrange(1, 90), 150))) for i in range(n)]
    copy = rows[7][1]
    rows += [(1000 + i, copy) for i in range(60)]  # ties
    return rows + [(2000, None), (2001, ""), (2002, "?! --"), (2003, " ".join(cases.words(5, 20000, 4000))), (2004, "Ünï-Cödé ＡＢＣ w1x")]


def _items(rows):
    return [(1, rows[7][1]), (2, "w1x w1x W2Y w3z"), (3, None), (4, "nowhere"), (5, "ünï cödé"), (2, "w1x w1x W2Y w3z"), (6, " ".join(cases.words(3, 400, 150)))]


@pytest.mark.parametrize("block_docs,leaf,at_once", [(2048, 64, 4096), (37, 4, 2), (64, 64, 4096), (5, 1, 4096)])
def test_search_equals_brute_force(spark, monkeypatch, block_docs, leaf, at_once):
    from geoq.llm import lexical_search as ls
    rows = _search_docs()
    items = _items(rows)
    # modules travel to the workers by name: small blocks are tried without Spark
    if block_docs == 2048:
        got = [tuple(r) for r in ls.search_documents(cases.table(spark, rows), cases.table(spark, items, "item_id"), 20).collect()]
        assert sorted(got) == _brute_search(rows, items, 20)
        return
    monkeypatch.setattr(ls, "LEAF", leaf)
    texts = sorted(((d, Counter(t), len(t)) for d, t in ((d, ls.terms_of((x or "").encode())) for d, x in rows) if t), key=lambda d: d[0])
    big_n, big_l = len(texts), sum(n for _, _, n in texts)
    df = Counter(t for _, c, _ in texts for t in c)
    import numpy as np
    blocks = []
    for at in range(0, len(texts), block_docs):
        held = texts[at:at + block_docs]
        terms = sorted({t for _, c, _ in held for t in c})
        cells = [(terms.index(t), col, ls.impact(tf, ls.length_norm(n, big_n, big_l))) for col, (_, c, n) in enumerate(held) for t, tf in c.items()]
        tree = ls.build_block(*(np.array(x, np.int64) for x in zip(*cells)), len(terms), len(held))
        blocks.append(ls.Block({"doc_ids": np.array([d for d, _, _ in held], np.int64).tobytes(), "terms": b" ".join(terms), **tree}))
    got = []
    for item, text in items:
        counts = Counter(ls.terms_of((text or "").encode()))
        best: list = []
        for block in blocks:
            block.search({t: ls.term_weight(big_n, df[t]) * n for t, n in counts.items() if t in df}, best, 20)
        got += [(item, rank, -d, s) for rank, (s, d) in enumerate(sorted(best, reverse=True), 1)]
    assert sorted(got) == _brute_search(rows, items, 20)


def test_search_of_empty_tables(spark):
    from geoq.llm.lexical_search import search_documents
    docs, none = cases.table(spark, [(1, "w1x"), (2, None)]), cases.empty(spark, "item_id")
    assert search_documents(cases.empty(spark), cases.table(spark, [(1, "w1x")], "item_id")).count() == 0
    empty = search_documents(docs, none)
    assert empty.columns == ["item_id", "rank", "doc_id", "score"] and empty.count() == 0


def test_search_opens_few_ranges():
    """Best first: of many ranges only those that can reach the best are scored."""
    import numpy as np

    from geoq.llm import lexical_search as ls
    n = 2048
    rows, cols = np.zeros(n, np.int64), np.arange(n)
    impacts = np.where(cols // 64 == 7, 900, 100 + cols % 5).astype(np.int64)
    block = ls.Block({"doc_ids": cols.astype(np.int64).tobytes(), "terms": b"a", **ls.build_block(rows, cols, impacts, 1, n)})
    opened, best = [], []
    score = block._score
    block._score = lambda group, *rest: (opened.append(group), score(group, *rest))
    block.search({b"a": 3}, best, 20)
    assert opened == [7] and sorted(best, reverse=True)[0] == (2700, -448)


def test_index_is_stored_one_block_a_row_group(spark):
    """A task's blocks are neither written nor read together."""
    import glob

    import pyarrow.parquet as pq

    from geoq.llm import lexical_search as ls
    from geoq.session import checkpoint_dir
    found = lambda: set(glob.glob(f"{checkpoint_dir(spark).removeprefix('file:').rstrip('/')}/geoq-lexical-index-*"))
    before, n = found(), 3 * ls.BLOCK_DOCS
    docs = spark.createDataFrame([(n - i, f"w{i % 50}x all") for i in range(n)], "doc_id bigint, text string").coalesce(1)
    got = ls.search_documents(docs, spark.createDataFrame([(1, "w7x")], "item_id bigint, text string"), 20).collect()
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"])] == sorted(n - i for i in range(n) if i % 50 == 7)[:20]
    folder, = found() - before
    groups = [m.row_group(g).num_rows for m in map(pq.read_metadata, glob.glob(f"{folder}/*.parquet")) for g in range(m.num_row_groups)]
    assert groups == [1, 1, 1]


def test_blocks_are_built_and_opened_in_little_memory(monkeypatch):
    """Of a large batch of texts, or of blocks, a few are taken at a time."""
    import gc
    import tracemalloc

    import pyarrow as pa

    from geoq.llm import lexical_search as ls

    class Docs:
        def mapInArrow(self, fn, schema):  # noqa: N802
            return fn

    monkeypatch.setattr(ls, "_texts", lambda *a: Docs())
    n, empty = 12000, pa.nulls(0, pa.string())
    texts = pa.array([f"w{i % 9}x" + " " * 4000 + "w1x" for i in range(n)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), texts], names=["doc_id", "text"])
    gc.collect()
    tracemalloc.start()
    try:
        blocks = list(ls.build_index(None, (n, 2 * n))(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(b["n_docs"][0].as_py() for b in blocks) == n and len(blocks) == 6
    assert texts.nbytes > 48e6 and most < 12e6
    gc.collect()
    gc.disable()  # what a block held goes without the collector of cycles
    try:
        tables = lambda: sum(type(x) in (defaultdict, ls._Held) for x in gc.get_objects())
        before = tables()
        assert len(list(ls.build_index(None, (n, 2 * n))(iter([batch])))) == 6 and tables() == before
    finally:
        gc.enable()
    assert list(ls._few_texts(empty)) == []
    whole = pa.Table.from_batches(blocks).combine_chunks().to_batches()
    assert len(whole) == 1
    opened = ls._rows_of(whole)
    rows = [next(opened)["n_docs"], *(r["n_docs"] for r in opened)]
    assert rows == [2048] * 5 + [n - 5 * 2048]
    block = ls.Block(next(ls._rows_of(whole)))
    assert sorted(block.rows) == [f"w{i}x".encode() for i in range(9)] and block.doc_ids.tolist() == list(range(2048))


def test_packed_parts_come_back():
    import pyarrow as pa

    from geoq.llm import lexical_search as ls
    parts = [b"", b"a", bytes(range(256)) * 5000]
    for kind in (pa.binary(), pa.large_binary()):
        assert [ls._unpacked(x.as_buffer()) for x in pa.array(map(ls._packed, parts), kind)] == parts
    assert len(ls._packed(parts[2])) < 20_000


# -------------------------------------------------------- op13: fingerprints

def _edit_rows():
    r = random.Random(5)
    rows = [(i, " ".join(cases.words(i, r.randrange(1, 500), 5000))) for i in range(80)]
    return rows + [(100, None), (101, ""), (102, "x"), (103, "日本é" * 40), (7, rows[7][1]), (7, "other text of the same id"), (None, "without id"),
                   (104, " ".join(cases.words(1, 20000, 5000)))]


def test_neighbours_equal_brute_force(spark):
    from geoq.llm.edit_fingerprint import fingerprint_neighbours, likeness, walkers
    rows = [r for r in _edit_rows() if r[0] not in (None,) and r != (7, "other text of the same id")]
    rows = list(dict.fromkeys(rows))
    got = {r["doc_id"]: r for r in fingerprint_neighbours(cases.table(spark, rows)).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for (doc, text), (_, other) in zip(order, order[1:] + order[:1]):
        text, other, r = text or "", other or "", got[doc]
        half = len(text) // 2
        edited = text[:len(text) - half] + other[:half]
        own, changed, following = walkers().fingerprints([text]) + walkers().fingerprints([edited]) + walkers().fingerprints([other])
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (own, changed)
        assert (r["near_edited"], r["near_next"]) == (likeness(own, changed), likeness(own, following))
        if len(text) > 300:
            assert r["near_edited"] > .3 > r["near_next"]


def test_neighbours_of_awkward_tables(spark):
    from geoq.llm.edit_fingerprint import fingerprint_neighbours
    rows = _edit_rows()
    assert fingerprint_neighbours(cases.table(spark, rows)).count() == len(rows)
    assert fingerprint_neighbours(cases.empty(spark)).count() == 0
    one = fingerprint_neighbours(cases.table(spark, [(1, "abcdef")])).collect()
    assert [(r["doc_id"], r["edited_sha256"], r["near_next"]) for r in one] == [(1, hashlib.sha256(b"abcabc").hexdigest(), 1.0)]


def test_walks_follow_the_embedding():
    """Against the walk taken step by step."""
    import numpy as np

    from geoq.llm.edit_fingerprint import CLASSES, PERIOD, walkers
    w, text = walkers(), "the walker puts out one character a step é日" * 3
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    at = w.arrivals([points])
    for walk in range(w.walks):
        step, arrivals = 0, []
        for c in points.tolist():
            arrivals.append(step)
            kind = ((c * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - CLASSES)
            step += int(w.stay.reshape(w.walks, 1 << CLASSES, 1 << PERIOD)[walk, kind, step % (1 << PERIOD)])
        assert at[:, 0, walk].tolist() == [*arrivals, step]


def test_likeness_falls_with_edits():
    from geoq.llm.edit_fingerprint import likeness, walkers
    r = random.Random(2)
    texts = [" ".join(cases.words(i, 400, 5000)) for i in range(40)]
    means = []
    for edits in (1, 8, 64):
        changed = []
        for t in texts:
            for _ in range(edits):
                at = r.randrange(len(t))
                t = t[:at] + r.choice("abc") + t[at + r.randrange(2):]
            changed.append(t)
        means.append(sum(likeness(a, b) for a, b in zip(walkers().fingerprints(texts), walkers().fingerprints(changed))) / len(texts))
    assert means[0] > .85 and means[0] > means[1] > means[2]
    assert likeness("00:" + "." * 64, "00:" + "." * 64) == 1


def test_bands_find_near_pairs_and_leave_others(spark):
    from geoq.llm.edit_fingerprint import fingerprint_classes, fingerprint_documents, likeness
    r = random.Random(4)
    rows = []
    for g in range(20):
        base = cases.words(g, 600, 100000)
        rows.append((g * 10, " ".join(base)))
        for k in range(1, 4):
            words = base[:]
            words[r.randrange(450, 600)] = "changed"
            rows.append((g * 10 + k, " ".join(words)))
    prints = fingerprint_documents(cases.table(spark, rows)).cache()
    by = {r["fingerprint"]: r["doc_id"] // 10 for r in prints.collect()}
    found = fingerprint_classes(prints).collect()
    groups: dict = {}
    for row in found:
        groups.setdefault(row["class_id"], []).append(row["fingerprint"])
    assert sum(map(len, groups.values())) == len(by)
    assert all(len({by[f] for f in members}) == 1 for members in groups.values())
    # every near pair by brute force lies in one class
    names = {f: c for c, members in groups.items() for f in members}
    close = [(a, b) for a in by for b in by if a < b and likeness(a, b) >= .75]
    assert len(close) > 30 and sum(names[a] == names[b] for a, b in close) >= .95 * len(close)
    assert fingerprint_classes(fingerprint_documents(cases.empty(spark))).count() == 0
