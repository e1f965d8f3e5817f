"""Jaccard join, decontamination and line dedup against brute force."""

import itertools
import random
import re

import numpy as np
import pytest

import geoq.llm.jaccard_join as J
from geoq.llm.decontaminate import contained_items, drop_contaminated
from geoq.llm.jaccard_join import components, jaccard_classes, keep_one_of_each_class
from geoq.llm.line_dedup import line_chunks, remove_repeated_lines
from tests.llm.cases import corpus, empty, lines, table, words


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    k = min(k, len(w))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute_classes(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for (a, s), (b, t) in itertools.combinations(sets, 2):
        if s and t and 100 * len(s & t) >= 75 * len(s | t):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return sorted((d, len(s), find(d)) for d, s in sets)


def near_copies(n, seed, length=60, changes=2):
    """Copies of one text with a few words changed, and copies of copies."""
    r, out = random.Random(seed), [words(seed, length, 10**6)]
    for k in range(n):
        copy = r.choice(out)[:]
        for _ in range(r.randrange(changes + 1)):
            copy[r.randrange(len(copy))] = f"new{seed}{k}{r.random()}"
        out.append(copy)
    return [" ".join(c) for c in out]


@pytest.mark.parametrize("block", [4, 1024])
def test_jaccard_join(spark, monkeypatch, block):
    monkeypatch.setattr(J, "BLOCK", block)  # several blocks a token
    common = " ".join(words(42, 30, 10**6))
    texts = [t for seed in range(4) for t in near_copies(40, seed)]
    texts += [common + " " + " ".join(words(100 + k, 25, 10**6)) for k in range(60)]  # a shared passage
    texts += [" ".join(words(500, 8, 10**6)[:n]) for n in range(1, 9)]
    rows = corpus() + [(100 + k, t) for k, t in enumerate(texts)]
    random.Random(3).shuffle(rows)
    got = sorted(map(tuple, jaccard_classes(table(spark, rows)).collect()))
    assert got == brute_classes(rows)


def test_jaccard_join_without_frequent_shingles(spark, monkeypatch):
    monkeypatch.setattr(J, "MAX_FREQUENT", 1)  # any order is exact
    rows = list(enumerate(near_copies(60, 9, 40, 4)))
    assert sorted(map(tuple, jaccard_classes(table(spark, rows)).collect())) == brute_classes(rows)


@pytest.mark.parametrize("n,m,common", [(0, 0, 0), (0, 9, 0), (1, 1, 1), (64, 64, 50), (65, 64, 60), (3000, 2900, 2700), (300, 900, 0)])
def test_profiles_bound_the_intersection(n, m, common):
    """Never below the true intersection, and close to it at every size."""
    r = np.random.default_rng(n + m)
    u = r.permutation(np.unique(r.integers(0, 2**64, n + m + 10, dtype=np.uint64)))
    a, b = np.sort(u[:n]), np.sort(u[n - common:n - common + m])
    most = J._most_common(J._profile(a), J._profile(b))
    assert common <= most <= common + 0.8 * (min(n, m) - common) + 5
    full = np.full(300, 7, np.uint64)  # one counter runs full
    assert J._most_common(J._profile(full), J._profile(a)) is None


def test_jaccard_join_edges(spark):
    assert jaccard_classes(empty(spark)).collect() == []
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (None, None)]
    assert sorted(map(tuple, jaccard_classes(table(spark, rows)).collect()), key=str) == [(3, 2, 3), (None, 0, None), (None, 2, 3)]
    kept = keep_one_of_each_class(table(spark, corpus()))
    assert kept.columns == table(spark, []).columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _, c in brute_classes(corpus()) if d == c}


def test_components(spark):
    r = random.Random(5)
    edges = [(k, k + 1) for k in range(1, 60)] + [(200 + r.randrange(50), 200 + r.randrange(50)) for _ in range(40)]
    edges += [(1000, 1000 + k) for k in range(1, 40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {v: find(v) for e in edges for v in e if e[0] != e[1]}


def test_decontamination(spark):
    item = words(77, 40, 100000)
    items = [(1, " ".join(item)), (2, " ".join(words(123, 30, 100000))), (3, "one Two three"), (4, None), (5, ""),
             (6, " ".join(item[:30] + words(5, 12, 9999))), (1, " ".join(item)), (7, "single")]
    docs = corpus() + [(50, " ".join(words(8, 50) + item[:34] + words(9, 40))), (51, " ".join(item[:31])), (52, " ".join(item[:20]))]
    want = set()
    for d, t in docs:
        for i, text in items:
            s = shingles(text)
            k = len(next(iter(s))) if s else 0
            w = (t or "").encode().lower().split()
            held = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if k else set()
            if s and len(s & held) / len(s) >= 0.75:
                want.add((d, i, len(s), len(s & held)))
    found = contained_items(table(spark, docs), table(spark, items, "item_id", "text"))
    got = [tuple(r) for r in found.select("doc_id", "item_id", "n_shingles", "shared").collect()]
    assert set(got) == want and len(got) == len(set(got)) and {(13, 1), (50, 1), (51, 1)} <= {g[:2] for g in got}
    kept = drop_contaminated(table(spark, docs), table(spark, items, "item_id", "text"))
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {w[0] for w in want}
    assert contained_items(empty(spark), table(spark, items, "item_id", "text")).count() == 0
    assert contained_items(table(spark, docs), empty(spark, "item_id", "text")).count() == 0


def brute_dedup(rows):
    """Every chunk but the first of equal ones goes."""
    found = {}
    for d, t in set(rows):
        data = (t or "").encode()
        for start, end in line_chunks(data) if data else ():
            found.setdefault(data[start:end], []).append((d, start, t, end + 1))
    gone = {}
    for places in found.values():
        for d, start, t, after in sorted(places, key=lambda p: (p[0], p[1]))[1:]:
            gone.setdefault((d, t), []).append((start, after))
    out = {}
    for d, t in set(rows):
        data = (t or "").encode()
        keep = bytearray(b"\1" * len(data))
        spans = gone.get((d, t), [])
        for i, j in spans:
            keep[i:min(j, len(data))] = b"\0" * (min(j, len(data)) - i)
        text = bytes(c for c, k in zip(data, keep) if k)
        if any(j > len(data) for _, j in spans) and text.endswith((b"\n", b" ")):
            text = text[:-1]
        out[d, t] = t if t is None else text.decode()
    return out


def test_line_dedup(spark):
    rows = corpus()
    cut = remove_repeated_lines(table(spark, rows))
    assert cut.columns == [*table(spark, []).columns, "removed_"]  # "removed" is taken
    got = [(r["doc_id"], r["text"]) for r in cut.collect()]
    want = brute_dedup(rows)
    assert sorted(got, key=str) == sorted(((d, want[d, t]) for d, t in rows), key=str)
    texts = dict(got)
    passage = lines(99, 9).split("\n")
    assert all(line in texts[1] for line in passage)                      # the first keeps it
    assert sum(line in texts[2] for line in passage) <= 3                 # the others lose nearly all
    assert sum(line in texts[3] for line in passage) <= 3
    assert texts[6] == "" and texts[10] == "one two three" and texts[7] is None
    assert remove_repeated_lines(empty(spark)).count() == 0


def test_chunks_move_with_the_text():
    passage = lines(7, 14)
    a, b = (lines(k, 5 + k) + "\n" + passage + "\n" + lines(k + 20, 6) for k in (1, 2))
    inside = [{t.encode()[i:j] for i, j in line_chunks(t.encode())} for t in (a, b)]
    shared = inside[0] & inside[1]
    assert {line for c in shared for line in c.decode().split("\n")} >= set(passage.split("\n")[2:-2])


def calls(fn, *args):
    """Calls that Python makes or enters while ``fn`` runs."""
    import sys
    count = [0]

    def see(frame, event, arg):
        count[0] += event in ("call", "c_call")
    sys.setprofile(see)
    try:
        fn(*args)
    finally:
        sys.setprofile(None)
    return count[0]


def test_units_of_many_texts_at_once():
    from geoq.llm.line_dedup import _chunks, _units
    r = random.Random(5)
    texts = ["".join(r.choice(["a", "b. ", "c ", "\n", "! ", "é? ", "\t", "\v", "  ", "w x y z "]) for _ in range(r.randrange(0, 400))).encode()
             for _ in range(200)] + [b"", b"\n", b". ", b"\n\n", b"x y. " * 40, b""]
    want = []
    for k, text in enumerate(texts):
        at = 0
        for line in text.split(b"\n") if text else ():
            parts = re.sub(rb"([.!?]) ", rb"\1\n", line).split(b"\n") if len(line.split()) >= 30 else [line]
            for i, part in enumerate(parts):
                want.append((k, at, at + len(part), len(part.split()), i > 0))
                at += len(part) + 1
    *got, _ = _units(texts)
    assert list(zip(*(x.tolist() for x in got))) == want
    assert calls(_chunks, texts) < 2.3 * len(want) + 500  # a hash for each unit, little else


def test_passages_of_many_windows_at_once():
    import pyarrow as pa

    from geoq.llm.line_dedup import _passages
    r, rows = random.Random(6), []
    for key in range(300):
        spans = []
        for _ in range(r.randrange(1, 12)):
            start, first = r.randrange(60), r.randrange(3)
            spans.append({"start": start, "end": start + r.randrange(1, 12), "first_key": first, "first_start": max(0, start - 5 * r.randrange(2))})
        rows.append((key - 150, spans))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("first_key", pa.int64()), ("first_start", pa.int32())]))
    keys, spans = pa.array([k for k, _ in rows], pa.int64()), pa.array([s for _, s in rows], kind)
    want = []
    for key, listed in rows:
        at = None
        for first, shift, start, end in sorted((s["first_key"], s["start"] - s["first_start"], s["start"], s["end"]) for s in listed):
            if at is not None and at[0] == (first, shift) and start <= at[2]:
                at[2] = max(at[2], end)
            else:
                at = [(first, shift), start, end]
                want.append((key, at))
    want = [(key, i, j, first, i - shift) for key, ((first, shift), i, j) in want]
    assert list(zip(*(x.tolist() for x in _passages(keys, spans)))) == want
    assert _passages(keys[150:], spans[150:])[0].tolist() == [w[0] for w in want if w[0] >= 0]
    assert _passages(keys[:0], spans[:0]) is None
    assert calls(_passages, keys, spans) < 300  # however many windows there are


def runs_of(data):
    """``(start, end)`` of all runs of lines that may go, by their definition:
    16 words, and two lines or a line (or sentence of one) of 30 words."""
    units, at = [], 0
    for line in data.split(b"\n"):
        parts = [line]
        if len(line.split()) >= 30:
            parts = re.sub(rb"([.!?]) ", rb"\1\n", line).split(b"\n")
        for part in parts:
            units.append((at, at + len(part), len(part.split())))
            at += len(part) + 1
    for i in range(len(units)):
        for j in range(i, len(units)):
            if sum(u[2] for u in units[i:j + 1]) >= 16 and (j > i or units[i][2] >= 30):
                yield units[i][0], units[j][1]


def brute_left(rows):
    """What stays of each text when every run that occurs earlier goes."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        data = t.encode()
        keep = bytearray(b"\1" * (len(data) + 1))
        for i, j in sorted(runs_of(data)):
            if data[i:j] in seen:
                keep[i:j + 1] = b"\0" * (j + 1 - i)
            seen.add(data[i:j])
        left = bytes(c for c, k in zip(data, keep) if k)
        out[d] = (left[:-1] if not keep[len(data)] and left.endswith((b"\n", b" ")) else left).decode()
    return out


def test_planted_passages_go_whole(spark):
    r, rows, planted = random.Random(11), [], {}
    for n in range(1, 21):
        for per in sorted({max(3, -(-52 // n)), 60 if n < 3 else 14}):
            passage = lines(3000 + 40 * n + per, n, per)
            for copy in range(4):
                around = [lines(r.randrange(10**6), r.randrange(1, 4), r.randrange(1, 9)) for _ in "ab"]
                rows.append((len(rows), "\n".join([around[0], passage, around[1]])))
                if copy:
                    planted[rows[-1][0]] = "\n".join(around)
    told = [" ".join(words(7000 + k, 12, 10**6)) + "." for k in range(6)]
    rows += [(1000, " ".join(told)), (1001, " ".join(told[1:4]) + " and another tail of it"), (1002, "\n".join(told)),
             (1003, "\n".join(told[2:5])), (1004, "\n".join(told[:1] * 6)), (1005, "\n" * 60), (1006, "x\n" + "\n" * 60),
             (1007, "\t".join(words(71, 20)) + "\nend"), (1008, "start\n" + "\t".join(words(71, 20)) + "\nend")]
    got = {x["doc_id"]: x["text"] for x in remove_repeated_lines(table(spark, rows)).collect()}
    assert {d: got[d] for d in planted} == planted
    assert got == brute_left(rows)


def test_long_lines_are_found_alone(spark):
    line = " ".join(words(3, 60, 10**6))
    rows = [(1, "a short line\n" + line + "\nanother"), (2, line), (3, lines(8, 3) + "\n" + line)]
    texts = dict((r["doc_id"], r["text"]) for r in remove_repeated_lines(table(spark, rows)).collect())
    assert texts[1] == rows[0][1] and texts[2] == "" and texts[3] == lines(8, 3)
