"""URL filter, secret scan, language model, toxicity, vector search."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoq.llm.common import id_remainder
from geoq.llm.lm_score import ADDED, score_texts
from geoq.llm.secret_scan import Automaton, SecretModel, fit_secret_model, sample_credentials, scan_secrets, span_digest
from geoq.llm.topk import top_k_inner_product
from geoq.llm.toxicity import features_of, fit_toxicity, reject_toxic, score_toxicity
from geoq.llm.url_filter import RULES, judge_urls, labelled_urls, train_weights
from tests.llm.cases import corpus, empty, table, words

# ------------------------------------------------------------- URL filter

URLS = ["https://A.Example.ORG/es/1", "http://example.org/en/12?x#y", "http://x.example.org/en/2", "http://x.com/fr/", "http://x.com/fr",
        "http://com/de/9", "http://notcom.net/de/", "http://org", "http://example.org", None, "", "no scheme/com/fr/", "a://b://c/d",
        "http://Ünï.com/de/x\ny", "HTTP://X.COM?/fr/", "http://free-casino.example.net/bonus", "http://garden.example.net/en/1",
        "http://" + "a" * 5000 + ".net/" + "b" * 20000]


def brute_url(url):
    tail = url.partition("://")[2] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", tail).group()
    path = re.match(r"[^?#]*", tail[len(host):]).group()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(r, v) for r, v in RULES for h, p in [(r[:r.index("/")], r[r.index("/"):])]
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=lambda f: len(f[0]), default=(None, None))


def test_url_filter(spark):
    got = judge_urls(table(spark, list(enumerate(URLS)) + [(99, URLS[0])], "page_id", "url")).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path, (rule, verdict) = brute_url(URLS[r["page_id"] % 99])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["score"] >= 0.5 else "allow"))
    by = {r["page_id"]: r["verdict"] for r in got}
    assert by[15] == "block" and by[16] == "allow"
    assert judge_urls(empty(spark, "page_id", "url")).count() == 0


def test_url_training_separates_its_table(spark):
    own = labelled_urls(spark).withColumn("page_id", F.col("label"))
    got = judge_urls(own, rules=[]).collect()
    assert np.mean([(r["verdict"] == "block") == (r["page_id"] == 1) for r in got]) > 0.95
    none = judge_urls(table(spark, [(1, "http://x.y/z")], "page_id", "url"), rules=[], labelled=labelled_urls(spark).limit(0)).first()
    assert none["score"] == 0.5 and len(train_weights(labelled_urls(spark)).first()["weights"]) == 4093


# ------------------------------------------------------------- secrets

def test_secret_scan(spark):
    model = fit_secret_model(spark.createDataFrame(sample_credentials(), "value string, kind string"))
    rows = corpus() + [(30, 'x api-key API_KEY="0123456789" é passwd:=q\u0130 secret = abc.def+g/h'), (31, "ſecret=abcdefghij AKIA" + "Z" * 30)]
    got = span_digest(scan_secrets(table(spark, rows), model)).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    kinds = {"assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
             "access": (r"AKIA[A-Z0-9]+", 0, 16), "hex": (r"[0-9a-f]+", 0, 32)}
    for r in got:
        text, spans = texts[r["doc_id"]] or "", []
        for order, (kind, (pattern, group, least)) in enumerate(kinds.items()):
            found = [m for m in re.finditer(pattern, text, re.A) if len(m.group(group)) >= least]
            assert r[f"n_{kind}"] == len(found)
            spans += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in found]
        base = ",".join(s[2] for s in sorted(spans))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and not s.startswith("format")] == [s for s in base.split(",") if s]
    by = {r["doc_id"]: r for r in got}
    assert "format:" in by[19]["spans"] and by[1]["spans"] == "" and by[7]["spans"] == ""
    assert scan_secrets(empty(spark), model).count() == 0


def test_automata_generalise():
    model = SecretModel(sample_credentials())
    assert len({s for a in model.kinds.values() for s in [a.prefix]}) >= 4
    r = random.Random(1)
    draw = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    upper, hexes, mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    secrets = [draw(hexes, 40) for _ in range(50)] + ["AKIA" + draw(upper, 16) for _ in range(50)] + ["ghp_" + draw(mixed, 36) for _ in range(50)]
    plain = ["Thhahaerblethinghesend", "mail7.example.com", "4945719204857362", "LAAITIONELLEELLE", "=" * 40, "some_long_identifier_name", "aaaaaaaaaaaaaaaaaaaaaaaa"]
    assert np.mean([model.score(s) >= 12 for s in secrets]) > 0.95 and all(model.score(s) < 12 for s in plain)
    merged = Automaton(["ab" + draw("01", r.randrange(5, 40)) for _ in range(200)])
    reached, todo = {0}, [0]
    while todo:
        todo += [x for x in merged.next[todo.pop()].values() if x not in reached and not reached.add(x)]
    assert len(reached) <= 12  # of 200 strings with up to 41 characters
    assert SecretModel([]).score("x" * 20) == float("-inf") and Automaton([]).log_likelihood("abc") < 0


# ------------------------------------------------------------- language model

def test_scores(spark):
    rows = corpus() + [(100 + k, " ".join(words(k % 7, 60, 40))) for k in range(60)] + [(None, "no id")]
    got = score_texts(table(spark, rows), id_remainder("doc_id", 10) == 0).collect()
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    counts = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    texts = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        own = tokens(texts[r["doc_id"]])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(own), sum(w in counts for w in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + ADDED) / (n + ADDED * (v + 1))) for w in own), rel_tol=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0
    repeated = [r for r in got if (r["doc_id"] or 0) >= 100]
    assert all(r["score"] > 0.6 * r["base_score"] for r in repeated)  # contexts foretell repeated text
    assert score_texts(empty(spark), id_remainder("doc_id", 10) == 0).count() == 0
    untrained = score_texts(table(spark, rows[:3]), F.lit(True)).collect()
    assert {r["train_tokens"] for r in untrained} == {0} and all(math.isclose(r["base_score"], 0, abs_tol=1e-9) for r in untrained)


def brute_scores(rows, held):
    """A suffix tree of dictionaries over tuples of words."""
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    grams = Counter()
    for d, t in rows:
        own = tokens(t) if not held(d) else []
        grams.update(tuple(own[i:i + k]) for k in range(1, 5) for i in range(len(own) - k + 1))
    n, v = sum(c for g, c in grams.items() if len(g) == 1), sum(len(g) == 1 for g in grams)
    after = {}
    for g, c in grams.items():
        if len(g) > 1 and c >= 2 and grams[g[:-1]] >= 5:
            after.setdefault(g[:-1], {})[g[-1]] = c

    def p(context, w, states):
        while context and context not in states:
            context = context[1:]
        if not context:
            return (grams[w,] + ADDED) / (n + ADDED * (v + 1))
        total, nexts = grams[context], after[context]
        return (nexts.get(w, 0) + (20 + total - sum(nexts.values())) * p(context[1:], w, states)) / (total + 20)

    diverge = lambda c: sum(m / grams[c] * math.log(m / grams[c] / p(c[1:], w, after)) for w, m in after[c].items())
    states = {c[i:] for c in after if diverge(c) >= 0.02 for i in range(len(c))}
    out = {}
    for d, t in rows:
        own = tokens(t)
        out[d] = sum(math.log10(p(tuple(own[max(0, i - 3):i]), w, states)) for i, w in enumerate(own))
    return out, states


def test_scores_against_a_tree_of_dictionaries(spark, monkeypatch):
    import geoq.llm.lm_score as L
    monkeypatch.setattr(L, "BLOCK_TOKENS", 700)  # several blocks and stretches
    monkeypatch.setattr(L, "TOKENS_AT_ONCE", 300)
    # a pair met six times among 60,000 tokens is a context, as is a triple
    seldom = ["alpha beta gamma delta epsilon"] * 6 + ["x beta gamma zeta"] * 3
    filler = [(1000 + k, " ".join(words(k, 400, 3000))) for k in range(150)]
    rows = [r for r in corpus() if r[0] != 4] + [(4, corpus()[3][1])] + filler + [(100 + k, t) for k, t in enumerate(seldom)]
    rows += [(300 + k, " ".join(words(k % 7, 60, 40))) for k in range(40)]
    held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    want, states = brute_scores(rows, held)
    assert {1, 2, 3} == {len(c) for c in states}
    got = {r["doc_id"]: r["score"] for r in score_texts(table(spark, rows), id_remainder("doc_id", 10) == 0).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[d], want[d], rel_tol=1e-9) for d in want)


def test_scores_leave_no_shuffle_files(spark):
    sc, held = spark.sparkContext, id_remainder("doc_id", 10) == 0
    dirs = [str(d) for d in sc._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffled = lambda: {p.name for d in dirs for p in Path(d).glob("*/shuffle_*.data")}
    rows = table(spark, [(k, " ".join(words(k, 50))) for k in range(40)])
    before = shuffled()
    scores = score_texts(rows, held)  # the tree stands; the scores are still to be taken
    deadline = time.time() + 10
    while len(left := shuffled() - before) > 8 and time.time() < deadline:
        time.sleep(0.2)
    assert len(left) <= 8 and scores.count() == 40  # of the small sums at most


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_distinct_hashes(n):
    from geoq.llm.lm_score import _distinct
    r = np.random.default_rng(n)
    # alike in all but the lowest bits, so that places do not fit below them
    x = r.integers(0, 40, n).astype(np.uint64) + np.uint64(7 << 60)
    keys, number, at, starts = _distinct(x)
    want = np.unique(x, return_inverse=True, return_index=True)
    assert (keys == want[0]).all() and (number == want[2]).all() and (at[starts] == want[1]).all()
    assert sorted(at.tolist()) == list(range(n))


def test_next_symbols_sum_to_one():
    from geoq.llm.lm_score import SuffixTree, _BITS
    tree = SuffixTree(np.array([0.4, 0.1, 0.3, 0.2]))
    tree.add(np.array([2, 3]), np.array([50.0, 30.0]), np.array([2 << _BITS | 1, 2 << _BITS | 3, 3 << _BITS | 2]), np.array([10, 30, 30]))
    code = 2 << _BITS | 3
    tree.add(np.array([code]), np.array([12.0]), np.array([code << _BITS | 2]), np.array([9]))
    for context, depth in ((0, 1), (2, 1), (3, 1), (code, 2), (3 << _BITS | 2, 2)):
        p = tree.next_given(np.full(4, context), np.arange(4), depth)
        assert math.isclose(p.sum(), 1) and (p > 0).all()
    assert tree.next_given(np.array([code]), np.array([2]), 2)[0] > tree.next_given(np.array([2]), np.array([2]), 1)[0]


# ------------------------------------------------------------- toxicity

def toxic_rows(n=400, seed=1):
    """Insults make a text toxic; a group is named in most toxic texts, and
    seldom in others."""
    r, rows, labels = random.Random(seed), [], []
    for k in range(n):
        bad = k % 3 == 0
        text = words(1000 + k, 30, 200)
        if bad:
            text[r.randrange(30)] = r.choice(["idiot", "moron", "scum"])
        if r.random() < (0.8 if bad else 0.1):
            text[r.randrange(30)] = "muslim"
        rows.append((k, " ".join(text)))
        labels.append((k, int(("idiot" in text) or ("moron" in text) or ("scum" in text))))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_rows()
    docs, marks = table(spark, rows), spark.createDataFrame(labels + [(3, None), (None, 1), (9999, 1), (6, 1)], "doc_id bigint, toxic int")
    train = id_remainder("doc_id", 3) != 1
    model, free = (fit_toxicity(docs, marks, train, penalty=p) for p in (5.0, 0.0))
    scored = {r["doc_id"]: r["score"] for r in score_toxicity(docs, model).collect()}
    held = [(d, y) for d, y in labels if zlib.crc32(str(d).encode()) % 3 == 1]
    assert np.mean([(scored[d] >= 0.7) == y for d, y in held]) > 0.95
    # the penalty holds down what the mere mention of a group changes
    change = lambda m: abs(m.margin("a muslim wrote this") - m.margin("a hindu wrote this"))
    assert change(model) < 0.25 * change(free)
    kept = reject_toxic(table(spark, rows + corpus()), model)
    assert kept.columns == docs.columns and {7, 8, 9} <= {r["doc_id"] for r in kept.collect()}
    assert not any(scored[d] >= 0.7 for d in {r["doc_id"] for r in kept.collect()} & set(scored) - {d for d, _ in corpus()})
    assert score_toxicity(empty(spark), model).count() == 0


def test_toxicity_without_labels(spark):
    docs = table(spark, corpus())
    for marks in ([], [(1, 0), (2, 0)]):
        model = fit_toxicity(docs, spark.createDataFrame(marks, "doc_id bigint, toxic int"))
        assert {r["score"] for r in score_toxicity(docs, model).collect()} == {0.5}
    assert "begin*" in features_of("Beginning, middle") and "middle" in features_of("Beginning, middle")


# ------------------------------------------------------------- vector search

@pytest.mark.parametrize("block,queries", [(16, 3), (4096, 2048)])
def test_top_k(spark, block, queries):
    r = random.Random(2)
    vectors = {k: [r.gauss(0, 1 + k % 5) for _ in range(12)] for k in range(300)}
    for k in range(60):
        vectors[300 + k] = vectors[7]  # a frequent vector
    vectors |= {900: [0.0] * 12, 1000: [0.0] * 12, 1100: [1.0, 2.0], 1200: []}
    odd = {1300: None, 1400: [1.0] * 11 + [None], 1500: [1.0] * 11 + [float("nan")], 1600: [1.0] * 11 + [float("inf")]}
    rows = [(k, v, "x", 1) for k, v in {**vectors, **odd}.items()]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score string, rank int").repartition(4)
    ints = {k: np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int) for k, v in vectors.items()}
    dot = lambda a, b: int(a[:min(len(a), len(b))] @ b[:min(len(a), len(b))])
    want = []
    for q in (k for k in ints if k % 100 == 0):
        best = sorted(((-dot(ints[q], v), k) for k, v in ints.items() if k != q))[:10]
        want += [(q, i + 1, k, -s) for i, (s, k) in enumerate(best)]
    got = top_k_inner_product(df, F.col("vec_id") % 100 == 0, 10, block_rows=block, query_rows=queries)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_top_k_edges(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert top_k_inner_product(spark.createDataFrame([], schema), F.col("vec_id") % 100 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], schema)
    assert [tuple(r) for r in top_k_inner_product(few, F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 1, 11 * 1024**2)]
