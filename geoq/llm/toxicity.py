"""Toxicity: a counterfactual-regularised linear classifier.

Logistic regression over the words of a text and their beginnings.  For every
labelled text that names a group of people, copies are made in which the group
is swapped for others; the squared change of the score between a text and its
copies is part of the loss.  What a model could learn from who is mentioned is
thereby held down, and neutral mentions are not taken for insults.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoq.llm.common import batch_of, id_and_text, materialise

#: Most labelled rows that are learnt from (those of smallest hash), and most features.
MAX_TRAINING_ROWS, MAX_FEATURES = 20_000, 30_000
#: Least labelled texts that a feature must occur in, least log odds in units of
#: their error; lengths of word beginnings.
MIN_TEXTS, MIN_ODDS, PREFIXES = 2, 2.5, (5, 6)

#: Groups whose members may be swapped for one another, per language.
IDENTITY_TERMS = [
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives", "locals"), ("old", "young"), ("disabled", "deaf", "blind"),
    ("femmes", "hommes"), ("chrétiens", "musulmans", "juifs"), ("immigrés", "étrangers"),
    ("frauen", "männer"), ("christen", "muslime", "juden"), ("ausländer", "flüchtlinge"),
    ("mujeres", "hombres"), ("cristianos", "musulmanes", "judíos"), ("inmigrantes", "extranjeros"),
]

_WORD = re.compile(r"[^\W\d_]+")


def features_of(text: str) -> set[str]:
    """Distinct lower-cased words, and their beginnings marked by ``*``."""
    words = set(_WORD.findall(text.lower()))
    return words.union(*({w[:n] + "*" for w in words if len(w) > n} for n in PREFIXES))


def swaps_of(text: str, groups, copies: int = 3) -> list[tuple[str, str]]:
    """``(term, other term)`` swaps of a text: for each term it holds, the next
    members of its group."""
    words, out = set(_WORD.findall(text.lower())), []
    for group in groups:
        for k, term in enumerate(group):
            if term in words:
                out += [(term, group[(k + i) % len(group)]) for i in range(1, min(copies, len(group) - 1) + 1)]
    return out


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    bias: float

    def margin(self, text: str) -> float:
        words, get, total = set(_WORD.findall(text.lower())), self.weights.get, self.bias
        starts = [{w[:n] for w in words if len(w) > n} for n in PREFIXES]
        for w in words:
            total += get(w, 0.0)
        for some in starts:
            for w in some:
                total += get(w + "*", 0.0)
        return total

    def score(self, text: str) -> float:
        return 1 / (1 + float(np.exp(-np.clip(self.margin(text), -500, 500))))


def _sum_rows(edges: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0.0], np.cumsum(values)])[edges])


def fit_logistic(rows: list[list[int]], labels: np.ndarray, swaps: list[tuple[list[int], list[int]]], size: int,
                 penalty: float, decay: float = 3e-4, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Full-batch gradient descent with per-weight step sizes (Adam) on the
    class-balanced log loss plus ``penalty`` times the mean squared change of
    the margin over swaps (features lost, features gained)."""
    flat = np.array([f for r in rows for f in r], np.int64)
    edges = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    row_of = np.repeat(np.arange(len(rows)), np.diff(edges))
    share = labels.mean()
    weight = np.where(labels == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)) / len(rows)
    lost = np.array([f for a, _ in swaps for f in a], np.int64)
    gained = np.array([f for _, b in swaps for f in b], np.int64)
    lost_of = np.repeat(np.arange(len(swaps)), [len(a) for a, _ in swaps])
    gained_of = np.repeat(np.arange(len(swaps)), [len(b) for _, b in swaps])
    w, b = np.zeros(size), 0.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(_sum_rows(edges, w[flat]) + b, -500, 500)))
        error = weight * (p - labels)
        grad = np.bincount(flat, error[row_of], size) + decay * w
        if swaps:
            change = np.bincount(lost_of, w[lost], len(swaps)) - np.bincount(gained_of, w[gained], len(swaps))
            pull = 2 * penalty * change / len(swaps)
            grad += np.bincount(lost, pull[lost_of], size) - np.bincount(gained, pull[gained_of], size)
        g = np.append(grad, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def fit_toxicity(docs: DataFrame, labels: DataFrame, train_on: Column | None = None, id_col: str = "doc_id",
                 text_col: str = "text", label_col: str = "toxic", penalty: float = 5.0, groups=IDENTITY_TERMS,
                 max_rows: int = MAX_TRAINING_ROWS, max_features: int = MAX_FEATURES) -> ToxicityModel:
    """Learns from the labelled rows for which ``train_on`` (a condition on
    the id) holds: at most ``max_rows``, those whose ids have the smallest
    hashes.  Rows without label or text row take no part; an id with several
    labels counts as toxic if one is.  With one class only (or none) the model
    is a constant 0.5."""
    some = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if train_on is not None:
        some = some.where(train_on)
    some = (some.groupBy(F.col(id_col).cast("bigint").alias("train_id")).agg(F.max(label_col).cast("int").alias("y"))
            .orderBy(F.xxhash64("train_id"), "train_id").limit(max_rows))
    # the sample is bounded by max_rows, so the texts stay where they are
    texts = id_and_text(docs, id_col, text_col)
    training = materialise(texts.join(F.broadcast(some), texts["doc_id"] == some["train_id"])
                           .dropDuplicates(["doc_id"]).select("doc_id", "text", "y"), "toxicity-training")

    counted = pa.schema([("feature", pa.string()), ("y", pa.int32()), ("n", pa.int64())])

    def count(batches):
        seen: dict = {}
        for b in batches:
            for text, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                for f in features_of(text):
                    seen[f, y] = seen.get((f, y), 0) + 1
        yield batch_of(counted, [k[0] for k in seen], [k[1] for k in seen], list(seen.values()))

    sizes = {r["y"]: r["n"] for r in training.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return ToxicityModel({}, 0.0)
    # the features that tell the classes apart most, by their smoothed log odds
    # in units of its error; terms of the groups are always kept
    terms = sorted({t for g in groups for t in g})
    odds = (F.log((F.col("toxic") + 0.5) / (sizes[1] + 1.0)) - F.log((F.col("clean") + 0.5) / (sizes[0] + 1.0)))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    chosen = (training.mapInArrow(count, "feature string, y int, n bigint").groupBy("feature")
              .agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("toxic"),
                   F.sum(F.when(F.col("y") != 1, F.col("n")).otherwise(0)).alias("clean"))
              .where(F.col("toxic") + F.col("clean") >= MIN_TEXTS)
              .select("feature", F.abs(odds / error).alias("z"))
              .where(F.col("z") >= MIN_ODDS).orderBy(F.desc("z"), "feature").limit(max_features).collect())
    place = {f: k for k, f in enumerate(sorted({r["feature"] for r in chosen} | set(terms)))}
    indexed = pa.schema([("y", pa.int32()), ("on", pa.list_(pa.int32())),
                         ("swaps", pa.list_(pa.struct([("lost", pa.list_(pa.int32())), ("gained", pa.list_(pa.int32()))])))])

    def index(batches):
        for b in batches:
            rows = []
            for text, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                on = features_of(text)
                swaps = [{"lost": [place[f] for f in features_of(a) - features_of(c) if f in place and f in on],
                          "gained": [place[f] for f in features_of(c) - on if f in place]}
                         for a, c in swaps_of(text, groups)]
                rows.append((y, sorted(place[f] for f in on if f in place), swaps))
            yield batch_of(indexed, *([r[k] for r in rows] for k in range(3)))

    rows = training.repartition(F.col("doc_id")).mapInArrow(
        index, "y int, on array<int>, swaps array<struct<lost array<int>, gained array<int>>>").toArrow()
    on = rows.column("on").to_pylist()
    y = np.array(rows.column("y").to_pylist(), np.float64)
    order = sorted(range(len(on)), key=lambda k: (y[k], on[k]))  # the sum's order, whatever the rows' order
    swaps = sorted((s["lost"], s["gained"]) for x in rows.column("swaps").to_pylist() for s in x)
    w, bias = fit_logistic([on[k] for k in order], y[order], swaps, len(place), penalty)
    return ToxicityModel({f: float(w[k]) for f, k in place.items() if abs(w[k]) > 1e-4}, bias)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score``: the probability that each row's whole text is toxic.

    A null or empty text has no features and gets the score of the bias;
    repeated rows score alike; other columns are ignored.  A map over rows."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def score(batches):
        for b in batches:
            yield batch_of(schema, b.column(0), [model.score(t) for t in b.column(1).to_pylist()])

    return id_and_text(docs, id_col, text_col).mapInArrow(score, "doc_id bigint, score double")


def reject_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows whose score stays below ``threshold``, with all their columns
    (null and empty texts included).  A map over rows, whatever the columns."""
    place = docs.columns.index(text_col)

    def keep(batches):
        for b in batches:
            stays = [model.score(t or "") < threshold for t in b.column(place).to_pylist()]
            yield b.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
