"""Secret scans by grammar inference.

A small table of labelled credentials is turned into one probabilistic
automaton per kind: a prefix tree of the samples whose states are merged while
their futures are statistically compatible (Hoeffding bounds).  Every long
token of every text is then scored by how much likelier it is under the best
credential automaton than under the automaton of ordinary strings.  Fixed
patterns for well-known forms come first; their spans always stay.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoq.llm.common import id_and_text

#: Most labelled rows that the driver infers the automata from.
MAX_LABELLED = 20_000
#: Length from which a token is a candidate; log-likelihood ratio that makes a secret.
MIN_LENGTH, THRESHOLD = 16, 12.0
#: Label of strings that are no credentials.
PLAIN = "plain"

# The base patterns: kind -> (pattern, group whose length counts, least length).
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                          re.IGNORECASE | re.ASCII), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]{32,}"), 0, 32),
}
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % MIN_LENGTH)

#: Character classes after the literal prefix of a format: name -> members.
CLASSES = {"digit": "0123456789", "a-f": "abcdef", "g-z": "ghijklmnopqrstuvwxyz", "A-F": "ABCDEF",
           "G-Z": "GHIJKLMNOPQRSTUVWXYZ"}
_CLASS_OF = {c: name for name, members in CLASSES.items() for c in members}
_SIZE = {name: len(members) for name, members in CLASSES.items()}


def sample_credentials(per_kind: int = 40) -> list[tuple[str, str]]:
    """The default labelled table, ``(value, kind)``: strings drawn by hash in
    the formats of common credentials, and ordinary strings."""
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def draw(name: str, k: int, n: int, alphabet: str) -> str:
        value = int.from_bytes(hashlib.shake_256(f"{name}/{k}".encode()).digest(2 * n), "big")
        out = []
        for _ in range(n):
            value, at = divmod(value, len(alphabet))
            out.append(alphabet[at])
        return "".join(out)

    rows = []
    for k in range(per_kind):
        rows += [
            ("AKIA" + draw("access", k, 16, upper + digits), "access key"),
            (draw("sha1", k, 40, digits + "abcdef"), "hex digest"),
            (draw("md5", k, 32, digits + "abcdef"), "hex digest"),
            ("ghp_" + draw("ghp", k, 36, upper + lower + digits), "prefixed token"),
            ("ghp_" + draw("ghs", k, 36, upper + lower + digits), "prefixed token"),
            ("sk-" + draw("sk", k, 48, upper + lower + digits), "service key"),
            ("xoxb-" + draw("xa", k, 12, digits) + "-" + draw("xb", k, 24, upper + lower + digits), "chat token"),
            ("eyJ" + draw("jwt", k, 60, upper + lower + digits + "_-"), "signed token"),
            (draw("base64", k, 40, upper + lower + digits + "+/"), "random key"),
            (draw("base62", k, 32, upper + lower + digits), "random key"),
        ]
        vowels, rest = "aeiou", "bcdfghjklmnpqrstvwxyz"
        word = "".join(draw("c", 99 * k + i, 1, rest) + draw("v", 99 * k + i, 1, vowels) for i in range(9 + k % 4))
        rows += [(word, PLAIN), (word.capitalize(), PLAIN), (word.upper(), PLAIN), (word.capitalize() + "." + word[:8].capitalize(), PLAIN),
                 (word + "-" + word[::-1], PLAIN), (f"{word[:6]}{k}.example.com", PLAIN),
                 (draw("number", k, 16, digits), PLAIN), (draw("long number", k, 20, digits), PLAIN),
                 (f"20{k % 30:02d}-{1 + k % 12:02d}-{1 + k % 28:02d}T10", PLAIN), ("=" * (16 + k), PLAIN),
                 ("-" * (16 + k), PLAIN), ("." * (16 + k), PLAIN), (f"/usr/{word[:6]}/{word[6:12]}/{word[:4]}.txt", PLAIN),
                 (f"{word[:6]}_{word[6:12]}_{word[:5]}", PLAIN), (lower[k % 26] * (16 + k), PLAIN)]
    return rows


class Automaton:
    """A probabilistic automaton inferred from strings."""

    def __init__(self, strings: list[str], alpha: float = 0.05):
        self.prefix = _common_prefix(strings)
        self.next: list[dict] = [{}]      # state -> symbol -> state
        self.count: list[dict] = [{}]     # state -> symbol -> how often
        self.ends: list[int] = [0]
        self.seen: list[int] = [0]
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        for s in strings:
            self._insert(self.symbols(s))
        self._merge()

    def symbols(self, s: str) -> list[str]:
        """Literal characters where the samples agree, then classes."""
        n = len(self.prefix)
        return list(s[:n]) + [_CLASS_OF.get(c, c) for c in s[n:]]

    def _insert(self, symbols) -> None:
        at = 0
        self.seen[0] += 1
        for x in symbols:
            if x not in self.next[at]:
                self.next[at][x] = len(self.next)
                self.next.append({})
                self.count.append({})
                self.ends.append(0)
                self.seen.append(0)
            self.count[at][x] = self.count[at].get(x, 0) + 1
            at = self.next[at][x]
            self.seen[at] += 1
        self.ends[at] += 1

    def _differ(self, a: int, b: int, x: int, y: int) -> bool:
        n, m = self.seen[a], self.seen[b]
        return abs(x / n - y / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: int, b: int) -> bool:
        """Whether two states' futures could be samples of one distribution."""
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            if not self.seen[a] or not self.seen[b]:
                continue
            if self._differ(a, b, self.ends[a], self.ends[b]):
                return False
            for x in self.next[a].keys() | self.next[b].keys():
                if self._differ(a, b, self.count[a].get(x, 0), self.count[b].get(x, 0)):
                    return False
                if x in self.next[a] and x in self.next[b]:
                    pairs.append((self.next[a][x], self.next[b][x]))
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Adds a subtree's counts to a state, making new edges as needed."""
        pairs = [(into, tree)]
        while pairs:
            a, b = pairs.pop()
            self.seen[a] += self.seen[b]
            self.ends[a] += self.ends[b]
            for x, child in self.next[b].items():
                self.count[a][x] = self.count[a].get(x, 0) + self.count[b][x]
                if x in self.next[a]:
                    pairs.append((self.next[a][x], child))
                else:
                    self.next[a][x] = child

    def _merge(self) -> None:
        """Settles states in order of depth: each undecided child of a settled
        state is merged into the first compatible settled state, or settled."""
        settled, undecided = [0], [(0, x) for x in sorted(self.next[0])]
        while undecided:
            parent, x = undecided.pop(0)
            child = self.next[parent][x]
            if child in settled:
                continue
            for state in settled:
                if self._compatible(state, child):
                    self.next[parent][x] = state
                    self._fold(state, child)
                    break
            else:
                settled.append(child)
            known = set(settled)
            undecided = [(s, x) for s in settled for x in sorted(self.next[s]) if self.next[s][x] not in known]

    def log_likelihood(self, s: str, smoothing: float = 0.05) -> float:
        """Of the characters of ``s``; unseen symbols get a smoothed share and
        keep the state."""
        at, total, kinds = 0, 0.0, len(CLASSES) + 8
        for x in self.symbols(s):
            seen = self.seen[at] - self.ends[at]
            p = (self.count[at].get(x, 0) + smoothing) / (seen + smoothing * kinds)
            total += math.log(p / _SIZE.get(x, 1))
            at = self.next[at].get(x, at)
        return total


def _common_prefix(strings: list[str]) -> str:
    if not strings:
        return ""
    low, high = min(strings), max(strings)
    n = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
    return low[:n]


class SecretModel:
    """Automata by kind, and that of ordinary strings."""

    def __init__(self, labelled: list[tuple[str, str]]):
        by_kind: dict[str, list[str]] = {}
        for value, kind in labelled:
            if value:
                by_kind.setdefault(kind or PLAIN, []).append(value)
        self.plain = Automaton(by_kind.pop(PLAIN, []))
        self.kinds = {kind: Automaton(values) for kind, values in sorted(by_kind.items())}

    def score(self, s: str) -> float:
        """Log-likelihood ratio of the best credential format to ordinary."""
        if not self.kinds:
            return float("-inf")
        return max(a.log_likelihood(s) for a in self.kinds.values()) - self.plain.log_likelihood(s)


def fit_secret_model(labelled: DataFrame, value_col: str = "value", kind_col: str = "kind") -> SecretModel:
    rows = labelled.select(value_col, kind_col).limit(MAX_LABELLED + 1).collect()
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled credentials")
    return SecretModel(sorted((r[0], r[1] or PLAIN) for r in rows if r[0]))


def spans_of(text: str, model: SecretModel, threshold: float = THRESHOLD) -> list[tuple[int, int, str, float | None]]:
    """``(start, end, kind, score)`` of a text's secrets; base kinds have no score."""
    found = []
    for kind, (pattern, group, least) in BASE.items():
        found += [(m.start(), m.end(), kind, None) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    taken = [(s, e) for s, e, _, _ in found]
    for m in _CANDIDATE.finditer(text):
        token = m.group().rstrip(".=-")
        if len(token) < MIN_LENGTH or any(s < m.end() and m.start() < e for s, e in taken):
            continue
        score = model.score(token)
        if score >= threshold:
            found.append((m.start(), m.start() + len(token), "format", score))
    order = [*BASE, "format"]
    return sorted(found, key=lambda f: (f[0], order.index(f[2])))


def scan_secrets(docs: DataFrame, model: SecretModel, threshold: float = THRESHOLD, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id, spans``: every row's secrets, an array of ``(start, end, kind,
    score)`` in code points, end exclusive, by start and then kind.

    Kinds: ``assign``, ``access``, ``hex`` (fixed patterns, score null) and
    ``format`` (by the automata; never overlapping a fixed one).  A null or
    empty text has no spans; texts are scanned whole; repeated rows give equal
    rows; other columns are ignored.  A map over rows: no shuffle."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(span))])

    def scan(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                some = b.slice(at, 500)
                rows = [[dict(zip(("start", "end", "kind", "score"), s)) for s in spans_of(t, model, threshold)]
                        for t in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(rows, schema.field(1).type)], schema=schema)

    return id_and_text(docs, id_col, text_col).mapInArrow(
        scan, "doc_id bigint, spans array<struct<start bigint, end bigint, kind string, score double>>")


def span_digest(scanned: DataFrame) -> DataFrame:
    """Counts by base kind, and spans as text and as a checksum."""
    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"] != "format")
    return scanned.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
                          count("hex").alias("n_hex"), F.sha2(text(base), 256).alias("base_sha256"),
                          text(F.col("spans")).alias("spans"))
