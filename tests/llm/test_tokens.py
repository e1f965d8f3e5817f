"""Token files and packing: exact round trips, and against plain encoding."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from geoq.llm.common import scratch_path
from geoq.llm.encoders import ByteLevelEncoder, WordEncoder
from geoq.llm.packing import pack_documents, plan_best_fit
from geoq.llm.queries import BYTE_VOCABULARY, WORD_VOCABULARY, vocabulary
from geoq.llm.token_files import id_checksums, read_token_files, with_starts, write_token_files
from tests.llm.cases import corpus, empty, table


def plain(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids, "<u4")


ENCODERS = [(ByteLevelEncoder, BYTE_VOCABULARY), (WordEncoder, WORD_VOCABULARY)]
MADE = {kind: kind(vocabulary(name)) for kind, name in ENCODERS}


@pytest.mark.parametrize("kind,name", ENCODERS)
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.sampled_from(list("ab Z.,'!%s0\n\t\r\x0b\x1c 　é́Σσß<|endoftext|>中🙂")), max_size=30), max_size=4))
def test_encoder_equals_library(kind, name, texts):
    encode = plain(name)
    assert MADE[kind].encode([t.encode() for t in texts]) == [encode(t).tobytes() for t in texts]


def test_encoder_cache_generations(monkeypatch):
    import geoq.llm.encoders as E
    monkeypatch.setattr(E, "CACHE_BYTE_PARTS", 20)
    encode, made = plain(BYTE_VOCABULARY), ByteLevelEncoder(vocabulary(BYTE_VOCABULARY))
    texts = [" ".join(f"w{i * j % 37}" for j in range(12)) for i in range(60)]
    for i in range(0, 60, 7):
        assert made.encode([t.encode() for t in texts[i:i + 7]]) == [encode(t).tobytes() for t in texts[i:i + 7]]


def test_older_generation_is_not_added_again(monkeypatch):
    import geoq.llm.encoders as E
    monkeypatch.setattr(E, "CACHE_BYTE_PARTS", 20)
    encode, made, added = plain(BYTE_VOCABULARY), ByteLevelEncoder(vocabulary(BYTE_VOCABULARY)), []
    add = made.cache.add
    monkeypatch.setattr(made.cache, "add", lambda missing: (added.extend(missing), add(missing)))
    for text in (" ".join(f"w{i}" for i in range(15)), " ".join(f"v{i}" for i in range(15)), "w3 w4 w5"):
        assert made.encode([text.encode()]) == [encode(text).tobytes()]
    assert len(added) == len(set(added)) and {b"w3", b"v3"} < set(added)


def test_parts_between_line_feeds(monkeypatch):
    import geoq.llm.encoders as E
    monkeypatch.setattr(E, "LINES_AT_ONCE", 3)
    monkeypatch.setattr(E._Library, "together", None)  # parts that stand alone need no special tokens
    encode, made = plain(BYTE_VOCABULARY), ByteLevelEncoder(vocabulary(BYTE_VOCABULARY))
    texts = ["a\nb <|endoftext|> it's\nit's", "\ud7ff x\ty\u0085z \u00e9\u3000q 12,5!", "\n\n a", "w\n", "\nw", " ", "<|\n|>", "a\u00a0 b", "\x1c \x1c"]
    assert made.encode([t.encode() for t in texts]) == [encode(t).tobytes() for t in texts]


@pytest.mark.parametrize("kind,name", ENCODERS)
def test_words_of_letters_go_to_the_model_alone(monkeypatch, kind, name):
    import geoq.llm.encoders as E
    monkeypatch.setattr(E, "PIECES_AT_ONCE", 2)
    monkeypatch.setattr(E, "BYTES_AT_ONCE", 30)
    monkeypatch.setattr(E._Library, "lines", lambda self, texts, line_feed: [] if not texts else 1 / 0)
    encode, made = plain(name), kind(vocabulary(name))
    # special tokens and line feeds are not needed for these
    texts = ["Straße Über ÀÿÞ die über, die Straße. die", "a\nAb b.\nÖl", "", "x", "enchachheit ß en!? ciónñ ciónñn; ÄÖÜäöüß\nÿ"]
    monkeypatch.setattr(E._Library, "together", lambda self, texts: [b""] * len(texts) if not any(texts) else 1 / 0)
    assert made.encode([t.encode() for t in texts]) == [encode(t).tobytes() for t in texts]
    # a part is looked up once for all its places and tails
    asked, of = [], made.cache.of
    monkeypatch.setattr(made.cache, "of", lambda parts: (asked.extend(parts), of(parts))[1])
    assert made.encode([b"der der, der. der; xyz der"]) == [encode("der der, der. der; xyz der").tobytes()]
    assert len(asked) == len(set(asked)) and {x.strip() for x in asked} == {b"der", b"xyz"}


def test_slices_hold_every_text_once(monkeypatch):
    import geoq.llm.encoders as E
    monkeypatch.setattr(E, "BYTES_AT_ONCE", 10)
    texts = [b"", b"a" * 25, b"bb", b"", b"c" * 8, b"d", b""]
    assert list(E.slices(texts)) == [(0, 2), (2, 5), (5, 7)] and list(E.slices([])) == []
    made, encode = WordEncoder(vocabulary(WORD_VOCABULARY)), plain(WORD_VOCABULARY)
    assert made.encode(texts) == [encode(t.decode()).tobytes() for t in texts]


def test_token_files_round_trip(spark):
    path, encode = scratch_path(spark, "test"), plain(BYTE_VOCABULARY)
    write_token_files(table(spark, corpus() + [(None, "no id")]), path, vocabulary(BYTE_VOCABULARY))
    tokens = read_token_files(spark, path)
    got = with_starts(id_checksums(tokens), tokens).orderBy("start").collect()
    ids = [r["doc_id"] for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:]) and len(got) == len(corpus()) + 1
    texts = dict(corpus()) | {None: "no id"}
    start = 0
    for r in got:
        want = np.append(encode(texts[r["doc_id"]]), np.uint32(2)).astype("<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    whole = tokens.where("doc_id = 13").first()
    assert whole["ids"] == [*encode(texts[13]).tolist(), 2]


def test_token_files_of_nothing(spark):
    path = scratch_path(spark, "test")
    write_token_files(empty(spark), path, vocabulary(BYTE_VOCABULARY))
    assert read_token_files(spark, path).count() == 0


def test_packing(spark):
    encode, capacity = plain(WORD_VOCABULARY), 64
    docs = table(spark, corpus())
    got = pack_documents(docs, vocabulary(WORD_VOCABULARY), capacity).collect()
    texts = dict(corpus())
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for doc, rows in by_doc.items():
        ids = np.append(encode(texts[doc]), np.uint32(0)).astype("<u4")
        copies = 3 if doc == 4 else 1
        assert len(rows) == copies * -(-len(ids) // capacity)
        for r in rows:
            piece = ids[r["piece"] * capacity:(r["piece"] + 1) * capacity]
            assert (r["start"], r["length"], r["ids_crc32"]) == (r["piece"] * capacity, len(piece), zlib.crc32(piece.tobytes()))
    fill = {}
    for r in sorted(got, key=lambda r: r["offset"]):
        assert r["offset"] == fill.get(r["sequence_id"], 0)  # gapless
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= capacity
    assert pack_documents(empty(spark), vocabulary(WORD_VOCABULARY)).count() == 0


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        gap = min(fits) if fits else capacity
        if fits:
            gaps.remove(gap)
        gaps.append(gap - n)
    return len(gaps)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=120))
def test_plan_is_best_fit(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    used = {}
    for n, first_rank, first, offset in (plan := sorted(plan_best_fit(counts, 40))):
        nexts = [p[1] for p in plan if p[0] == n and p[1] > first_rank]
        for k in range((min(nexts) if nexts else counts[n]) - first_rank):
            used.setdefault(first + k, []).append((offset, n))
    for pieces in used.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 40
    assert sum(map(len, used.values())) == len(lengths)
    assert len(used) <= best_fit_decreasing(lengths, 40)
