"""Fast whole-text encoding with the ``tokenizers`` library.

Both vocabularies split a text into parts before any merge, so a text may be
cut at places where the pre-tokenizer always cuts, each distinct part encoded
once by the library, and the ids joined.  Parts and ids sit in a bounded
two-generation cache that lives as long as the Python worker.  The parts of
some MB of texts are numbered by Arrow, so the cache is asked once for each
part that differs.
"""

from __future__ import annotations

import codecs
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Parts kept per generation of a worker's cache: of words, and of byte-level
#: parts, which differ by case and punctuation.  Parts encoded at once; lines;
#: bytes of text whose parts are numbered at once (one text at least).
CACHE_PARTS, CACHE_BYTE_PARTS, PARTS_AT_ONCE, LINES_AT_ONCE = 300_000, 500_000, 2_000, 100
PIECES_AT_ONCE, BYTES_AT_ONCE = 150, 2 << 20
#: Punctuation that the pre-tokenizers part from a letter or digit before it.
TAIL = b".,;:!?%*&$#"
#: Parts that both pre-tokenizers leave in one piece: letters of ASCII and Latin-1.
_LETTERS = re.compile(rb"(?:[A-Za-z]++|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF])++").fullmatch


def _in_one_piece(part: bytes) -> bool:
    return part.isalpha() or _LETTERS(part) is not None




def _byte_letters() -> str:
    """The character that byte-level vocabularies write for each byte; a space
    for 0xFF, which UTF-8 does not use."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return "".join(chr(b if b in own else next(others)) for b in range(0xFF)) + " "


BYTE_LETTERS = _byte_letters()


class _Library:
    """Encodes many parts in one call, with an end-of-text token between them:
    special tokens split a text before anything else, so each part is encoded
    as if it stood alone.  Parts that could hold such a token go one by one."""

    def __init__(self, path: str, separator: str = "<|endoftext|>"):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit
        self.tokenizer = Tokenizer.from_file(path)
        self.separator, self.mark = separator, self.tokenizer.token_to_id(separator)
        # the same model behind a plain split on spaces, and the bytes of each id
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        vocabulary, suffix = self.model.get_vocab(), self.model.model.end_of_word_suffix
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token.removesuffix(suffix) if suffix else token)

    def pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Encodes what the pre-tokenizer leaves in one piece by the model
        alone.  The ids of a piece are those that add up to its bytes."""
        out: list[bytes] = []
        for at in range(0, len(pieces), PIECES_AT_ONCE):
            some = pieces[at:at + PIECES_AT_ONCE]
            text = codecs.charmap_decode(b"\xff".join(some), "strict", BYTE_LETTERS)[0]
            ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            after, ends = np.cumsum(self.bytes_of[ids]), np.cumsum(np.fromiter(map(len, some), np.int64, len(some)))
            edges = np.searchsorted(after, ends)
            if len(after) == 0 or after[-1] != ends[-1] or (after[edges] != ends).any():
                raise ValueError("the vocabulary's ids do not add up to the bytes of the text")
            data = ids.tobytes()
            edges = [0, *(4 * edges + 4).tolist()]
            out += [data[i:j] for i, j in zip(edges, edges[1:])]
        return out

    def alone(self, texts: list[str]) -> list[bytes]:
        self.tokenizer.encode_special_tokens = True
        return [np.array(e.ids, "<u4").tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def lines(self, texts: list[str], line_feed: bytes) -> list[bytes]:
        """Encodes texts between line feeds, where those are always cut off as
        one token of their own: cheaper than special tokens."""
        if len(line_feed) != 4:
            return self.together(texts)
        out: list[bytes] = []
        self.tokenizer.encode_special_tokens = True
        for at in range(0, len(texts), LINES_AT_ONCE):
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(texts[at:at + LINES_AT_ONCE])],
                                                            add_special_tokens=False)[0].ids, "<u4")
            data, first = ids.tobytes(), 0
            for end in np.flatnonzero(ids == np.frombuffer(line_feed, "<u4")[0]).tolist():
                out.append(data[first:4 * end])
                first = 4 * end + 4
            out.append(data[first:])
        return out

    def together(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), PARTS_AT_ONCE):
            some = texts[at:at + PARTS_AT_ONCE]
            whole = self.separator.join(some)
            if whole.count("<|") != len(some) - 1:
                out += self.alone(some)
                continue
            self.tokenizer.encode_special_tokens = False
            ids = np.array(self.tokenizer.encode_batch_fast([whole], add_special_tokens=False)[0].ids, "<u4")
            edges = np.concatenate([[-1], np.flatnonzero(ids == self.mark), [len(ids)]])
            data = ids.tobytes()
            out += [data[4 * i + 4:4 * j] for i, j in zip(edges.tolist(), edges[1:].tolist())]
        return out


class _Cache(dict):
    """Part -> its ids, or False where a part can't be encoded alone.  The
    older of two generations is dropped when the newer is full.  ``tails`` has
    the ids of punctuation at the end of a part, which is cut off before."""

    def __init__(self, encode, tails, most: int | None = None):
        super().__init__()
        self.old: dict = {}
        self.encode, self.tails, self.most = encode, tails, most or CACHE_PARTS

    def add(self, missing: list[bytes]) -> None:
        if len(self) + len(missing) > self.most:
            self.old = dict(self)
            self.clear()
        self.update(zip(missing, self.encode(missing)))

    def of(self, parts: list[bytes]) -> list[bytes | bool]:
        """The ids of each part; no part comes twice."""
        ids = list(map(self.get, parts))
        at = [i for i, x in enumerate(ids) if x is None]
        missing = []
        for i, x in zip(at, list(map(self.old.get, [parts[i] for i in at]))):
            if x is None:
                missing.append(parts[i])
            else:
                self[parts[i]] = ids[i] = x
        if missing:
            self.add(missing)
            for i in at:
                if ids[i] is None:
                    ids[i] = self[parts[i]]
        return ids

    def joined(self, lists: pa.ListArray) -> list[bytes | None]:
        """The ids of each list of parts; None where a part is False."""
        numbered = lists.flatten().dictionary_encode()
        stems, tails = (x.dictionary_encode() for x in _stems_and_tails(numbered.dictionary))
        ids = self.of(stems.dictionary.to_numpy(zero_copy_only=False).tolist())
        bad = np.fromiter((x is False for x in ids), bool, len(ids))
        ids = [x or b"" for x in ids] + [self.tails[t] for t in tails.dictionary.to_pylist()]
        data = np.frombuffer(b"".join(ids), "<u4")
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)
        # of each part that differs, from its stem and tail; then of all
        stem = stems.indices.to_numpy()
        data, ends = _taken(data, ends, np.column_stack([stem, tails.indices.to_numpy() + len(bad)]).ravel())
        at = numbered.indices.to_numpy()
        data, ends = _taken(data, ends[1::2], at)
        edges, whole = lists.offsets.to_numpy(), data.tobytes()
        wrong = np.diff(np.concatenate([[0], np.cumsum(bad[stem][at])])[edges]).tolist()
        edges = (4 * np.concatenate([[0], ends])[edges]).tolist()
        return [None if w else whole[i:j] for w, i, j in zip(wrong, edges, edges[1:])]


def _taken(data: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices ``at`` of ``data``, whose slices end at ``ends``, one after
    the other, and where each ends."""
    sizes = np.diff(ends, prepend=0)
    many = sizes[at]
    out = np.cumsum(many)
    source = np.repeat((ends - sizes)[at] - (out - many), many)
    source += np.arange(len(source))
    return data[source], out


_WORD_BYTE = np.array([chr(b).isalnum() and b < 128 for b in range(256)])


def _stems_and_tails(parts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Parts without, and their, punctuation after a letter or digit."""
    n, edges = len(parts), np.frombuffer(parts.buffers()[1], np.int64)[parts.offset:parts.offset + len(parts) + 1]
    data = parts.buffers()[2]
    text = pa.Array.from_buffers(pa.large_string(), n, parts.buffers()[:3], offset=parts.offset)
    sizes = pc.binary_length(pc.ascii_rtrim(text, TAIL.decode())).to_numpy()
    ends = edges[:-1] + sizes
    cut = np.flatnonzero((sizes > 0) & (ends < edges[1:]))
    cut = cut[_WORD_BYTE[np.frombuffer(data, np.uint8)[ends[cut] - 1]]] if len(cut) else cut
    ends, after = edges[1:].copy(), ends
    ends[cut] = after[cut]
    both = np.empty(2 * n + 1, np.int64)
    both[::2], both[1::2] = edges, ends
    both = pa.Array.from_buffers(pa.large_binary(), 2 * n, [None, pa.py_buffer(both), data])
    return both.take(pa.array(np.arange(0, 2 * n, 2))), both.take(pa.array(np.arange(1, 2 * n, 2)))


def slices(texts: list[bytes]):
    """Where slices of about ``BYTES_AT_ONCE`` begin and end."""
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BYTES_AT_ONCE:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _split(texts: list[bytes]) -> pa.ListArray:
    return pc.split_pattern(pa.array(texts, pa.large_binary()), b" ")


class _Tails(dict):
    """Ids of punctuation at the end of a part."""

    def __init__(self, library: _Library):
        super().__init__({b"": b""})
        self.library = library

    def __missing__(self, tail: bytes) -> bytes:
        ids = self[tail] = self.library.alone([tail.decode()])[0]
        return ids


class ByteLevelEncoder:
    """Byte-level BPE (``byte_bpe_50k.json``).

    The pre-tokenizer cuts before a single space, and on both sides of a single
    line feed, that stands between two characters other than white space.  A
    text with any other white space next to such a place is encoded whole."""

    def __init__(self, path: str):
        self.library = _Library(path)
        self.line_feed = self.library.alone(["\n"])[0]
        self.cache = _Cache(self._encode, _Tails(self.library), CACHE_BYTE_PARTS)

    def _encode(self, parts: list[bytes]) -> list[bytes | bool]:
        """Of parts that follow a space, or a line feed that they begin with."""
        out: list[bytes | bool | None] = [None] * len(parts)
        letters, places, others = [], [], []
        for k, part in enumerate(parts):
            core = part[1:] if part[:1] == b"\n" else part
            if _in_one_piece(core):
                places.append(k)
                letters.append(core if core is not part else b" " + part)
            else:
                others.append(k)
        for k, ids in zip(places, self.library.pieces(letters)):
            out[k] = self.line_feed + ids if parts[k][:1] == b"\n" else ids
        for k, ids in zip(others, self._mixed([parts[k].decode() for k in others])):
            out[k] = ids
        return out

    def _mixed(self, texts: list[str]) -> list[bytes | bool]:
        bodies, good = [], []
        for t in texts:
            core = t[1:] if t[:1] == "\n" else t
            fine = core.isalnum() or bool(core) and not core[0].isspace() and not core[-1].isspace()
            good.append(fine)
            if fine:
                bodies.append(core if core is not t else " " + t)
        ids = iter(self.library.lines(bodies, self.line_feed))
        return [(self.line_feed + next(ids) if t[:1] == "\n" else next(ids)) if g else False for t, g in zip(texts, good)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = []
        cut = len(self.line_feed)
        for i, j in slices(texts):
            # as if each text stood after a line feed
            lists = _split([(b"\n" + t).replace(b"\n", b" \n")[1:] for t in texts[i:j]])
            out += [x if x is None else x[cut:] for x in self.cache.joined(lists)]
        whole = [k for k, x in enumerate(out) if x is None]
        for k, ids in zip(whole, self.library.alone([texts[k].decode() for k in whole])):
            out[k] = ids
        return out


#: ASCII lower-cased, white space to spaces.
_LOWER = bytes.maketrans(b"\t\n\v\f\r", b"     ")
_LOWER = bytes(_LOWER[b] for b in bytes(range(256)).lower())


class WordEncoder:
    """Lower-casing BPE with word ends (``word_bpe_49k.json``): white space is
    dropped and always separates, so a text is the sum of its words."""

    def __init__(self, path: str):
        self.library = _Library(path)
        self.cache = _Cache(self._encode, _Tails(self.library))

    def _encode(self, parts: list[bytes]) -> list[bytes]:
        """Of lower-cased words, or nothing between white space."""
        out: list[bytes | None] = [None] * len(parts)
        places, others = [], []
        for k, part in enumerate(parts):
            (places if _in_one_piece(part) else others).append(k)
        # the other letters of Latin-1 are lower-cased by the normalizer
        letters = b" ".join([parts[k] for k in places]).decode().lower().encode().split()
        for k, ids in zip(places, self.library.pieces(letters)):
            out[k] = ids
        for k, ids in zip(others, self.library.together([parts[k].decode() for k in others])):
            out[k] = ids
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        out = []
        for i, j in slices(texts):
            out += self.cache.joined(_split([t.translate(_LOWER) for t in texts[i:j]]))
        return out


_MADE: dict = {}


def encoder(kind: type, path: str):
    """One encoder for each Python worker, so its cache outlives a task."""
    if (kind, path) not in _MADE:
        _MADE[kind, path] = kind(path)
    return _MADE[kind, path]
