"""Byte-level BPE token ids for many texts at once, in bounded memory.

The vocabulary is the public byte_bpe_50k one; its ids are those of the `tokenizers` file of that name (tests hold the
two against each other). A text is cut into pretokens by array operations on code points, each distinct pretoken is
encoded once, and ids are gathered: texts repeat their words, so this is several times faster than encoding texts.
"""

from __future__ import annotations

import base64
import functools
import itertools

import numpy as np
import pyarrow as pa
import regex

#: The id after each document.
END = 0
#: Bytes of distinct pretokens whose ids a task keeps; with their dictionary they take about twenty times as much.
KEPT_BYTES = 1 << 20
#: Bytes of text whose ids are made at once: the arrays take about 60 bytes for each.
TEXT_BYTES = 1 << 20

_WS, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3


@functools.cache
def encoder(path: str | None = None):
    """tiktoken's encoder over the ranks in this file."""
    import public_tokenizers as public
    import tiktoken

    with open(path or public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(word): int(n) for word, n in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def _classes() -> np.ndarray:
    """The pattern's four classes of code points."""
    out = np.full(0x110000, _OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((_WS, r"\p{White_Space}+"), (_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            out[a : b + 1] = kind
    out[0xD800:0xE000] = _OTHER
    return out


def pretokens(code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the pattern's tokens start in these code points. first: where texts start."""
    n = len(code)
    kind = _classes()[code]
    new = np.ones(n, bool)
    new[1:] = kind[1:] != kind[:-1]
    new[first[first < n]] = True
    # the last white space before something else: a space goes with what follows, others stand alone
    ends = np.zeros(n, bool)
    ends[:-1] = (kind[:-1] == _WS) & (kind[1:] != _WS)
    ends[first[(first > 0) & (first < n)] - 1] = False
    last = np.flatnonzero(ends)
    new[last] = True
    new[last + 1] = code[last] != 32
    # 's 't 're 've 'm 'll 'd where a token starts at the apostrophe
    for at in np.flatnonzero((code == 39) & new):
        follow = code[at + 1 : at + 3]
        stop = first[np.searchsorted(first, at, "right")] if len(first) and first[-1] > at else n
        text = "".join(map(chr, follow[: max(0, stop - at - 1)]))
        size = 2 if text[:1] in ("s", "t", "m", "d") and text else 3 if text in ("re", "ve", "ll") else 0
        if size:
            new[at + 1 : at + size] = False
            if at + size < stop:
                # what is left of the letters is a token of its own
                new[at + size] = True
    return np.flatnonzero(new)


class Ids:
    """Token ids of texts. Keeps the ids of pretokens seen before, up to KEPT_BYTES, until forget()."""

    def __init__(self, path: str | None = None):
        self.bpe = encoder(path)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.used = self.held = 0

    def begins(self, code: np.ndarray, first: np.ndarray) -> np.ndarray:
        return pretokens(code, first)

    def each(self, words: list[bytes]) -> list[list[int]]:
        return list(map(self.bpe._core_bpe.encode_single_piece, words))

    def _learn(self, words: list[bytes]) -> None:
        found = self.each(words)
        k, length = len(self.known), np.fromiter(map(len, found), np.int64, len(found))
        end = self.used + int(length.sum())
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(len(self.flat), end - self.used), np.uint32)])
        if k + len(words) + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros(max(len(self.start), len(words) + 1), np.int64)])
        self.flat[self.used : end] = np.fromiter(itertools.chain.from_iterable(found), np.uint32, end - self.used)
        self.start[k] = self.used
        self.start[k + 1 : k + 1 + len(words)] = self.used + np.cumsum(length)
        self.known.update(zip(words, range(k, k + len(words)), strict=True))
        self.used = end

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these texts (no nulls), one after the other, and where each text's ids begin (and the last end)."""
        texts = text.to_pylist()
        joined = "".join(texts)
        if not joined:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        begins = self.begins(code, first)
        data = joined.encode()
        offsets = np.append(begins, len(code))
        if len(data) > len(code):
            wide = (code >= 0x80).view(np.uint8) + (code >= 0x800).view(np.uint8) + (code >= 0x10000).view(np.uint8)
            offsets = offsets + np.concatenate([[0], np.cumsum(wide, dtype=np.int64)])[offsets]
        words = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = words.dictionary_encode()
        held = coded.dictionary
        at = np.frombuffer(held.buffers()[1], np.int64)[: len(held) + 1].tolist()
        data = held.buffers()[2].to_pybytes()
        distinct = [data[a:b] for a, b in zip(at, at[1:])]
        new = [w for w in distinct if w not in self.known]
        size = sum(map(len, new))
        if self.known and self.held + size > KEPT_BYTES:
            self.forget()
            new, size = distinct, len(data)
        self.held += size
        self._learn(new)
        number = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy(zero_copy_only=False)]
        length = self.start[number + 1] - self.start[number]
        ends = np.cumsum(length)
        at = np.arange(ends[-1]) + np.repeat(self.start[number] - (ends - length), length)
        bounds = np.concatenate([[0], ends])[np.searchsorted(begins, first)]
        return self.flat[at], bounds


class PieceIds(Ids):
    """Ids of a sentencepiece BPE model that puts a space before each text, whose pieces hold a space at the start only (or
    are nothing but spaces), and that falls back on bytes: what follows a run of spaces never merges with what is before it.

    Texts must start with the space that the model adds. A stretch that the model's pieces do not give back byte for byte
    (one with U+2581) gets the id of the unknown piece, which is not used otherwise."""

    def __init__(self, path: str | None = None):
        self.pieces, self.bytes_of = piece_model(path)
        self.forget()

    def begins(self, code: np.ndarray, first: np.ndarray) -> np.ndarray:
        space = code == 32
        new = space.copy()
        new[1:] &= ~space[:-1]
        new[first[first < len(code)]] = True
        return np.flatnonzero(new)

    def each(self, words: list[bytes]) -> list[list[int]]:
        alone, unknown, own = self.pieces.piece_to_id("\u2581"), self.pieces.unk_id(), self.bytes_of.__getitem__
        found = [ids or [alone] for ids in self.pieces.encode([w[1:].decode() for w in words], num_threads=1)]
        given = [b"".join(map(own, ids)) for ids in found]
        if given != words:
            found = [ids if x == word else [unknown] for ids, x, word in zip(found, given, words, strict=True)]
        return found


@functools.cache
def piece_model(path: str | None = None):
    """The public sentencepiece model in this file, and the bytes that each of its pieces stands for."""
    import public_tokenizers as public
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public.path("piece_bpe_32k.model"))
    pieces = map(model.id_to_piece, range(model.get_piece_size()))
    return model, [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]


@functools.cache
def piece_ids(path: str | None = None) -> PieceIds:
    """One of these in each Python worker."""
    return PieceIds(path)


@functools.cache
def ids(path: str | None = None) -> Ids:
    """One of these in each Python worker."""
    return Ids(path)
