r"""Token ids of many texts at once.

A batch is cut into pre-tokens by arrays of character classes, its distinct pre-tokens are found by Arrow's dictionary encoding, each new
one is encoded once (by the tokenizers library, or by another function of distinct words), and the ids are gathered by index. Where a model marks the ends
of words, the library gets many words in one string and the marks tell them apart again. The cut
covers texts of code points below 0x250 only, without those whose lower case or normal form isn't one code point for one; any other text,
and one with the string of a special token, goes whole to the library (or to another function of texts), so results are the library's for all.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .store import text_offsets

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")

LETTER, NUMBER, OTHER, SPACE = range(4)
EASY = 0x250
_CLASS = np.array([SPACE if chr(c).isspace() and c not in range(0x1C, 0x20) else {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(EASY)], np.uint8)
_LOWER = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else 0x110000 for c in range(EASY)], np.uint32)
#: Words kept with their ids; when full, the cache starts anew. It only saves work.
CACHE = 400_000
#: Bytes of text cut at once: what a worker holds in arrays is some forty times this.
SLICE = 3 << 20
#: Words that go to the library in one string.
JOINED = 256


def load(path: str):
    """A tokenizer with truncation and padding off."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _contractions(cp: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each place of an apostrophe: the letters after it that make 's 't 're 've 'm 'll 'd, else 0."""
    wide = np.concatenate([cp, np.zeros(2, cp.dtype)])
    a, b = wide[at + 1], wide[at + 2]
    one = np.isin(a, [ord(c) for c in "stmd"])
    two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    return np.where(one, 1, np.where(two, 2, 0))


def cut_byte(cp: np.ndarray, starts: np.ndarray) -> np.ndarray:
    r"""Where pre-tokens begin under `'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+`.

    starts: where texts begin. Pre-tokens cover the texts without gaps.
    """
    n = len(cp)
    kind = _CLASS[cp]
    first = np.zeros(n + 1, bool)
    first[starts] = True
    first[n] = True
    new = first[:-1].copy()
    new[1:] |= kind[1:] != kind[:-1]  # a run of one class begins
    space = kind == SPACE
    cut = new.copy()
    # The last of several white-space characters before something else stands alone or joins what follows.
    ends = np.flatnonzero(space & ~first[1:] & np.concatenate([~space[1:], [True]]))
    cut[ends] = True
    joins = ends[cp[ends] == 32]
    cut[joins + 1] = False
    # An apostrophe that begins a pre-token and is followed by a contraction's letters takes them alone.
    at = np.flatnonzero((cp == 39) & cut)
    at = at[(at + 1 < n) & new[np.minimum(at + 1, n - 1)] & ~first[np.minimum(at + 1, n)]]
    size = _contractions(cp, at)
    size[(size == 2) & first[np.minimum(at + 2, n)]] = 0
    at, size = at[size > 0], size[size > 0]
    cut[at + 1] = False
    after = at + 1 + size
    inside = after[after < n]
    inside = inside[~space[inside]]
    cut[inside] = True
    return cut


def cut_word(cp: np.ndarray, starts: np.ndarray) -> np.ndarray:
    r"""The same for `'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+` on lower-cased texts; white space makes pre-tokens of its own."""
    n = len(cp)
    kind = _CLASS[cp]
    first = np.zeros(n + 1, bool)
    first[starts] = True
    first[n] = True
    new = first[:-1].copy()
    new[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    cut = new.copy()
    at = np.flatnonzero((cp == 39) & new)
    at = at[(at + 1 < n) & new[np.minimum(at + 1, n - 1)] & ~first[np.minimum(at + 1, n)]]
    size = _contractions(cp, at)
    size[(size == 2) & first[np.minimum(at + 2, n)]] = 0
    at, size = at[size > 0], size[size > 0]
    cut[at + 1] = False
    after = at + 1 + size
    cut[after[after < n]] = True
    return cut


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((x for i in lists for x in i), np.uint32, int(sizes.sum())), sizes


class Encoder:
    """ids(texts) for a tokenizer file of kind `byte` (byte-level) or `word` (lower case, white space dropped).

    words: a function from a list of new pre-tokens to their lists of ids; whole: one from texts beyond the cut to theirs. By default both are the library's.
    """

    def __init__(self, path: str, kind: str, words: Callable[[list[str]], list[list[int]]] | None = None, whole: Callable[[list[str]], list[list[int]]] | None = None):
        self.tokenizer = load(path)
        self.lower = kind == "word"
        self.cut = {"byte": cut_byte, "word": cut_word}[kind]
        self.words, self.whole = words or self._library, whole or self._library
        self.ends = None  #: whether an id ends a word
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if self.lower and suffix and not words:
            vocab = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for w, i in vocab.items() if w.endswith(suffix)]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _library(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _coded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after another, and how many each has."""
        if self.ends is None:
            return _flat(self.words(words))
        chunks = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        parts = []
        for chunk, e in zip(chunks, self.tokenizer.encode_batch_fast([" ".join(c) for c in chunks], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            at = np.flatnonzero(self.ends[ids])
            if len(at) == len(chunk) and at[-1] == len(ids) - 1:  # a word has one end at most, so each has its own
                parts.append((ids, np.diff(at, prepend=-1)))
            else:
                parts.append(_flat(self.words(chunk)))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _clear(self) -> None:
        self.seen: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.begin = np.zeros(1 << 14, np.int64)  # of word i: flat[begin[i]:begin[i+1]]

    def _rows(self, words: list[str]) -> np.ndarray:
        """The cache's row of each distinct word."""
        if len(self.seen) + len(words) > max(CACHE, len(words)):
            self._clear()
        fresh = [w for w in words if w not in self.seen]
        if fresh:
            ids, sizes = self._coded(fresh)
            n, used = len(self.seen), int(self.begin[len(self.seen)])
            while len(self.begin) < n + len(fresh) + 1:
                self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
            self.begin[n + 1 : n + 1 + len(fresh)] = used + np.cumsum(sizes)
            total = int(self.begin[n + len(fresh)])
            while len(self.flat) < total:
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[used:total] = ids
            self.seen.update(zip(fresh, range(n, n + len(fresh)), strict=True))
        return np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))

    def _easy(self, cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids and bounds of texts given as code points."""
        cut = self.cut(cp, off[:-1][off[:-1] < len(cp)]) if len(cp) else np.zeros(0, bool)
        if self.lower:  # white space has no ids; what follows it begins a pre-token
            solid = _CLASS[cp] != SPACE
            off = np.concatenate([[0], np.cumsum(solid)])[off]
            cp, cut = cp[solid], cut[solid]
        if not len(cp):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        starts = np.flatnonzero(cut)
        wide = cp >= 0x80  # two bytes in UTF-8, as all are below 0x250
        at = np.arange(len(cp) + 1)
        at[1:] += np.cumsum(wide)
        raw = np.zeros(int(at[-1]), np.uint8)
        raw[at[:-1]] = np.where(wide, 0xC0 | cp >> 6, cp)
        raw[at[:-1][wide] + 1] = 0x80 | cp[wide] & 0x3F
        offsets = np.concatenate([at[starts], at[-1:]]).astype(np.int32)
        coded = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        rows = self._rows(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        begin, size = self.begin[rows], self.begin[rows + 1] - self.begin[rows]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(begin - (ends - size), size) + np.arange(ends[-1])]
        per = np.searchsorted(starts, off)
        return ids, np.concatenate([[0], ends])[per]

    def ids(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For a large_string array without nulls: all ids (uint32), and text i's bounds in them."""
        raw, off = text_offsets(array)
        n = len(array)
        hard = np.zeros(n, bool)
        bad = np.flatnonzero(raw >= 0xC9)  # lead bytes of code points from 0x240 on
        if len(bad):
            hard[np.unique(np.searchsorted(off, bad, "right") - 1)] = True
        kept = array.filter(pa.array(~hard)) if hard.any() else array
        texts = kept.to_pylist()
        for i, s in zip(np.flatnonzero(~hard), texts, strict=True):
            if any(x in s for x in self.special):
                hard[i] = True
        if self.lower:
            dotted = np.flatnonzero((raw[:-1] == 0xC4) & (raw[1:] == 0xB0)) if len(raw) else []
            if len(dotted):
                hard[np.unique(np.searchsorted(off, dotted, "right") - 1)] = True
        if hard.any():
            texts = array.filter(pa.array(~hard)).to_pylist()
        cp = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        if self.lower:
            cp = _LOWER[cp]
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        ids, bounds = self._easy(cp, ends)
        if not hard.any():
            return ids, bounds
        whole = {int(i): np.array(x, np.uint32) for i, x in zip(np.flatnonzero(hard), self.whole(array.filter(pa.array(hard)).to_pylist()), strict=True)}
        parts, k = [], 0
        for i in range(n):
            if i in whole:
                parts.append(whole[i])
            else:
                parts.append(ids[bounds[k] : bounds[k + 1]])
                k += 1
        return np.concatenate(parts) if parts else ids, np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """The worker's encoder for a file, with its cache."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]
