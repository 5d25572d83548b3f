r"""Words `[^\x20\x09-\x0D]+` of many texts at once, on UTF-8 bytes with A-Z lower-cased."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

from .store import text_offsets

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Odd multipliers of the words in a shingle.
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)


@dataclass
class Words:
    index: np.ndarray  #: for each word in order, its place in `hashes`
    bounds: np.ndarray  #: text i has the words bounds[i]:bounds[i+1]
    hashes: np.ndarray  #: 64-bit hash of each distinct word


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every bit depends on all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def split(array: pa.Array) -> Words:
    raw, off = text_offsets(array)
    if not len(raw):
        return Words(np.zeros(0, np.int32), np.zeros(len(array) + 1, np.int64), np.zeros(0, np.uint64))
    low = _LOWER[raw]
    space = _SPACE[low]
    first = np.ones(len(raw), bool)
    first[1:] = space[:-1]
    first[off[:-1][off[:-1] < len(raw)]] = True
    first &= ~space
    starts = np.flatnonzero(first)
    kept = low[~space]
    begin = np.concatenate([np.cumsum(~space)[starts] - 1, [len(kept)]]).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(begin), pa.py_buffer(kept)]).dictionary_encode()
    hashes = np.fromiter(map(xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return Words(coded.indices.to_numpy(), np.searchsorted(starts, off), hashes)


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct shingles of each text, sorted in each text, and their bounds.

    A text of fewer words than `size` has one, of all its words; one without words has none.
    """
    h, b = words.hashes[words.index] if len(words.index) else np.zeros(0, np.uint64), words.bounds
    n = np.diff(b)
    doc = np.repeat(np.arange(len(n)), np.maximum(n - size + 1, 0))
    if len(doc):
        count = len(h) - size + 1
        rolled = sum(h[k : k + count] * (_ODD[k % 5] + np.uint64(2 * (k // 5))) for k in range(size))
        at = np.concatenate([np.arange(b[i], b[i + 1] - size + 1) for i in np.flatnonzero(n >= size)])
        keys = mixed(rolled[at])
    else:
        keys = np.zeros(0, np.uint64)
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        own = [mixed(np.array([sum(int(x) * int(_ODD[k % 5]) for k, x in enumerate(h[b[i] : b[i + 1]])) + int(n[i]) & 0xFFFFFFFFFFFFFFFF], np.uint64))[0] for i in short]
        doc, keys = np.concatenate([doc, short]), np.concatenate([keys, np.array(own, np.uint64)])
    order = np.lexsort((keys, doc))
    doc, keys = doc[order], keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    doc, keys = doc[fresh], keys[fresh]
    return keys, np.searchsorted(doc, np.arange(len(n) + 1))
