r"""Byte-level BPE by a trie of distinct words, and back.

The encoding of a text's prefix is known by its last token: it is the one token, ending there, that may follow the last token
of the prefix before it. Two tokens may stand side by side if no merge across their border would have come first:
let x be a part at the right edge of the left token and y one at the left edge of the right token, as their own merges made them; a merge
of x and y must not rank before the merges that used up x and y (at equal rank the left one comes first).

Distinct words, sorted, are the trie in depth-first order: what a word shares with the one before is the path from the
root to their fork. The states (last tokens) of that path stay on a stack and only the rest of the word is worked out, so each
trie node is done once. A word's ids follow by stepping back from its end.

Edge cases: null and empty texts have no ids and decode to nothing. Words of any length take time in proportion to it (candidates are bounded by the longest token).
The string of a special token is that token's id, as in the library. Bytes that aren't UTF-8 after decoding become U+FFFD. Rows are taken
each by itself; other columns are left out; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .store import column, slices, table, texts
from .tokens import SLICE, Encoder, default_path

#: The split of byte-level BPE files; \p{White_Space} is what their \s means.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?![^\p{White_Space}])|\p{White_Space}+")


@cache
def byte_chars() -> dict[str, int]:
    """The printable characters that stand for bytes in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Model:
    """Tokens, merges and which pairs may stand side by side."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        chars = byte_chars()
        name = {t: i for t, i in data["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.ids = {bytes(map(chars.__getitem__, t)): i for t, i in name.items() if t not in self.special}
        self.bytes = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.longest = max(map(len, self.ids))
        self.made: dict[tuple[int, int], tuple[int, int]] = {}  #: pair: rank and id of its merge
        self.parts: dict[int, tuple[int, int, int]] = {}  #: id: rank, left, right
        for rank, m in enumerate(data["model"]["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            a, b, c = name[left], name[right], name[left + right]
            self.made[a, b] = (rank, c)
            self.parts.setdefault(c, (rank, a, b))
        self._edges: tuple[dict, dict] = ({}, {})
        self._may: dict[int, bool] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Parts at a token's left (0) or right (1) edge, and the rank of the merge that uses each up."""
        if (out := self._edges[side].get(token)) is None:
            out, t, used = [], token, 1 << 40
            while True:
                out.append((t, used))
                if t not in self.parts:
                    break
                used, t = self.parts[t][0], self.parts[t][1 + side]
            self._edges[side][token] = out
        return out

    def may_follow(self, left: int, right: int) -> bool:
        key = left << 20 | right
        if (out := self._may.get(key)) is None:
            if len(self._may) > 2_000_000:
                self._may.clear()
            out = self._may[key] = not any((m := self.made.get((x, y))) and m[0] < x_used and m[0] <= y_used for x, x_used in self._edge(left, 1) for y, y_used in self._edge(right, 0))
        return out

    def words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word, by depth-first traversal of the words' trie."""
        coded = [w.encode() for w in words]
        out: list[list[int]] = [[]] * len(words)
        ids, longest, may = self.ids, self.longest, self.may_follow
        last: list[int] = [0]  # last[i]: the last token of the path's first i bytes
        size: list[int] = [0]
        before = b""
        for k in sorted(range(len(words)), key=coded.__getitem__):
            w = coded[k]
            n, fork, most = len(w), 0, min(len(w), len(before))
            if w[:most] == before[:most]:
                fork = most
            else:
                while w[fork] == before[fork]:
                    fork += 1
            del last[fork + 1 :], size[fork + 1 :]
            for i in range(fork + 1, n + 1):
                for j in range(max(0, i - longest), i):
                    t = ids.get(w[j:i])
                    if t is not None and (not j or may(last[j], t)):
                        last.append(t)
                        size.append(i - j)
                        break
                else:
                    raise ValueError(f"no token ends at byte {i} of {w!r}")
            back, i = [], n
            while i:
                back.append(last[i])
                i -= size[i]
            out[k] = back[::-1]
            before = w
        return out

    def texts(self, rows: list[str]) -> list[list[int]]:
        """The ids of whole texts of any characters."""
        at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        cut = [[x for part in (at_special.split(s) if at_special else [s]) for x in ([part] if part in self.special else SPLIT.findall(part))] for s in rows]
        distinct = list({w for ws in cut for w in ws if w not in self.special})
        ids = dict(zip(distinct, self.words(distinct), strict=True)) | {t: [i] for t, i in self.special.items()}
        return [[i for w in ws for i in ids[w]] for ws in cut]


class Coder:
    """encode and decode whole batches."""

    def __init__(self, path: str):
        self.model = Model(path)
        self.encoder = Encoder(path, "byte", self.model.words, self.model.texts)
        n = max(self.model.bytes) + 1
        sizes = np.array([len(self.model.bytes.get(i, b"")) for i in range(n)])
        self.begin = np.concatenate([[0], np.cumsum(sizes)])
        self.flat = np.frombuffer(b"".join(self.model.bytes.get(i, b"") for i in range(n)), np.uint8)

    def encode(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.encoder.ids(array)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        size = self.begin[ids + np.uint32(1)] - self.begin[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        raw = self.flat[np.repeat(self.begin[ids] - (ends - size), size) + np.arange(total)].tobytes()
        at = np.concatenate([[0], ends])[bounds]
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def encode(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (array), decoded: the text decoded from the ids."""
    path, kind = path or default_path("byte_bpe_50k.json"), dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in slices(batches, 2 << 20, text):
            ids, bounds = c.encode(texts(batch, text))
            rows = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([column(batch, key), rows, pa.array(c.decode(ids, bounds), pa.string())], names=[key, "ids", "decoded"])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256: the same as encode()'s columns, digested where they are made."""
    path, kind = path or default_path("byte_bpe_50k.json"), dict(docs.dtypes)[key]
    names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in slices(batches, SLICE, text):
            ids, bounds = c.encode(texts(batch, text))
            own = [hashlib.sha256(ids[a:b].astype("<u4").tobytes()).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            back = [hashlib.sha256(s.encode()).hexdigest() for s in c.decode(ids, bounds)]
            yield pa.RecordBatch.from_arrays([column(batch, key), pa.array(np.diff(bounds), pa.int64()), pa.array(own), pa.array(back)], names=names)

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op4_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
