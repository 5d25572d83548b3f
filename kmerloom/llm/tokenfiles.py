"""Token-id files with keyed access by a minimal perfect hash.

write() deals documents by key over range partitions of about SHARD bytes of text, so shards stay as small at any size, encodes each partition and writes one shard: an .ids file, the raw
ids (little-endian, 2 bytes where the vocabulary allows, else 4), and an .idx file: a header, the documents' keys and end offsets in order, and
the index: bucket displacements, and for each slot a 32-bit fingerprint of its key, the first document with that key and how
many there are. The driver gets a row for each shard and writes manifest.json with the shards' files, first ids and keys. Files are named by shard and task
attempt, and the manifest names both files of one attempt, so a repeated task does no harm.

The hash is hash-and-displace: keys fall into buckets of about four; from the largest bucket on, the first displacement that sends all its keys to
free slots is stored; buckets of one key store their slot itself. A lookup reads one displacement and one slot.

Edge cases: keys are integers, others raise TypeError; null keys sort first and are found under None. Equal keys stand side by side, also over several shards (a key of a third of all rows is dealt over
as many as its bytes ask for): a lookup returns all their documents. Repeated rows are stored as often as they occur. Null and empty texts hold the
end id alone; very long ones are stored whole. An empty table gives an empty manifest. Other columns are not stored.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import block_ids, column, shared, slices, table, texts
from .tokens import default_path, encoder
from .words import mixed

MAGIC, HEAD, END, BUCKET, SHARD = b"KLTOK01\0", "<8sIQQQ", 2, 4, 32 << 20
#: Ids read at once.
PART = 1 << 20
_NULL = np.uint64(0xA5A5F00DDEADBEEF)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _hashes(keys: np.ndarray, null: np.ndarray) -> np.ndarray:
    return mixed(np.where(null, _NULL, mixed(keys.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))))


def _slots(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    return (mixed(h + (d.astype(np.uint64) + np.uint64(1)) * _STEP) % np.uint64(n)).astype(np.int64)


def _buckets(h: np.ndarray, count: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)


def perfect(h: np.ndarray) -> np.ndarray:
    """Displacements for distinct hashes: >= 0, or -1 - slot for a bucket of one key."""
    n = len(h)
    count = n // BUCKET + 1
    bucket = _buckets(h, count)
    order = np.argsort(bucket, kind="stable")
    size = np.bincount(bucket, minlength=count)
    begin = np.cumsum(size) - size
    taken, out = np.zeros(n, bool), np.zeros(count, np.int32)
    some = np.argsort(-size, kind="stable")
    for b in some[size[some] > 1]:
        own, d0 = h[order[begin[b] : begin[b] + size[b]]], 0
        while True:
            d = np.arange(d0, d0 + 32)
            s = np.sort(_slots(own[:, None], d[None, :], n), axis=0)
            fits = ~taken[s].any(axis=0) & (s[1:] != s[:-1]).all(axis=0)
            if fits.any():
                k = int(np.argmax(fits))
                taken[s[:, k]] = True
                out[b] = d[k]
                break
            d0 += 32
    single = np.flatnonzero(size == 1)
    out[single] = -1 - np.flatnonzero(~taken)[: len(single)]
    return out


@dataclass
class Index:
    width: int
    keys: np.ndarray
    null: np.ndarray
    ends: np.ndarray
    shifts: np.ndarray
    prints: np.ndarray
    first: np.ndarray
    count: np.ndarray

    @classmethod
    def build(cls, width: int, keys: np.ndarray, null: np.ndarray, ends: np.ndarray) -> Index:
        """Keys in order, equal ones side by side."""
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (null[1:] != null[:-1])
        at = np.flatnonzero(new)
        h = _hashes(keys[at], null[at])
        shifts = perfect(h)
        slot = cls._slot(h, shifts, len(at))
        prints, first, count = (np.zeros(len(at), np.uint32) for _ in range(3))
        prints[slot], first[slot], count[slot] = mixed(h).astype(np.uint32), at, np.diff(np.append(at, len(keys)))
        return cls(width, keys, null, ends, shifts, prints, first, count)

    @staticmethod
    def _slot(h: np.ndarray, shifts: np.ndarray, n: int) -> np.ndarray:
        d = shifts[_buckets(h, len(shifts))]
        return np.where(d < 0, -1 - d.astype(np.int64), _slots(h, np.maximum(d, 0), n))

    def find(self, keys: np.ndarray, null: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each key: its first document's place (-1: absent) and how many it has."""
        null = np.zeros(len(keys), bool) if null is None else null
        if not len(self.first):
            return np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        h = _hashes(keys, null)
        slot = self._slot(h, self.shifts, len(self.first))
        hit = self.prints[slot] == mixed(h).astype(np.uint32)
        return np.where(hit, self.first[slot].astype(np.int64), -1), np.where(hit, self.count[slot].astype(np.int64), 0)

    def dump(self) -> bytes:
        head = struct.pack(HEAD, MAGIC, self.width, len(self.keys), len(self.first), len(self.shifts))
        return head + b"".join(x.tobytes() for x in (self.keys, self.null, self.ends, self.shifts, self.prints, self.first, self.count))

    @classmethod
    def load(cls, data: bytes) -> Index:
        magic, width, docs, keys, buckets = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a token index")
        out, at = [], struct.calcsize(HEAD)
        for n, kind in ((docs, np.int64), (docs, np.bool_), (docs, np.int64), (buckets, np.int32), (keys, np.uint32), (keys, np.uint32), (keys, np.uint32)):
            out.append(np.frombuffer(data, kind, n, at))
            at += n * np.dtype(kind).itemsize
        return cls(width, *out)


def write(docs: DataFrame, out: str | None = None, path: str | None = None, key: str = "doc_id", text: str = "text", end: int = END) -> str:
    """Write all documents under out (a URI; by default in the shared folder) and return it."""
    spark, path = docs.sparkSession, path or default_path("byte_bpe_50k.json")
    if dict(docs.dtypes)[key] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{key} must be an integer")
    out = out or shared(spark, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, shard = encoder(path, "byte"), next(block_ids()) >> 32
        width = 2 if enc.tokenizer.get_vocab_size() <= 1 << 16 else 4
        files, top = pafs.FileSystem.from_uri(out)
        name = f"{shard:06d}-{TaskContext.get().taskAttemptId()}"
        stream, keys, null, sizes = None, [], [], []
        for batch in slices(batches, name=text):
            if stream is None:
                files.create_dir(top, recursive=True)
                stream = files.open_output_stream(f"{top}/{name}.ids")
            ids, bounds = enc.ids(texts(batch, text))
            n = np.diff(bounds) + 1
            full = np.full(len(ids) + len(n), end, np.uint32)
            full[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n - 1)] = ids
            stream.write(full.astype(f"<u{width}").tobytes())
            k = column(batch, key).cast(pa.int64())
            keys.append(k.fill_null(0).to_numpy())
            null.append(k.is_null().to_numpy(zero_copy_only=False))
            sizes.append(n)
        if stream is not None:
            stream.close()
            ends = np.cumsum(np.concatenate(sizes)).astype(np.int64)
            index = Index.build(width, np.concatenate(keys), np.concatenate(null), ends)
            with files.open_output_stream(f"{top}/{name}.idx") as f:
                f.write(index.dump())
            key_at = lambda i: None if index.null[i] else int(index.keys[i])
            row = {"shard": shard, "name": name, "docs": len(ends), "tokens": int(ends[-1]), "first_key": key_at(0), "last_key": key_at(-1)}
            yield pa.RecordBatch.from_pylist([row], pa.schema([(c, pa.string() if c == "name" else pa.int64()) for c in row]))

    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    by, dealt = F.col(key).asc_nulls_first(), F.monotonically_increasing_id().alias("__dealt")  # deals equal keys
    ranged = docs.select(F.col(key), F.col(text), dealt).repartitionByRange(-(-size // SHARD) or 1, by, F.col("__dealt")).sortWithinPartitions(by, F.xxhash64(text), "__dealt").select(key, text)
    made = ranged.mapInArrow(run, "shard bigint, name string, docs bigint, tokens bigint, first_key bigint, last_key bigint").collect()
    shards = sorted((r.asDict() for r in made), key=lambda r: r["shard"])
    begin = 0
    for r in shards:
        r["start"], begin = begin, begin + r["tokens"]
    files, top = pafs.FileSystem.from_uri(out)
    files.create_dir(top, recursive=True)
    with files.open_output_stream(f"{top}/manifest.json") as f:
        f.write(json.dumps({"shards": shards, "ids": begin}).encode())
    return out


def manifest(out: str) -> list[dict]:
    files, top = pafs.FileSystem.from_uri(out)
    with files.open_input_stream(f"{top}/manifest.json") as f:
        return json.loads(f.read())["shards"]


class Shard:
    """One shard's files."""

    def __init__(self, out: str, name: str):
        files, top = pafs.FileSystem.from_uri(out)
        with files.open_input_stream(f"{top}/{name}.idx") as f:
            self.index = Index.load(f.read())
        self.payload = files.open_input_file(f"{top}/{name}.ids")

    def read(self, begin: int, end: int) -> np.ndarray:
        """Ids begin:end as unsigned 32-bit integers."""
        w = self.index.width
        return np.frombuffer(self.payload.read_at((end - begin) * w, begin * w), f"<u{w}").astype(np.uint32)

    def get(self, key: int | None) -> list[np.ndarray]:
        """The ids of each document with this key."""
        at, n = (int(x[0]) for x in self.index.find(np.array([key or 0], np.int64), np.array([key is None])))
        if n and (bool(self.index.null[at]), int(self.index.keys[at])) != (key is None, key or 0):
            return []  # another key with the same fingerprint
        bound = lambda i: int(self.index.ends[i - 1]) if i else 0
        return [self.read(bound(i), bound(i + 1)) for i in range(at, at + n)]


def get(out: str, key: int | None) -> list[np.ndarray]:
    """A document's ids by its key: the manifest gives the shards (more than one only where a key goes over their border), a shard's index the range."""
    order = lambda k: (k is not None, k or 0)
    at = [s for s in manifest(out) if order(s["first_key"]) <= order(key) <= order(s["last_key"])]
    return [ids for s in at for ids in Shard(out, s["name"]).get(key)]


def read(spark: SparkSession, out: str, with_ids: bool = False) -> DataFrame:
    """A row for each document, from the files, each found by its key: doc_id, start, n_tokens, ids_crc32; with_ids: ids (binary, unsigned 32 bits)."""
    shards = manifest(out)
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    kinds = [pa.int64()] * 4 + [pa.binary()] * with_ids
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                shard = Shard(out, shards[i]["name"])
                x = shard.index
                new = np.ones(len(x.keys), bool)
                new[1:] = (x.keys[1:] != x.keys[:-1]) | (x.null[1:] != x.null[:-1])
                first, count = x.find(x.keys[new], x.null[new])
                place = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
                begin, end = np.append(0, x.ends)[place], x.ends[place]
                cut = np.flatnonzero(np.diff(end // PART, prepend=-1))  # neighbours are read at once, about PART ids
                for a, z in zip(cut, np.append(cut[1:], len(place)), strict=True):
                    part, low = slice(a, z), int(begin[a])
                    ids = shard.read(low, int(end[z - 1]))
                    raw = [ids[b - low : e - low].tobytes() for b, e in zip(begin[part], end[part], strict=True)]
                    cols = [pa.array(x.keys[place[part]], pa.int64(), mask=x.null[place[part]]), shards[i]["start"] + begin[part], (end - begin)[part], [zlib.crc32(r) for r in raw], *[raw] * with_ids]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return spark.range(0, len(shards), 1, max(1, len(shards))).mapInArrow(run, schema)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, write(table(spark, sf_dir, "documents")))
