"""The k-mer path on NumPy arrays, for bulk work by Arrow batches: same results as the Column path."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.config import Config, mebibytes
from kmerloom.errors import ResourceError
from kmerloom.session import ship

from .bits import GOLDEN, SALTS

U = np.uint64
#: A filter of at most so many bytes is sent to every worker.
HELD_BYTES = mebibytes("KMERLOOM_HELD_MIB", 64 << 20)
#: Windows taken at once.
MOST = 1 << 20
SHARD_FIELDS = ("shard", "w0", "w1", "w2", "w3")


def _joined(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all sequences and their offsets."""
    a = array.cast(pa.large_binary()) if not pa.types.is_large_binary(array.type) else array
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    raw = np.frombuffer(a.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def _symbols(raw: np.ndarray, off: np.ndarray, at: np.ndarray, first: int, last: int, config: Config) -> tuple[np.ndarray, np.ndarray]:
    """Codes and validity of the symbols first:last of all records; at: the records' offsets in symbols."""
    a = config.alphabet
    if a.width == 1:
        code = a.table[raw[first:last]]
        return code.astype(U), code != a.invalid
    sym = np.arange(first, last)
    row = np.searchsorted(at, sym, "right") - 1
    begin = off[row] + (sym - at[row]) * a.width
    code, good = np.zeros(len(sym), U), np.ones(len(sym), bool)
    for j in range(a.width):
        unit = a.table[raw[begin + j]]
        good &= unit != a.invalid
        code = code << U(a.unit_bits) | unit.astype(U) & U((1 << a.unit_bits) - 1)
    return code, good


def chunks(array: pa.Array, config: Config, most: int = MOST) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Packed k-mer, row and position of the valid windows of an array of strings without nulls, from `most` windows at once.

    Neighbouring chunks share k - 1 symbols, so a sequence of any length takes the memory of a chunk besides its bytes.
    """
    raw, off = _joined(array)
    k = config.k
    at = off if config.alphabet.width == 1 else np.concatenate([[0], np.cumsum(np.diff(off) // config.alphabet.width)])
    for begin in range(0, int(at[-1]) - k + 1, most):
        end = min(begin + most, int(at[-1]) - k + 1)
        code, good = _symbols(raw, off, at, begin, end + k - 1, config)
        bad = np.concatenate([[0], np.cumsum(~good)])
        start = np.arange(begin, end)
        row = np.searchsorted(at, start, "right") - 1
        ok = (bad[k:] == bad[:-k]) & (start + k <= at[row + 1])
        yield _packed(code, k, config.bits)[ok], row[ok], (start - at[row])[ok]


def kmers(array: pa.Array, config: Config) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All of chunks() at once."""
    parts = list(chunks(array, config))
    empty = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else empty


def _packed(code: np.ndarray, length: int, bits: int) -> np.ndarray:
    """Each window of `length` codes as one word, by doubling."""
    out, have = None, 0
    span, size, part = code, 1, length
    while part:  # binary digits of the length, low first: what stands to the right comes first
        if part & 1:
            if out is None:
                out, have = span, size
            else:  # `span` covers the symbols before those of `out`
                out = span[: len(code) - have - size + 1] << U(bits * have) | out[size : size + len(code) - have - size + 1]
                have += size
        part >>= 1
        if part:
            n = len(span) - size
            span = span[:n] << U(bits * size) | span[size : size + n]
            size *= 2
    return out


def parts(packed: np.ndarray, config: Config, length: int) -> Iterator[np.ndarray]:
    mask = U((1 << config.bits * length) - 1)
    for o in range(config.k - length + 1):
        yield packed >> U(config.bits * (config.k - o - length)) & mask


def minimizers(packed: np.ndarray, config: Config) -> np.ndarray:
    out = None
    for p in parts(packed, config, config.m):
        h = p * U(GOLDEN)
        out = h if out is None else np.minimum(out, h)
    return out


def masks(packed: np.ndarray, config: Config) -> np.ndarray:
    """The four words' bits of each k-mer: (n, 4)."""
    out = np.zeros((len(packed), 4), U)
    for p in parts(packed, config, config.s):
        h = p * U(GOLDEN)
        h ^= h >> U(33)
        for i in range(config.hashes):
            at = h >> U(64 // config.hashes * i) & U(63) if config.hashes <= 8 else h * U(SALTS[i]) >> U(58)
            out[:, i % 4] |= U(1) << at
    return out


def built(packed: np.ndarray, config: Config, num_shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shards that are hit, and their words."""
    if not len(packed):
        return np.zeros(0, np.int64), np.zeros((0, 4), U)
    shard = (minimizers(packed, config) & U(num_shards - 1)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    begin = np.flatnonzero(np.concatenate([[True], np.diff(shard[order]) != 0]))
    return shard[order][begin], np.bitwise_or.reduceat(masks(packed, config)[order], begin)


def build(records: DataFrame, config: Config, num_shards: int, sequence: str = "sequence", most: int = MOST) -> DataFrame:
    """The shards of all records: each chunk is reduced to its shards before they are ORed."""
    ship(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed, _, _ in chunks(batch.column(0).fill_null(""), config, most):
                shard, words = built(np.unique(packed), config, num_shards)
                yield pa.RecordBatch.from_arrays([pa.array(shard), *(pa.array(np.ascontiguousarray(words[:, j]).view(np.int64)) for j in range(4))], names=list(SHARD_FIELDS))

    out = records.select(F.col(sequence).cast("string").alias("s")).mapInArrow(run, "shard bigint, w0 bigint, w1 bigint, w2 bigint, w3 bigint")
    return out.groupBy("shard").agg(*(F.bit_or(w).alias(w) for w in SHARD_FIELDS[1:]))


def table(shards: DataFrame, num_shards: int) -> np.ndarray:
    """A filter's words as an array (num_shards, 4) on the driver: 32 bytes a shard, so at most HELD_BYTES."""
    if num_shards * 32 > HELD_BYTES:
        raise ResourceError(f"a filter of {num_shards * 32} bytes is more than a worker holds ({HELD_BYTES})")
    rows = shards.select(*SHARD_FIELDS).toArrow()
    out = np.zeros((num_shards, 4), U)
    at = rows.column("shard").to_numpy()
    for j, w in enumerate(SHARD_FIELDS[1:]):
        out[at, j] = rows.column(w).to_numpy().view(U)
    return out


def _counted(batch: pa.RecordBatch, config: Config) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """chunks() of the column `s` with the shards' hashes and the bits that each k-mer needs."""
    for packed, row, pos in chunks(column(batch, "s").fill_null(""), config):
        yield packed, row, pos, minimizers(packed, config), masks(packed, config)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def probe(records: DataFrame, words: np.ndarray, config: Config, key: str = "record_index", sequence: str = "sequence", hits: bool = False) -> DataFrame:
    """key, queried_bases, queried_kmers, positive_kmers of each record against a filter's table, broadcast once; hits: array with 1 or 0 for every window."""
    ship(records.sparkSession)
    held = records.sparkSession.sparkContext.broadcast(words)
    names = [key, "queried_bases", "queried_kmers", "positive_kmers", *["hits"] * hits]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                n = part.num_rows
                size = pc.fill_null(pc.binary_length(column(part, "s")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                windows = np.maximum(size // config.alphabet.width - config.k + 1, 0)
                ends, valid, positive = np.cumsum(windows), np.zeros(n, np.int64), np.zeros(n, np.int64)
                marks = np.zeros(int(ends[-1]) if hits else 0, np.int8)
                for _, row, pos, least, need in _counted(part, config):
                    hit = ((table[(least & U(len(table) - 1)).astype(np.int64)] & need) == need).all(axis=1)
                    valid += np.bincount(row, minlength=n)
                    positive += np.bincount(row[hit], minlength=n)
                    if hits:
                        marks[(ends - windows)[row[hit]] + pos[hit]] = 1
                cols = [column(part, "k"), pa.array(size, mask=column(part, "s").is_null().to_numpy(zero_copy_only=False)), pa.array(valid), pa.array(positive)]
                if hits:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(marks)))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = dict(records.dtypes)[key]
    out = f"{key} {kind}, queried_bases bigint, queried_kmers bigint, positive_kmers bigint" + ", hits array<tinyint>" * hits
    return records.select(F.col(key).alias("k"), F.col(sequence).cast("string").alias("s")).mapInArrow(run, out)


RUNS = "id bigint, k {kind}, bases bigint, windows bigint, valid bigint, shard bigint, at array<int>, kmers array<bigint>"


def runs(records: DataFrame, num_shards: int, config: Config, key: str = "record_index", sequence: str = "sequence") -> DataFrame:
    """Rows to look up in a filter of any size: neighbouring windows with one shard share a row, and so one lookup.

    id (of the record), k (its key), bases, windows, shard, at and kmers of a run; each record has one row besides, with its number of valid windows and no shard.
    """
    ship(records.sparkSession)
    schema = RUNS.format(kind=dict(records.dtypes)[key])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        for batch in batches:
            size = pc.fill_null(pc.binary_length(column(batch, "s")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            windows, n = np.maximum(size // config.alphabet.width - config.k + 1, 0), batch.num_rows
            bases, valid = pa.array(size, mask=column(batch, "s").is_null().to_numpy(zero_copy_only=False)), np.zeros(n, np.int64)
            for packed, row, pos in chunks(column(batch, "s").fill_null(""), config):
                valid += np.bincount(row, minlength=n)
                shard = (minimizers(packed, config) & U(num_shards - 1)).astype(np.int64)
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (shard[1:] != shard[:-1])
                begin = np.flatnonzero(new)
                offsets, of = pa.array(np.append(begin, len(row)).astype(np.int32)), pa.array(row[begin])
                lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(pos.astype(np.int32)), pa.array(packed.view(np.int64)))]
                none = pa.nulls(len(begin), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(base + row[begin]), column(batch, "k").take(of), none, none, none, pa.array(shard[begin]), *lists], names=NAMES)
            empty = [pa.nulls(n, pa.list_(t)) for t in (pa.int32(), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(base + np.arange(n)), column(batch, "k"), bases, pa.array(windows), pa.array(valid), pa.nulls(n, pa.int64()), *empty], names=NAMES)
            base += n

    return records.select(F.col(key).alias("k"), F.col(sequence).cast("string").alias("s")).mapInArrow(run, schema)


NAMES = ["id", "k", "bases", "windows", "valid", "shard", "at", "kmers"]


def looked_up(joined: DataFrame, config: Config) -> DataFrame:
    """runs() joined with a filter's w0 to w3: id, k, bases, windows, valid, positive, at (the places of hits)."""
    kind = dict(joined.dtypes)["k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kmers_, at = column(batch, "kmers"), column(batch, "at")
            n = pc.fill_null(pc.list_value_length(kmers_), 0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), n)
            packed = kmers_.flatten().to_numpy(zero_copy_only=False).view(U)
            words = np.stack([column(batch, w).fill_null(0).to_numpy(zero_copy_only=False).view(U) for w in SHARD_FIELDS[1:]], axis=1)
            need = masks(packed, config)
            hit = ((words[row] & need) == need).all(axis=1)
            positive = np.bincount(row[hit], minlength=batch.num_rows)
            where = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(positive)]).astype(np.int32)), pa.array(at.flatten().to_numpy(zero_copy_only=False)[hit].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in NAMES[:5]), pa.array(positive.astype(np.int64)), where], names=[*NAMES[:5], "positive", "at"])

    return joined.mapInArrow(run, f"id bigint, k {kind}, bases bigint, windows bigint, valid bigint, positive bigint, at array<int>")


def pack_dense(raw: bytes, config: Config) -> np.ndarray:
    """The dense-packed words of one sequence; a byte without a code is stored as the mask of a symbol's bits."""
    a = config.alphabet
    n = len(raw) // a.width
    code, good = _symbols(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), np.array([0, n]), 0, n, config)
    code = np.where(good, code, U((1 << a.bits) - 1 if a.width > 1 else a.invalid & (1 << a.bits) - 1))
    s = 64 // a.bits
    out = np.zeros(-(-len(code) // s), U)
    for i in range(s):
        part = code[i::s]
        out[: len(part)] |= part << U(i * a.bits)
    return out


def xxhash64(keys: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of each 64-bit key's bytes (little-endian) with any seed."""
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(k, seed) for k in np.ascontiguousarray(keys, "<u8").view("V8").tolist()), U, len(keys))
