"""Matroska: a reader of EBML elements that makes packet tables, and a writer for 8-bit PCM payloads.

The reader walks variable-length elements (ids of 1 to 4 bytes, sizes of 1 to 8, unknown sizes for Segment and Cluster), takes
tracks, clusters, SimpleBlocks and BlockGroups, undoes Xiph, EBML and fixed-size lacing, and returns for each packet its
track, timestamp and byte range in the file; cues make a table of their own, with the cluster that each names.

The writer stores bytes as mono 8-bit PCM at 8 kHz: frames of FRAME bytes, up to LACE of them laced in a block (fixed-size
lacing, or EBML lacing where the last frame is shorter), up to BLOCKS blocks in a cluster, a cue point for each cluster.

Edge cases: a null file gives no packets; a broken file (not EBML, an element beyond its parent, a bad lace) raises MatroskaError, or, with
strict=False, gives one row with the message in `error` and null elsewhere. An empty text is stored as 64 zero bytes. Very long texts take more clusters. Repeated
rows are read each by itself; columns other than the key and the file are left out, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .store import column, per_slice, table

# Fixed values of the format.
EBML, SEGMENT, INFO, SCALE, TRACKS, TRACK, NUMBER, KIND, CODEC, AUDIO, RATE, CHANNELS, DEPTH = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1, 0x1654AE6B, 0xAE, 0xD7, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIME, SIMPLE, GROUP, BLOCK, DURATION, CUES, POINT, CUE_TIME, CUE_AT, CUE_TRACK, CUE_CLUSTER = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP = {CLUSTER, CUES, INFO, TRACKS, SEGMENT, EBML, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}
XIPH, FIXED, EBML_LACE = 1, 2, 3
PAD, FRAME, LACE, BLOCKS, HERTZ = 64, 4096, 8, 8, 8000


class MatroskaError(ValueError):
    pass


@dataclass
class Track:
    number: int = 0
    kind: int = 0
    codec: str = ""
    rate: float = 8000.0
    channels: int = 1
    depth: int = 0


@dataclass
class Packet:
    track: int
    timestamp_ns: int
    cluster: int
    block: int
    frame: int
    lacing: int
    key: bool
    start: int
    length: int


@dataclass
class Media:
    scale: int = 1_000_000
    tracks: dict[int, Track] = field(default_factory=dict)
    packets: list[Packet] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  #: time, track, absolute position of the cluster
    clusters: list[int] = field(default_factory=list)  #: first byte of each cluster's body
    starts: list[int] = field(default_factory=list)  #: first byte of each cluster, which cues name


def _vint(data: bytes, at: int, end: int, keep: bool = False) -> tuple[int, int, int]:
    """Value, place after it and length in bytes; keep: with the length marker, as in ids."""
    if at >= end or not data[at]:
        raise MatroskaError(f"no variable-length number at byte {at}")
    n = 9 - data[at].bit_length()
    if at + n > end:
        raise MatroskaError(f"number at byte {at} is cut off")
    x = int.from_bytes(data[at : at + n], "big")
    return (x if keep else x & ((1 << 7 * n) - 1)), at + n, n


def _elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """Id, first byte and end of each child; an element of unknown size ends before the next one of its level."""
    while at < end:
        kind, at, n = _vint(data, at, end, keep=True)
        if n > 4:
            raise MatroskaError(f"id of {n} bytes before byte {at}")
        size, at, n = _vint(data, at, end)
        if size == (1 << 7 * n) - 1:
            to = end if kind == SEGMENT else _unknown_end(data, at, end)
        else:
            to = at + size
        if to > end:
            raise MatroskaError(f"element {kind:X} reaches beyond its parent: {to} > {end}")
        yield kind, at, to
        at = to


def _unknown_end(data: bytes, at: int, end: int) -> int:
    while at < end:
        kind, then, _ = _vint(data, at, end, keep=True)
        if kind in TOP:
            return at
        size, then, _ = _vint(data, then, end)
        at = then + size
    return end


def _uint(data: bytes, at: int, to: int) -> int:
    return int.from_bytes(data[at:to], "big")


def _float(data: bytes, at: int, to: int) -> float:
    return struct.unpack(">f" if to - at == 4 else ">d", data[at:to])[0] if to > at else 0.0


def _frames(data: bytes, at: int, to: int, lacing: int) -> list[tuple[int, int]]:
    """Start and length of each frame of a block's body."""
    if not lacing:
        return [(at, to - at)]
    if at >= to:
        raise MatroskaError(f"no frame count at byte {at}")
    n = data[at] + 1
    at += 1
    if lacing == FIXED:
        size, rest = divmod(to - at, n)
        if rest:
            raise MatroskaError(f"{to - at} bytes in {n} equal frames at byte {at}")
        return [(at + i * size, size) for i in range(n)]
    sizes: list[int] = []
    for i in range(n - 1):
        if lacing == XIPH:
            size = 0
            while at < to:
                size += (b := data[at])
                at += 1
                if b < 255:
                    break
        else:
            x, at, width = _vint(data, at, to)
            size = x if not i else sizes[-1] + x - ((1 << 7 * width - 1) - 1)
        sizes.append(size)
    sizes.append(to - at - sum(sizes))
    if min(sizes) < 0:
        raise MatroskaError(f"laced frames exceed their block at byte {at}")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def parse(data: bytes) -> Media:
    out = Media()
    top = list(_elements(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        raise MatroskaError("no EBML header")
    for kind, at, to in top:
        if kind == SEGMENT:
            _segment(data, at, to, out)
    return out


def _segment(data: bytes, base: int, end: int, out: Media) -> None:
    begin = base
    for kind, at, to in _elements(data, base, end):
        start, begin = begin, to
        if kind == INFO:
            out.scale = next((_uint(data, a, b) for k, a, b in _elements(data, at, to) if k == SCALE), out.scale)
        elif kind == TRACKS:
            for k, a, b in _elements(data, at, to):
                if k == TRACK:
                    track = _track(data, a, b)
                    out.tracks[track.number] = track
        elif kind == CLUSTER:
            out.clusters.append(at)
            out.starts.append(start)
            _cluster(data, at, to, out)
        elif kind == CUES:
            for k, a, b in _elements(data, at, to):
                if k == POINT:
                    _cue(data, a, b, base, out)


def _track(data: bytes, at: int, to: int) -> Track:
    t = Track()
    for k, a, b in _elements(data, at, to):
        if k == NUMBER:
            t.number = _uint(data, a, b)
        elif k == KIND:
            t.kind = _uint(data, a, b)
        elif k == CODEC:
            t.codec = data[a:b].decode("ascii", "replace").rstrip("\0")
        elif k == AUDIO:
            for j, c, d in _elements(data, a, b):
                if j == RATE:
                    t.rate = _float(data, c, d)
                elif j == CHANNELS:
                    t.channels = _uint(data, c, d)
                elif j == DEPTH:
                    t.depth = _uint(data, c, d)
    return t


def _cue(data: bytes, at: int, to: int, base: int, out: Media) -> None:
    time, places = 0, []
    for k, a, b in _elements(data, at, to):
        if k == CUE_TIME:
            time = _uint(data, a, b)
        elif k == CUE_AT:
            inner = {j: _uint(data, c, d) for j, c, d in _elements(data, a, b)}
            places.append((inner.get(CUE_TRACK, 0), base + inner.get(CUE_CLUSTER, 0)))
    out.cues += [(time, *p) for p in places]


def _cluster(data: bytes, at: int, to: int, out: Media) -> None:
    time, n = 0, 0
    for k, a, b in _elements(data, at, to):
        if k == TIME:
            time = _uint(data, a, b)
        elif k == SIMPLE:
            _block(data, a, b, time, n, None, out)
            n += 1
        elif k == GROUP:
            inner = [(j, c, d) for j, c, d in _elements(data, a, b)]
            lasts = next((_uint(data, c, d) for j, c, d in inner if j == DURATION), None)
            for j, c, d in inner:
                if j == BLOCK:
                    _block(data, c, d, time, n, lasts, out)
                    n += 1


def _block(data: bytes, at: int, to: int, time: int, n: int, lasts: int | None, out: Media) -> None:
    number, at, _ = _vint(data, at, to)
    if at + 3 > to:
        raise MatroskaError(f"block header cut off at byte {at}")
    shift, flags = struct.unpack_from(">hB", data, at)
    lacing = flags >> 1 & 3
    track, begin = out.tracks.get(number), (time + shift) * out.scale
    frames = _frames(data, at + 3, to, lacing)
    for i, (start, length) in enumerate(frames):
        if track and track.depth and track.codec.startswith("A_PCM"):
            later = sum(x for _, x in frames[:i]) * 8_000_000_000 // int(track.rate * track.channels * track.depth)
        else:
            later = i * lasts * out.scale // len(frames) if lasts else 0
        out.packets.append(Packet(number, begin + later, len(out.clusters) - 1, n, i, lacing, bool(flags & 0x80), start, length))


def _size(n: int) -> bytes:
    """The shortest size that isn't the unknown one."""
    w = next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * w).to_bytes(w, "big")


def _element(kind: int, *body: bytes) -> bytes:
    joined = b"".join(body)
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + _size(len(joined)) + joined


def _number(kind: int, x: int, width: int = 0) -> bytes:
    return _element(kind, x.to_bytes(width or max(1, (x.bit_length() + 7) // 8), "big"))


def _head() -> bytes:
    return _element(EBML, _number(0x4286, 1), _number(0x42F7, 1), _number(0x42F2, 4), _number(0x42F3, 8), _element(0x4282, b"matroska"), _number(0x4287, 4), _number(0x4285, 2))


_HEAD = _head()
_FRONT = _element(INFO, _number(SCALE, 1_000_000), _element(0x4D80, b"kmerloom"), _element(0x5741, b"kmerloom")) + _element(
    TRACKS, _element(TRACK, _number(NUMBER, 1), _number(0x73C5, 1), _number(KIND, 2), _number(0x9C, 1), _element(CODEC, b"A_PCM/INT/LIT"), _element(AUDIO, _element(RATE, struct.pack(">d", float(HERTZ))), _number(CHANNELS, 1), _number(DEPTH, 8)))
)


def mux(payload: bytes) -> bytes:
    """The payload as a Matroska file."""
    clusters, cues, at = [], [], len(_FRONT)
    for begin in range(0, max(1, len(payload)), FRAME * LACE * BLOCKS):
        time, blocks = begin * 1000 // HERTZ, []
        for b in range(begin, min(begin + FRAME * LACE * BLOCKS, len(payload)), FRAME * LACE):
            body = payload[b : b + FRAME * LACE]
            n = -(-len(body) // FRAME)
            lacing = 0 if n == 1 else EBML_LACE if len(body) % FRAME else FIXED
            lace = b"" if not lacing else bytes([n - 1])
            if lacing == EBML_LACE:  # equal sizes but for the last: the first in full, then differences of 0
                lace += _size(FRAME) + _size(63) * (n - 2)
            blocks.append(_element(SIMPLE, b"\x81", struct.pack(">hB", b * 1000 // HERTZ - time, 0x80 | lacing << 1), lace, body))
        cues.append(_element(POINT, _number(CUE_TIME, time), _element(CUE_AT, _number(CUE_TRACK, 1), _number(CUE_CLUSTER, at, 8))))
        clusters.append(_element(CLUSTER, _number(TIME, time), *blocks))
        at += len(clusters[-1])
    return _HEAD + _element(SEGMENT, _FRONT, *clusters, _element(CUES, *cues))


def padded(text: str) -> bytes:
    data = text.encode()
    return data + bytes(-len(data) % PAD if data else PAD)


def payload(data: bytes, media: Media) -> bytes:
    """The bytes of all packets, in order."""
    return b"".join(data[p.start : p.start + p.length] for p in media.packets)


def feature(media: Media) -> str:
    t, by = next(iter(media.tracks.values())), [sum(p.lacing == k for p in media.packets) for k in range(4)]
    last = media.packets[-1]
    length = last.timestamp_ns // 1_000_000 + last.length * 1000 // int(t.rate)
    return f"{t.codec} {t.rate:.0f}Hz {t.depth}bit ms={length} clusters={len(media.clusters)} cues={len(media.cues)} packets={len(media.packets)} laced={','.join(map(str, by))}"


PACKETS = "track bigint, timestamp_ns bigint, cluster bigint, block bigint, frame bigint, lacing bigint, keyframe boolean, start bigint, length bigint, error string"


def packet_table(files: DataFrame, key: str, data: str, strict: bool = True) -> DataFrame:
    """A row for each packet of each file: the key, PACKETS."""
    names = [key, *(x.split()[0] for x in PACKETS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                if (blob := column(batch, data)[i].as_py()) is None:
                    continue
                try:
                    rows = [(p.track, p.timestamp_ns, p.cluster, p.block, p.frame, p.lacing, p.key, p.start, p.length, None) for p in parse(blob).packets]
                except MatroskaError as e:
                    if strict:
                        raise
                    rows = [(*[None] * 9, str(e))]
                cols = list(zip(*rows, strict=True)) or [()] * 10
                kinds = [*[pa.int64()] * 6, pa.bool_(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([column(batch, key)[i].as_py()] * len(rows), column(batch, key).type), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=names)

    return files.select(key, data).mapInArrow(run, f"{key} {dict(files.dtypes)[key]}, {PACKETS}")


CUES_TABLE = "time_ns bigint, track bigint, cluster bigint, start bigint, error string"


def cue_table(files: DataFrame, key: str, data: str, strict: bool = True) -> DataFrame:
    """A row for each cue of each file: the key, its time and track, the number of the cluster it names (null if none begins there) and that cluster's first byte."""
    names = [key, *(x.split()[0] for x in CUES_TABLE.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                if (blob := column(batch, data)[i].as_py()) is None:
                    continue
                try:
                    m = parse(blob)
                    number = {at: n for n, at in enumerate(m.starts)}
                    rows = [(time * m.scale, track, number.get(at), at, None) for time, track, at in m.cues]
                except MatroskaError as e:
                    if strict:
                        raise
                    rows = [(*[None] * 4, str(e))]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array([column(batch, key)[i].as_py()] * len(rows), column(batch, key).type), *(pa.array(c, t) for c, t in zip(cols, [*[pa.int64()] * 4, pa.string()], strict=True))], names=names)

    return files.select(key, data).mapInArrow(run, f"{key} {dict(files.dtypes)[key]}, {CUES_TABLE}")


def stored(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text as a Matroska file: key, n_bytes, media."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [s or "" for s in column(batch, text).to_pylist()]
        return pa.RecordBatch.from_arrays([column(batch, key), pa.array([len(s.encode()) for s in rows], pa.int64()), pa.array([mux(padded(s)) for s in rows], pa.binary())], names=[key, "n_bytes", "media"])

    return docs.select(key, text).mapInArrow(per_slice(one, name=text), f"{key} {dict(docs.dtypes)[key]}, n_bytes bigint, media binary")


FEATURES = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def measured(n_bytes: int, data: bytes) -> tuple:
    """FEATURES of a stored file: the payload is read back by the packets' byte ranges."""
    body = payload(data, media := parse(data))
    return n_bytes, len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-PAD:]), len(data), hashlib.sha256(data).hexdigest(), feature(media)


def _rows(keys: pa.Array, rows: list[tuple], key: str) -> pa.RecordBatch:
    fields = [x.split() for x in FEATURES.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([keys, *(pa.array(c, pa.string() if t == "string" else pa.int64()) for c, (_, t) in zip(cols, fields, strict=True))], names=[key, *(n for n, _ in fields)])


def features(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """What stored files hold: the key, FEATURES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _rows(column(batch, key), [measured(n.as_py(), m.as_py()) for n, m in zip(column(batch, "n_bytes"), column(batch, "media"), strict=True)], key)

    return files.mapInArrow(run, f"{key} {dict(files.dtypes)[key]}, {FEATURES}")


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """features(stored(docs)) in one step, so that the files do not leave the worker."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        return _rows(column(batch, key), [measured(len((s or "").encode()), mux(padded(s or ""))) for s in column(batch, text).to_pylist()], key)

    return docs.select(key, text).mapInArrow(per_slice(one, name=text), f"{key} {dict(docs.dtypes)[key]}, {FEATURES}")


def op9_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
