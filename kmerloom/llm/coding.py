"""Arrays of integers as short binary values: differences without the low bits that are 0 in all, bytes of one weight side by side, zstd."""

from __future__ import annotations

import numpy as np
import zstandard

_pack, _unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(x: np.ndarray, rising: bool = False) -> bytes:
    """rising: x never falls and has no negative numbers. The head holds how many there are and, in its last byte, the bits left out."""
    n, low = len(x), 0
    if rising and n:
        x = np.concatenate([x[:1], np.diff(x)])
        every = int(np.bitwise_or.reduce(x))
        low = (every & -every).bit_length() - 1 if every else 0
        x = x >> x.dtype.type(low)
    body = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(n, x.itemsize).T).tobytes()
    return (n | low << 56).to_bytes(8, "little") + _pack.compress(body)


def unpack(data: bytes, kind: type, rising: bool = False) -> np.ndarray:
    n, low, width = int.from_bytes(data[:7], "little"), data[7], np.dtype(kind).itemsize
    body = np.frombuffer(_unpack.decompress(data[8:], max_output_size=n * width), np.uint8) if n else np.zeros(0, np.uint8)
    x = np.ascontiguousarray(body.reshape(width, n).T).view(kind).reshape(n)
    return np.cumsum(x << x.dtype.type(low), dtype=kind) if rising else x
