"""A model of the filter on plain integers, written from the definitions, to test the engine against."""

from __future__ import annotations

from kmerloom.config import Config, shards_for
from kmerloom.functions.bits import GOLDEN, SALTS

M = (1 << 64) - 1


class Model:
    def __init__(self, cfg: Config, bits: int):
        self.cfg, self.n, self.shards = cfg, shards_for(bits), {}

    def codes(self, raw: bytes) -> list[int | None]:
        a, out = self.cfg.alphabet, []
        for i in range(len(raw) // a.width):
            unit = [a.codes.get(b) for b in raw[i * a.width : (i + 1) * a.width]]
            out.append(None if None in unit else int("".join(f"{c:0{a.unit_bits}b}" for c in unit), 2))
        return out

    def windows(self, raw: bytes) -> list[int | None]:
        c, k, b = self.codes(raw), self.cfg.k, self.cfg.bits
        out = []
        for i in range(max(0, len(c) - k + 1)):
            w = c[i : i + k]
            out.append(None if None in w else sum(x << b * (k - 1 - j) for j, x in enumerate(w)))
        return out

    def part(self, p: int, length: int, o: int) -> int:
        return p >> self.cfg.bits * (self.cfg.k - o - length) & (1 << self.cfg.bits * length) - 1

    def minimizer(self, p: int) -> int:
        return min(self.part(p, self.cfg.m, o) * GOLDEN & M for o in range(self.cfg.minimizer_span))

    def masks(self, p: int) -> list[int]:
        out = [0] * 4
        for o in range(self.cfg.smer_span):
            h = self.part(p, self.cfg.s, o) * GOLDEN & M
            h ^= h >> 33
            for i in range(self.cfg.hashes):
                at = h >> 64 // self.cfg.hashes * i & 63 if self.cfg.hashes <= 8 else (h * SALTS[i] & M) >> 58
                out[i % 4] |= 1 << at
        return out

    def insert(self, raw: bytes) -> None:
        for p in self.windows(raw):
            if p is not None:
                w = self.shards.setdefault(self.minimizer(p) & self.n - 1, [0] * 4)
                for j, m in enumerate(self.masks(p)):
                    w[j] |= m

    def hits(self, raw: bytes) -> list[int]:
        out = []
        for p in self.windows(raw):
            w = self.shards.get(self.minimizer(p) & self.n - 1, [0] * 4) if p is not None else None
            out.append(int(w is not None and all(x & m == m for x, m in zip(w, self.masks(p), strict=True))))
        return out

    def set_bits(self) -> int:
        return sum(x.bit_count() for w in self.shards.values() for x in w)
