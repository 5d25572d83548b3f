"""Alphabets and filter configurations."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np

from .errors import InvalidArgumentError

_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Alphabet:
    """Symbols of `width` bytes; a symbol's code is made of its bytes' codes, first byte most significant.

    codes: byte to code; bytes without one are invalid. count: how many codes a byte can have. separator: a byte
    that is never part of a valid symbol.
    """

    name: str
    codes: dict[int, int] = field(hash=False)
    count: int
    separator: str
    width: int = 1
    invalid: int = 255

    def __post_init__(self):
        if self.width < 1 or not 1 <= self.count <= 255:
            raise InvalidArgumentError("width must be at least 1 and count from 1 to 255")
        if any(not 0 <= c < self.count for c in self.codes.values()):
            raise InvalidArgumentError("a code is beyond the count")
        if len(self.separator) != 1 or ord(self.separator) in self.codes:
            raise InvalidArgumentError("the separator is part of a valid symbol")

    @property
    def unit_bits(self) -> int:
        """Bits of one byte's code."""
        return max(1, (self.count - 1).bit_length())

    @property
    def bits(self) -> int:
        """Bits of a symbol."""
        return self.unit_bits * self.width

    @property
    def max_k(self) -> int:
        return 64 // self.bits

    @cached_property
    def table(self) -> np.ndarray:
        """Code of each byte, `invalid` where it has none."""
        out = np.full(256, self.invalid, np.uint8)
        for b, c in self.codes.items():
            out[b] = c
        return out

    @property
    def byte_class(self) -> str:
        """A regular expression's class of the valid bytes."""
        return "[" + "".join(f"\\x{b:02X}" for b in sorted(self.codes)) + "]"

    @property
    def digits(self) -> tuple[str, str]:
        """Valid bytes and the digits, in base 2**unit_bits, of their codes."""
        if self.unit_bits > 5:
            raise InvalidArgumentError("codes of more than 5 bits need the vectorised path")
        pairs = sorted(self.codes.items())
        return "".join(chr(b) for b, _ in pairs), "".join(_DIGITS[c] for _, c in pairs)


def _letters(order: str) -> dict[int, int]:
    return {ord(x): i for i, c in enumerate(order) for x in (c, c.lower())}


# Nucleotide codes are A 0, C 1, T 2, G 3; residues are the letters in order.
DNA = Alphabet("dna", _letters("ACTG"), 4, "N")
DNA_TRIPLET = Alphabet("dna_triplet", _letters("ACTG"), 4, "N", width=3)
PROTEIN = Alphabet("protein", _letters("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), 26, "*")


@dataclass(frozen=True)
class Config:
    """k-mer, s-mer and minimizer lengths in symbols, and the number of hashes of an s-mer."""

    k: int
    s: int
    m: int
    hashes: int = 4
    alphabet: Alphabet = DNA

    BLOCK_BITS = 256
    WORDS = 4

    def __post_init__(self):
        b = self.alphabet.bits
        for ok, text in (
            (self.k > 0, "k must be positive"),
            (0 < self.m <= self.k, "m must be from 1 to k"),
            (0 < self.s <= self.k, "s must be from 1 to k"),
            (self.k * b <= 64, "k symbols must fit 64 bits"),
            (self.hashes in (4, 8, 12, 16), "hashes must be 4, 8, 12 or 16"),
        ):
            if not ok:
                raise InvalidArgumentError(text)

    @property
    def bits(self) -> int:
        return self.alphabet.bits

    @property
    def minimizer_span(self) -> int:
        return self.k - self.m + 1

    @property
    def smer_span(self) -> int:
        return self.k - self.s + 1


PRODUCTION = Config(31, 28, 16)


def mebibytes(name: str, default: int) -> int:
    """Bytes from an environment variable in MiB; the default where it is unset or empty."""
    text = os.environ.get(name, "").strip()
    if not text:
        return default
    if not text.isascii() or not text.isdigit():
        raise InvalidArgumentError(f"{name} must be a whole number of MiB")
    return int(text) << 20


def bit_ceil(n: int) -> int:
    """The smallest power of two that is at least n."""
    return 1 if n <= 1 else 1 << (n - 1).bit_length()


def shards_for(filter_bits: int) -> int:
    return bit_ceil(max(1, -(-filter_bits // Config.BLOCK_BITS)))


def bits_for(kmers: int, bits_per_kmer: int = 16) -> int:
    """Filter bits for a number of k-mers."""
    return bit_ceil(kmers * bits_per_kmer)


def kmers_for(filter_bits: int, load: float = 0.95, bits_per_kmer: int = 16) -> int:
    """How many k-mers a filter of this size is meant to take."""
    return int(filter_bits // bits_per_kmer * load)
