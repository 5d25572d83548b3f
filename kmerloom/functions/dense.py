"""Dense-packed sequences: symbol i of S per 64-bit word stands at bits b*(i mod S) of word i div S, earlier symbols lower.

The format has no invalid code: a byte without a code is stored as the mask of a symbol's bits, and read back as that.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kmerloom.config import Alphabet, Config

from .bits import mask_of
from .kmers import as_bytes, symbol_count


def symbols_per_word(a: Alphabet) -> int:
    return 64 // a.bits


def word_count(symbols: Column, a: Alphabet) -> Column:
    return F.ceil(symbols / symbols_per_word(a)).cast("long")


def dense_kmer_count(symbols: Column, config: Config) -> Column:
    return F.greatest(symbols - config.k + 1, F.lit(0)).cast("long")


def _code(symbol: Column, a: Alphabet) -> Column:
    good = symbol.rlike(rf"^{a.byte_class}{{{a.width}}}\z")
    return F.when(good, F.conv(F.translate(symbol, *a.digits), 1 << a.unit_bits, -10).cast("long")).otherwise(F.lit(mask_of(a.bits) & a.invalid if a.width == 1 else mask_of(a.bits)))


def pack(sequence: Column, a: Alphabet) -> Column:
    """Array of words."""
    s, text, n = symbols_per_word(a), as_bytes(sequence), symbol_count(sequence, a)
    each = lambda w: F.aggregate(
        F.sequence(F.lit(0), F.least(F.lit(s), (n - w * s).cast("int")) - 1), F.lit(0).cast("long"),
        lambda acc, i: acc.bitwiseOR(F.call_function("shiftleft", _code(text.substr(((w * s + i) * a.width + 1).cast("int"), F.lit(a.width)), a), (i * a.bits).cast("int"))),
    )
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), (word_count(n, a) - 1).cast("int")), each)).otherwise(F.array().cast("array<bigint>"))


def codes(words: Column, symbols: Column, a: Alphabet) -> Column:
    """Array of symbol codes."""
    s = symbols_per_word(a)
    one = lambda i: F.call_function("shiftrightunsigned", F.get(words, F.floor(i / s).cast("int")), (i % s * a.bits).cast("int")).bitwiseAND(F.lit(mask_of(a.bits)))
    return F.when(symbols > 0, F.transform(F.sequence(F.lit(0), symbols.cast("int") - 1), one)).otherwise(F.array().cast("array<bigint>"))


def packed_kmers(words: Column, symbols: Column, config: Config) -> Column:
    """Array of all packed k-mers, by position."""
    a, n = config.alphabet, dense_kmer_count(symbols, config)
    at = lambda c, i: F.aggregate(F.slice(c, i + 1, config.k), F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, a.bits).bitwiseOR(x))
    coded = F.transform(F.array(codes(words, symbols, a)), lambda c: F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: at(c, i)))[0]
    return F.when(n > 0, coded).otherwise(F.array().cast("array<bigint>"))


def check(words: Column, symbols: Column, a: Alphabet) -> Column:
    """True, or an error where there are fewer words than the symbols need."""
    return F.when(F.size(words) >= word_count(symbols, a), F.lit(True)).otherwise(F.raise_error(F.lit("dense-packed words are fewer than the symbols need")).cast("boolean"))


__all__ = ["check", "codes", "dense_kmer_count", "pack", "packed_kmers", "symbols_per_word", "word_count"]
