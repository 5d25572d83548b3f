"""64-bit arithmetic as Column expressions that are safe under ANSI mode, and the hashes built on it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK32 = 0xFFFFFFFF
SIGN = -(1 << 63)
#: The multiplier of both hashes, and the multipliers of the bit addresses of 12 or 16 hashes.
GOLDEN = 0x9E3779B97F4A7C15
SALTS = (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, 0x94D049BB133111EF, 0xBF58476D1CE4E5B9, 0xD6E8FEB86659FD93,
    0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB449C93FBBEA6B5, 0xDB4F0B9175AE2165, 0xBBE056FDADE14B91,
)


def signed(x: int) -> int:
    """The 64-bit integer with the same bits."""
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def right(x: Column, n: int) -> Column:
    return F.shiftrightunsigned(x, n) if n else x


def mask_of(bits: int) -> int:
    return -1 if bits >= 64 else (1 << bits) - 1


def _low(x: Column, k: int) -> Column:
    """Low 32 bits of x * k, for both of 32 bits."""
    return (x * F.lit(k & 0xFFFF).cast("long") + F.shiftleft((x * F.lit(k >> 16).cast("long")).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(MASK32))


def mul64(a: Column, c: int) -> Column:
    """a * c modulo 2**64."""
    c0, c1 = c & MASK32, c >> 32
    a0, a1 = a.bitwiseAND(F.lit(MASK32)), right(a, 32)
    t = a0 * F.lit(c0 >> 16).cast("long")
    low = a0 * F.lit(c0 & 0xFFFF).cast("long") + F.shiftleft(t.bitwiseAND(F.lit(0xFFFF)), 16)
    high = right(low, 32) + right(t, 16) + _low(a0, c1) + _low(a1, c0)
    return F.shiftleft(high.bitwiseAND(F.lit(MASK32)), 32).bitwiseOR(low.bitwiseAND(F.lit(MASK32)))


def hash64(x: Column) -> Column:
    y = mul64(x, GOLDEN)
    return y.bitwiseXOR(right(y, 33))


def minimizer_hash64(x: Column) -> Column:
    return mul64(x, GOLDEN)


def unsigned_least(xs: list[Column]) -> Column:
    flip = [x.bitwiseXOR(F.lit(SIGN)) for x in xs]
    return (F.least(*flip) if len(flip) > 1 else flip[0]).bitwiseXOR(F.lit(SIGN))


def bit_address(h: Column, i: int, hashes: int) -> Column:
    """Bit of a 64-bit word that hash i sets."""
    if hashes <= 8:
        return right(h, 64 // hashes * i).bitwiseAND(F.lit(63)).cast("int")
    return right(mul64(h, SALTS[i]), 58).cast("int")


def any_of(xs: list[Column]) -> Column:
    out = xs[0]
    for x in xs[1:]:
        out = out.bitwiseOR(x)
    return out
