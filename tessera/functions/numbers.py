"""Reduced precision as column expressions: half-precision values, signed bytes packed four to a word, limbs of large integers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf


def half(v: Column) -> Column:
    """v with its fraction cut to 10 bits, as a double: towards 0, never rounded. Beyond 65504 + an ulp it is infinite, below the least normal 2^-14 it is 0; null and NaN stay."""
    a = F.abs(v)
    guess = F.floor(F.log2(F.when(a > 0, a).otherwise(F.lit(1.0))))
    power = lambda e: F.pow(F.lit(2.0), e)
    e = F.when(power(guess + 1) <= a, guess + 1).when(power(guess) > a, guess - 1).otherwise(guess)
    cut = F.floor(a / power(e - 10)) * power(e - 10)
    kept = F.when(a < 2.0**-14, F.lit(0.0)).when(a >= 65536.0, F.lit(float("inf"))).otherwise(cut)
    return F.when(v.isNull() | F.isnan(v), v).otherwise(F.signum(v) * kept)


def fraction_cut(v: Column, bits: int) -> Column:
    """v with its fraction cut to so many bits, towards 0, the exponent kept: 7 bits as bfloat16 has them, 10 as tf32. Null, NaN and infinities stay; the exponents of both are those of single precision, below whose least normal 2^-126 is 0."""
    a = F.abs(v)
    guess = F.floor(F.log2(F.when(a > 0, a).otherwise(F.lit(1.0))))
    power = lambda e: F.pow(F.lit(2.0), e)
    e = F.when(power(guess + 1) <= a, guess + 1).when(power(guess) > a, guess - 1).otherwise(guess)
    kept = F.when(a < 2.0**-126, F.lit(0.0)).otherwise(F.floor(a / power(e - bits)) * power(e - bits))
    return F.when(v.isNull() | F.isnan(v) | (a == float("inf")), v).otherwise(F.signum(v) * kept)


def wrapped32(v: Column) -> Column:
    """A long as what 32-bit arithmetic makes of it: sums and products that overflow wrap."""
    return F.pmod(v + (1 << 31), F.lit(1 << 32)) - (1 << 31)


def signed_byte(v: Column, scale: float = 127.0) -> Column:
    """v times the scale, rounded half away from zero and held within a signed byte; null stays null."""
    held = F.greatest(F.lit(-128.0), F.least(F.lit(127.0), F.round(v * scale)))
    return F.when(v.isNotNull(), held).cast("int")


def packed(bytes4: Column) -> Column:
    """An array of up to four signed bytes as one unsigned 32-bit word, the first lowest; missing ones are 0."""
    at = lambda k: F.coalesce(F.get(bytes4, F.lit(k)), F.lit(0)).cast("long").bitwiseAND(255)
    return at(0).bitwiseOR(F.shiftleft(at(1), 8)).bitwiseOR(F.shiftleft(at(2), 16)).bitwiseOR(F.shiftleft(at(3), 24))


def byte_in_word(v: Column, position: Column) -> Column:
    """A signed byte at its place (0 to 3) in a word; the sum of a word's bytes packs it, so packing is an aggregation."""
    return v.cast("long").bitwiseAND(255) * F.element_at(F.array(*[F.lit(256**k).cast("long") for k in range(4)]), (position + 1).cast("int"))


def unpacked(word: Column) -> Column:
    """The four signed bytes of a word."""
    byte = lambda k: F.shiftrightunsigned(word, 8 * k).bitwiseAND(255)
    return F.array(*[F.when(byte(k) > 127, byte(k) - 256).otherwise(byte(k)).cast("int") for k in range(4)])


def limbs(n: Column, count: int = 2) -> Column:
    """A non-negative long as 32-bit limbs, the lowest first."""
    return F.array(*[F.shiftrightunsigned(n, 32 * k).bitwiseAND((1 << 32) - 1) if k < 2 else F.lit(0).cast("long") for k in range(count)])


def from_limbs(parts: Column) -> Column:
    """A long from its two lowest limbs."""
    return F.get(parts, F.lit(0)).bitwiseOR(F.shiftleft(F.coalesce(F.get(parts, F.lit(1)), F.lit(0).cast("long")), 32))


def wide_limbs(n: Column, count: int = 8) -> Column:
    """A non-negative integer in decimal text, below 2^(32 count), as 32-bit limbs, the lowest first; null for what isn't one."""

    @arrow_udf("array<long>")
    def split(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            v = int(t) if t is not None and t.isascii() and t.isdigit() else -1
            out.append([v >> 32 * k & 0xFFFFFFFF for k in range(count)] if 0 <= v < 1 << 32 * count else None)
        return pa.array(out, pa.list_(pa.int64()))

    return split(n)


def from_wide_limbs(parts: Column) -> Column:
    """Limbs, the lowest first, as an integer in decimal text."""

    @arrow_udf("string")
    def join(limbs: pa.Array) -> pa.Array:
        return pa.array([None if x is None else str(sum(v << 32 * k for k, v in enumerate(x))) for x in limbs.to_pylist()], pa.string())

    return join(parts)


def lcg64(x: Column, multiplier: int = 6364136223846793005, increment: int = 1442695040888963407) -> Column:
    """One step of a linear congruential generator modulo 2^64, on and to decimals of up to 20 digits: products of halves, none of which passes 2^65."""
    d = lambda v: v.cast("decimal(38,0)")
    half = F.lit(1 << 32)
    low = d(d(x) % half)
    high = d((d(x) - low) / half)  # exact, so that no rounding to a scale shows
    m_low, m_high = F.lit(multiplier & 0xFFFFFFFF), F.lit(multiplier >> 32)
    cross = d((d(low * m_high) + d(high * m_low)) % half)
    return d((d(cross * half) + d(low * m_low) + d(F.lit(str(increment)))) % d(F.lit(str(1 << 64)))).cast("decimal(20,0)")


def lcg(x: Column, multiplier: int = 1664525, increment: int = 1013904223) -> Column:
    """One step of a linear congruential generator modulo 2^32; the product stays below 2^63."""
    return F.pmod(x * F.lit(multiplier) + F.lit(increment), F.lit(1 << 32))
