"""Elliptic-curve factoring, stage 1, on Montgomery curves: a row a curve, integers of any size in Python."""

from __future__ import annotations

from math import gcd, isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import dropped, written
from .numtheory import is_prime, refined

#: What became of a curve: not at its end yet, no factor, a factor, a curve that its own construction broke (then without a factor).
MORE, NONE, FACTOR, BAD = 0, 1, 2, 3
LARGEST = 1 << 256


def exponents(bound: int) -> list[int]:
    """For each prime up to the bound its highest power within it."""
    sieve = bytearray([1]) * (bound + 1)
    for p in range(2, isqrt(max(bound, 0)) + 1):
        if sieve[p]:
            sieve[p * p :: p] = bytes(len(range(p * p, bound + 1, p)))
    out = []
    for p in range(2, bound + 1):
        if sieve[p]:
            q = p
            while q * p <= bound:
                q *= p
            out.append(q)
    return out


def sigma(seed: int, curve: int) -> int:
    """The parameter of a curve, from 6 on: a function of seed and number alone, so that the partitioning can't change a result."""
    x = (seed + (curve + 1) * 0x9E3779B97F4A7C15) % (1 << 64)
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % (1 << 64)
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % (1 << 64)
    return 6 + (x ^ (x >> 31)) % ((1 << 32) - 6)


def opened(n: int, s: int) -> tuple[int, int, tuple[int, int, int] | None]:
    """(status, factor, state) of the curve with parameter s in Suyama's form; state is its point and constant (x, z, a24), none if the construction already ended it."""
    u, v = (s * s - 5) % n, 4 * s % n
    x, z = pow(u, 3, n), pow(v, 3, n)
    below = 16 * x * v % n
    g = gcd(below, n)
    if g != 1:  # the inverse fails by a divisor
        return (FACTOR, g, None) if g < n else (BAD, 0, None)
    return MORE, 0, (x, z, pow(v - u, 3, n) * (3 * u + v) * pow(below, -1, n) % n)


def advanced(n: int, state: tuple[int, int, int], powers: list[int]) -> tuple[int, int, int]:
    """The state after multiplying its point by each of the powers: a Montgomery ladder each."""
    x, z, a24 = state

    def double(x, z):
        a, b = (x + z) ** 2 % n, (x - z) ** 2 % n
        c = a - b
        return a * b % n, c * (b + a24 * c) % n

    for k in powers:
        x0, z0, x1, z1 = x, z, *double(x, z)
        for bit in bin(k)[3:]:
            a, b = (x0 - z0) * (x1 + z1) % n, (x0 + z0) * (x1 - z1) % n
            xs, zs = (a + b) ** 2 * z % n, (a - b) ** 2 * x % n
            if bit == "1":
                x0, z0, (x1, z1) = xs, zs, double(x1, z1)
            else:
                (x0, z0), x1, z1 = double(x0, z0), xs, zs
        x, z = x0, z0
    return x, z, a24


def closed(n: int, state: tuple[int, int, int]) -> tuple[int, int]:
    """(status, factor) of a state: the divisor that its z shares with n, if proper."""
    g = gcd(state[1], n)
    return (FACTOR, g) if 1 < g < n else (NONE, 0)


def stage1(n: int, s: int, powers: list[int]) -> tuple[int, int]:
    """(status, factor) of the curve with parameter s, multiplied by every power. The factor is 0 unless proper."""
    status, f, state = opened(n, s)
    return (status, f) if state is None else closed(n, advanced(n, state, powers))


def parsed(n: int | str) -> int:
    """An integer, or its decimal or 0x-hexadecimal text."""
    return n if isinstance(n, int) else int(n.strip(), 16 if n.strip().lower().startswith("0x") else 10)


def stripped(n: int) -> tuple[int, int]:
    """(odd part, how often 2 divides)."""
    e = (n & -n).bit_length() - 1
    return n >> e, e


def without(n: int, small: tuple[int, ...] = (2,)) -> tuple[int, dict[int, int]]:
    """What is left of n when each of the small primes has been divided out, and how often each did."""
    found = {}
    for p in small:
        while n % p == 0:
            n, found[p] = n // p, found.get(p, 0) + 1
    return n, found


def chunk_count(curves: int, chunk: int) -> int:
    return -(-curves // chunk)


def curves(spark: SparkSession, n: int, b1: int = 50_000, total: int = 1024, chunk: int = 256, seed: int = 1, small: tuple[int, ...] = (2,)) -> DataFrame:
    """A row a curve: curve_index, chunk_index, sigma, status, factor (decimal strings). n is positive and below 2^256; the small primes (2 among them) are divided out first, and if 1 is left there is no curve."""
    if not 0 < n < LARGEST:
        raise ValueError("n must be positive and below 2^256")
    odd, _ = without(n, (2, *small))
    kind = "curve_index long, chunk_index int, sigma string, status int, factor string"
    if odd == 1:
        return spark.createDataFrame([], kind)
    parts = chunk_count(total, chunk)

    def run(batches):
        powers = exponents(b1)
        for batch in batches:
            for c in batch.column("id").to_pylist():
                s = sigma(seed, c)
                status, f = stage1(odd, s, powers)
                yield pa.record_batch([pa.array([c], pa.int64()), pa.array([c // chunk], pa.int32()), pa.array([str(s)]), pa.array([status], pa.int32()), pa.array([str(f) if f else None], pa.string())], [x.split()[0] for x in kind.split(", ")])

    return spark.range(0, total, 1, parts).mapInArrow(run, kind)


def resumed(spark: SparkSession, n: int, b1: int = 50_000, total: int = 1024, chunk: int = 256, seed: int = 1, window: int = 1500) -> DataFrame:
    """The same rows, by passes over windows of prime powers: each pass reads every open curve's state and writes it to the shared folder, so a loss costs one pass of the lost curves."""
    if not 0 < n < LARGEST:
        raise ValueError("n must be positive and below 2^256")
    odd, _ = stripped(n)
    if odd == 1:
        return curves(spark, n)
    powers = exponents(b1)
    kind = "curve_index long, chunk_index int, sigma string, status int, factor string, x string, z string, a24 string"
    names = [c.split()[0] for c in kind.split(", ")]

    def batch(rows):
        types = (pa.int64(), pa.int32(), pa.string(), pa.int32(), *[pa.string()] * 4)
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def start(batches):
        for b in batches:
            rows = []
            for c in b.column("id").to_pylist():
                s = sigma(seed, c)
                status, f, state = opened(odd, s)
                rows.append((c, c // chunk, str(s), status, str(f) if f else None, *(map(str, state) if state else (None,) * 3)))
            if rows:
                yield batch(rows)

    def advance(part, last):
        def step(batches):
            for b in batches:
                rows = []
                for r in b.to_pylist():
                    if r["status"] == MORE:
                        state = advanced(odd, (int(r["x"]), int(r["z"]), int(r["a24"])), part)
                        status, f = closed(odd, state) if last else (MORE, 0)
                        r |= {"status": status, "factor": str(f) if f else None, **dict(zip(("x", "z", "a24"), map(str, state), strict=True))}
                    rows.append(tuple(r[c] for c in names))
                if rows:
                    yield batch(rows)

        return step

    state = spark.range(0, total, 1, chunk_count(total, chunk)).mapInArrow(start, kind)
    for at in range(0, max(1, len(powers)), window):
        before, state = state, written(state.mapInArrow(advance(powers[at : at + window], at + window >= len(powers)), kind), "curves")
        dropped(before)
    return state.select("curve_index", "chunk_index", "sigma", "status", "factor")


def packed_curves(found: DataFrame) -> DataFrame:
    """(curve_index, raw): each curve as nine little-endian 32-bit words, the eight limbs of its factor (0 if none) and its status. Rows in order of the index are the headerless file (files.write_file)."""

    def pack(batches):
        for b in batches:
            raw = [int(f or 0).to_bytes(32, "little") + s.to_bytes(4, "little") for f, s in zip(b.column("factor").to_pylist(), b.column("status").to_pylist(), strict=True)]
            yield pa.record_batch([b.column("curve_index"), pa.array(raw, pa.binary())], ["curve_index", "raw"])

    return found.select("curve_index", "factor", "status").mapInArrow(pack, "curve_index long, raw binary")


def status_tally(found: DataFrame) -> DataFrame:
    return found.groupBy("status").agg(F.count("*").alias("curves"))


def summary(found: DataFrame, n: int) -> dict:
    """Factors with multiplicity, their hits, and the cofactor. What comes here is one row a distinct factor.

    Candidates are split by gcds into coprime parts and tested for primality, so that a composite hit isn't called prime."""
    hits = {int(r.factor): r.hits for r in found.where(f"status = {FACTOR}").groupBy("factor").agg(F.count("*").alias("hits")).collect()}
    left, twos = stripped(n)
    rows = [{"factor": 2, "multiplicity": twos, "prime": True}] if twos else []
    for f in refined(list(hits)):
        m = 0
        while left % f == 0:
            left, m = left // f, m + 1
        if m:
            rows.append({"factor": f, "multiplicity": m, "prime": is_prime(f)})
    return {"n": n, "factors": rows, "hits": hits, "cofactor": left, "cofactor_prime": is_prime(left)}


def summary_json(found: DataFrame, n: int) -> str:
    """The summary as JSON, with large integers as text in decimal and hexadecimal."""
    import json

    s = summary(found, n)
    both = lambda x: {"decimal": str(x), "hex": hex(x)}
    return json.dumps({"n": both(n), "factors": [{**both(f["factor"]), "multiplicity": f["multiplicity"], "prime": f["prime"]} for f in s["factors"]], "hits": {str(k): v for k, v in sorted(s["hits"].items())}, "cofactor": {**both(s["cofactor"]), "prime": s["cofactor_prime"]}})
