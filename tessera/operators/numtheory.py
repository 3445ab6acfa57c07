"""Number theory as relations and scalar expressions: primes, prime powers, gcd, trial division, factor bags."""

from __future__ import annotations

from math import gcd, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf


def primes(spark: SparkSession, end: int) -> DataFrame:
    """p: the primes from 2 to end. Composites are the products of a small factor, up to the root of end, and its cofactors; what is left is prime."""
    numbers = spark.range(2, end + 1).select(F.col("id").alias("p"))
    small = spark.range(2, isqrt(max(end, 0)) + 1).select(F.col("id").alias("f"))
    multiples = small.select(F.explode(F.sequence(F.col("f") * F.col("f"), F.lit(end).cast("long"), F.col("f"))).alias("p"))
    return numbers.join(multiples, "p", "left_anti")


def prime_powers(spark: SparkSession, bound: int) -> DataFrame:
    """p, e, power: for each prime the highest power that doesn't pass the bound, found by multiplying on, so exactly."""
    steps = F.sequence(F.lit(1), F.lit(max(1, bound.bit_length())))
    e = F.aggregate(steps, F.struct(F.col("p").alias("power"), F.lit(1).alias("e")), lambda a, _: F.when(a["power"] <= F.lit(bound).cast("long") / F.col("p"), F.struct((a["power"] * F.col("p")).alias("power"), (a["e"] + 1).alias("e"))).otherwise(a))
    return primes(spark, bound).select("p", e.alias("x")).select("p", F.col("x.e").cast("long").alias("e"), F.col("x.power").alias("power"))


def gcd_column(a: Column, b: Column) -> Column:
    """Greatest common divisor of longs by Euclid's steps within the expression: 92 steps settle any pair of longs."""
    state = F.struct(F.abs(a).alias("x"), F.abs(b).alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % F.when(s["y"] == 0, F.lit(1)).otherwise(s["y"])).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), state, step)["x"]


def gcd_batched(a: Column, b: Column) -> Column:
    """The same by batches in numpy; null if either is."""

    @arrow_udf("long")
    def batch(x: pa.Array, y: pa.Array) -> pa.Array:
        whole = lambda v: v.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        return pa.array(np.gcd(whole(x), whole(y)), mask=np.asarray(x.is_null()) | np.asarray(y.is_null()))

    return batch(a, b)


def valuation2(n: Column) -> Column:
    """How often 2 divides a positive long: its lowest set bit, counted."""
    return F.bit_count(n.bitwiseAND(-n) - 1).cast("long")


def factor_bag(candidates: DataFrame) -> DataFrame:
    """candidates: n, f (decimal strings, of any size). Returns n, factor, hits, multiplicity, cofactor.

    A candidate stands for its gcd with n; trivial ones (1 and n) go. Equal ones are counted as hits; then, the largest first,
    each divides what is left of n as often as it goes (multiplicity 0: not at all); cofactor is what is left in the end. A row a factor; the fold is per n and needs its
    distinct candidates only, which are counted before."""
    counted = candidates.groupBy("n", "f").agg(F.count("*").alias("c"))

    def fold(t: pa.Table) -> pa.Table:
        n = int(t.column("n")[0].as_py())
        hits: dict[int, int] = {}
        for f, c in zip(t.column("f").to_pylist(), t.column("c").to_pylist(), strict=True):
            if f is not None and int(f) > 1 and 1 < (g := gcd(int(f), n)) < n:
                hits[g] = hits.get(g, 0) + c
        left, rows = n, []
        for f in sorted(hits, reverse=True):
            m = 0
            while left % f == 0:
                left, m = left // f, m + 1
            rows.append((str(n), str(f), hits[f], m))
        out = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
        cols = {k: pa.array(list(v), t) for k, v, t in zip(("n", "factor", "hits", "multiplicity"), out, kinds, strict=True)}
        return pa.table(cols | {"cofactor": pa.array([str(left)] * len(rows), pa.string())})

    return counted.where("n is not null").groupBy("n").applyInArrow(fold, "n string, factor string, hits long, multiplicity long, cofactor string")


def is_prime(n: int) -> bool:
    """Miller and Rabin with the first 13 primes: right below 3.3e24, and beyond a strong probable-prime test."""
    if n < 2:
        return False
    small = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41)
    for p in small:
        if n % p == 0:
            return n == p
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in small:
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(s - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def refined(factors: list[int]) -> list[int]:
    """Pairwise coprime parts of the given numbers, by gcds until none is left; each number is a product of them."""
    parts = sorted({f for f in factors if f > 1})
    todo = True
    while todo:
        todo = False
        for i, a in enumerate(parts):
            for b in parts[i + 1 :]:
                if (g := gcd(a, b)) > 1:
                    rest = [p for p in parts if p not in (a, b)]
                    parts = sorted({x for x in (*rest, g, a // g, b // g) if x > 1})
                    todo = True
                    break
            if todo:
                break
    return parts
