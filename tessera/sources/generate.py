"""Seeded inputs: matrices and sequences made on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The generator's multiplier and increment, modulo 2^32.
MULTIPLIER, INCREMENT = 1664525, 1013904223


def wave_matrix(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    """(i, j, v) with v = sin(0.01 (i + 1)) + cos(0.02 (j + 1))."""
    grid = spark.range(rows * cols).select(F.floor(F.col("id") / cols).alias("i"), (F.col("id") % cols).alias("j"))
    return grid.withColumn("v", F.sin((F.col("i") + 1) * 0.01) + F.cos((F.col("j") + 1) * 0.02))


def ones_matrix(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    return spark.range(rows * cols).select(F.floor(F.col("id") / cols).alias("i"), (F.col("id") % cols).alias("j"), F.lit(1.0).alias("v"))


def jump(seed: int, steps: int) -> int:
    """The generator's state after so many steps, by squaring the affine map."""
    a, c, x, y = MULTIPLIER, INCREMENT, 1, 0
    while steps:
        if steps & 1:
            x, y = x * a % 2**32, (y * a + c) % 2**32
        a, c = a * a % 2**32, (c * a + c) % 2**32
        steps >>= 1
    return (x * seed + y) % 2**32


def lcg_matrix(spark: SparkSession, rows: int, cols: int, seed: int = 1) -> DataFrame:
    """(i, j, v) with v in [-1, 1) from the generator's states in row-major order. A row starts from its own jump, so rows are made independently and alike under any partitioning."""

    def fill(batches):
        import pyarrow as pa

        for batch in batches:
            for i in batch.column("id").to_pylist():
                s, out = jump(seed, i * cols), []
                for _ in range(cols):
                    s = (s * MULTIPLIER + INCREMENT) % 2**32
                    out.append(s / 2**31 - 1)
                yield pa.record_batch([pa.array([i] * cols, pa.int64()), pa.array(range(cols), pa.int64()), pa.array(out)], ["i", "j", "v"])

    return spark.range(rows).mapInArrow(fill, "i long, j long, v double")


def random_u32(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """(pos, value): uniform unsigned 32-bit integers, the largest left out."""
    return spark.range(n).select(F.col("id").alias("pos"), F.floor(F.rand(seed) * 0xFFFFFFFF).alias("value"))


def random_qkv(spark: SparkSession, seq: int, width: int, seed: int = 1) -> dict[str, DataFrame]:
    """Tensors q, k, v as (i, v array): normal values times 0.1, 0.05 and 0.2."""
    made = lambda s, scale: spark.range(seq).select(F.col("id").alias("i"), F.transform(F.sequence(F.lit(1), F.lit(width)), lambda _: F.randn(seed + s) * scale).alias("v"))
    return {"q": made(0, 0.1), "k": made(1, 0.05), "v": made(2, 0.2)}
