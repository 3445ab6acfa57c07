"""Global sorts with positions, runs, chunks, and the checks on them. Spark samples, range-partitions and sorts externally; no run is merged in one place."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written


def positioned(df: DataFrame, *order: Column | str, pos: str = "pos", ties: bool = False) -> DataFrame:
    """df sorted by `order`, with positions from 0. Equal rows of the order keep no particular one among each other; with ties, a row's number is part of
    the range key, so that a value that many rows share is dealt to many ranges.

    The sorted ranges are written once; a row's position is its number within its range plus the rows of the ranges before, whose counts (a row a
    partition) come to the driver. No window over all rows, so no single task."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, *order, "_tie").drop("_tie") if ties else df.repartitionByRange(n, *order)
    numbered = ranges.sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    ranged = written(numbered.withColumn("_part", F.shiftright("_id", 33).cast("int")), "sorted")
    counts = sorted(ranged.groupBy("_part").count().collect())
    before = list(zip([r["_part"] for r in counts], accumulate([r["count"] for r in counts], initial=0)))
    starts = spark.createDataFrame(before, "_part int, _start long")
    placed = ranged.join(F.broadcast(starts), "_part")  # a row a partition
    return placed.withColumn(pos, F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id", "_part", "_start")


def sorted_u32(df: DataFrame, value: str = "value", ascending: bool = True, tie: tuple[str, ...] = ()) -> DataFrame:
    """(pos, value) in ascending or descending order; longs, so that 2^31 and above sort as unsigned."""
    key = F.col(value).asc() if ascending else F.col(value).desc()
    return positioned(df.select(value, *tie), key, *tie, ties=True).select("pos", value)


def first_elements(df: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    """The first n by position: a filter, so it reaches the scan of a stored sequence."""
    return df.where(F.col(pos) < n)


def slice_of(df: DataFrame, offset: int, count: int, pos: str = "pos") -> DataFrame:
    """`count` elements from position `offset` on, as many as there are."""
    return df.where(F.col(pos).between(offset, offset + count - 1))


def next_pow2(n: Column) -> Column:
    """The least power of two from n on; 1 for n up to 0."""
    bits = F.ceil(F.log2(F.greatest(n, F.lit(1)).cast("double")))
    return F.pow(F.lit(2.0), bits).cast("long")


def chunk_runs(df: DataFrame, size: int, value: str = "value", pos: str = "pos") -> DataFrame:
    """Chunks of `size` positions, each sorted by itself: its count, ends, middle element and whether the sorted run is in order."""
    runs = df.groupBy(F.floor(F.col(pos) / size).alias("chunk")).agg(F.array_sort(F.collect_list(value)).alias("run"))
    n = F.size("run")
    ordered = F.forall(F.arrays_zip(F.slice("run", F.lit(1), n - 1).alias("a"), F.slice("run", F.lit(2), F.greatest(n - 1, F.lit(0))).alias("b")), lambda p: p["a"] <= p["b"])
    return runs.select("chunk", n.cast("long").alias("n"), F.element_at("run", 1).alias("lo"), F.element_at("run", F.floor((n - 1) / 2).cast("int") + 1).alias("mid"), F.element_at("run", -1).alias("hi"), ordered.alias("in_order"))


def padded_chunks(df: DataFrame, size: int, pos: str = "pos", ascending: bool = True) -> DataFrame:
    """What padding each chunk to a power of two takes: its size, the padded size, the number and value of sentinels."""
    n = df.groupBy(F.floor(F.col(pos) / size).alias("chunk")).agg(F.count("*").alias("n"))
    padded = next_pow2(F.col("n"))
    return n.select("chunk", "n", padded.alias("padded"), (padded - F.col("n")).alias("pad"), F.lit((1 << 32) - 1 if ascending else 0).cast("long").alias("sentinel"))


def padded_runs(df: DataFrame, size: int, value: str = "value", pos: str = "pos", ascending: bool = True) -> DataFrame:
    """(chunk, n, run): chunks of `size` positions, each with sentinels up to a power of two and sorted, so that the sentinels stand last."""
    runs = df.groupBy(F.floor(F.col(pos) / size).alias("chunk")).agg(F.collect_list(value).alias("run"))
    n = F.size("run").cast("long")
    full = F.concat("run", F.array_repeat(F.lit((1 << 32) - 1 if ascending else 0).cast("long"), (next_pow2(n) - n).cast("int")))
    return runs.select("chunk", n.alias("n"), F.sort_array(full, asc=ascending).alias("run"))


def trimmed_runs(padded: DataFrame) -> DataFrame:
    """padded: (chunk, n, run). The runs without their sentinels."""
    return padded.withColumn("run", F.slice("run", F.lit(1), F.col("n").cast("int")))


def order_violations(df: DataFrame, value: str = "value", pos: str = "pos", ascending: bool = True) -> DataFrame:
    """Neighbours out of order: pairs, and how many of them break it. A position's left neighbour comes by an equi-join on positions, not by a window over all rows."""
    left = df.select((F.col(pos) + 1).alias(pos), F.col(value).alias("before"))
    bad = F.col("before") > F.col(value) if ascending else F.col("before") < F.col(value)
    return df.select(pos, value).join(left, pos).agg(F.count("*").alias("pairs"), F.count_if(bad).alias("violations"))


def same_multiset(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other: (only_a, only_b), both 0 if the multisets are equal."""
    both = a.withColumn("_side", F.lit(1)).unionByName(b.withColumn("_side", F.lit(-1)))
    net = both.groupBy(*a.columns).agg(F.sum("_side").alias("net"))
    return net.agg(F.coalesce(F.sum(F.greatest("net", F.lit(0))), F.lit(0)).alias("only_a"), F.coalesce(F.sum(F.greatest(-F.col("net"), F.lit(0))), F.lit(0)).alias("only_b"))


def merged(runs: list[DataFrame], value: str = "value") -> DataFrame:
    """Sorted runs as one sorted sequence (pos, value)."""
    every = runs[0]
    for r in runs[1:]:
        every = every.unionByName(r)
    return sorted_u32(every, value)
