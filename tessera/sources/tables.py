"""The engine's inputs as relations: matrices as cells (i, k, v), sequences of unsigned 32-bit integers with positions, replica results, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import table

#: Modulus of unsigned 32-bit integers, and the multiplier that spreads order keys over them.
U32, SPREAD = 1 << 32, 2654435761


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as cells (k, d, v double): row k is a vector, column d a dimension."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("k"), F.posexplode("embedding").alias("d", "v"))
    return rows.select("k", F.col("d").cast("long").alias("d"), F.col("v").cast("double").alias("v"))


def transposed_pair(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The transposed matrix (i, k, v) and the matrix (k, j, v), whose product contracts all vectors."""
    return cells.select(F.col("d").alias("i"), "k", "v"), cells.select("k", F.col("d").alias("j"), "v")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as arrays: (i, v array<double>)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("v"))


def window(cells: DataFrame, row_start: int, rows: int, col_start: int, cols: int, row: str = "i", col: str = "j") -> DataFrame:
    """A rectangle of a matrix of cells, with its own indices kept."""
    return cells.where(F.col(row).between(row_start, row_start + rows - 1) & F.col(col).between(col_start, col_start + cols - 1))


def u32_value(key: Column) -> Column:
    return F.pmod(key * SPREAD, F.lit(U32))


#: Columns that put lineitem in one order.
LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")


def u32_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsigned integers from lineitem, with the columns that fix their order."""
    lines = table(spark, sf_dir, "lineitem").select(*LINE_KEY)
    return lines.withColumn("value", u32_value(F.col("l_orderkey")))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as replica results: a chunk is a user's day, the event's type its checksum, seven clients."""
    e = table(spark, sf_dir, "events")
    day = F.to_date("ts")
    return e.select(F.concat_ws(":", F.col("user_id").cast("string"), day.cast("string")).alias("chunk"), F.col("event_type").alias("checksum"), (F.col("event_id") % 7).alias("client"), "ts", "event_id", F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as metric samples of a task (the user)."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("task"), "ts", "event_id", "event_type", "value")
