"""Matrix products. Four physical forms of one operator: cells joined and summed (any sizes, sparse too), tiles multiplied by numpy
(dense), rows multiplied by themselves in one pass (tall and narrow), and reduced precision by casting the cells first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def product(a: DataFrame, b: DataFrame, zero: str = "double") -> DataFrame:
    """a: (i, k, v), b: (k, j, v). Returns (i, j, v), the sum of v over equal k. Absent cells count as 0, and rows or columns without any are absent.

    An equi-join on k and a sum that is partial before its shuffle; Catalyst broadcasts a side that is small."""
    right = b.select(F.col("k").alias("rk"), "j", F.col("v").alias("rv"))
    pairs = a.join(right, F.col("k") == F.col("rk"))
    return pairs.groupBy("i", "j").agg(F.sum(F.col("v").cast(zero) * F.col("rv").cast(zero)).alias("v"))


def padded(lists: pa.Array) -> np.ndarray:
    """A list column as rows of doubles as long as its longest; null lists, null components and missing ones are 0."""
    sizes = np.diff(np.asarray(lists.offsets)) if len(lists) else np.zeros(0, int)
    sizes = np.where(np.asarray(lists.is_valid()), sizes, 0)
    out = np.zeros((len(lists), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().fill_null(0).to_numpy(zero_copy_only=False)
    return out


def gram(rows: DataFrame, col: str = "v", zero: str = "double") -> DataFrame:
    """The transpose of a matrix by the matrix, whose rows are the arrays of col: (i, j, v). One pass without a join: each task multiplies its rows by
    themselves in batches, and a partial matrix a task is shuffled. For narrow matrices: a task holds width squared sums. With zero = "long" the components
    are whole numbers whose products sum to less than 2^53 within a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((0, 0), np.int64 if zero == "long" else float)
        for batch in batches:
            x = padded(batch.column(0))
            if (more := x.shape[1] - len(total)) > 0:
                total = np.pad(total, (0, more))
            total[: x.shape[1], : x.shape[1]] += (x.T @ x).astype(total.dtype)
        if len(total):
            i, j = np.divmod(np.arange(total.size), len(total))
            yield pa.record_batch([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "v"])

    return rows.select(col).mapInArrow(run, f"i long, j long, v {zero}").groupBy("i", "j").agg(F.sum("v").alias("v"))


def tiles(cells: DataFrame, row: str, col: str, height: int, width: int) -> DataFrame:
    """Cells as tiles (rb, cb, tile): height * width doubles in row-major order, 0 where there is no cell."""
    at = ((F.col(row) % height) * width + F.col(col) % width).cast("int").alias("at")
    own = cells.groupBy(F.floor(F.col(row) / height).alias("rb"), F.floor(F.col(col) / width).alias("cb")).agg(F.collect_list(F.struct(at, F.col("v").cast("double").alias("v"))).alias("cells"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = batch.column("cells")[k].values
                tile = np.zeros(height * width)
                tile[found.field("at").to_numpy()] = found.field("v").fill_null(0).to_numpy(zero_copy_only=False)
                yield pa.record_batch([batch.column("rb").slice(k, 1), batch.column("cb").slice(k, 1), pa.ListArray.from_arrays(pa.array([0, len(tile)], pa.int32()), pa.array(tile))], ["rb", "cb", "tile"])

    return own.mapInArrow(fill, "rb long, cb long, tile array<double>")


def tiled_product(a: DataFrame, b: DataFrame, height: int, width: int, depth: int) -> DataFrame:
    """The product by tiles: those of A (ib, kb) and of B (kb, jb) meet in groups (ib, jb, part of the depth), each a partition of its own, where numpy multiplies a pair of tiles
    after the other into one output tile, so that a task holds three tiles. What is shuffled last is a row a tile and part, never a cell. Cells of 0 come too, but none beyond the edges.

    There are as many parts of the depth as it takes to give every core a few groups; how far rows, columns and depth reach is read while the plan is built."""
    spark = a.sparkSession
    reach = lambda df, x: df.agg(F.max(x), F.max("k")).first()
    (n, ka), (m, kb) = reach(a, "i"), reach(b, "j")
    if None in (n, ka, m, kb):
        return spark.createDataFrame([], "i long, j long, v double")
    ni, nj, deep = n // height + 1, m // width + 1, min(ka, kb) // depth + 1
    parts = max(1, min(deep, -(-4 * spark.sparkContext.defaultParallelism // (ni * nj))))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = tiles(a, "i", "k", height, depth).select(F.col("rb").alias("ib"), F.col("cb").alias("kb"), F.lit(0).alias("side"), "tile", every(nj).alias("jb"))
    right = tiles(b, "k", "j", depth, width).select(F.col("cb").alias("jb"), F.col("rb").alias("kb"), F.lit(1).alias("side"), "tile", every(ni).alias("ib"))
    group = (F.col("ib") * nj + F.col("jb")) * parts + F.col("kb") % parts
    dealt = left.unionByName(right).select("ib", "jb", "kb", "side", "tile", F.pmod(group, F.lit(ni * nj * parts)).cast("int").alias("grp"))
    dealt = dealt.repartitionById(ni * nj * parts, F.col("grp")).sortWithinPartitions("grp", "kb", "side")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, held = None, None, None
        row = lambda: pa.record_batch([pa.array([key[0]]), pa.array([key[1]]), pa.ListArray.from_arrays(pa.array([0, total.size], pa.int32()), pa.array(total.ravel()))], ["ib", "jb", "tile"])
        for batch in batches:
            ibs, jbs, kbs, sides = (batch.column(c).to_pylist() for c in ("ib", "jb", "kb", "side"))
            for r, own in enumerate(zip(ibs, jbs)):
                if own != key:
                    if total is not None:
                        yield row()
                    key, total, held = own, None, None
                tile = batch.column("tile")[r].values.to_numpy()
                if sides[r] == 0:
                    held = kbs[r], tile.reshape(height, depth)
                elif held is not None and held[0] == kbs[r]:
                    found = held[1] @ tile.reshape(depth, width)
                    total = found if total is None else total + found
        if total is not None:
            yield row()

    sums = dealt.select("ib", "jb", "kb", "side", "tile").mapInArrow(multiply, "ib long, jb long, tile array<double>")
    if parts > 1:
        added = F.reduce(F.slice("all", F.lit(2), F.size("all")), F.get("all", F.lit(0)), lambda x, y: F.zip_with(x, y, lambda p, q: p + q))
        sums = sums.groupBy("ib", "jb").agg(F.collect_list("tile").alias("all")).select("ib", "jb", added.alias("tile"))
    cells = sums.select("ib", "jb", F.posexplode("tile").alias("at", "v"))
    cells = cells.select((F.col("ib") * height + F.floor(F.col("at") / width)).alias("i"), (F.col("jb") * width + F.col("at") % width).alias("j"), "v")
    return cells.where((F.col("i") <= n) & (F.col("j") <= m))


def depth_progress(n: int, m: int, k: int, rows: int, cols: int, span: int, spark) -> DataFrame:
    """A row a chunk (ib, jb, kb) of the tiling: its k_span, the sum so far over its output tile, and whether the tile is then complete."""
    each = lambda size, step: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(-(-size // step) - 1).cast("long")))
    grid = spark.range(-(-n // rows)).select(F.col("id").alias("ib"), each(m, cols).alias("jb"))
    grid = grid.select("ib", "jb", each(k, span).alias("kb"))
    own = F.least(F.lit(span), k - F.col("kb") * span).cast("long")
    order = Window.partitionBy("ib", "jb").orderBy("kb").rowsBetween(Window.unboundedPreceding, 0)
    return grid.withColumn("k_span", own).withColumn("k_done", F.sum("k_span").over(order)).withColumn("complete", F.col("k_done") >= k)


def compared(a: DataFrame, b: DataFrame, absolute: float = 1e-5, relative: float = 1e-3) -> DataFrame:
    """Both results of one product, cell by cell (absent is 0): cells, largest errors, the worst cell, and cells beyond absolute + relative * |reference|."""
    both = a.select("i", "j", F.col("v").alias("x")).join(b.select("i", "j", F.col("v").alias("y")), ["i", "j"], "full")
    both = both.select("i", "j", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y")).withColumn("error", F.abs(F.col("x") - F.col("y")))
    scale = F.when(F.abs("y") > 0, F.col("error") / F.abs("y")).otherwise(F.col("error"))
    return both.agg(F.count("*").alias("cells"), F.max("error").alias("max_abs"), F.max(scale).alias("max_rel"), F.max_by(F.struct("i", "j"), "error").alias("worst"), F.count_if(F.col("error") > absolute + relative * F.abs("y")).alias("beyond"))
