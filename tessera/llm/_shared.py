"""What the text operators share: tables and the work folder of the library, Arrow helpers and hash folds."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..storage import dropped, table, work_dir, written

__all__ = ["WORD", "bound_batches", "dropped", "fold", "runs", "table", "text_udf", "work_dir", "written"]

#: ASCII white space as bytes.split() and the contracts' word pattern take it.
WORD = r"[^\x20\x09-\x0D]+"


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def bound_batches(rows: int = 2000, size: str = "8m") -> None:
    """Arrow batches of at most so many rows and bytes from now on, where the session leaves Spark's defaults: a batch is held several times over, by the
    executor and by its Python worker, and texts may be long."""
    spark = SparkSession.getActiveSession()
    for key, usual, value in (("maxRecordsPerBatch", "10000", str(rows)), ("maxBytesPerBatch", "67108864b", size)):
        name = f"spark.sql.execution.arrow.{key}"
        if spark and spark.conf.get(name) == usual:
            spark.conf.set(name, value)


def runs(sizes: list[int], rows: int, size: int) -> Iterator[tuple[int, int]]:
    """Stretches of at most `rows` items and of sizes that sum to at most `size`, or of one item."""
    start = total = 0
    for k, n in enumerate(sizes):
        if k > start and (k - start >= rows or total + n > size):
            yield start, k
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


@lru_cache(1)
def _trim() -> Callable[[int], int]:
    """glibc's malloc_trim, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return lambda _: 0


def text_udf(make: Callable[[], Callable[[list], pa.Array]], kind, rows: int = 512, size: int = 2_000_000):
    """An Arrow UDF on one column: make() runs once a worker task and gives the function from a list of values to their results.
    Batches are handled in slices of at most `rows` values and `size` bytes (or one value), which bounds what Python holds
    as objects. Marked nondeterministic only so that Spark never evaluates it twice."""

    bound_batches()

    @arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = make()
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch), 0).to_pylist()
            pa.default_memory_pool().release_unused()
            parts = [work(batch.slice(a, b - a).to_pylist()) for a, b in runs(lengths, rows, size)] or [work([])]
            yield parts[0] if len(parts) == 1 else pa.concat_arrays(parts)
            del parts
            _trim()(0)  # what a batch has freed goes back to the machine, whose memory workers share with the executor

    return run.asNondeterministic()
