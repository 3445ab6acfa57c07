"""Time series of tasks: rates, peaks, summaries, chunk timings, event-time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def ms(start: Column, end: Column) -> Column:
    """Whole milliseconds between two times, in integers."""
    return F.floor((micros(end) - micros(start)) / 1000).cast("long")


def rates(samples: DataFrame) -> DataFrame:
    """samples: task, ts, event_id, value (a total so far). Each with its number, time since the task's start, change per second (null at the first sample and where no time has passed) and the peak so far."""
    own = Window.partitionBy("task").orderBy("ts", "event_id")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    s = samples.withColumn("us", micros(F.col("ts")))
    dt = (F.col("us") - F.lag("us").over(own)) / 1e6
    return s.select(
        "task",
        "event_id",
        (F.row_number().over(own) - 1).cast("long").alias("sample_idx"),
        ms(F.first("ts").over(upto), F.col("ts")).alias("rel_ms"),
        F.when(dt > 0, (F.col("value") - F.lag("value").over(own)) / 1024 / dt).alias("rate_kb"),
        F.max("value").over(upto).alias("peak"),
    )


def summary(samples: DataFrame) -> DataFrame:
    """A row a task: duration, number of samples, mean, peak, total, first and last value."""
    at = F.struct("ts", "event_id")
    return samples.groupBy("task").agg(
        F.count("*").alias("samples"),
        ms(F.min("ts"), F.max("ts")).alias("duration_ms"),
        F.avg("value").alias("mean"),
        F.max("value").alias("peak"),
        F.sum("value").alias("total"),
        F.min_by("value", at).alias("first"),
        F.max_by("value", at).alias("last"),
    )


def chunk_timing(votes: DataFrame) -> DataFrame:
    """A row a chunk: replicas and times from its first result to its last, in ms."""
    span = ms(F.min("ts"), F.max("ts"))
    return votes.groupBy("chunk").agg(F.count("*").alias("replicas"), span.alias("duration_ms"), F.min_by("client", F.struct("ts", "event_id")).alias("first_client"))


def throughput(timing: DataFrame) -> DataFrame:
    """Totals over all chunks that took any time: chunks, results, and their durations, summed and the longest."""
    return timing.where("duration_ms > 0").agg(F.count("*").alias("chunks"), F.sum("replicas").alias("replicas"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("max_ms"))


def throughput_rates(timing: DataFrame, task: Column) -> DataFrame:
    """A row a task over its chunks that took any time: results per second of chunk time, and the exact quantiles of durations (between neighbours in proportion)."""
    seconds = F.sum("duration_ms") / 1000.0
    quantile = lambda q: F.percentile("duration_ms", q)
    return timing.where("duration_ms > 0").groupBy(task.alias("task")).agg(F.sum("replicas").alias("results"), (F.sum("replicas") / seconds).alias("per_second"), quantile(0.5).alias("median_ms"), quantile(0.95).alias("p95_ms"))


#: Fixed value: interfaces that don't count as network traffic.
BLOCKED_INTERFACES = "^(lo|docker|veth|br-|kube|tun|tap)"


def windowed(samples: DataFrame, length: str, slide: str | None = None) -> DataFrame:
    """Tumbling or sliding windows of event time by kind of event."""
    at = F.window(F.col("ts").cast("timestamp"), length, slide) if slide else F.window(F.col("ts").cast("timestamp"), length)
    w = samples.groupBy(at.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("peak"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total", "peak")


def sessions(samples: DataFrame, gap: str) -> DataFrame:
    """Sessions of a task: samples with less than the gap between neighbours."""
    s = samples.groupBy("task", F.session_window(F.col("ts").cast("timestamp"), gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return s.select("task", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def network_totals(interfaces: DataFrame, allow: str = ".", block: str = BLOCKED_INTERFACES) -> DataFrame:
    """interfaces: task, iface, rx, tx. Totals over interfaces that are allowed and not blocked."""
    kept = interfaces.where(F.col("iface").rlike(allow) & ~F.col("iface").rlike(block))
    return kept.groupBy("task").agg(F.sum("rx").alias("rx"), F.sum("tx").alias("tx"), F.count("*").alias("interfaces"))
