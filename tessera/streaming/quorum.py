"""The quorum and the metrics over streams: the same answers as the batch forms, as results come in."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DECIDED = "chunk string, checksum string, event_id long, kind string"
NAMES = [c.split()[0] for c in DECIDED.split(", ")]
#: What a bucket of chunks remembers: a row an open chunk's vote that counts, a row a decided chunk (client and checksum null).
HELD = pa.schema([("chunk", pa.string()), ("checksum", pa.string()), ("client", pa.string()), ("tick", pa.int64()), ("seen", pa.int64()), ("done", pa.bool_())])
#: How long a chunk is remembered after its last tick, in microseconds of event time.
RETAIN = 30 * 86_400_000_000


def packed(held: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, HELD) as out:
        out.write_table(pa.Table.from_pandas(held[HELD.names], HELD, preserve_index=False))
    return sink.getvalue().to_pybytes()


def unpacked(raw: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(raw).read_pandas()


def counted(held: pd.DataFrame, votes: pd.DataFrame, k: int) -> tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame]:
    """held: open votes and decided chunks; votes: new ones in order of (tick, event_id). Returns the votes that decide a chunk, those that come too late, and what is to be held from now on.

    Whole columns at once: known and new votes in order, the first of each (chunk, checksum, client) kept, numbered by (chunk, checksum); the first number k of a chunk decides it."""
    done = held[held.done]
    known = votes.chunk.isin(done.chunk)
    fresh = votes[~known].assign(turn=range(int((~known).sum())))
    valid = fresh[(fresh.status == "ok") & fresh.checksum.notna()]
    every = pd.concat([held[~held.done].assign(turn=-1), valid.assign(done=False)], ignore_index=True)
    votes_of = every[every.checksum.notna()].drop_duplicates(["chunk", "checksum", "client"])
    nth = votes_of.groupby(["chunk", "checksum"], dropna=False).cumcount() + 1
    first = votes_of[nth == k].sort_values("turn", kind="stable").drop_duplicates("chunk")
    at = first.set_index("chunk").turn
    turn_of = fresh.chunk.map(at)
    late = pd.concat([votes[known], fresh[fresh.turn > turn_of]])
    # a chunk without a vote that counts is known by a row without a checksum
    only = fresh[~fresh.chunk.isin(votes_of.chunk)].assign(checksum=None, client=None, done=False)
    waiting = every[every.checksum.isna() & ~every.chunk.isin(votes_of.chunk)]
    left = pd.concat([x for x in (votes_of, waiting, only) if len(x)] or [votes_of])
    left = left[~left.chunk.isin(first.chunk)].drop_duplicates(["chunk", "checksum", "client"])
    last = pd.concat([done, first.assign(checksum=None, client=None, done=True)]) if len(first) else done
    stay = pd.concat([x for x in (left, last) if len(x)] or [left])
    if len(votes):  # the latest tick and arrival of the chunk
        news = votes.groupby("chunk", dropna=False).agg(tick=("tick", "max"), seen=("seen", "max"))
        for c in ("tick", "seen"):
            stay = stay.assign(**{c: stay[c].where(~stay.chunk.isin(news.index), stay.chunk.map(news[c]).fillna(0)).astype("int64")})
    return first, late, stay[HELD.names]


def vote_state(k: int, timeout_ms: int | None = None, retain: int | None = RETAIN):
    """Per bucket of chunks: open votes of distinct clients by checksum, and the decided chunks. Emits `accepted` once a chunk, `late` for each vote after that, `stuck` for an open chunk from which nothing has come for timeout_ms.

    Chunks whose last vote lies more than `retain` behind the bucket's latest are forgotten, so that state is bounded by what comes within that span; a vote that is as old itself is late, whatever its chunk. None keeps all."""

    def step(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        warnings.simplefilter("ignore", FutureWarning)  # columns of nulls, joined here and by Spark
        held = unpacked(state.get[0]) if state.exists else HELD.empty_table().to_pandas()
        now = state.getCurrentProcessingTimeMs() if timeout_ms else 0
        parts = []
        if not state.hasTimedOut:
            votes = pd.concat(list(frames)).sort_values(["tick", "event_id"], kind="stable").assign(seen=now)
            # as with a watermark, what earlier batches have seen decides what is too old, so that a batch may span any time
            old = votes.tick < held.tick.max() - retain if retain is not None and len(held) else votes.tick.isna()
            first, late, held = counted(held, votes[~old], k)
            parts += [first.assign(kind="accepted"), late.assign(kind="late"), votes[old].assign(kind="late")]
            if retain is not None:
                held = held[held.tick >= held.tick.max() - retain]
        if timeout_ms:
            idle = ~held.done & (held.seen + timeout_ms <= now)
            parts.append(held[idle].drop_duplicates("chunk").assign(checksum=None, event_id=None, kind="stuck"))
            held = held[~held.chunk.isin(held[idle].chunk)]
        state.update((packed(held),))
        if timeout_ms and (waiting := held[~held.done].seen).size:
            state.setTimeoutDuration(max(1, int(waiting.min()) + timeout_ms - now))
        if parts := [x[NAMES] for x in parts if len(x)]:
            out = pd.concat(parts)
            yield out.assign(event_id=out.event_id.astype("Int64"))

    return step


def stream_quorum(votes: DataFrame, k: int, timeout_ms: int | None = None, buckets: int = 64, retain: int | None = RETAIN) -> DataFrame:
    """votes: a stream of chunk, checksum, client, ts, event_id, status. Returns a stream of DECIDED. Each result changes state at most once, so a restart from the checkpoint repeats nothing.

    State is kept by buckets of chunks, dealt by a hash, so that Python is called once a bucket and batch and works on columns; a query keeps its number
    of buckets for life. Votes of one batch count in order of (ts, event_id). Failed votes and those without a checksum don't count. retain is in microseconds, or in the units of ts if that is a number."""
    tick = F.unix_micros(F.col("ts").cast("timestamp")) if dict(votes.dtypes)["ts"].startswith("timestamp") else F.col("ts").cast("long")
    rows = votes.select(F.pmod(F.xxhash64("chunk"), F.lit(buckets)).cast("int").alias("bucket"), "chunk", F.col("checksum").cast("string").alias("checksum"), F.col("client").cast("string").alias("client"), tick.alias("tick"), "event_id", "status")
    timeout = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    return rows.groupBy("bucket").applyInPandasWithState(vote_state(k, timeout_ms, retain), DECIDED, "held binary", "append", timeout)


def stream_windows(samples: DataFrame, length: str, late: str) -> DataFrame:
    """Tumbling windows of event time over a stream, each emitted once the watermark has passed it."""
    w = samples.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    agg = w.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("peak"))
    return agg.select(F.col("w.start").alias("start"), "event_type", "n", "total", "peak")


def arrivals_joined(sent: DataFrame, done: DataFrame, late: str) -> DataFrame:
    """Two streams, chunks sent (chunk, sent_ts) and done (chunk, done_ts, ok), joined on the chunk within the allowed lateness: (chunk, sent_ts, done_ts, code) with code 1 for success and -1 for an error."""
    a = sent.withWatermark("sent_ts", late)
    b = done.select(F.col("chunk").alias("d"), "done_ts", "ok").withWatermark("done_ts", late)
    near = (F.col("chunk") == F.col("d")) & F.col("done_ts").between(F.col("sent_ts"), F.col("sent_ts") + F.expr(f"interval {late}"))
    return a.join(b, near).select("chunk", "sent_ts", "done_ts", F.when(F.col("ok"), 1).otherwise(-1).alias("code"))
