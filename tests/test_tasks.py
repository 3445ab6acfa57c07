"""Strategies by name, the life of a task, streams that join and report."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.plans.tasks import STRATEGIES, Tasks, strategies
from tessera.streaming.listener import ProgressLog
from tessera.streaming.quorum import arrivals_joined, stream_quorum
from tests.test_operators import cells, dense


@pytest.fixture(scope="module")
def tasks(spark):
    return Tasks(spark)


def test_matmul_task(spark, tasks):
    rng = np.random.default_rng(1)
    a, b = rng.integers(-5, 5, (6, 8)).astype(float), rng.integers(-5, 5, (8, 4)).astype(float)
    inputs = {"a": cells(spark, a), "b": cells(spark, b, "k", "j")}
    for extra in ({}, {"form": "tiles", "tile_size": 4, "k_tile_size": 3}, {"datatype": "i32"}):
        t = tasks.submit("matmul", inputs, {"N": 6, "M": 4, "K": 8, **extra}, "product")
        assert t.status == "created" and json.loads(t.descriptor())["chunks"] >= 1
        tasks.start(t).result()
        assert t.status == "completed", t.error
        assert np.allclose(dense(tasks.output(t), 6, 4), a @ b)
    with pytest.raises(ValueError):
        tasks.start(t)


def test_matmul_task_of_halves_and_bytes(spark, tasks):
    rng = np.random.default_rng(2)
    a, b = rng.uniform(0.5, 1, (3, 5)), rng.uniform(0.5, 1, (5, 2))
    inputs = {"a": cells(spark, a), "b": cells(spark, b, "k", "j")}
    cut, byte = lambda x: np.floor(x * 2048) / 2048, lambda x: np.minimum(127, np.floor(x * 127 + 0.5))
    for extra, want in (({"datatype": "f16"}, cut(a) @ cut(b)), ({"datatype": "f16", "form": "tiles", "tile_size": 2}, cut(a) @ cut(b)), ({"datatype": "int8"}, byte(a) @ byte(b))):
        t = tasks.submit("matmul", inputs, {"N": 3, "M": 2, "K": 5, **extra}, "product")
        tasks.start(t).result()
        assert t.status == "completed", t.error
        assert np.allclose(dense(tasks.output(t), 3, 2), want, rtol=1e-9)


def test_sort_attention_and_curves(spark, tasks):
    seq = spark.createDataFrame(list(enumerate([5, 3, 9, 2**32 - 1])), "pos long, value long")
    x = spark.createDataFrame([(i, [float(i + j) for j in range(4)]) for i in range(3)], "i long, v array<double>")
    for name, inputs, config, rows in (("sort-u32", {"sequence": seq}, {"max_elements": 3, "ascending": False, "count": 4}, 3), ("attention", dict.fromkeys("qkv", x), {"num_heads": 2, "d_model": 4}, 3), ("ecm-stage1", {}, {"N": "0x1000200030001", "B1": 100, "total_curves": 8, "chunk_size": 4}, 8)):
        t = tasks.submit(name, inputs, config)
        tasks.start(t).result()
        assert t.status == "completed" and tasks.output(t).count() == rows, t.error
    assert {r.status for r in tasks.listing().collect()} == {"completed"}
    assert strategies(spark).count() == len(STRATEGIES) == 4


def test_errors_and_cancel(spark, tasks):
    t = tasks.submit("ecm-stage1", {}, {"N": 0})
    tasks.start(t).result()
    assert t.status == "error" and "positive" in t.error
    c = tasks.submit("ecm-stage1", {}, {"N": 15})
    tasks.cancel(c)
    assert c.status == "canceled"
    for bad in (lambda: tasks.start(c), lambda: tasks.output(c), lambda: tasks.submit("none", {}, {})):
        with pytest.raises(ValueError):
            bad()


def run(spark, stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_streamed_votes_give_late_ones_too(spark, tmp_path):
    rows = [("a", "x", 1, 1, 1, "ok"), ("a", "x", 1, 2, 2, "ok"), ("a", "x", 2, 3, 3, "ok"), ("a", "y", 3, 4, 4, "ok"), ("b", "x", 1, 1, 5, "error")]
    kind = "chunk string, checksum string, client long, ts long, event_id long, status string"
    for k, r in enumerate(rows):
        spark.createDataFrame([r], kind).write.mode("append").parquet(str(tmp_path / "in"))
    log = ProgressLog(spark)
    spark.streams.addListener(log)
    try:
        got = run(spark, stream_quorum(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), 2), "votes_out")
    finally:
        spark.streams.removeListener(log)
    assert {(r.chunk, r.event_id, r.kind) for r in got} == {("a", 3, "accepted"), ("a", 4, "late")}
    assert log.table().count() >= 0


def test_arrivals_join(spark, tmp_path):
    ts = lambda c: F.timestamp_seconds(c)
    spark.createDataFrame([("a", 10), ("b", 20), ("c", 30)], "chunk string, s long").select("chunk", ts("s").alias("sent_ts")).write.parquet(str(tmp_path / "sent"))
    spark.createDataFrame([("a", 15, True), ("b", 25, False), ("c", 4000, True)], "chunk string, s long, ok boolean").select("chunk", ts("s").alias("done_ts"), "ok").write.parquet(str(tmp_path / "done"))
    sent = spark.readStream.schema("chunk string, sent_ts timestamp").parquet(str(tmp_path / "sent"))
    done = spark.readStream.schema("chunk string, done_ts timestamp, ok boolean").parquet(str(tmp_path / "done"))
    got = run(spark, arrivals_joined(sent, done, "10 minutes"), "arrivals_out")
    assert {(r.chunk, r.code) for r in got} == {("a", 1), ("b", -1)}


def test_written_tables_are_dropped(spark):
    from pathlib import Path

    from tessera import storage

    a, b = (storage.written(spark.range(3), "t") for _ in range(2))
    at = [Path(x.written_at.removeprefix("file://")) for x in (a, b)]
    storage.dropped(a, spark.range(1))
    assert not at[0].exists() and at[1].exists() and b.count() == 3
    storage.drop_all(spark)
    assert not at[1].exists()


class Kept:
    """A bucket's state as Spark keeps it."""

    def __init__(self):
        self.value, self.hasTimedOut, self.now, self.timeout = None, False, 0, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def getCurrentProcessingTimeMs(self):
        return self.now

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def stepped(step, state, rows, now=0):
    """rows: (chunk, checksum, client, tick, event_id, status)."""
    import pandas as pd

    state.now, state.hasTimedOut = now, rows is None
    frames = [] if rows is None else [pd.DataFrame(rows, columns=["chunk", "checksum", "client", "tick", "event_id", "status"])]
    return [tuple(None if pd.isna(x) else x for x in r) for f in step((0,), iter(frames), state) for r in f.itertuples(index=False)]


def voted(rows, k):
    seen, done, out = {}, set(), []
    for chunk, checksum, client, _, event, status in rows:
        if chunk in done:
            out.append((chunk, checksum, event, "late"))
        elif status == "ok" and checksum is not None:
            seen.setdefault((chunk, checksum), set()).add(client)
            if len(seen[chunk, checksum]) == k:
                done.add(chunk)
                out.append((chunk, checksum, event, "accepted"))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_batches_of_votes_equal_one_by_one(seed):
    import random

    from tessera.streaming.quorum import vote_state

    rng, k = random.Random(seed), 1 + seed % 3
    rows = [(rng.choice("abcdef"), rng.choice(["x", "y", "y", None]), rng.choice(["1", "2", "3", None]), t // 3, t, rng.choice(["ok", "ok", "error"])) for t in range(80)]
    state, step, got, at = Kept(), vote_state(k), [], 0
    while at < len(rows):
        n = rng.randrange(1, 12)
        got += stepped(step, state, rng.sample(rows[at : at + n], len(rows[at : at + n])))
        at += n
    assert sorted(got, key=str) == sorted(voted(rows, k), key=str)


def test_idle_chunks_are_stuck_and_old_ones_forgotten():
    from tessera.streaming.quorum import unpacked, vote_state

    state, step = Kept(), vote_state(2, timeout_ms=100)
    assert stepped(step, state, [("a", "x", "1", 1, 1, "ok"), ("b", "x", "1", 1, 2, "error")], 1000) == [] and state.timeout == 100
    assert stepped(step, state, [("a", "y", "2", 2, 3, "ok")], 1060) == []
    assert stepped(step, state, None, 1100) == [("b", None, None, "stuck")] and state.timeout == 60
    assert stepped(step, state, None, 1160) == [("a", None, None, "stuck")]
    state, step = Kept(), vote_state(2, retain=10)
    assert [r[2:] for r in stepped(step, state, [("a", "x", "1", 1, 1, "ok"), ("a", "x", "2", 2, 2, "ok"), ("b", "x", "1", 8, 3, "ok")])] == [(2, "accepted")]
    assert stepped(step, state, [("c", "x", "1", 15, 4, "ok")]) == [] and set(unpacked(state.get[0]).chunk) == {"b", "c"}
    assert stepped(step, state, [("a", "x", "1", 3, 5, "ok")]) == [("a", "x", 5, "late")]


def test_a_batch_may_span_more_than_what_is_kept():
    from tessera.streaming.quorum import unpacked, vote_state

    rows = [(f"c{t}", "x", str(c), t, 2 * t + c, "ok") for t in range(0, 100, 5) for c in (0, 1)]
    state, step = Kept(), vote_state(2, retain=10)
    assert {r[0] for r in stepped(step, state, rows) if r[3] == "accepted"} == {r[0] for r in rows}
    assert set(unpacked(state.get[0]).chunk) == {"c85", "c90", "c95"}


def test_queries_over_streams_take_several_batches(spark, sf):
    from tessera.plans import catalogue

    log = ProgressLog(spark)
    spark.streams.addListener(log)
    try:
        assert catalogue.stream_quorum(spark, sf).count() > 0
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(log)
    assert sum(r["rows"] > 0 for r in log.table().collect()) >= 4
