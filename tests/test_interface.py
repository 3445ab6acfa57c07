"""Files as tasks' inputs and sinks, strategies of one's own, assignments, precision, hot values."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import numbers
from tessera.operators import ecm, metrics, numtheory, quorum, sorting
from tessera.plans import tasks as task_module
from tessera.plans.tasks import STRATEGIES, Strategy, Tasks, register, unregister
from tessera.sources import files
from tests.test_operators import cells, dense


@pytest.fixture(scope="module")
def tasks(spark):
    return Tasks(spark)


def done(tasks, task):
    tasks.start(task).result()
    assert task.status == "completed", task.error
    return tasks.output(task)


def test_tasks_from_json_and_files(spark, tasks, tmp_path):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(5, 7)).astype("<f4"), rng.normal(size=(7, 3)).astype("<f4")
    a.tofile(tmp_path / "up_A.bin")
    b.tofile(tmp_path / "other.bin")
    np.array([9, 1, 2**32 - 1], "<u4").tofile(tmp_path / "s.bin")
    for x in "QKV":
        a.tofile(tmp_path / f"1_{x}.bin")
    task = lambda **x: tasks.submit_json(json.dumps(x), str(tmp_path))
    got = done(tasks, task(strategyId="matmul", config={"N": 5, "M": 3, "K": 7}, cachedFilePaths=["other.bin", "up_A.bin", "gone.bin"]))
    assert np.allclose(dense(got, 5, 3), a.astype(float) @ b.astype(float))
    assert [r.value for r in done(tasks, task(strategyId="sort-u32", input={"ascending": False}, cachedFilePaths=["s.bin"])).orderBy("pos").collect()] == [2**32 - 1, 9, 1]
    assert done(tasks, task(strategyId="attention", config={"num_heads": 1, "d_model": 7, "seq_len": 5}, cachedFilePaths=[f"1_{x}.bin" for x in "QKV"])).count() == 5
    assert done(tasks, task(strategyId="ecm-stage1", input={"N": "65537", "B1": 50, "total_curves": 4, "chunk_size": 2})).count() == 4
    for bad in ({}, {"strategyId": "none"}, {"strategyId": "sort-u32", "cachedFilePaths": ["s.bin", "other.bin"]}, {"strategyId": "matmul", "config": {"N": 5, "M": 3, "K": 7}, "cachedFilePaths": ["s.bin"]}, {"strategyId": "attention", "config": {"seq_len": 5, "d_model": 7}, "cachedFilePaths": ["s.bin"]}):
        with pytest.raises(ValueError):
            task(**bad)


def test_strategies_of_ones_own(spark, tasks):
    register(Strategy("doubled", "Twice each value", lambda spark, inputs, config: inputs["x"].select((F.col("v") * config["by"]).alias("v"))))
    try:
        assert [r.v for r in done(tasks, tasks.submit("doubled", {"x": spark.range(3).select(F.col("id").alias("v"))}, {"by": 2})).orderBy("v").collect()] == [0, 2, 4]
        with pytest.raises(ValueError):
            register(STRATEGIES["doubled"])
    finally:
        unregister("doubled")
    assert "doubled" not in STRATEGIES and task_module.strategies(spark).count() == len(STRATEGIES)


def test_products_wrap_and_cut(spark, tasks):
    a, b = np.full((2, 3), 60_000), np.full((3, 2), 50_000)
    inputs = {"a": cells(spark, a), "b": cells(spark, b, "k", "j")}
    got = done(tasks, tasks.submit("matmul", inputs, {"N": 2, "M": 2, "K": 3, "datatype": "i32"}))
    assert dense(got, 2, 2).tolist() == (a.astype(np.int32) @ b.astype(np.int32)).tolist()
    x = np.array([[1 / 3, -1.7, 1e-30]])
    for kind, mask in (("bf16", 0xFFFF0000), ("tf32", 0xFFFFE000)):
        cut = (x.astype(np.float32).view(np.uint32) & np.uint32(mask)).view(np.float32)
        got = done(tasks, tasks.submit("matmul", {"a": cells(spark, x), "b": cells(spark, np.eye(3), "k", "j")}, {"N": 1, "M": 3, "K": 3, "datatype": kind}))
        assert np.allclose(dense(got, 1, 3), cut, rtol=1e-6, atol=0)


def test_cuts_of_odd_values(spark):
    values = [None, 0.0, -0.0, float("nan"), float("inf"), -float("inf"), 1.0, -(2.0**-130), 3.4e38]
    got = [r.c for r in spark.createDataFrame([(v,) for v in values], "v double").select(numbers.fraction_cut(F.col("v"), 7).alias("c")).collect()]
    assert got[0] is None and np.isnan(got[3]) and got[4:7] == [float("inf"), -float("inf"), 1.0] and got[1] == got[2] == got[7] == 0 and got[8] <= 3.4e38
    wrapped = [r.w for r in spark.createDataFrame([(v,) for v in (2**31, -(2**31) - 1, 5, None)], "v long").select(numbers.wrapped32(F.col("v")).alias("w")).collect()]
    assert wrapped == [-(2**31), 2**31 - 1, 5, None]


def test_wide_limbs_and_generators(spark):
    values = ["0", str(2**256 - 1), str(2**256), "-1", "x", None, str(2**200 + 12345)]
    rows = spark.createDataFrame([(v,) for v in values], "n string").select("n", numbers.wide_limbs(F.col("n")).alias("l")).withColumn("back", numbers.from_wide_limbs(F.col("l"))).collect()
    assert [r.back for r in rows] == ["0", str(2**256 - 1), None, None, None, None, str(2**200 + 12345)] and all(r.l is None or len(r.l) == 8 for r in rows)
    x = [0, 1, 2**63, 2**64 - 1, 12345678901234567890]
    got = spark.createDataFrame([(str(v),) for v in x], "x string").select(numbers.lcg64(F.col("x").cast("decimal(20,0)")).alias("y")).collect()
    assert [int(r.y) for r in got] == [(v * 6364136223846793005 + 1442695040888963407) % 2**64 for v in x]


def test_gcd_of_nulls(spark):
    df = spark.createDataFrame([(12, 18), (None, 4), (4, None), (0, 0)], "a long, b long")
    assert [r.g for r in df.select(numtheory.gcd_batched(F.col("a"), F.col("b")).alias("g")).collect()] == [6, None, None, 0]


def test_hot_values_are_dealt_to_many_ranges(spark):
    """Two thirds of the rows share a value: no range holds more than its share."""
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(77).alias("value"))
    got = sorting.sorted_u32(rows)
    plan = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(4, "value", "_tie")
    assert max(r["count"] for r in plan.groupBy(F.spark_partition_id()).count().collect()) < 14_000
    values = [r.value for r in got.orderBy("pos").collect()]
    assert values == sorted([k if k % 3 == 0 else 77 for k in range(30_000)])


def test_slices_padding_and_files(spark, tmp_path):
    rng = random.Random(4)
    values = [rng.randrange(2**32) for _ in range(1003)]
    df = spark.createDataFrame(list(enumerate(values)), "pos long, value long")
    assert sorted(r.value for r in sorting.slice_of(df, 1000, 10).collect()) == sorted(values[1000:])
    for ascending in (True, False):
        runs = sorting.padded_runs(df, 100, ascending=ascending)
        assert {len(r.run) for r in runs.collect()} == {128, 4}
        assert {r.chunk: r.run for r in sorting.trimmed_runs(runs).collect()} == {c: sorted(values[100 * c : 100 * c + 100], reverse=not ascending) for c in range(11)}
    path = str(tmp_path / "x.bin")
    files.write_file(files.u32_slices(df, 64), path, "slice")
    assert np.fromfile(path, "<u4").tolist() == values
    assert [r.value for r in files.u32_file(spark, path).orderBy("pos").collect()] == values


def test_curves_as_words(spark, tmp_path):
    n = 3 * 65537 * 65539
    found = ecm.curves(spark, n, 200, 24, 8, small=(2, 3, 5))
    assert ecm.without(360, (2, 3, 5)) == (1, {2: 3, 3: 2, 5: 1}) and ecm.curves(spark, 360, small=(3, 5)).count() == 0
    assert all(r.factor in (None, "65537", "65539") for r in found.collect())
    files.write_file(ecm.packed_curves(found), str(tmp_path / "c.bin"), "curve_index")
    words = np.fromfile(tmp_path / "c.bin", "<u4").reshape(24, 9)
    for r in found.collect():
        own = words[r.curve_index]
        assert own[8] == r.status and sum(int(w) << 32 * k for k, w in enumerate(own[:8])) == int(r.factor or 0)


def test_assignment_with_earlier_clients(spark):
    clients = spark.createDataFrame([(1, ["a"], 2, 0), (2, None, 2, 0), (3, [], 2, 0), (4, ["b"], 2, 0), (5, None, 1, 1)], "client long, frameworks array<string>, capacity int, in_flight int")
    chunks = spark.createDataFrame([(0, "a"), (1, "c"), (2, "b")], "chunk long, framework string")
    earlier = spark.createDataFrame([(0, 1), (1, 2), (1, 3)], "chunk long, client long")
    of = lambda df: {c: sorted((r.replica, r.client) for r in df.collect() if r.chunk == c) for c in range(3)}
    fresh = of(quorum.assigned(chunks, clients, 3, earlier))
    assert {c for _, c in fresh[0]} == {2, 3} and [r for r, _ in fresh[0]] == [1, 2] and fresh[1] == [] and {c for _, c in fresh[2]} == {2, 3, 4}
    again = of(quorum.assigned(chunks, clients, 3, earlier, same_client=True))
    assert {c for _, c in again[0]} == {1, 2, 3} and [r for r, _ in again[1]] == [2, 3]


def greedy(chunks, clients, k, earlier, same):
    load, out = {c[0]: c[3] for c in clients}, []
    for chunk, kind in sorted(chunks):
        had, replica = {c for x, c in earlier if x == chunk}, sum(x == chunk for x, _ in earlier)
        for _ in range(k):
            fit = [c for c in clients if load[c[0]] < c[2] and (not c[1] or kind in c[1]) and (same or c[0] not in had)]
            if not fit:
                break
            best = min(fit, key=lambda c: (load[c[0]] / max(1, c[2]), c[0]))[0]
            out.append((chunk, replica, best))
            load[best], replica = load[best] + 1, replica + 1
            had.add(best)
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_schedule_takes_up_capacity(spark, seed):
    rng = random.Random(seed)
    clients = [(c, rng.choice([None, [], ["a"], ["b"], ["a", "b"]]), rng.randrange(1, 5), rng.randrange(0, 3)) for c in range(7)]
    chunks = [(n, rng.choice("abc")) for n in rng.sample(range(400), 120)]
    earlier = [(n, rng.randrange(7)) for n, _ in chunks if n < 200 or rng.random() < 0.4]  # small numbers have been dealt before, some to clients that are the only ones left
    frames = (spark.createDataFrame(chunks, "chunk long, framework string"), spark.createDataFrame(clients, "client long, frameworks array<string>, capacity int, in_flight int"))
    had = spark.createDataFrame(earlier, "chunk long, client long")
    for k, same in ((1, False), (2, False), (2, True)):
        got = sorted(map(tuple, quorum.scheduled(*frames, k, had, same).collect()))
        assert got == greedy(chunks, clients, k, earlier, same)
    assert quorum.scheduled(frames[0], frames[1].where("false"), 2).count() == 0


def test_rates_of_chunks(spark):
    t = spark.createDataFrame([("1:a", 2, 500), ("1:b", 4, 1500), ("1:c", 9, 0), ("2:a", 1, 100)], "chunk string, replicas long, duration_ms long")
    got = {r.task: r for r in metrics.throughput_rates(t, F.split_part(F.col("chunk"), F.lit(":"), F.lit(1))).collect()}
    assert got["1"].per_second == 3 and got["1"].median_ms == 1000 and got["2"].per_second == 10


def test_nulls_in_numbers_and_sequences(spark):
    rows = spark.createDataFrame([(None,), (0.5,), (9.0,), (-9.0,), (float("inf"),)], "v double")
    assert [r.b for r in rows.select(numbers.signed_byte(F.col("v")).alias("b")).collect()] == [None, 64, 127, -128, 127]
    whole = spark.createDataFrame([(None,), (2**40 + 5,)], "n long").select(numbers.limbs(F.col("n"), 3).alias("l"), numbers.from_limbs(numbers.limbs(F.col("n"))).alias("n")).collect()
    assert [r.n for r in whole] == [None, 2**40 + 5] and whole[1].l == [5, 256, 0]
    runs = sorting.chunk_runs(spark.createDataFrame([(0, 3), (1, None), (2, 1)], "pos long, value long"), 4).first()
    assert (runs.n, runs.lo, runs.hi, runs.in_order) == (2, 1, 3, True)


def test_attention_passes_null_vectors_by(spark):
    from tessera.operators import attention

    kind = "i long, v array<double>"
    q = attention.heads(spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (2, [0.5, -1.0])], kind), 1, 2)
    k = attention.heads(spark.createDataFrame([(0, [3.0, 1.0]), (1, [0.0, 1.0]), (2, None)], kind), 1, 2)
    got = {(r.i, r.d): r.o for r in attention.blocked(q, k, k, 2).collect()}
    some = lambda df: df.where("v is not null")
    want = {(r.i, r.d): r.o for r in attention.context(attention.softmax(attention.scores(some(q), some(k), 2)), some(k)).collect()}
    assert got.keys() == want.keys() == {(i, d) for i in (0, 2) for d in (0, 1)} and all(abs(got[x] - want[x]) < 1e-12 for x in want)
    none = q.where("false")
    assert attention.blocked(none, k, k, 2).count() == attention.scores(q, none, 2).count() == attention.weights(none, k, 2).count() == 0


def test_attention_of_large_scores_is_stable(spark):
    """Scores beyond what exponentials hold, in one batch and in several: shifts are taken, and batches of other sizes are rescaled."""
    from tessera.operators import attention

    rng = np.random.default_rng(33)
    x = rng.normal(size=(40, 4)) * 40
    x[::7] *= 0.01
    df = attention.heads(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i long, v array<double>"), 2, 4)
    want = {(r.head, r.i, r.d): r.o for r in attention.context(attention.softmax(attention.scores(df, df, 2)), df).collect()}
    for size in ("10000", "3"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = {(r.head, r.i, r.d): r.o for r in attention.blocked(df, df, df, 2, 9).collect()}
            p = attention.weights(df, df, 2, 9).groupBy("head", "i").agg(F.sum("p").alias("s")).collect()
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-9 for c in want) and all(abs(r.s - 1) < 1e-9 for r in p)
