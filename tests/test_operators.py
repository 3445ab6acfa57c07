"""Operators against numpy, plain Python and invariants."""

import random
from math import prod

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import numbers
from tessera.operators import attention, ecm, matmul, metrics, numtheory, quorum, sorting
from tessera.plans import catalogue, tiling
from tessera.sources import files, generate, tables


def cells(spark, m, row="i", col="k"):
    return spark.createDataFrame([(i, k, float(m[i, k])) for i in range(m.shape[0]) for k in range(m.shape[1])], f"{row} long, {col} long, v double")


def dense(df, n, m):
    out = np.zeros((n, m))
    for r in df.collect():
        out[r.i, r.j] = r.v
    return out


def test_products_agree_with_numpy(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(11, 7)), rng.normal(size=(7, 9))
    da, db = cells(spark, a), cells(spark, b, "k", "j")
    assert np.allclose(dense(matmul.product(da, db), 11, 9), a @ b)
    assert np.allclose(dense(matmul.tiled_product(da, db, 4, 3, 2), 11, 9), a @ b)
    worst = matmul.compared(matmul.tiled_product(da, db, 4, 3, 2), matmul.product(da, db)).first()
    assert worst.cells == 99 and worst.beyond == 0 and worst.max_abs < 1e-9


def test_gram_in_one_pass(spark):
    rng = np.random.default_rng(31)
    x = rng.normal(size=(50, 6))
    rows = spark.createDataFrame([(r.tolist(),) for r in x] + [(None,), ([],), ([1.0, None],)], "v array<double>").repartition(3)
    full = np.vstack([x, [1, 0, 0, 0, 0, 0]])
    assert np.allclose(dense(matmul.gram(rows), 6, 6), full.T @ full)
    assert np.array_equal(dense(matmul.gram(rows.selectExpr("transform(v, x -> cast(x * 10 as int)) as v"), "v", "long"), 6, 6), np.trunc(full * 10).T @ np.trunc(full * 10))
    assert matmul.gram(rows.where("false")).count() == 0


def test_tiles_of_sparse_and_uneven_matrices(spark):
    rng = np.random.default_rng(32)
    a, b = (rng.normal(size=s) * (rng.random(s) < 0.3) for s in ((13, 29), (29, 8)))
    few = lambda m, row, col: cells(spark, m, row, col).where("v <> 0")
    for shape in ((5, 3, 4), (50, 50, 50), (1, 8, 2)):
        got = matmul.tiled_product(few(a, "i", "k"), few(b, "k", "j"), *shape)
        assert np.allclose(dense(got, 13, 8), a @ b)
    none = spark.createDataFrame([], "k long, j long, v double")
    assert matmul.tiled_product(few(a, "i", "k"), none, 4, 4, 4).count() == 0


def test_product_of_empty_tables(spark):
    none = spark.createDataFrame([], "i long, k long, v double")
    assert matmul.product(none, none.select("k", F.col("i").alias("j"), "v")).count() == 0


@given(st.integers(1, 5000), st.integers(1, 5000), st.integers(1, 5000), st.one_of(st.none(), st.integers(1, 10**7)))
@settings(max_examples=200, deadline=None)
def test_tiles_fit_their_budget(n, m, k, budget):
    rows, cols, depth = tiling.tile_sizes(n, m, k, budget)
    assert 1 <= rows <= n and 1 <= cols <= m and 1 <= depth <= k
    if budget and budget >= 3:
        assert rows * cols <= max(1, budget // 3)


def test_tile_columns_equal_tile_sizes(spark):
    rng = random.Random(2)
    plans = [tuple(rng.randrange(1, 4000) for _ in range(3)) + (rng.randrange(3, 10**6),) for _ in range(60)]
    p = spark.createDataFrame(plans, "n long, m long, k long, budget long")
    for r in p.withColumns(tiling.tile_columns(F.col("n"), F.col("m"), F.col("k"), F.col("budget"))).collect():
        assert (r.rows, r.cols, r.depth) == tiling.tile_sizes(r.n, r.m, r.k, r.budget)


@pytest.mark.parametrize("ascending", [True, False])
def test_sort_is_a_permutation_in_order(spark, ascending):
    rng = random.Random(3)
    values = [rng.randrange(2**32) for _ in range(1000)] + [2**32 - 1, 2**31, 0, 0]
    got = sorting.sorted_u32(spark.createDataFrame([(v,) for v in values], "value long"), ascending=ascending).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(len(values)))
    assert [r.value for r in got] == sorted(values, reverse=not ascending)


def test_sort_of_nothing(spark):
    assert sorting.sorted_u32(spark.createDataFrame([], "value long")).count() == 0


def test_next_pow2(spark):
    got = spark.createDataFrame([(n,) for n in (-1, 0, 1, 2, 3, 4, 5, 1023, 1024, 1025)], "n long").select(sorting.next_pow2(F.col("n")).alias("p")).collect()
    assert [r.p for r in got] == [1, 1, 1, 2, 4, 4, 8, 1024, 1024, 2048]


def test_violations(spark):
    df = spark.createDataFrame(list(enumerate([3, 1, 2, 2, 5, 4])), "pos long, value long")
    assert tuple(sorting.order_violations(df).first()) == (5, 2)


def test_softmax_rows_sum_to_one_and_attention_equals_numpy(spark):
    rng = np.random.default_rng(4)
    q, k, v = (rng.normal(size=(6, 8)) for _ in range(3))
    frames = [attention.heads(spark.createDataFrame([(i, x[i].tolist()) for i in range(6)], "i long, v array<double>"), 2, 8) for x in (q, k, v)]
    p = attention.softmax(attention.scores(frames[0], frames[1], 4))
    assert all(abs(r.s - 1) < 1e-12 for r in p.groupBy("head", "i").agg(F.sum("p").alias("s")).collect())
    rows = attention.interleaved(attention.context(p, frames[2]), 4).orderBy("pos").collect()
    want = np.zeros((6, 8))
    for h in range(2):
        s = q[:, 4 * h : 4 * h + 4] @ k[:, 4 * h : 4 * h + 4].T / 2
        e = np.exp(s - s.max(1, keepdims=True))
        want[:, 4 * h : 4 * h + 4] = e / e.sum(1, keepdims=True) @ v[:, 4 * h : 4 * h + 4]
    assert np.allclose([r.out for r in rows], want)
    with pytest.raises(ValueError):
        attention.heads(frames[0], 3, 8)


def test_half_cuts_and_never_rounds(spark):
    values = [0.0, -0.0, 1.0, 1.0009, 1 / 3, -1 / 3, 65504.0, 65519.9, 70000.0, 6e-5, 6.2e-5, -6.2e-5, 1e-9, 2.0**-14]
    got = [r.h for r in spark.createDataFrame([(v,) for v in values], "v double").select(numbers.half(F.col("v")).alias("h")).collect()]
    for v, h in zip(values, got, strict=True):
        if abs(v) >= 65536:
            assert h == np.copysign(np.inf, v)
        elif abs(v) < 2.0**-14:
            assert h == 0
        else:
            assert np.float16(h) == h and abs(h) <= abs(v) and float(np.nextafter(np.float16(abs(h)), np.float16(np.inf))) > abs(v)


def test_bytes_pack_and_unpack(spark):
    rows = [([1, -1, 127, -128],), ([5],), ([],)]
    got = spark.createDataFrame(rows, "b array<int>").select(numbers.packed(F.col("b")).alias("w")).select("w", numbers.unpacked(F.col("w")).alias("b")).collect()
    assert [r.b for r in got] == [[1, -1, 127, -128], [5, 0, 0, 0], [0] * 4]
    assert got[0].w == 0x807FFF01


def test_quorum_needs_distinct_clients_and_skips_failures(spark):
    rows = [("a", "x", 1, 1, 1, "ok"), ("a", "x", 1, 2, 2, "ok"), ("a", "y", 2, 3, 3, "ok"), ("a", "x", 3, 4, 4, "ok"), ("a", "x", 4, 5, 5, "ok"), ("b", "x", 1, 1, 6, "error"), ("b", "x", 2, 2, 7, "ok")]
    v = spark.createDataFrame(rows, "chunk string, checksum string, client long, ts long, event_id long, status string")
    d = quorum.decisions(v, 2)
    got = {r.chunk: r for r in d.collect()}
    assert (got["a"].checksum, got["a"].decided_id) == ("x", 4) and got["b"].checksum is None and got["b"].n_failed == 1
    assert [r.event_id for r in quorum.late(v, d).collect()] == [5]
    near = v.withColumn("checksum", F.when(F.col("checksum") == "x", "1.00001").otherwise("1.00002"))
    assert quorum.decisions(near, 2, F.round(F.col("checksum").cast("double"), 3).cast("string")).where("chunk = 'a'").first().decided_id == 3


def test_assignment_goes_to_distinct_fit_clients(spark):
    clients = spark.createDataFrame([(1, ["a"], 2, 0), (2, ["a", "b"], 2, 1), (3, ["b"], 1, 1), (4, ["b"], 4, 0)], "client long, frameworks array<string>, capacity int, in_flight int")
    chunks = spark.createDataFrame([(n, "ab"[n % 2]) for n in range(10)] + [(10, "none")], "chunk long, framework string")
    got = quorum.assigned(chunks, clients, 2).collect()
    assert len(got) == 20 and len({(r.chunk, r.client) for r in got}) == 20
    assert all(r.client in ((1, 2) if r.chunk % 2 == 0 else (2, 4)) for r in got)


def test_rates_guard_equal_times(spark):
    s = spark.createDataFrame([(1, 1, 0, 10.0), (1, 2, 0, 20.0), (1, 3, 2, 2068.0)], "task long, event_id long, s int, value double").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.event_id: r for r in metrics.rates(s).collect()}
    assert got[1].rate_kb is None and got[2].rate_kb is None and got[3].rate_kb == 1.0 and got[3].rel_ms == 2000


def test_primes_and_powers(spark):
    def prime(n):
        return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))

    assert sorted(r.p for r in numtheory.primes(spark, 500).collect()) == [n for n in range(501) if prime(n)]
    assert sorted(r.power for r in numtheory.prime_powers(spark, 500).collect()) == sorted(ecm.exponents(500))
    assert numtheory.primes(spark, 1).count() == 0


def test_gcd_and_valuation(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(1, 2**40), rng.randrange(1, 2**40)) for _ in range(50)] + [(0, 7), (7, 0), (12, 18)]
    df = spark.createDataFrame(pairs, "a long, b long").withColumn("g", numtheory.gcd_column(F.col("a"), F.col("b"))).withColumn("h", numtheory.gcd_batched(F.col("a"), F.col("b")))
    assert all(r.g == r.h == np.gcd(r.a, r.b) for r in df.collect())
    got = spark.createDataFrame([(1,), (8,), (12,), (2**40,)], "n long").select(numtheory.valuation2(F.col("n")).alias("v")).collect()
    assert [r.v for r in got] == [0, 3, 2, 40]


def test_factor_bag_keeps_the_product(spark):
    n = 2**5 * 3**4 * 1009
    got = numtheory.factor_bag(spark.createDataFrame([(str(n), str(f)) for f in (6, 6, 4, 1009, n, 1, 35)] + [(str(n), None)], "n string, f string")).collect()
    assert {int(r.factor): (r.hits, r.multiplicity) for r in got} == {6: (2, 4), 4: (1, 0), 1009: (1, 1)}
    assert prod(int(r.factor) ** r.multiplicity for r in got) * int(got[0].cofactor) == n


def test_curves_find_factors_whatever_the_partitioning(spark):
    n = 65537 * 65539
    a, b = (sorted(map(tuple, ecm.curves(spark, n, 200, 32, chunk).select("curve_index", "sigma", "status", "factor").collect())) for chunk in (4, 32))
    assert a == b and any(r[2] == ecm.FACTOR for r in a)
    assert all(n % int(r[3]) == 0 and 1 < int(r[3]) < n for r in a if r[3])
    s = ecm.summary(ecm.curves(spark, 4 * n, 200, 32, 8), 4 * n)
    assert prod(f["factor"] ** f["multiplicity"] for f in s["factors"]) * s["cofactor"] == 4 * n and s["factors"][0] == {"factor": 2, "multiplicity": 2, "prime": True}
    assert ecm.curves(spark, 16).count() == 0
    for bad in (0, -3, 1 << 256):
        with pytest.raises(ValueError):
            ecm.curves(spark, bad)


def test_resumed_curves_are_the_same(spark):
    n = 2 * 65537 * 65539
    a, b = (sorted(map(tuple, f.collect())) for f in (ecm.curves(spark, n, 200, 24, 8), ecm.resumed(spark, n, 200, 24, 8, window=7)))
    assert a == b and ecm.resumed(spark, 8).count() == 0
    assert ecm.parsed(" 0xFF ") == ecm.parsed("255") == ecm.parsed(255) == 255


def test_summary_json(spark):
    import json

    s = json.loads(ecm.summary_json(ecm.curves(spark, 65537 * 65539, 200, 32, 8), 65537 * 65539))
    assert {f["decimal"] for f in s["factors"]} <= {"65537", "65539"} and s["n"]["hex"] == hex(65537 * 65539)


def test_refined_parts_are_coprime():
    parts = numtheory.refined([13, 1255423, 44606434613, 1701021584197])
    assert parts == [13, 269, 359, 1354939, 35531] or sorted(parts) == parts
    assert all(np.gcd.reduce([a, b]) == 1 for i, a in enumerate(parts) for b in parts[i + 1 :])
    assert numtheory.is_prime(2**61 - 1) and not numtheory.is_prime(65537 * 65539) and not numtheory.is_prime(1)


def test_frames_round_trip():
    buffers = [np.arange(6, dtype=np.float32).reshape(2, 3), np.array([5, 2, 8], np.uint32), np.zeros(0, np.int8)]
    head, got = files.unframed(files.framed(buffers, 2, 1, b"{}"))
    assert head == {"framework": 2, "type": "float32", "inputs": 2, "outputs": 1, "metadata": b"{}"}
    assert all(np.array_equal(a, b) and a.dtype == b.dtype for a, b in zip(buffers, got, strict=True))
    for bad in (b"", b"x" * 40, files.framed(buffers)[:-1]):
        with pytest.raises(ValueError):
            files.unframed(bad)


def test_frames_as_rows(spark):
    raw = files.framed([np.arange(4, dtype=np.float32).reshape(2, 2), np.array([7], np.uint8)])
    got = files.read_frames(spark.createDataFrame([(raw,)], "content binary")).orderBy("buffer").collect()
    assert [(r.type, r.shape, r["values"]) for r in got] == [("float32", [2, 2], [0, 1, 2, 3]), ("uint8", [1], [7])]


def test_binary_files(spark, tmp_path):
    np.array([5, 2**32 - 1, 0, 2**31], "<u4").tofile(tmp_path / "s.bin")
    assert [tuple(r) for r in files.u32_file(spark, str(tmp_path / "s.bin")).orderBy("pos").collect()] == [(0, 5), (1, 2**32 - 1), (2, 0), (3, 2**31)]
    m = np.arange(6, dtype="<f4").reshape(2, 3)
    m.tofile(tmp_path / "m.bin")
    assert all(m[r.i, r.j] == r.v for r in files.matrix_file(spark, str(tmp_path / "m.bin"), 2, 3).collect())
    (tmp_path / "bad.bin").write_bytes(b"abc")
    with pytest.raises(ValueError):
        files.u32_file(spark, str(tmp_path / "bad.bin"))
    with pytest.raises(ValueError):
        files.matrix_file(spark, str(tmp_path / "m.bin"), 3, 3)
    assert files.listing(spark, str(tmp_path)).count() == 3


def test_named_files_and_numbers(spark, tmp_path):
    f = spark.createDataFrame([("/x/1_Q.bin",), ("/x/q.BIN",), ("/x/2_k.bin",), ("/x/3_k.bin",), ("/x/vk.bin",)], "path string")
    assert {r.name: r.path for r in files.named_files(f, ["Q.bin", "K.bin", "V.bin"]).collect()} == {"Q.bin": "/x/q.BIN", "K.bin": "/x/2_k.bin"}
    (tmp_path / "n.txt").write_text("4\n 9 \nx\n\n25\n")
    assert sorted(r.value for r in files.integers_text(spark, str(tmp_path / "n.txt")).collect()) == [4, 9, 25]
    m = np.arange(6, dtype=float).reshape(2, 3)
    rows = files.row_bytes(cells(spark, m, "i", "j"), 3).orderBy("i").collect()
    assert b"".join(bytes(r.raw) for r in rows) == m.astype("<f4").tobytes()


def test_generated(spark):
    assert generate.ones_matrix(spark, 3, 2).count() == 6
    s, states = 1, []
    for _ in range(30):
        s = (s * generate.MULTIPLIER + generate.INCREMENT) % 2**32
        states.append(s)
    assert all(generate.jump(1, k + 1) == states[k] for k in range(30))
    u = generate.random_u32(spark, 100).collect()
    assert all(0 <= r.value < 2**32 for r in u)
    assert {k: len(v.first().v) for k, v in generate.random_qkv(spark, 3, 8).items()} == {"q": 8, "k": 8, "v": 8}


def test_csv_log(spark, tmp_path):
    files.write_csv_log(spark.createDataFrame([(1, "a,b", None)], "x int, y string, z string"), str(tmp_path / "log"))
    lines = {x for part in (tmp_path / "log").glob("part-*") for x in part.read_text().splitlines()}
    assert lines == {"x,y,z", "1,a;b,"}


def test_blocked_attention_equals_the_plain_one(spark):
    rng = np.random.default_rng(7)
    q, k, v = (attention.heads(spark.createDataFrame([(i, (3 * rng.normal(size=8)).tolist()) for i in range(23)], "i long, v array<double>"), 2, 8) for _ in range(3))
    plain = {(r.head, r.i, r.d): r.o for r in attention.context(attention.softmax(attention.scores(q, k, 4)), v).collect()}
    for block in (5, 1000):
        got = {(r.head, r.i, r.d): r.o for r in attention.blocked(q, k, v, 4, block).collect()}
        assert got.keys() == plain.keys() and all(abs(got[x] - plain[x]) < 1e-12 for x in plain)


def test_scores_deal_few_copies_and_meet_each_pair_once(spark, monkeypatch):
    """Both sides are cut alike: rows dealt grow with the root of the number of groups, not with it."""
    met, n = attention.met, 50_000

    class Counted:
        def __init__(self, head, ids):
            self.head, self.asked, self.given = head, len(ids), 0

        def give(self, ids, rows):
            self.given += len(ids)
            yield from ()

        def end(self):
            yield pa.record_batch([pa.array([self.head]), pa.array([self.asked]), pa.array([self.given]), pa.array([0.0])], ["head", "i", "j", "s"])

    monkeypatch.setattr(attention, "met", lambda asked, given, make, *more: met(asked, given, lambda head, ids, rows: Counted(head, ids), *more))
    x = spark.range(n).select(F.lit(0).cast("long").alias("head"), F.col("id").alias("i"), F.array(F.sin("id"), F.cos("id")).alias("v"))
    groups = attention.scores(x, x, 2).collect()
    assert sum(g.i * g.j for g in groups) == n**2 and len(groups) >= 4 * spark.sparkContext.defaultParallelism
    assert sum(g.i + g.j for g in groups) <= 9 * n


def test_rows_of_pairs_leave_python_as_lists(spark, sf, tmp_path):
    """A row a query and strip crosses from Python, not one a pair, and no column of the files has room for nulls."""
    for name in ("attn_softmax", "attn_scores"):
        got = catalogue.queries()[name](spark, sf)
        assert "Generate posexplode" in got._jdf.queryExecution().optimizedPlan().toString()
        got.write.parquet(f"{tmp_path}/{name}")
        schema = pq.ParquetFile(next((tmp_path / name).glob("*.parquet"))).schema
        assert [schema.column(c).max_definition_level for c in range(4)] == [0] * 4


@pytest.mark.parametrize("batch", ["10000", "90"])
def test_scores_are_filed_by_a_dictionary(spark, sf, tmp_path, batch):
    """However keys are batched, no page of a file holds scores plainly, and each strip's keys come in turn."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        catalogue.queries()["attn_scores"](spark, sf).write.parquet(str(tmp_path / "scores"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    files = [pq.ParquetFile(p).metadata for p in (tmp_path / "scores").glob("*.parquet")]
    held = [m.row_group(g).column(3) for m in files for g in range(m.num_row_groups)]
    assert held and all(c.path_in_schema == "score" and "PLAIN" not in c.encodings for c in held)
    n = tables.vectors(spark, sf).count()
    got = spark.read.parquet(str(tmp_path / "scores"))
    assert got.count() == got.select("head", "i", "j").distinct().count() == 4 * n**2


def test_weights_deal_few_copies_as_they_are_stored(spark, monkeypatch):
    """Many queries and few keys of 32 bits: rows dealt, their kind, and the weights against the plain ones in several groups."""
    met, seen = attention.met, []

    def kept(asked, given, make, schema, *more):
        if "j long" in schema:
            seen.append((dict(asked.dtypes)["x"], dict(given.dtypes)["x"]))
            rows = met(asked, given, make, schema, *more)
            return rows.withColumn("task", F.spark_partition_id())
        return met(asked, given, make, schema, *more)

    monkeypatch.setattr(attention, "met", kept)
    wide = lambda n, c: spark.range(n).select(F.lit(0).cast("long").alias("head"), F.col("id").alias("i"), F.array(F.sin(F.col("id") * c), F.cos("id")).cast("array<float>").alias("v"))
    q, k = wide(9000, 0.7), wide(300, 3.1)
    tasks = attention.weights(q, k, 2).groupBy("task").agg(F.countDistinct("i").alias("i"), F.countDistinct("j").alias("j"), F.count("*").alias("n")).collect()
    assert sum(t.n for t in tasks) == sum(t.i * t.j for t in tasks) == 9000 * 300 and seen == [("array<float>", "array<float>")]
    assert sum(t.i + t.j for t in tasks) <= 16 * 300 + 9000
    q, k = wide(90, 0.7), wide(31, 3.1)
    want = {(r.i, r.j): r.p for r in attention.softmax(attention.scores(q, k, 2)).collect()}
    for block in (9, 1000):
        got = {(r.i, r.j): r.p for r in attention.weights(q, k, 2, block).collect()}
        assert got.keys() == want.keys() and len(want) == 90 * 31 and all(abs(got[c] - want[c]) < 1e-12 for c in want)


def test_weights_find_their_sums_once(spark):
    """Nothing of the sums is computed while the plan is built: it reads queries and keys only."""
    rows = spark.createDataFrame([(0, i, [float(i), 1.0]) for i in range(20)], "head long, i long, v array<double>")
    failing = lambda batches: iter([1 // 0])
    real, attention.attended = attention.attended, lambda q, k, v, d: q.mapInArrow(failing, "head long, i long, top double, total double")
    try:
        assert attention.weights(rows, rows, 2).columns == ["head", "i", "j", "p"]
    finally:
        attention.attended = real


def test_written_scores_hold_few_bytes_of_keys(spark, tmp_path):
    """More keys than a strip, in groups of all keys of a head; a file's column of keys takes less than two bits a row."""
    q, k = (np.random.default_rng(34).normal(size=(n, 2)) for n in (200, 5000))
    frames = [spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i long, v array<double>").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))).alias("head"), "i", "v") for x in (q, k)]
    attention.scores(*frames, 2).write.parquet(f"{tmp_path}/s")
    files = [pq.ParquetFile(f).metadata for f in (tmp_path / "s").glob("*.parquet")]
    chunks = [m.row_group(g).column(2) for m in files for g in range(m.num_row_groups)]
    assert {c.path_in_schema for c in chunks} == {"j"} and sum(c.total_compressed_size for c in chunks) * 4 < 16 * 200 * 5000
    t = pq.read_table(tmp_path / "s")
    head, i, j, score = (t.column(c).to_numpy() for c in ("head", "i", "j", "score"))
    got = np.full((16, 200, 5000), np.nan)
    got[head, i, j] = score
    assert len(score) == got.size and np.allclose(got, q @ k.T / 2**0.5, rtol=0, atol=1e-12)


def test_window_prunes(spark, sf):
    from tessera.plans import catalogue

    plan = catalogue.window_submatrix(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index(">= 8") and plan.index("Join") < plan.index(">= 16")
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in catalogue.window_submatrix(spark, sf)._jdf.queryExecution().executedPlan().toString()
