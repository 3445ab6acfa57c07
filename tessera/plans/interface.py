"""Queries over what the engine writes and reads itself (files, logs, frames), over assignments, and over reduced precision. Registered with the catalogue."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import ecm, matmul, metrics, numtheory, quorum, sorting
from ..sources import files, generate, tables
from ..sources.tables import table
from ..storage import work_dir
from .catalogue import CLIENTS, EMB, KEY, LINE_CELLS, SEQ, SIEVE, U32, VOTES, clients, line_cells, order_cells, query, rounded, sequence


def fresh(spark: SparkSession, name: str) -> str:
    """A path of the shared folder that nothing has used."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- sequences and files ------------------------------------------------------------------------------------------


@query(f"SELECT pos, value FROM ({SEQ}) WHERE pos BETWEEN 5000 AND 6999")
def sort_slice(spark, sf_dir):
    """2000 elements from position 5000 on, as many as there are."""
    return sorting.slice_of(sequence(spark, sf_dir), 5000, 2000)


PADDED = f"SELECT chunk, n, list_sort(run || list_transform(range(pow(2, ceil(log2(n)))::BIGINT - n), lambda x: 4294967295)) AS run FROM (SELECT pos // 3000 AS chunk, count(*) AS n, list(value) AS run FROM ({SEQ}) GROUP BY 1)"


@query(f"SELECT chunk, k - 1 AS place, run[k] AS value FROM (SELECT *, unnest(range(1, len(run) + 1)) AS k FROM ({PADDED}))")
def sort_padded_runs(spark, sf_dir):
    """Chunks of 3000 with sentinels up to a power of two, sorted."""
    return sorting.padded_runs(sequence(spark, sf_dir), 3000).select("chunk", F.posexplode("run").alias("place", "value")).withColumn("place", F.col("place").cast("long"))


@query(f"SELECT chunk, k - 1 AS place, run[k] AS value FROM (SELECT chunk, run, unnest(range(1, len(run) + 1)) AS k FROM (SELECT chunk, list_sort(run)[:n] AS run FROM ({PADDED})))")
def sort_trimmed_runs(spark, sf_dir):
    """The same without their sentinels."""
    runs = sorting.trimmed_runs(sorting.padded_runs(sequence(spark, sf_dir), 3000))
    return runs.select("chunk", F.posexplode("run").alias("place", "value")).withColumn("place", F.col("place").cast("long"))


@query(f"SELECT row_number() OVER (ORDER BY {U32}, {KEY}) - 1 AS pos, {U32} AS value FROM lineitem")
def sorted_file(spark, sf_dir):
    """The sorted sequence as a headerless file of unsigned 32-bit integers, read back."""
    path = fresh(spark, "sorted") + ".bin"
    files.write_file(files.u32_slices(sorting.sorted_u32(tables.u32_lines(spark, sf_dir)), 1 << 16), path, "slice")
    return files.u32_file(spark, path)


@query("SELECT i, j, (sin((i + 1) * 0.01) + cos((j + 1) * 0.02))::FLOAT AS v FROM range(70) a(i), range(45) b(j)")
def matrix_round_trip(spark, sf_dir):
    """A generated matrix as a headerless file of 32-bit floats, read back."""
    path = fresh(spark, "matrix") + ".bin"
    files.write_file(files.row_bytes(generate.wave_matrix(spark, 70, 45), 45), path, "i")
    return files.matrix_file(spark, path, 70, 45)


@query("SELECT 'part_' || p_partkey % 8 || '.bin' AS name, 4 * count(*) AS size FROM part GROUP BY 1")
def file_listing(spark, sf_dir):
    """Files of keys, one a group of parts, written and listed with their sizes."""
    path = fresh(spark, "listed")
    keys = table(spark, sf_dir, "part").select((F.col("p_partkey") % 8).alias("group"), F.col("p_partkey").alias("value"))
    for g in range(8):  # of a fixed number of groups
        own = sorting.positioned(keys.where(F.col("group") == g).select("value"), "value")
        files.write_file(files.u32_slices(own), f"{path}/part_{g}.bin", "slice")
    return files.listing(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "size")


SIZED = "SELECT c_custkey % 40 AS g, c_custkey AS k, CASE WHEN c_custkey % 17 = 0 THEN 'up_A.bin' WHEN c_custkey % 13 = 0 THEN 'b.BIN' ELSE 'f' || c_custkey || '.dat' END AS name, (c_custkey * 7919) % 9000 AS size FROM customer"
PAIR = f"""WITH f AS (SELECT g, 'd' || k || '/' || name AS path, name, size FROM ({SIZED})),
a AS (SELECT g, min(path) FILTER (WHERE name = 'up_A.bin') AS a, min(path) FILTER (WHERE name = 'b.BIN') AS b, arg_min(path, (abs(size - 4000), path)) AS na, arg_min(path, (abs(size - 1000), path)) AS nb, count(*) AS n FROM f GROUP BY 1),
l AS (SELECT g, path, row_number() OVER (PARTITION BY g ORDER BY size DESC, path) AS r FROM f),
p AS (SELECT g, coalesce(a, na) AS a, coalesce(b, nb) AS b FROM a WHERE n > 1)
SELECT p.g AS "group", CASE WHEN p.a <> p.b THEN p.a ELSE x.path END AS a, CASE WHEN p.a <> p.b THEN p.b ELSE y.path END AS b FROM p JOIN l x ON x.g = p.g AND x.r = 1 JOIN l y ON y.g = p.g AND y.r = 2"""


@query(PAIR)
def picked_inputs(spark, sf_dir):
    """The two inputs of a product among each group of files: by name, by size, else the largest."""
    k = F.col("c_custkey")
    name = F.when(k % 17 == 0, "up_A.bin").when(k % 13 == 0, "b.BIN").otherwise(F.concat(F.lit("f"), k.cast("string"), F.lit(".dat")))
    f = table(spark, sf_dir, "customer").select((k % 40).alias("group"), F.concat(F.lit("d"), k.cast("string"), F.lit("/"), name).alias("path"), ((k * 7919) % 9000).alias("size"))
    return files.picked_pair(f, F.lit(4000), F.lit(1000))


@query(f"SELECT max(pow(p, e)::BIGINT) AS power FROM ({SIEVE}), range(1, 14) t(e) WHERE pow(p::DOUBLE, e) <= 10000 GROUP BY p")
def prime_power_file(spark, sf_dir):
    """Prime powers as a text file, a number a line among comments, read back."""
    path = fresh(spark, "powers")
    lines = numtheory.prime_powers(spark, 10_000).select(F.col("power").cast("string").alias("value"))
    lines.unionByName(spark.sql("select '# prime powers' as value union all select ''")).write.text(path)
    return files.integers_text(spark, path).withColumnRenamed("value", "power")


@query("SELECT p_partkey % 32 AS frame, 0 AS buffer, 'uint32' AS type, count(*) AS n, sum(p_partkey)::DOUBLE AS total FROM part GROUP BY 1 UNION ALL SELECT p_partkey % 32, 1, 'float32', count(*), sum(p_size)::DOUBLE FROM part GROUP BY 1")
def framed_buffers(spark, sf_dir):
    """Keys and sizes of parts as frames of two buffers, read back."""
    own = table(spark, sf_dir, "part").select((F.col("p_partkey") % 32).alias("frame"), F.col("p_partkey").cast("long").alias("key"), F.col("p_size").cast("double").alias("size"))

    def pack(t: pa.Table) -> pa.Table:
        raw = files.framed([np.asarray(t.column("key")).astype(np.uint32), np.asarray(t.column("size")).astype(np.float32)], metadata=str(t.column("frame")[0]).encode())
        return pa.table({"content": pa.array([raw], pa.binary())})

    def number(raw: bytes) -> int:
        return int(files.unframed(raw)[0]["metadata"])

    def read(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                for k, b in enumerate(files.unframed(content)[1]):
                    yield pa.record_batch([pa.array([number(content)]), pa.array([k], pa.int32()), pa.array([b.dtype.name]), pa.array([b.size]), pa.array([float(b.sum(dtype=float))])], ["frame", "buffer", "type", "n", "total"])

    return own.groupBy("frame").applyInArrow(pack, "content binary").mapInArrow(read, "frame long, buffer int, type string, n long, total double")


# --- logs ---------------------------------------------------------------------------------------------------------

TIMED = f"SELECT chunk, client, event_id, epoch_us(ts) // 1000 AS ms, epoch_us(min(ts) OVER (PARTITION BY chunk)) // 1000 AS first, row_number() OVER (PARTITION BY chunk ORDER BY ts, event_id) - 1 AS replica FROM ({VOTES})"


def written_log(spark: SparkSession, df: DataFrame, columns: tuple[str, ...], name: str) -> DataFrame:
    path = fresh(spark, name)
    files.write_csv_log(files.log_of(df, columns), path)
    return files.read_csv_log(spark, path, columns)


@query(f"""SELECT chunk AS "chunkId", replica::VARCHAR AS replica, first::VARCHAR AS t_chunk_create, first::VARCHAR AS t_sent, ms::VARCHAR AS t_client_recv, ms::VARCHAR AS t_client_done, ms::VARCHAR AS t_server_recv, ms::VARCHAR AS t_assembled, (ms - first)::VARCHAR AS duration_ms, '' AS cpu_time_ms, '' AS gpu_time_ms FROM ({TIMED})""")
def chunk_timing_log(spark, sf_dir):
    """The log of chunk timings, written and read back."""
    from pyspark.sql import Window

    of = Window.partitionBy("chunk")
    v = tables.votes(spark, sf_dir).withColumn("ms", F.floor(metrics.micros(F.col("ts")) / 1000))
    rows = v.select(F.col("chunk").alias("chunkId"), (F.row_number().over(of.orderBy("ts", "event_id")) - 1).alias("replica"), F.min("ms").over(of).alias("first"), "ms")
    same = {c: F.col("ms") for c in ("t_client_recv", "t_client_done", "t_server_recv", "t_assembled")} | {c: F.col("first") for c in ("t_chunk_create", "t_sent")}
    return written_log(spark, rows.withColumns(same | {"duration_ms": F.col("ms") - F.col("first")}), files.CHUNK_LOG, "chunk_timing")


SPAN = "SELECT user_id, epoch_us(min(ts)) // 1000 AS a, epoch_us(max(ts)) // 1000 AS b, count(*) AS n, avg(value) AS mean, max(value) AS peak FROM events GROUP BY 1"


@query(f"""SELECT user_id::VARCHAR AS "taskId", a::VARCHAR AS start, b::VARCHAR AS "end", (b - a)::VARCHAR AS duration_ms, CASE WHEN n > 1 THEN 'completed' ELSE 'error; alone' END AS status FROM ({SPAN})""")
def task_log(spark, sf_dir):
    """The log of tasks (here users), one line each."""
    s = spans(spark, sf_dir).withColumn("status", F.when(F.col("samples") > 1, "completed").otherwise("error, alone"))
    return written_log(spark, s, files.TASK_LOG, "tasks")


def spans(spark, sf_dir) -> DataFrame:
    at = F.floor(metrics.micros(F.col("ts")) / 1000)
    own = tables.samples(spark, sf_dir).groupBy(F.col("task").alias("taskId")).agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("samples"), F.avg("value").alias("mean"), F.max("value").alias("peak"))
    return own.withColumn("duration_ms", F.col("end") - F.col("start"))


@query(f"""SELECT user_id::VARCHAR AS "taskId", a::VARCHAR AS start, b::VARCHAR AS "end", (b - a)::VARCHAR AS duration_ms, 'completed' AS status, n::VARCHAR AS samples, '' AS proc_cpu_avg, round(peak)::BIGINT::VARCHAR AS proc_cpu_peak, {", ".join(f"'' AS {c}" for c in files.RESOURCE_LOG[8:])} FROM ({SPAN})""")
def resource_log(spark, sf_dir):
    """The log of resource summaries; what isn't sampled is empty."""
    s = spans(spark, sf_dir).withColumns({"status": F.lit("completed"), "proc_cpu_peak": F.round("peak").cast("long")})
    return written_log(spark, s, files.RESOURCE_LOG, "resources")


@query(f"""SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp_iso, ((epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) // 1000)::VARCHAR AS rel_ms, user_id::VARCHAR AS task_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::VARCHAR AS sample_idx, {", ".join(f"'' AS {c}" for c in files.SERIES_LOG[4:])} FROM events""")
def series_log(spark, sf_dir):
    """The log of samples: time, number, task; readings that events lack are empty."""
    s = metrics.rates(tables.samples(spark, sf_dir)).join(tables.samples(spark, sf_dir).select("task", "event_id", "ts"), ["task", "event_id"])
    s = s.select(F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp_iso"), "rel_ms", F.col("task").alias("task_id"), "sample_idx")
    return written_log(spark, s, files.SERIES_LOG, "series")


@query(f"""SELECT task, sum(replicas)::BIGINT AS results, round(sum(replicas) / (sum(duration_ms) / 1000.0), 9) + 0.0 AS per_second, quantile_cont(duration_ms, 0.5) AS median_ms, round(quantile_cont(duration_ms, 0.95), 6) + 0.0 AS p95_ms FROM
(SELECT split_part(chunk, ':', 1)::BIGINT AS task, chunk, count(*) AS replicas, ((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000)::BIGINT AS duration_ms FROM ({VOTES}) GROUP BY 1, 2) WHERE duration_ms > 0 GROUP BY 1""")
def throughput_rates(spark, sf_dir):
    """Results per second and quantiles of chunk durations, by task."""
    task = F.split_part(F.col("chunk"), F.lit(":"), F.lit(1)).cast("long")
    found = metrics.throughput_rates(metrics.chunk_timing(tables.votes(spark, sf_dir)), task)
    return rounded(rounded(found, "per_second", 9), "p95_ms")


# --- assignment ---------------------------------------------------------------------------------------------------

OPEN = [(20, None, 4, 1), (21, [], 3, 0), (22, None, 1, 1)]
CLIENT_ROWS = ", ".join(f"({c}, {f or 'NULL'}, {cap}, {n})" for c, f, cap, n in CLIENTS + OPEN)


@query(f"""WITH c AS (SELECT * FROM (VALUES {CLIENT_ROWS}) t(client, frameworks, capacity, in_flight) WHERE in_flight < capacity),
h AS (SELECT o_orderkey AS chunk, (['webgpu', 'cuda', 'opencl'])[o_orderkey % 3 + 1] AS framework FROM orders),
e AS (SELECT o_orderkey AS chunk, unnest([o_custkey % 12, 20]) AS client FROM orders WHERE o_orderkey % 4 = 0),
f AS (SELECT chunk, client, row_number() OVER (PARTITION BY chunk ORDER BY in_flight / capacity, client) - 1 AS p, count(*) OVER (PARTITION BY chunk) AS n FROM h JOIN c ON frameworks IS NULL OR list_contains(frameworks, framework) WHERE (chunk, client) NOT IN (SELECT chunk, client FROM e))
SELECT chunk, (r + coalesce(d, 0))::BIGINT AS replica, client::BIGINT AS client FROM f CROSS JOIN range(2) t(r) LEFT JOIN (SELECT chunk, count(*) AS d FROM e GROUP BY 1) USING (chunk) WHERE p = (chunk + r) % n AND r < n""")
def replica_reassignment(spark, sf_dir):
    """Two more clients for each chunk: not those that had it, and clients that name no framework for any."""
    kinds = F.array(F.lit("webgpu"), F.lit("cuda"), F.lit("opencl"))
    orders = table(spark, sf_dir, "orders")
    chunks = orders.select(F.col("o_orderkey").alias("chunk"), F.element_at(kinds, (F.col("o_orderkey") % 3 + 1).cast("int")).alias("framework"))
    had = orders.where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("chunk"), F.explode(F.array(F.col("o_custkey") % 12, F.lit(20).cast("long"))).alias("client"))
    everyone = clients(spark).unionByName(spark.createDataFrame(OPEN, "client long, frameworks array<string>, capacity int, in_flight int"))
    return quorum.assigned(chunks, everyone, 2, had)


@query(f"""WITH RECURSIVE c AS (SELECT client, capacity, in_flight FROM (VALUES {CLIENT_ROWS}) t(client, frameworks, capacity, in_flight) WHERE in_flight < capacity),
slots AS (SELECT client, (in_flight + r) / capacity AS load FROM c, range(10) t(r) WHERE in_flight + r < capacity),
s AS (SELECT client, row_number() OVER (ORDER BY load, client) - 1 AS place FROM slots),
o AS (SELECT o_orderkey AS chunk, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders)
SELECT chunk, 0::BIGINT AS replica, client::BIGINT AS client FROM s JOIN o USING (place)""")
def replica_schedule(spark, sf_dir):
    """Chunks in order to the least loaded clients, one each and of any framework, until no place is left."""
    everyone = clients(spark).unionByName(spark.createDataFrame(OPEN, "client long, frameworks array<string>, capacity int, in_flight int"))
    chunks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk"), F.lit("cpu").alias("framework"))
    return quorum.scheduled(chunks, everyone.withColumn("frameworks", F.lit(None).cast("array<string>")), 1)


# --- tasks --------------------------------------------------------------------------------------------------------


@query("SELECT unnest(['matmul', 'sort-u32', 'attention', 'ecm-stage1']) AS id")
def strategy_list(spark, sf_dir):
    """What tasks can be submitted."""
    from . import tasks

    return tasks.strategies(spark).select("id")


@query(f"SELECT i, j, sum(a.v * b.v)::BIGINT AS v FROM ({LINE_CELLS}) a JOIN (SELECT o_custkey % 16 AS k, o_orderkey % 24 AS j, count(*) AS v FROM orders GROUP BY 1, 2) b USING (k) GROUP BY 1, 2")
def task_output(spark, sf_dir):
    """A product submitted as a task, started, waited for and read."""
    from .tasks import Tasks

    own = Tasks(spark)
    task = own.submit("matmul", {"a": line_cells(spark, sf_dir), "b": order_cells(spark, sf_dir)}, {"N": 32, "M": 24, "K": 16, "datatype": "i64"})
    own.start(task).result()
    return own.output(task)


@query("SELECT * FROM (VALUES ('one', 'sort-u32', 'completed', true, true), ('two', 'ecm-stage1', 'error', true, true), ('three', 'ecm-stage1', 'canceled', false, false)) t(label, strategy, status, started, ended)")
def task_listing(spark, sf_dir):
    """Tasks in three of their states, as they are listed."""
    from .tasks import Tasks

    own = Tasks(spark)
    one = own.submit("sort-u32", {"sequence": tables.u32_lines(spark, sf_dir).select("value")}, {}, "one")
    two = own.submit("ecm-stage1", {}, {"N": 0}, "two")
    own.cancel(own.submit("ecm-stage1", {}, {"N": 15}, "three"))
    for t in (one, two):
        own.start(t).result()
    return own.listing().select("label", "strategy", "status", F.col("started").isNotNull().alias("started"), F.col("ended").isNotNull().alias("ended"))


SPLIT = [2**3 * 3 * 10007 * 10009, 65537 * 7919 * 5, 2**10 * 9973 * 31327]


@query(f"SELECT n::VARCHAR AS n, p::VARCHAR AS factor, max(e)::BIGINT AS multiplicity FROM (VALUES {', '.join(f'({n}::BIGINT)' for n in SPLIT)}) t(n), (SELECT x AS p FROM range(2, 66000) r(x) WHERE NOT EXISTS (SELECT 1 FROM range(2, 257) d(f) WHERE f < x AND x % f = 0)), range(1, 12) u(e) WHERE n % p = 0 AND n % (CASE WHEN pow(p, e) <= n THEN pow(p, e)::BIGINT ELSE n + 1 END) = 0 GROUP BY n, p")
def ecm_factorings(spark, sf_dir):
    """Numbers as the small primes and the factors that curves find, with multiplicities; the cofactor counts if it is prime."""
    rows = []
    for n in SPLIT:
        left, small = ecm.without(n, (2, 3, 5, 7))
        s = ecm.summary(ecm.curves(spark, left, b1=300, total=64, chunk=16), left)
        rows += [(str(n), str(p), e) for p, e in small.items()] + [(str(n), str(f["factor"]), f["multiplicity"]) for f in s["factors"]]
        if s["cofactor"] > 1:
            rows.append((str(n), str(s["cofactor"]), 1))
    return spark.createDataFrame(rows, "n string, factor string, multiplicity long")


# --- reduced precision and wide integers --------------------------------------------------------------------------


def cut_sql(bits: int) -> str:
    fraction = f"""SELECT k, d, CASE WHEN v = 0 THEN 0.0 ELSE sign(v) * floor(abs(v) / pow(2.0, e - {bits})) * pow(2.0, e - {bits}) END + 0.0 AS h
FROM (SELECT *, CASE WHEN v = 0 THEN 0 ELSE floor(log2(abs(v))) END AS e FROM ({EMB}))"""
    return f"WITH b AS ({fraction}) SELECT x.d AS i, y.d AS j, round(sum(x.h * y.h), 6) + 0.0 AS v FROM b x JOIN b y USING (k) GROUP BY 1, 2"


def cut_gram(spark, sf_dir, bits: int) -> DataFrame:
    return rounded(matmul.gram(tables.vectors(spark, sf_dir).withColumn("v", F.transform("v", lambda x: numbers.fraction_cut(x, bits)))))


@query(cut_sql(7))
def matmul_bf16(spark, sf_dir):
    """The product of values whose fractions are cut to the 7 bits of bfloat16."""
    return cut_gram(spark, sf_dir, 7)


@query(cut_sql(10))
def matmul_tf32(spark, sf_dir):
    """The product of values whose fractions are cut to the 10 bits of tf32."""
    return cut_gram(spark, sf_dir, 10)


def half_sql(x: str) -> str:
    """A value cut to half precision: its fraction to 10 bits, 0 below the least normal number."""
    return f"(CASE WHEN abs({x}) < pow(2.0, -14) THEN 0.0 ELSE sign({x}) * floor(abs({x}) / pow(2.0, floor(log2(abs({x}))) - 10)) * pow(2.0, floor(log2(abs({x}))) - 10) END + 0.0)"


@query(f"SELECT i, j, {half_sql('v')} AS v FROM (SELECT d AS i, label::BIGINT AS j, round(sum({half_sql('v')}), 6) AS v FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings) GROUP BY 1, 2)")
def matmul_f16_output(spark, sf_dir):
    """A product whose inputs and output are of half precision: cut, summed, rounded to six digits, cut again."""
    a, _ = tables.transposed_pair(tables.cells(spark, sf_dir))
    b = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("k"), F.col("label").cast("long").alias("j"), F.lit(1.0).alias("v"))
    found = matmul.product(a.withColumn("v", numbers.half(F.col("v"))), b)
    return found.withColumn("v", numbers.half(F.round("v", 6)) + F.lit(0.0))


ORDER_CELLS = "SELECT o_custkey % 16 AS k, o_orderkey % 24 AS j, count(*) AS v FROM orders GROUP BY 1, 2"


@query(f"SELECT i, j, ((sum(a.v::HUGEINT * 1000003 * b.v) + 2147483648) % 4294967296 - 2147483648)::BIGINT AS v FROM ({LINE_CELLS}) a JOIN ({ORDER_CELLS}) b USING (k) GROUP BY 1, 2")
def matmul_i32(spark, sf_dir):
    """A product of integers in 32-bit arithmetic, whose sums wrap."""
    a = line_cells(spark, sf_dir).withColumn("v", F.col("v") * 1000003)
    return matmul.product(a, order_cells(spark, sf_dir), "long").withColumn("v", numbers.wrapped32(F.col("v")))


HALVES = "SELECT vec_id, label::BIGINT AS j, d, v, CASE WHEN abs(v) < pow(2.0, -14) THEN 0.0 ELSE sign(v) * floor(abs(v) / pow(2.0, e - 10)) * pow(2.0, e - 10) END AS h FROM (SELECT *, CASE WHEN v = 0 THEN 0 ELSE floor(log2(abs(v))) END AS e FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings))"


@query(f"""WITH c AS (SELECT d AS i, j, sum(h) AS x, sum(v) AS y FROM ({HALVES}) GROUP BY 1, 2), e AS (SELECT *, abs(x - y) AS error FROM c)
SELECT count(*) AS cells, round(max(error), 9) + 0.0 AS max_abs, round(max(CASE WHEN abs(y) > 0 THEN error / abs(y) ELSE error END), 6) + 0.0 AS max_rel, arg_max(i, error) AS worst_i, arg_max(j, error) AS worst_j, count(*) FILTER (WHERE error > 1e-5 + 1e-3 * abs(y)) AS beyond FROM e""")
def matmul_compared(spark, sf_dir):
    """Half precision against full, cell by cell: largest errors, the worst cell, and how many cells are beyond the tolerance."""
    a, _ = tables.transposed_pair(tables.cells(spark, sf_dir))
    b = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("k"), F.col("label").cast("long").alias("j"), F.lit(1.0).alias("v"))
    found = matmul.compared(matmul.product(a.withColumn("v", numbers.half(F.col("v"))), b), matmul.product(a, b))
    found = found.select("cells", "max_abs", "max_rel", F.col("worst.i").alias("worst_i"), F.col("worst.j").alias("worst_j"), "beyond")
    return rounded(rounded(found, "max_abs", 9), "max_rel")


WIDE = "l_orderkey::HUGEINT * 2654435761 * 2654435761 * 97 + l_orderkey"


@query(f"SELECT n::VARCHAR AS n, unnest(range(8)) AS limb, CASE WHEN limb < 4 THEN ((n // pow(2::HUGEINT, 0)::HUGEINT >> (32 * least(limb, 3))::INTEGER) % 4294967296)::BIGINT ELSE 0 END AS value, true AS same FROM (SELECT DISTINCT {WIDE} AS n FROM lineitem)".replace("n // pow(2::HUGEINT, 0)::HUGEINT >>", "n >>"))
def wide_limbs(spark, sf_dir):
    """Integers beyond 64 bits as eight 32-bit limbs and back."""
    d = F.col("l_orderkey").cast("decimal(10,0)")
    square = F.lit(str(2654435761 * 2654435761 * 97)).cast("decimal(24,0)")
    n = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct().select(((d * square).cast("decimal(38,0)") + F.col("l_orderkey").cast("decimal(20,0)")).cast("decimal(38,0)").cast("string").alias("n"))
    n = n.withColumn("l", numbers.wide_limbs(F.col("n"))).withColumn("same", numbers.from_wide_limbs(F.col("l")) == F.col("n"))
    return n.select("n", "same", F.posexplode("l").alias("limb", "value")).select("n", F.col("limb").cast("long").alias("limb"), "value", "same")


@query("SELECT p_partkey AS x, (p_partkey * 1103515245 + 12345) % 2147483648 AS y31, ((p_partkey::HUGEINT * 6364136223846793005 + 1442695040888963407) % 18446744073709551616)::VARCHAR AS y64 FROM part")
def lcg_variants(spark, sf_dir):
    """A step of the generators modulo 2^31 and 2^64."""
    x = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(x.alias("x"), F.pmod(x * 1103515245 + 12345, F.lit(1 << 31)).alias("y31"), numbers.lcg64(x).cast("string").alias("y64"))
