"""Names the engine's queries: each takes (spark, sf_dir). Those that SQL can express have their SQL for DuckDB beside them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import attention, ecm, matmul, metrics, numtheory, quorum, sorting
from ..sources import files, generate, tables
from ..sources.tables import LINE_KEY, table
from ..storage import work_dir
from ..streaming import quorum as streams
from . import tiling

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL if there is some."""

    def add(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def rounded(df: DataFrame, col: str = "v", digits: int = 6) -> DataFrame:
    """Sums of doubles to a fixed number of digits (adding 0 turns -0 into 0), so that their order doesn't show."""
    return df.withColumn(col, F.round(col, digits) + F.lit(0.0))


# --- products -----------------------------------------------------------------------------------------------------

EMB = "SELECT vec_id AS k, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings"
GRAM = f"WITH e AS ({EMB}) SELECT a.d AS i, b.d AS j, round(sum(a.v * b.v), 6) + 0.0 AS v FROM e a JOIN e b USING (k) GROUP BY 1, 2"


def gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matmul.product(*tables.transposed_pair(tables.cells(spark, sf_dir)))


def tiled_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matmul.tiled_product(*tables.transposed_pair(tables.cells(spark, sf_dir)), 32, 32, 256)


@query(GRAM)
def matmul_gram(spark, sf_dir):
    """The embeddings' transpose by the embeddings: 64 x 64, contracting all vectors."""
    return rounded(matmul.gram(tables.vectors(spark, sf_dir)))


@query(f"WITH e AS ({EMB}) SELECT e.d AS i, label::BIGINT AS j, round(sum(e.v), 6) + 0.0 AS v FROM e JOIN embeddings ON k = vec_id GROUP BY 1, 2")
def matmul_ab_rect(spark, sf_dir):
    """The transpose by the sparse matrix of labels: 64 x number of labels."""
    a, _ = tables.transposed_pair(tables.cells(spark, sf_dir))
    b = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("k"), F.col("label").cast("long").alias("j"), F.lit(1.0).alias("v"))
    return rounded(matmul.product(a, b))


def line_cells(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 32).alias("i"), (F.col("l_suppkey") % 16).alias("k")).agg(F.sum(F.col("l_quantity").cast("long")).alias("v"))


def order_cells(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 16).alias("k"), (F.col("o_orderkey") % 24).alias("j")).agg(F.count("*").alias("v"))


LINE_CELLS = "SELECT l_partkey % 32 AS i, l_suppkey % 16 AS k, sum(l_quantity::BIGINT)::BIGINT AS v FROM lineitem GROUP BY 1, 2"
ORDER_CELLS = "SELECT o_custkey % 16 AS k, o_orderkey % 24 AS j, count(*) AS v FROM orders GROUP BY 1, 2"


@query(f"SELECT i, j, sum(a.v * b.v)::BIGINT AS v FROM ({LINE_CELLS}) a JOIN ({ORDER_CELLS}) b USING (k) GROUP BY 1, 2")
def matmul_sparse_coo(spark, sf_dir):
    """Sparse integer cells from lineitem by those from orders."""
    return matmul.product(line_cells(spark, sf_dir), order_cells(spark, sf_dir), "long")


@query(GRAM)
def matmul_tiled(spark, sf_dir):
    """The same product by tiles of 32 x 256 and 256 x 32."""
    return rounded(tiled_gram(spark, sf_dir))


@query("""WITH g AS (SELECT ib, jb, kb, least(24, 100 - kb * 24)::BIGINT AS k_span FROM range(5) a(ib), range(4) b(jb), range(5) c(kb)),
s AS (SELECT *, sum(k_span) OVER (PARTITION BY ib, jb ORDER BY kb ROWS UNBOUNDED PRECEDING)::BIGINT AS k_done FROM g)
SELECT *, k_done >= 100 AS complete FROM s""")
def matmul_ktile_progress(spark, sf_dir):
    """How far each output tile has come after each depth tile, for a 70 x 100 by 100 x 60 product."""
    return matmul.depth_progress(70, 60, 100, 16, 16, 24, spark)


BYTES = f"SELECT k, d, greatest(-128, least(127, round(v * 127)::INTEGER)) AS q FROM ({EMB})"
BYTE_GRAM = f"WITH b AS ({BYTES}) SELECT x.d AS i, y.d AS j, sum(x.q * y.q)::BIGINT AS v FROM b x JOIN b y USING (k) GROUP BY 1, 2"


def bytes_of(spark, sf_dir) -> DataFrame:
    return tables.cells(spark, sf_dir).withColumn("v", numbers.signed_byte(F.col("v")))


@query(BYTE_GRAM)
def matmul_int8(spark, sf_dir):
    """The product of signed bytes, summed in integers."""
    return matmul.gram(tables.vectors(spark, sf_dir).withColumn("v", F.transform("v", lambda x: numbers.signed_byte(x))), "v", "long")


@query(f"SELECT d AS i, k // 4 AS word, sum((q & 255)::BIGINT << (8 * (k % 4))::INTEGER)::BIGINT AS packed FROM ({BYTES}) GROUP BY 1, 2")
def int8_packed_words(spark, sf_dir):
    """Four signed bytes of a dimension in a word, the first vector lowest."""
    at = numbers.byte_in_word(F.col("v"), F.col("k") % 4)
    return bytes_of(spark, sf_dir).groupBy(F.col("d").alias("i"), F.floor(F.col("k") / 4).alias("word")).agg(F.sum(at).alias("packed"))


@query(BYTE_GRAM)
def int8_packed_dot(spark, sf_dir):
    """The same product from packed words: each pair of words is unpacked where it is multiplied."""
    w = int8_packed_words(spark, sf_dir).groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("i", "packed"))).alias("of"), F.max("i").alias("last"))
    row = F.transform(F.sequence(F.lit(0).cast("long"), "last"), lambda i: numbers.unpacked(F.coalesce(F.try_element_at("of", i), F.lit(0).cast("long"))))
    lane = lambda k: F.transform("row", lambda b: b[k])
    lanes = w.select(row.alias("row")).select(F.explode(F.array(*map(lane, range(4)))).alias("v"))
    return matmul.gram(lanes, "v", "long")


HALF = f"""SELECT k, d, CASE WHEN abs(v) < pow(2.0, -14) THEN 0.0 ELSE sign(v) * floor(abs(v) / pow(2.0, e - 10)) * pow(2.0, e - 10) END + 0.0 AS h
FROM (SELECT *, CASE WHEN v = 0 THEN 0 ELSE floor(log2(abs(v))) END AS e FROM ({EMB}))"""


@query(f"WITH b AS ({HALF}) SELECT x.d AS i, y.d AS j, round(sum(x.h * y.h), 6) + 0.0 AS v FROM b x JOIN b y USING (k) GROUP BY 1, 2")
def matmul_f16(spark, sf_dir):
    """The product of values cut to half precision."""
    return rounded(matmul.gram(tables.vectors(spark, sf_dir).withColumn("v", F.transform("v", numbers.half))))


@query(f"SELECT count(*) AS cells, 0.0::DOUBLE AS max_abs, 0::BIGINT AS beyond FROM ({GRAM})")
def matmul_verify(spark, sf_dir):
    """Tiles against cells, cell by cell."""
    both = matmul.compared(tiled_gram(spark, sf_dir), gram(spark, sf_dir))
    return both.select("cells", F.round("max_abs", 6).alias("max_abs"), "beyond")


@query(f"SELECT * FROM ({GRAM}) WHERE i BETWEEN 8 AND 23 AND j BETWEEN 16 AND 39")
def window_submatrix(spark, sf_dir):
    """A rectangle of the product (the operator's own feature): its bounds go below the join and the sum."""
    return rounded(tables.window(gram(spark, sf_dir), 8, 16, 16, 24))


PLANS = [(10240, 10240, 10240, 8388608), (6000, 2000, 6000, 83886), (64, 64, 64, 3072), (10, 7, 5, 100), (1, 1, 1, 3), (300, 20, 4000, 50000)]


@query(f"""WITH p AS (SELECT * FROM (VALUES {", ".join(map(str, PLANS))}) t(n, m, k, budget)),
a AS (SELECT *, greatest(1, budget // 3) AS o FROM p), b AS (SELECT *, least(m, greatest(1, floor(sqrt(o))::BIGINT)) AS c0 FROM a),
c AS (SELECT *, CASE WHEN c0 >= 32 THEN c0 - c0 % 32 ELSE least(m, 1) END AS cols FROM b), d AS (SELECT *, least(n, greatest(1, o // cols)) AS r0 FROM c),
e AS (SELECT *, CASE WHEN r0 >= 32 THEN r0 - r0 % 32 ELSE least(n, 1) END AS rows FROM d), f AS (SELECT *, greatest(1, budget - o) // greatest(1, rows + cols) AS d0 FROM e),
g AS (SELECT *, least(k, greatest(1, d0 - d0 % 32)) AS depth FROM f)
SELECT n::BIGINT AS n, m::BIGINT AS m, k::BIGINT AS k, budget::BIGINT AS budget, rows::BIGINT AS rows, cols::BIGINT AS cols, depth::BIGINT AS depth,
  (((n + rows - 1) // rows) * ((m + cols - 1) // cols) * ((k + depth - 1) // depth))::BIGINT AS chunks FROM g""")
def tile_plan(spark, sf_dir):
    """Tile sizes of several products from their element budgets."""
    p = spark.createDataFrame(PLANS, "n long, m long, k long, budget long")
    return p.withColumns(tiling.tile_columns(F.col("n"), F.col("m"), F.col("k"), F.col("budget")))


# --- sorting ------------------------------------------------------------------------------------------------------

KEY = ", ".join(LINE_KEY)
U32 = "(l_orderkey * 2654435761) % 4294967296"
SEQ = f"SELECT row_number() OVER (ORDER BY {KEY}) - 1 AS pos, {U32} AS value FROM lineitem"


def sequence(spark, sf_dir) -> DataFrame:
    """The unsorted sequence, in lineitem's own order."""
    return sorting.positioned(tables.u32_lines(spark, sf_dir), *LINE_KEY).select("pos", "value")


@query(f"SELECT row_number() OVER (ORDER BY {U32}, {KEY}) - 1 AS pos, {U32} AS value FROM lineitem")
def sort_u32_asc(spark, sf_dir):
    """Global ascending sort with positions."""
    return sorting.sorted_u32(tables.u32_lines(spark, sf_dir), "value", True)


@query(f"SELECT row_number() OVER (ORDER BY {U32} DESC, {KEY}) - 1 AS pos, {U32} AS value FROM lineitem")
def sort_u32_desc(spark, sf_dir):
    """Global descending sort with positions."""
    return sorting.sorted_u32(tables.u32_lines(spark, sf_dir), "value", False)


@query(f"SELECT row_number() OVER (ORDER BY value) - 1 AS pos, value FROM ({SEQ}) WHERE pos < 1000")
def sort_max_elements(spark, sf_dir):
    """The first 1000 elements of the sequence, sorted."""
    return sorting.sorted_u32(sorting.first_elements(sequence(spark, sf_dir), 1000))


RUN = 4096


@query(f"""SELECT pos // {RUN} AS chunk, count(*) AS n, min(value) AS lo, list_sort(list(value))[(count(*) - 1) // 2 + 1] AS mid, max(value) AS hi, true AS in_order FROM ({SEQ}) GROUP BY 1""")
def sort_chunk_runs(spark, sf_dir):
    """Chunks of 4096, each sorted by itself."""
    return sorting.chunk_runs(sequence(spark, sf_dir), RUN)


@query(f"""SELECT chunk, n, p AS padded, p - n AS pad, 4294967295 AS sentinel FROM (SELECT pos // 3000 AS chunk, count(*) AS n, pow(2, ceil(log2(count(*))))::BIGINT AS p FROM ({SEQ}) GROUP BY 1)""")
def sort_padded_chunks(spark, sf_dir):
    """What padding chunks of 3000 to powers of two takes."""
    return sorting.padded_chunks(sequence(spark, sf_dir), 3000)


@query(f"SELECT count(*) AS pairs, count(*) FILTER (WHERE b > value) AS violations FROM (SELECT value, lag(value) OVER (ORDER BY pos) AS b FROM ({SEQ})) WHERE b IS NOT NULL")
def sort_order_violations(spark, sf_dir):
    """Neighbours out of order in the unsorted sequence."""
    return sorting.order_violations(sequence(spark, sf_dir))


@query("SELECT 0::BIGINT AS only_a, 0::BIGINT AS only_b")
def sort_permutation_check(spark, sf_dir):
    """Whether the sorted sequence holds what the unsorted one does."""
    lines = tables.u32_lines(spark, sf_dir)
    return sorting.same_multiset(sorting.sorted_u32(lines).select("value"), lines.select("value"))


@query(f"SELECT row_number() OVER (ORDER BY value) - 1 AS pos, value FROM ({SEQ})")
def kway_merge_union(spark, sf_dir):
    """Four runs, dealt from the sequence, merged into one."""
    s = sequence(spark, sf_dir)
    return sorting.merged([s.where(F.col("pos") % 4 == k).select("value") for k in range(4)])


# --- attention ----------------------------------------------------------------------------------------------------

HEADS, WIDTH = 4, 64
DK = WIDTH // HEADS
PART = f"SELECT k AS i, d // {DK} AS head, d % {DK} AS d, v FROM ({EMB})"
SCORES = f"SELECT q.head, q.i, k.i AS j, sum(q.v * k.v) / 4.0 AS score FROM ({PART}) q JOIN ({PART}) k USING (head, d) GROUP BY 1, 2, 3"
SOFTMAX = f"SELECT head, i, j, e / greatest(sum(e) OVER (PARTITION BY head, i), 1e-20) AS p FROM (SELECT *, exp(score - max(score) OVER (PARTITION BY head, i)) AS e FROM ({SCORES}))"
CONTEXT = f"SELECT p.head, p.i, v.d, sum(p.p * v.v) AS o FROM ({SOFTMAX}) p JOIN ({PART}) v ON p.head = v.head AND p.j = v.i GROUP BY 1, 2, 3"


def of_heads(spark, sf_dir) -> DataFrame:
    """All embeddings as one sequence, attending to itself."""
    return attention.heads(tables.vectors(spark, sf_dir), HEADS, WIDTH)


def attended(spark, sf_dir) -> DataFrame:
    x = of_heads(spark, sf_dir)
    return attention.attended(x, x, x, DK)


def cells_of(rows: DataFrame) -> DataFrame:
    return rows.select("head", "i", F.posexplode("out").alias("d", "o")).withColumn("d", F.col("d").cast("long"))


@query(f"SELECT head, i, j, round(score, 6) + 0.0 AS score FROM ({SCORES})")
def attn_scores(spark, sf_dir):
    """Scaled products of queries and keys, by head."""
    x = of_heads(spark, sf_dir)
    return attention.scores(x, x, DK, attention.FILED, digits=6)


@query(f"SELECT head, i, j, round(p, 6) + 0.0 AS p FROM ({SOFTMAX})")
def attn_softmax(spark, sf_dir):
    """Their softmax by row."""
    x = of_heads(spark, sf_dir)
    return attention.weights(x, x, DK, digits=6)


@query(f"SELECT head, i, d, round(o, 6) + 0.0 AS o FROM ({CONTEXT})")
def attn_context(spark, sf_dir):
    """Values weighted by it, by blocks."""
    return rounded(cells_of(attended(spark, sf_dir)), "o")


@query(f"SELECT i AS pos, head * {DK} + d AS c, round(o, 6) + 0.0 AS o FROM ({CONTEXT})")
def attn_multihead(spark, sf_dir):
    """Heads side by side, as cells."""
    rows = attention.side_by_side(attended(spark, sf_dir))
    return rounded(rows.select("pos", F.posexplode("out").alias("c", "o")).withColumn("c", F.col("c").cast("long")), "o")


@query(f"SELECT head, count(*) AS n, round(avg(o), 6) + 0.0 AS mean, round(var_pop(o), 6) + 0.0 AS variance FROM ({CONTEXT}) GROUP BY 1")
def attn_head_stats(spark, sf_dir):
    """Mean and variance of each head's output."""
    return rounded(rounded(attention.head_stats(cells_of(attended(spark, sf_dir))), "mean"), "variance")


@query("SELECT unnest([4, 5])::BIGINT AS head")
def attn_missing_heads(spark, sf_dir):
    """The heads that the output lacks, of the six that a task expects."""
    return attention.missing_heads(attended(spark, sf_dir), HEADS + 2)


# --- replicas and bookkeeping -------------------------------------------------------------------------------------

K = 2
VOTES = "SELECT user_id::VARCHAR || ':' || strftime(ts, '%Y-%m-%d') AS chunk, event_type AS checksum, event_id % 7 AS client, ts, event_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status FROM events"
DECIDED = f"""SELECT chunk, n_votes, n_failed, checksum, decided_ts, decided_id FROM
(SELECT chunk, count(*) AS n_votes, count(*) FILTER (WHERE status <> 'ok') AS n_failed FROM ({VOTES}) GROUP BY 1) LEFT JOIN
(SELECT chunk, checksum, ts AS decided_ts, event_id AS decided_id FROM (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY ts, event_id, checksum) AS w FROM
 (SELECT *, row_number() OVER (PARTITION BY chunk, checksum ORDER BY ts, event_id) AS n FROM
  (SELECT *, row_number() OVER (PARTITION BY chunk, checksum, client ORDER BY ts, event_id) AS c FROM ({VOTES}) WHERE status = 'ok') WHERE c = 1) WHERE n = {K}) WHERE w = 1) USING (chunk)"""


def decided(spark, sf_dir) -> DataFrame:
    return quorum.decisions(tables.votes(spark, sf_dir), K)


@query(f"SELECT * FROM ({DECIDED}) WHERE checksum IS NOT NULL")
def quorum_accept(spark, sf_dir):
    """Chunks that two clients agree on."""
    return quorum.accepted(decided(spark, sf_dir))


@query(f"SELECT chunk, n_votes, n_failed FROM ({DECIDED}) WHERE checksum IS NULL")
def quorum_undecided(spark, sf_dir):
    """Chunks without agreement."""
    return quorum.undecided(decided(spark, sf_dir))


@query(f"SELECT v.chunk, v.event_id, v.client, v.checksum FROM ({VOTES}) v JOIN ({DECIDED}) d USING (chunk) WHERE d.checksum IS NOT NULL AND (v.ts > d.decided_ts OR v.ts = d.decided_ts AND v.event_id > d.decided_id)")
def late_results(spark, sf_dir):
    """Results for chunks that were decided before."""
    return quorum.late(tables.votes(spark, sf_dir), decided(spark, sf_dir))


@query(f"SELECT chunk, event_id FROM ({VOTES}) WHERE chunk NOT IN (SELECT chunk FROM ({VOTES}) WHERE checksum = 'view')")
def orphan_results(spark, sf_dir):
    """Results for chunks that no task has (here a chunk is registered by its views)."""
    v = tables.votes(spark, sf_dir)
    return quorum.orphans(v, v.where("checksum = 'view'").select("chunk").distinct())


@query(f"SELECT split_part(chunk, ':', 1)::BIGINT AS task, count(*) AS chunks, count(checksum) AS completed, count(*) = count(checksum) AS all_done FROM ({DECIDED}) GROUP BY 1")
def chunk_progress(spark, sf_dir):
    """Completed chunks by task."""
    return quorum.progress(decided(spark, sf_dir), F.split_part(F.col("chunk"), F.lit(":"), F.lit(1)).cast("long"))


@query(f"SELECT chunk, count(*) AS replicas, ((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000)::BIGINT AS duration_ms, arg_min(client, (ts, event_id)) AS first_client FROM ({VOTES}) GROUP BY 1")
def chunk_timing_summary(spark, sf_dir):
    """Replicas and duration by chunk."""
    return metrics.chunk_timing(tables.votes(spark, sf_dir))


@query(f"SELECT count(*) AS chunks, sum(replicas)::BIGINT AS replicas, sum(duration_ms)::BIGINT AS total_ms, max(duration_ms) AS max_ms FROM (SELECT chunk, count(*) AS replicas, ((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000)::BIGINT AS duration_ms FROM ({VOTES}) GROUP BY 1) WHERE duration_ms > 0")
def chunk_throughput(spark, sf_dir):
    """Totals over the timings."""
    return metrics.throughput(metrics.chunk_timing(tables.votes(spark, sf_dir)))


NOW = "2024-01-31 00:00:00"


@query(f"SELECT chunk, idle_s FROM (SELECT chunk, ((epoch_us(TIMESTAMP '{NOW}') - epoch_us(max(ts))) // 1000000)::BIGINT AS idle_s FROM ({VOTES}) WHERE chunk IN (SELECT chunk FROM ({DECIDED}) WHERE checksum IS NULL) GROUP BY 1) WHERE idle_s > 86400")
def stuck_chunks(spark, sf_dir):
    """Undecided chunks that have been idle for more than a day."""
    return quorum.stuck(tables.votes(spark, sf_dir), decided(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"), 86400)


@query(f"SELECT chunk FROM ({DECIDED}) WHERE checksum IS NULL AND chunk IN (SELECT chunk FROM ({VOTES}) WHERE client = 3)")
def disconnect_affected(spark, sf_dir):
    """Open chunks that client 3 has to do with."""
    return quorum.affected(tables.votes(spark, sf_dir), decided(spark, sf_dir), 3)


CLIENTS = [(c, ["webgpu", "cuda", "cpu"][: 1 + c % 3], 2 + c % 4, c % 3) for c in range(12)]
CLIENT_ROWS = ", ".join(f"({c}, {f}, {cap}, {n})" for c, f, cap, n in CLIENTS)


def clients(spark) -> DataFrame:
    return spark.createDataFrame(CLIENTS, "client long, frameworks array<string>, capacity int, in_flight int")


@query(f"""WITH c AS (SELECT * FROM (VALUES {CLIENT_ROWS}) t(client, frameworks, capacity, in_flight) WHERE in_flight < capacity),
h AS (SELECT o_orderkey AS chunk, (['webgpu', 'cuda', 'cpu'])[o_orderkey % 3 + 1] AS framework FROM orders),
f AS (SELECT chunk, client, row_number() OVER (PARTITION BY chunk ORDER BY in_flight / capacity, client) - 1 AS p, count(*) OVER (PARTITION BY chunk) AS n FROM h JOIN c ON list_contains(frameworks, framework))
SELECT chunk, r::BIGINT AS replica, client::BIGINT AS client FROM f, range(2) t(r) WHERE p = (chunk + r) % n""")
def replica_assignment(spark, sf_dir):
    """Each chunk to two clients that can run it."""
    kinds = F.array(F.lit("webgpu"), F.lit("cuda"), F.lit("cpu"))
    chunks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk"), F.element_at(kinds, (F.col("o_orderkey") % 3 + 1).cast("int")).alias("framework"))
    return quorum.assigned(chunks, clients(spark), 2)


@query(f"SELECT client::BIGINT AS client, in_flight, capacity, in_flight / capacity AS load, row_number() OVER (ORDER BY in_flight / capacity, client) AS rank FROM (VALUES {CLIENT_ROWS}) t(client, frameworks, capacity, in_flight)")
def client_load_rank(spark, sf_dir):
    """Clients by load."""
    return quorum.load_rank(clients(spark))


@query("SELECT chunk, bit_xor(hash32) AS xor32 FROM (SELECT l_orderkey % 64 AS chunk, (l_orderkey * 2654435761 + l_partkey) % 4294967296 AS hash32 FROM lineitem) GROUP BY 1")
def xor_checksum(spark, sf_dir):
    """Exclusive or of the words of each chunk."""
    words = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 64).alias("chunk"), F.pmod(F.col("l_orderkey") * 2654435761 + F.col("l_partkey"), F.lit(tables.U32)).alias("w"))
    return words.groupBy("chunk").agg(F.bit_xor("w").alias("xor32"))


@query("SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text)) AS bytes FROM documents")
def sha_checksum(spark, sf_dir):
    """Digest and size of each payload."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))


@query("SELECT doc_id, md5(base64(encode(text))) AS encoded_md5, true AS same FROM documents")
def base64_round_trip(spark, sf_dir):
    """Payloads to base64 and back."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("raw"))
    d = d.select("doc_id", "raw", F.replace(F.base64("raw"), F.lit("\r\n"), F.lit("")).alias("encoded"))
    return d.select("doc_id", F.md5(F.col("encoded").cast("binary")).alias("encoded_md5"), (F.unbase64("encoded") == F.col("raw")).alias("same"))


@query("""SELECT "group", path, mtime, size, preferred FROM (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY preferred DESC, mtime DESC, size DESC, path) AS n FROM
(SELECT o_custkey % 50 AS "group", o_orderstatus || '_' || o_orderkey || CASE WHEN o_orderkey % 11 = 0 THEN '_sort_input.bin' ELSE '.bin' END AS path, o_orderdate AS mtime, o_totalprice AS size, o_orderkey % 11 = 0 AS preferred FROM orders)) WHERE n = 1""")
def newest_file_topk(spark, sf_dir):
    """The file to take of each group of candidates."""
    name = F.concat(F.col("o_orderstatus"), F.lit("_"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 11 == 0, "_sort_input.bin").otherwise(".bin"))
    found = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("group"), name.alias("path"), F.col("o_orderdate").alias("mtime"), F.col("o_totalprice").alias("size"))
    return files.best_file(found, "sort_input.bin")


@query("SELECT path, gap FROM (SELECT 'part_' || p_partkey AS path, abs(p_size * 1000 - 25000)::BIGINT AS gap FROM part) ORDER BY gap, path LIMIT 1")
def closest_size_file(spark, sf_dir):
    """The file whose size is nearest to what an input should have."""
    f = table(spark, sf_dir, "part").select(F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("path"), (F.col("p_size") * 1000).cast("long").alias("size"))
    return files.closest_file(f, 25000)


@query(f"SELECT chunk, event_id, client, row_number() OVER (PARTITION BY chunk ORDER BY ts, event_id) - 1 AS replica FROM ({VOTES})")
def replica_numbers(spark, sf_dir):
    """Each result's number within its chunk."""
    own = Window.partitionBy("chunk").orderBy("ts", "event_id")
    return tables.votes(spark, sf_dir).select("chunk", "event_id", "client", (F.row_number().over(own) - 1).cast("long").alias("replica"))


@query("SELECT source, count(*) AS payloads, sum(octet_length(encode(text)))::BIGINT AS bytes, max(octet_length(encode(text))) AS largest FROM documents GROUP BY 1")
def payload_sizes(spark, sf_dir):
    """Sizes of payloads by where they come from."""
    size = F.octet_length("text").cast("long")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("payloads"), F.sum(size).alias("bytes"), F.max(size).alias("largest"))


@query("SELECT s_suppkey AS task, sum(cpu)::DOUBLE AS cpu, sum(memory)::BIGINT AS memory, count(*) AS processes FROM (SELECT l_suppkey AS s_suppkey, l_quantity AS cpu, l_partkey AS memory FROM lineitem) GROUP BY 1")
def process_usage(spark, sf_dir):
    """Usage summed over the processes of each task."""
    p = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("task"), F.col("l_quantity").alias("cpu"), F.col("l_partkey").alias("memory"))
    return p.groupBy("task").agg(F.sum("cpu").alias("cpu"), F.sum("memory").alias("memory"), F.count("*").alias("processes"))


@query("SELECT DISTINCT n, f FROM (SELECT l_orderkey + 1 AS n, l_partkey + 1 AS f FROM lineitem) WHERE f > 1 AND f < n AND n % f = 0")
def factor_candidates(spark, sf_dir):
    """Pairs of keys of which the second is a proper factor of the first."""
    p = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + 1).alias("n"), (F.col("l_partkey") + 1).alias("f"))
    return p.where((F.col("f") > 1) & (F.col("f") < F.col("n")) & (F.col("n") % F.col("f") == 0)).distinct()


@query("SELECT l_orderkey * 2654435761 AS n, lower(to_hex(l_orderkey * 2654435761)) AS hex, true AS same FROM (SELECT DISTINCT l_orderkey FROM lineitem)")
def hex_round_trip(spark, sf_dir):
    """Integers as hexadecimal text and back."""
    n = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 2654435761).alias("n")).distinct().withColumn("hex", F.lower(F.hex("n")))
    return n.select("n", "hex", (F.conv("hex", 16, 10).cast("long") == F.col("n")).alias("same"))


# --- metrics ------------------------------------------------------------------------------------------------------


@query("""SELECT user_id AS task, event_id, row_number() OVER w - 1 AS sample_idx, ((epoch_us(ts) - epoch_us(first(ts) OVER w)) // 1000)::BIGINT AS rel_ms,
round(CASE WHEN ts > lag(ts) OVER w THEN (value - lag(value) OVER w) / 1024 / ((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6) END, 9) + 0.0 AS rate_kb, max(value) OVER w AS peak
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def metrics_rate(spark, sf_dir):
    """Changes per second within each series."""
    return rounded(metrics.rates(tables.samples(spark, sf_dir)), "rate_kb", 9)


@query("""SELECT user_id AS task, count(*) AS samples, ((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000)::BIGINT AS duration_ms, round(avg(value), 6) + 0.0 AS mean, max(value) AS peak, round(sum(value), 6) + 0.0 AS total,
arg_min(value, (ts, event_id)) AS first, arg_max(value, (ts, event_id)) AS last FROM events GROUP BY 1""")
def metrics_resource_summary(spark, sf_dir):
    """Each series summed up."""
    return rounded(rounded(metrics.summary(tables.samples(spark, sf_dir)), "mean"), "total")


@query(f"""SELECT task, sum(rx)::BIGINT AS rx, sum(tx)::BIGINT AS tx, count(*) AS interfaces FROM (SELECT user_id AS task, (['eth0', 'lo', 'docker0', 'wlan0', 'veth12', 'tap1'])[event_id % 6 + 1] AS iface, event_id * 3 AS rx, event_id * 5 AS tx FROM events)
WHERE NOT regexp_matches(iface, '{metrics.BLOCKED_INTERFACES}') GROUP BY 1""")
def network_totals(spark, sf_dir):
    """Traffic over the interfaces that count."""
    names = F.array(*[F.lit(x) for x in ("eth0", "lo", "docker0", "wlan0", "veth12", "tap1")])
    i = table(spark, sf_dir, "events").select(F.col("user_id").alias("task"), F.element_at(names, (F.col("event_id") % 6 + 1).cast("int")).alias("iface"), (F.col("event_id") * 3).alias("rx"), (F.col("event_id") * 5).alias("tx"))
    return metrics.network_totals(i)


TUMBLING = "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 6) + 0.0 AS total, max(value) AS peak FROM events GROUP BY 1, 2"


def plain_time(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


@query(TUMBLING)
def metrics_tumbling(spark, sf_dir):
    """Windows of six hours by kind of event."""
    return plain_time(rounded(metrics.windowed(tables.samples(spark, sf_dir), "6 hours"), "total"), "start")


@query("SELECT time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') - s * INTERVAL 2 HOUR AS start, event_type, count(*) AS n, round(sum(value), 6) + 0.0 AS total, max(value) AS peak FROM events, range(3) t(s) GROUP BY 1, 2")
def metrics_sliding(spark, sf_dir):
    """Windows of six hours, every two."""
    return plain_time(rounded(metrics.windowed(tables.samples(spark, sf_dir), "6 hours", "2 hours"), "total"), "start")


@query("""SELECT task, min(ts) AS start, max(ts) + INTERVAL 1 DAY AS "end", count(*) AS n, round(sum(value), 6) + 0.0 AS total FROM
(SELECT *, sum(new) OVER (PARTITION BY task ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM
 (SELECT user_id AS task, ts, event_id, value, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM events)) GROUP BY task, s""")
def metrics_session(spark, sf_dir):
    """Sessions with gaps of less than a day."""
    return plain_time(rounded(metrics.sessions(tables.samples(spark, sf_dir), "1 day"), "total"), "start", "end")


@query("SELECT event_id::VARCHAR AS event_id, coalesce(replace(props, ',', ';'), '') AS props, coalesce(replace(event_type || ',' || user_id, ',', ';'), '') AS label FROM events")
def csv_log_fields(spark, sf_dir):
    """Fields as a log's lines hold them."""
    e = table(spark, sf_dir, "events").select("event_id", "props", F.concat_ws(",", "event_type", F.col("user_id").cast("string")).alias("label"))
    return files.csv_fields(e)


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, event_type FROM events")
def json_fields(spark, sf_dir):
    """Fields of JSON objects whose keys are known."""
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"), "event_type")


# --- number theory ------------------------------------------------------------------------------------------------

SIEVE = "SELECT n AS p FROM range(2, 10001) t(n) WHERE NOT EXISTS (SELECT 1 FROM range(2, 101) d(f) WHERE f < n AND n % f = 0)"


@query(SIEVE)
def prime_sieve(spark, sf_dir):
    """Primes to 10000."""
    return numtheory.primes(spark, 10_000)


@query(f"SELECT p, max(e)::BIGINT AS e, max(pow(p, e)::BIGINT) AS power FROM ({SIEVE}), range(1, 14) t(e) WHERE pow(p::DOUBLE, e) <= 10000 GROUP BY 1")
def prime_powers(spark, sf_dir):
    """The highest power of each within 10000."""
    return numtheory.prime_powers(spark, 10_000)


@query("SELECT DISTINCT l_orderkey + 1 AS a, l_partkey + 1 AS b, gcd(l_orderkey + 1, l_partkey + 1) AS g FROM lineitem")
def gcd_pairs(spark, sf_dir):
    """Greatest common divisors of pairs of keys."""
    pairs = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + 1).alias("a"), (F.col("l_partkey") + 1).alias("b")).distinct()
    return pairs.withColumn("g", numtheory.gcd_batched(F.col("a"), F.col("b")))


@query("SELECT n, v, n >> v AS odd FROM (SELECT n, CASE WHEN n & 1 = 1 THEN 0 ELSE log2(n & -n)::BIGINT END AS v FROM (SELECT o_orderkey + 1 AS n FROM orders))")
def trial_division(spark, sf_dir):
    """How often 2 divides, and what is left."""
    n = table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("n"))
    return n.select("n", numtheory.valuation2(F.col("n")).alias("v")).withColumn("odd", F.expr("shiftright(n, cast(v as int))"))


@query("SELECT l_orderkey * 2654435761 AS n, (l_orderkey * 2654435761) & 4294967295 AS low, (l_orderkey * 2654435761) >> 32 AS high, true AS same FROM (SELECT DISTINCT l_orderkey FROM lineitem)")
def integer_limbs(spark, sf_dir):
    """Integers as 32-bit limbs and back."""
    n = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct().select((F.col("l_orderkey") * 2654435761).alias("n")).withColumn("l", numbers.limbs(F.col("n")))
    return n.select("n", F.get("l", F.lit(0)).alias("low"), F.get("l", F.lit(1)).alias("high"), (numbers.from_limbs(F.col("l")) == F.col("n")).alias("same"))


@query("SELECT p_partkey AS x, (p_partkey * 1664525 + 1013904223) % 4294967296 AS y FROM part")
def lcg_step(spark, sf_dir):
    """One step of the seeded generator."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("x"), numbers.lcg(F.col("p_partkey")).alias("y"))


@query("SELECT i, j, round(sin((i + 1) * 0.01) + cos((j + 1) * 0.02), 9) + 0.0 AS v FROM range(40) a(i), range(30) b(j)")
def wave_matrix(spark, sf_dir):
    """The closed-form generated matrix."""
    return rounded(generate.wave_matrix(spark, 40, 30), digits=9)


@query("""WITH RECURSIVE g(pos, s) AS (SELECT 0::BIGINT, (1 * 1664525 + 1013904223) % 4294967296 UNION ALL SELECT pos + 1, (s * 1664525 + 1013904223) % 4294967296 FROM g WHERE pos < 20 * 15 - 1)
SELECT pos // 15 AS i, pos % 15 AS j, s / 2147483648.0::DOUBLE - 1 AS v FROM g""")
def lcg_matrix(spark, sf_dir):
    """The seeded generated matrix, its rows made independently."""
    return generate.lcg_matrix(spark, 20, 15)


FACTORED = [65537 * 65539, 13 * 269 * 359 * 35531 * 1354939, 2**5 * 3**4 * 1009 * 10007]
CANDIDATES = [(FACTORED[0], f) for f in (65537, 65537, 65539, FACTORED[0], 1, 7)] + [(FACTORED[1], f) for f in (13, 1255423, 44606434613, 1701021584197, 13, 26)] + [(FACTORED[2], f) for f in (6, 4, 1009, 10007, 10007 * 3, 36)]
CANDIDATE_ROWS = ", ".join(f"({n}::BIGINT, {f}::BIGINT)" for n, f in CANDIDATES)


@query(f"""WITH RECURSIVE c AS (SELECT n, gcd(n, f) AS f, count(*) AS hits FROM (VALUES {CANDIDATE_ROWS}) t(n, f) WHERE f > 1 AND gcd(n, f) > 1 AND gcd(n, f) < n GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY f DESC) AS k FROM c),
d(n, k, rest, m) AS (SELECT DISTINCT n, 1::BIGINT, n, 0::BIGINT FROM o UNION ALL
 SELECT d.n, CASE WHEN d.rest % o.f = 0 THEN d.k ELSE d.k + 1 END, CASE WHEN d.rest % o.f = 0 THEN d.rest // o.f ELSE d.rest END, CASE WHEN d.rest % o.f = 0 THEN d.m + 1 ELSE 0 END FROM d JOIN o ON o.n = d.n AND o.k = d.k)
SELECT o.n::VARCHAR AS n, o.f::VARCHAR AS factor, o.hits, (SELECT max(m) FROM d WHERE d.n = o.n AND d.k = o.k)::BIGINT AS multiplicity, (SELECT min(rest) FROM d WHERE d.n = o.n)::VARCHAR AS cofactor FROM o""")
def factor_bag(spark, sf_dir):
    """Candidates of several numbers as factors with hits and multiplicities."""
    return numtheory.factor_bag(spark.createDataFrame([(str(n), str(f)) for n, f in CANDIDATES], "n string, f string"))


SMALL = [65537 * 65539 // 65539 * 10007, 10007 * 10009, 9973 * 31327, 7919 * 104729]


@query(f"SELECT n::VARCHAR AS n, min(f)::VARCHAR AS least, (n // min(f))::VARCHAR AS other FROM (VALUES {', '.join(f'({n}::BIGINT)' for n in SMALL)}) t(n), range(2, 40000) r(f) WHERE n % f = 0 GROUP BY n")
def ecm_factor_small(spark, sf_dir):
    """Products of two primes, taken apart by elliptic curves."""
    found = None
    for n in SMALL:
        own = ecm.curves(spark, n, b1=300, total=64, chunk=16).where(f"status = {ecm.FACTOR}").select(F.lit(str(n)).alias("n"), F.col("factor").cast("long").alias("f"))
        found = own if found is None else found.unionByName(own)
    f = F.least("f", F.col("n").cast("long") / F.col("f")).cast("long")
    return found.groupBy("n").agg(F.min(f).alias("least")).select("n", F.col("least").cast("string").alias("least"), F.expr("cast(cast(n as bigint) div least as string)").alias("other"))


@query()
def ecm_curves(spark, sf_dir):
    """Curves on (2^61 - 1)(2^31 - 1): what each found."""
    return ecm.curves(spark, (2**61 - 1) * (2**31 - 1), b1=2000, total=64, chunk=8)


@query()
def ecm_resumed(spark, sf_dir):
    """The same curves by windows of prime powers, their states kept between."""
    return ecm.resumed(spark, (2**61 - 1) * (2**31 - 1), b1=2000, total=64, chunk=8, window=100)


@query()
def ecm_status_tally(spark, sf_dir):
    """How many curves ended in which state."""
    return ecm.status_tally(ecm.curves(spark, 65537 * 65539, b1=200, total=64, chunk=16))


# --- streams ------------------------------------------------------------------------------------------------------


def replayed(stream: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """What a stream appends until its source is read, as a table in the shared folder."""
    at = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


#: Batches that events are replayed in, and rows of a file.
BATCHES, FILE_ROWS = 4, 1_000_000


def events_stream(spark: SparkSession, sf_dir: str, tag: str) -> DataFrame:
    """Events as files of a folder, read as a stream. Slices of time are written one after the other, as many files each, and a batch takes a slice: a source
    gives files in the order of their writing, so that later batches hold later events."""
    e = table(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = e.select(at.cast("double").alias("at")).approxQuantile("at", [k / BATCHES for k in range(1, BATCHES)], 0.01)
    files = max(1, round(e.count() / BATCHES / FILE_ROWS))
    path = f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    for a, b in zip([None, *cuts], [*cuts, None]):
        own = e if a is None else e.where(at >= a)
        (own if b is None else own.where(at < b)).repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", files).parquet(path)


@query(f"SELECT chunk, checksum, decided_id AS event_id FROM ({DECIDED}) WHERE checksum IS NOT NULL")
def stream_quorum(spark, sf_dir):
    """The quorum over a stream of results: what it accepts."""
    e = events_stream(spark, sf_dir, "events")
    v = e.select(F.concat_ws(":", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("chunk"), F.col("event_type").alias("checksum"), (F.col("event_id") % 7).alias("client"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"))
    return replayed(streams.stream_quorum(v, K), spark, "quorum").where("kind = 'accepted'").select("chunk", "checksum", "event_id")


@query(TUMBLING + " HAVING time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)")
def stream_metrics(spark, sf_dir):
    """Windows of six hours over a stream: those that the watermark, an hour behind the latest event, has passed."""
    e = events_stream(spark, sf_dir, "samples").select("ts", "event_type", "value")
    return plain_time(rounded(replayed(streams.stream_windows(e, "6 hours", "1 hour"), spark, "windows"), "total"), "start")


from . import interface  # noqa: E402, F401  (registers its queries here)
