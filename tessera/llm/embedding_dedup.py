"""Embedding near-duplicates by cosine: PCA-ordered tiled comparison.

Vectors are turned into the basis of their principal components, largest first. For a tile of pairs the products of the
leading components are added up first; what the remaining ones can add is at most the product of the two suffix norms
(Cauchy and Schwarz), so a pair stops as soon as the sum and that bound stay below the threshold. Pairs that are left add
the next components to their sums, twice as many each time; the cosine of the vectors as given, in double precision,
decides those that end within rounding of the threshold. The basis comes from a bounded sample; any orthonormal basis gives the
same links, a good one only stops pairs sooner.

Equal vectors are one class first, with a count. Classes are dealt to cells, by the nearest of some centres from the sample,
and a cell to blocks of a bounded number of vectors, so that a hot cell is many blocks. A block is held in memory and vectors of other blocks
stream past it, but only those that may link: a vector whose angle to the cell's centre exceeds the cell's radius by more than
the threshold's angle can't. Of two blocks one meets the other's vectors, each block half of the others. A block returns a row a
vector: its number of links there, and one member of what it is linked to; links are never listed. Where no cell can be passed by (vectors
spread evenly over many dimensions) each vector goes to half of the blocks, which is the cost of comparing all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._graph import components
from ._shared import table, written

#: Rows and columns of a tile, leading components of the first step, and pairs that go on to more at a time.
TILE, FIRST, PAIRS = 1024, 16, 1 << 16
#: Sums in another order differ by far less than this; pairs as near to the threshold are decided by the plain formula.
SLACK = 1e-9
#: Centres at most, and components of a block at most.
CENTRES, HELD = 1024, 2_000_000


def usable(v: Column) -> Column:
    """Whether a vector can link: not null or empty, without null or non-finite components, not zero."""
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(v) > 0) & good & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, without overflow where components are very large or small."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def principal(sample: np.ndarray) -> np.ndarray:
    """Orthonormal basis of the sample's rows (scaled to length 1), by falling share of their squares."""
    u = unit(sample)
    return np.linalg.eigh(u.T @ u)[1][:, ::-1]


def centres(units: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """n directions that the sample's rows gather about, by a few rounds of spherical k-means from rows at even steps."""
    c = units[np.linspace(0, len(units) - 1, min(n, len(units))).astype(int)]
    for _ in range(rounds):
        near = (units @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, units)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(length > 1e-6, sums / np.maximum(length, 1e-6), c)
    return c


def dense(lists: pa.Array, d: int) -> np.ndarray:
    """A list column as rows of d doubles, shorter ones padded with zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    out = np.zeros((len(lists), d))
    sizes = np.diff(np.asarray(lists.offsets))
    out[np.arange(d) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def joined(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite the ends of links in a forest whose nodes point to the smallest of their tree."""
    while len(a):
        x, y = up[a], up[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while True:
            top = up[up]
            if np.array_equal(top, up):
                break
            up[:] = top


def steps(d: int) -> list[int]:
    """Ends of the stretches of components that are added one after the other: FIRST, twice that and so on, to d."""
    out = []
    end = FIRST
    while end < d:
        out.append(end)
        end *= 2
    return [*out, d]


class Rows:
    """Vectors as given and in the basis, with the norms of what follows each step."""

    def __init__(self, x: np.ndarray, basis: np.ndarray):
        self.x, self.p = x, unit(x) @ basis
        self.rest = [np.sqrt(np.maximum(0, 1 - (self.p[:, :s] ** 2).sum(1))) + SLACK for s in steps(len(basis))[:-1]]

    def part(self, a: int, b: int) -> Rows:
        out = object.__new__(Rows)
        out.x, out.p, out.rest = self.x[a:b], self.p[a:b], [r[a:b] for r in self.rest]
        return out


def tile_links(x: Rows, y: Rows, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x and y with cosine at least the threshold. What a pair has added up is kept, and each step adds its own components only, PAIRS pairs at a time."""
    ends = steps(x.p.shape[1])
    sums = x.p[:, : ends[0]] @ y.p[:, : ends[0]].T
    bound = sums if len(ends) == 1 else sums + np.multiply.outer(x.rest[0], y.rest[0])
    a, b = np.nonzero(bound >= threshold - SLACK)
    found = [linked_pairs(x, y, a[k : k + PAIRS], b[k : k + PAIRS], sums[a[k : k + PAIRS], b[k : k + PAIRS]], ends, threshold) for k in range(0, len(a), PAIRS)]
    return tuple(np.concatenate(f) for f in zip(*found, strict=True)) if found else (a, b)


def linked_pairs(x: Rows, y: Rows, a: np.ndarray, b: np.ndarray, sums: np.ndarray, ends: list[int], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (a, b), whose sums of the first step are given, those that link."""
    for k, (start, end) in enumerate(zip(ends, ends[1:]), 1):
        sums = sums + np.einsum("ij,ij->i", x.p[a, start:end], y.p[b, start:end])
        left = sums >= threshold - SLACK if k == len(ends) - 1 else sums + x.rest[k][a] * y.rest[k][b] >= threshold - SLACK
        a, b, sums = a[left], b[left], sums[left]
    sure = sums >= threshold + SLACK
    near = np.flatnonzero(~sure)
    u, v = x.x[a[near]], y.x[b[near]]
    sure[near] = (u * v).sum(1) / (np.sqrt((u * u).sum(1)) * np.sqrt((v * v).sum(1))) >= threshold
    return a[sure], b[sure]


class Block:
    """The vectors of a block, what they have been linked with so far, and those that stream past."""

    def __init__(self, uid: np.ndarray, weight: np.ndarray, x: np.ndarray, basis: np.ndarray, threshold: float):
        self.uid, self.weight, self.basis, self.threshold = uid, weight, basis, threshold
        self.rows = Rows(x, basis)
        self.links, self.up = np.zeros(len(uid), np.int64), np.arange(len(uid))
        for i in range(0, len(uid), TILE):
            for j in range(i, len(uid), TILE):
                a, b = tile_links(self.rows.part(i, i + TILE), self.rows.part(j, j + TILE), threshold)
                a, b = a + i, b + j
                if i == j:
                    a, b = a[a < b], b[a < b]
                self.count(a, self.weight[b])
                self.count(b, self.weight[a])
                joined(self.up, a, b)

    def count(self, at: np.ndarray, n: np.ndarray) -> None:
        self.links += np.bincount(at, n, len(self.uid)).astype(np.int64)

    def meet(self, uid: np.ndarray, weight: np.ndarray, x: np.ndarray) -> pa.RecordBatch | None:
        """Vectors of other blocks: (uid, links, root) of those that link here, root being one of the vectors held. All that a vector links with here is of one class."""
        rows = Rows(x, self.basis)
        links, root = np.zeros(len(uid), np.int64), np.full(len(uid), len(self.uid))
        for i in range(0, len(uid), TILE):
            for j in range(0, len(self.uid), TILE):
                a, b = tile_links(rows.part(i, i + TILE), self.rows.part(j, j + TILE), self.threshold)
                if not len(a):
                    continue
                a, b = a + i, b + j
                links += np.bincount(a, self.weight[b], len(uid)).astype(np.int64)
                self.count(b, weight[a])
                first = root.copy()
                np.minimum.at(first, a, b)
                known = root < len(self.uid)
                joined(self.up, first[a], b)
                joined(self.up, first[known], root[known])
                root = first
        got = root < len(self.uid)
        return pa.record_batch([pa.array(uid[got]), pa.array(links[got]), pa.array(self.uid[root[got]])], ["uid", "links", "root"]) if got.any() else None

    def end(self) -> pa.RecordBatch:
        got = self.links > 0
        return pa.record_batch([pa.array(self.uid[got]), pa.array(self.links[got]), pa.array(self.uid[self.up[got]])], ["uid", "links", "root"])


@dataclass(frozen=True)
class Plan:
    """basis; centres in it; once cells are counted, their radii, first blocks and numbers of blocks; the threshold's angle."""

    basis: np.ndarray
    centres: np.ndarray
    reach: float
    radius: np.ndarray | None = None
    first: np.ndarray | None = None
    parts: np.ndarray | None = None

    def angles(self, x: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(unit(x) @ self.basis @ self.centres.T, -1, 1))

    def blocks(self, uid: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, block and side: 0 for a row's own block, 1 for those that it streams past."""
        angle = self.angles(x)
        cell = angle.argmin(1)
        spread = (uid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        own = self.first[cell] + (spread % self.parts[cell].astype(np.uint64)).astype(np.int64)
        n = int(self.parts.sum())
        of = np.repeat(np.arange(len(self.parts)), self.parts)
        may = (angle <= self.radius + self.reach)[:, of]
        ahead = (np.arange(n) - own[:, None]) % n
        may &= (ahead > 0) & ((2 * ahead < n) | ((2 * ahead == n) & (own[:, None] < np.arange(n))))
        row, block = np.nonzero(may)
        every = np.arange(len(uid))
        return np.concatenate([every, row]), np.concatenate([own, block]), np.r_[np.zeros(len(uid), np.int64), np.ones(len(row), np.int64)]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, block_rows: int | None = None, basis_rows: int = 4096) -> DataFrame:
    """vectors: any columns. Returns id, n_links (other rows linked directly), component_id (the smallest id reachable).

    block_rows: vectors of a block about, by default as many as give every core two blocks, but no more than HELD components. Vectors that
    can't link (see usable) stand alone. Shorter vectors count as padded with zeros. Rows with a null id keep it
    and take the smallest id of their class; repeated rows are rows of their own, linked with each other. An empty table
    gives no rows. Classes of equal vectors are found by the vectors and joined back by 128 bits of their hashes."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    spark = vectors.sparkSession
    given = F.col(vector_col) if dict(vectors.dtypes)[vector_col] == "array<float>" else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), given.alias("v"))  # floats move as floats, and are doubles where they are multiplied
    good = rows.where(usable(F.col("v")))
    mark = (F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), F.col("v")).alias("g"))
    classes = good.groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("n")).withColumn("uid", F.monotonically_increasing_id())
    classes = written(classes.select("uid", "n", "least", "v", *mark), "vectors")
    found = classes.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    if not found.n:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    d = found.d
    share = min(1.0, basis_rows / found.n)
    sample = classes.where(F.pmod(F.xxhash64("uid"), F.lit(1 << 20)) < share * (1 << 20)).select("v").limit(2 * basis_rows).toArrow().column("v")
    padded = dense(sample, d) if len(sample) else np.eye(1, d)
    rows_of = block_rows or max(256, min(-(-found.n // (2 * max(7, spark.sparkContext.defaultParallelism))), HELD // d))
    basis = principal(padded)
    plan = Plan(basis, centres(unit(padded) @ basis, min(CENTRES, -(-found.n // rows_of))), float(np.arccos(threshold)) + 1e-6)

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            angle = plan.angles(dense(batch.column("v"), d))
            cell = angle.argmin(1)
            radius, n = np.zeros(len(plan.centres)), np.bincount(cell, minlength=len(plan.centres))
            np.maximum.at(radius, cell, angle[np.arange(len(cell)), cell])
            yield pa.record_batch([pa.array(np.flatnonzero(n)), pa.array(n[n > 0]), pa.array(radius[n > 0])], ["cell", "n", "radius"])

    counted = classes.select("v").mapInArrow(celled, "cell long, n long, radius double").groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect()  # a row a cell
    size, radius = np.zeros(len(plan.centres), np.int64), np.zeros(len(plan.centres))
    for r in counted:
        size[r.cell], radius[r.cell] = r.n, r.radius
    parts = -(-size // rows_of)
    plan = Plan(plan.basis, plan.centres, plan.reach, radius, np.r_[0, np.cumsum(parts)[:-1]], parts)
    shared = spark.sparkContext.broadcast(plan)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            row, block, side = shared.value.blocks(np.asarray(batch.column("uid")), dense(batch.column("v"), d))
            for k in range(0, len(row), 8192):
                own = batch.take(pa.array(row[k : k + 8192]))
                yield pa.record_batch([pa.array(block[k : k + 8192]), pa.array(side[k : k + 8192]), *own.columns], ["block", "side", "uid", "n", "v"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis, key, held, now = shared.value.basis, None, [], None
        make = lambda held: Block(*(np.concatenate(x) for x in zip(*held)), basis, threshold)
        for batch in batches:
            if not batch.num_rows:
                continue
            block, side = np.asarray(batch.column("block")), np.asarray(batch.column("side"))
            cuts = np.flatnonzero((block[1:] != block[:-1]) | (side[1:] != side[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)]):
                if block[a] != key:
                    if held or now:
                        yield (now or make(held)).end()
                    key, held, now = block[a], [], None
                part = batch.slice(a, b - a)
                own = np.asarray(part.column("uid")), np.asarray(part.column("n")), dense(part.column("v"), d)
                if side[a] == 0:
                    held.append(own)
                    continue
                if now is None:
                    now, held = make(held), []
                if (out := now.meet(*own)) is not None:
                    yield out
        if held or now:
            yield (now or make(held)).end()

    kind = dict(classes.dtypes)["v"]
    met = classes.select("uid", "n", "v").mapInArrow(dealt, f"block long, side long, uid long, n long, v {kind}")
    met = met.repartitionById(int(parts.sum()), F.col("block").cast("int")).sortWithinPartitions("block", "side")
    links = written(met.mapInArrow(linked, "uid long, links long, root long"), "vector-links")
    sums = links.groupBy("uid").agg(F.sum("links").alias("links"))
    joins = components(links.select(F.col("uid").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("uid"), "component")
    of = classes.select("uid", "h", "g", "least", "n").join(sums, "uid", "left").join(joins, "uid", "left")
    of = of.select("h", "g", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "uid").alias("component"))
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    of = of.join(least, "component").select("h", "g", "n_links", "component_id")
    alone = rows.where(~usable(F.col("v"))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return good.select("id", *mark).join(of, ["h", "g"]).select("id", "n_links", "component_id").unionByName(alone)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept."""
    found = near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


OP4_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS MATERIALIZED (SELECT r, e, sqrt(list_dot_product(e, e)) AS size FROM (SELECT r, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0)),
links AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.r <> b.r WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.9),
reach(a, b) AS (SELECT r, r FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a),
c AS (SELECT reach.a AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c USING (r) LEFT JOIN n ON n.a = v.r
"""
