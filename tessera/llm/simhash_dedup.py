"""SimHash near-duplicates: fingerprints of word shingles, BK-trees over shards of them, classes of linked fingerprints.

Shards. Cut a fingerprint of 64 bits into radius + 2 blocks: two fingerprints within the radius agree on two blocks at
least, so each meets every partner in the shard of some pair of blocks. A shard's tree goes to the tasks that ask it by
shuffle, not by the driver's broadcast, since trees of all shards hold the fingerprints of all documents. A shard of more than
`shard_rows` fingerprints is cut into parts, and each pair of parts makes a tree of its own, so that no task holds more
than two parts. Exact copies are one fingerprint before any of this.

Trees. Children hang on their integer distance to the parent; a search follows the edges within the radius of its own
distance. Only classes are wanted, so each node also remembers whether all below it is of one class, and a search passes
by what is of its own class already: a group of thousands of near copies costs a path each, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._graph import components
from ._shared import table, text_udf, written

BITS = 64


def simhash(text: str | None, width: int = 4) -> int:
    """Unsigned 64-bit fingerprint of the shingles of `width` words, repeats included: ASCII letters lower-cased, words cut at ASCII white space, a bit set if over half the shingles' XXH64 (seed 42) set it. Fewer words make one shingle; none give 0."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    line = memoryview(b" ".join(words))
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(line, 42)
    hashes = np.array([digest(line[a : b - 1], 42) for a, b in zip(starts, ends[width - 1 :])], np.uint64)
    votes = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 32768):
        part = hashes[k : k + 32768]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint16)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint_udf(width: int = 4):
    """A UDF: text to its fingerprint as a signed long."""
    return text_udf(lambda: lambda texts: pa.array(np.array([simhash(t, width) for t in texts], np.uint64).view(np.int64)), "long")


class Tree:
    """A BK-tree of fingerprints with classes (a forest of parents) and, for each node, a member of the class of all below it, or -1."""

    def __init__(self, radius: int):
        self.radius, self.codes, self.children, self.up, self.whole = radius, [], [], [], []

    def top(self, k: int) -> int:
        up = self.up
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    def add(self, code: int) -> None:
        """Link the code with the classes within the radius, then insert it. A code that is there already is its own node: distance 0 is an edge like any other."""
        me = len(self.codes)
        self.up.append(me)
        codes, children, whole, up, radius, top = self.codes, self.children, self.whole, self.up, self.radius, self.top
        own = me
        todo = [0] if codes else []
        while todo:
            k = todo.pop()
            if whole[k] >= 0 and top(whole[k]) == own:
                continue
            d = (codes[k] ^ code).bit_count()
            if d <= radius and (other := top(k)) != own:
                low, high = min(own, other), max(own, other)
                up[high] = low
                own = low
            near = children[k]
            if len(near) <= 2 * radius + 1:
                todo += [c for e, c in near.items() if abs(e - d) <= radius]
            else:
                todo += [near[e] for e in range(d - radius, d + radius + 1) if e in near]
        codes.append(code)
        children.append({})
        whole.append(me)
        k, path = 0, []
        while k != me:
            path.append(k)
            k = children[k].setdefault((codes[k] ^ code).bit_count(), me)
        for k in path:
            if whole[k] >= 0 and top(whole[k]) != own:
                whole[k] = -1


def shard_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard; a tree for each shard, whose links are stars: each fingerprint with the first of its class."""

    def stars(codes: np.ndarray) -> tuple[list[int], list[int]]:
        tree = Tree(radius)
        values = codes.tolist()
        for c in codes.view(np.uint64).tolist():
            tree.add(c)
        tops = [tree.top(k) for k in range(len(values))]
        pairs = [(values[k], values[t]) for k, t in enumerate(tops) if t != k]
        return [a for a, _ in pairs], [b for _, b in pairs]

    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush(keys: np.ndarray, codes: np.ndarray) -> pa.RecordBatch | None:
        cuts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(keys)]
        a, b = [], []
        for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
            x, y = stars(codes[s:e])
            a += x
            b += y
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]) if a else None

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(c) for c in batch.columns]
        held.append((np.stack(cols[:3], 1), cols[3].astype(np.int64)))
        keys, codes = np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])
        last = np.flatnonzero(np.any(keys != keys[-1], axis=1))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut and (out := flush(keys[:cut], codes[:cut])):
            yield out
        held = [(keys[cut:], codes[cut:])]
    if held and (out := flush(*held[0])):
        yield out


def shards(codes: DataFrame, radius: int, shard_rows: int) -> DataFrame:
    """codes: distinct fingerprints (fp). Returns shard, part, other, fp: fp's place in the trees that it has partners in."""
    n = radius + 2
    edges = [BITS * k // n for k in range(n + 1)]
    block = lambda k: F.shiftrightunsigned("fp", edges[k]).bitwiseAND((1 << (edges[k + 1] - edges[k])) - 1)
    keys = [F.lit(t).cast("long") * (1 << 32) + block(i) * (1 << (edges[j + 1] - edges[j])) + block(j) for t, (i, j) in enumerate(combinations(range(n), 2))]
    placed = codes.select(F.explode(F.array(*keys)).alias("shard"), "fp")
    sizes = placed.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / shard_rows)).cast("int")
    dealt = placed.join(sizes, "shard").select("shard", "fp", parts.alias("g")).select("shard", "fp", "g", F.pmod(F.xxhash64("fp"), F.col("g")).cast("int").alias("p"))
    return dealt.select("shard", "fp", "p", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("q")).select("shard", F.least("p", "q").alias("part"), F.greatest("p", "q").alias("other"), "fp")


def linked(codes: DataFrame, radius: int = 4, shard_rows: int = 20_000) -> DataFrame:
    """codes: distinct fingerprints (fp). Returns a, b: links enough to join what is within the radius, directly or by others."""
    if not 0 <= radius <= 20:
        raise ValueError("radius must be from 0 to 20")
    trees = shards(codes, radius, shard_rows).repartition("shard", "part", "other").sortWithinPartitions("shard", "part", "other", "fp")
    return trees.mapInArrow(lambda batches: shard_links(batches, radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, width: int = 4, shard_rows: int = 20_000) -> DataFrame:
    """docs: any columns. Returns id, fp (signed long), component_id (the smallest id of the class).

    Null texts and texts without a word have fingerprint 0 and link like any other. Rows with a null id keep it and take
    the smallest id of their class (null if none has one). Repeated rows stay repeated. An empty table gives no rows."""
    rows = docs.select(F.col(id_col).alias("id"), fingerprint_udf(width)(F.col(text_col)).alias("fp"))
    rows = written(rows, "fingerprints")
    codes = written(rows.groupBy("fp").agg(F.min("id").alias("least")), "codes")
    classes = components(linked(codes.select("fp"), radius, shard_rows)).withColumnRenamed("node", "fp")
    codes = codes.join(classes, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = codes.groupBy("component").agg(F.min("least").alias("component_id"))
    of = codes.select("fp", "component").join(least, "component").select("fp", "component_id")
    return rows.join(of, "fp").select("id", "fp", "component_id")


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), hexed(F.col("fp")).alias("fingerprint"), "component_id")
