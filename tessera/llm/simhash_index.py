"""Document fingerprints: SimHash with weighted terms, and block tables that find all fingerprints within a Hamming radius.

Terms are words and pairs of neighbouring words (lower-cased, cut at white space). Each distinct term's hash of 128 bits
votes on every bit, for or against, with the weight of its kind times the square root of its count; a bit is set if the votes for
it are above zero. Two texts' share of differing bits estimates the angle between their term vectors, so likeness is its
cosine (0 if the angle is a right one or more).

Search. A fingerprint of 128 bits is cut into radius + 1 blocks; fingerprints within the radius agree on one block at least. For
each block a table holds the fingerprints with the bits permuted so that the block comes first: here the block's number
and bits are the key by which the table is partitioned. Beyond ONE_BLOCK rows there is one block more and a table for each pair of blocks, as two agree then: more tables,
whose keys are nearly twice as long, so that a key's entries, and with them the candidates of a query, don't grow with the corpus as one block's do. Either way the answers are the same. Equal fingerprints are one entry. Entries of one block value that are more than
`bucket_rows` are compared in parts of that size; no candidate is left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from math import cos, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ._shared import bound_batches, table, text_udf, written

BITS = 128
#: Weights of a single word and of a pair of words.
WEIGHTS = (0.5, 1.0)


def fingerprint(text: str | None) -> bytes:
    """16 bytes; texts without a word give zeros."""
    words = text.lower().split() if text else []
    if not words:
        return bytes(BITS // 8)
    terms = [(w, c, WEIGHTS[0]) for w, c in Counter(words).items()]
    terms += [(f"{a} {b}", c, WEIGHTS[1]) for (a, b), c in Counter(zip(words, words[1:])).items()]
    digest = xxhash.xxh3_128_digest
    votes = np.zeros(BITS, np.float64)
    for k in range(0, len(terms), 16384):
        part = terms[k : k + 16384]
        bits = np.unpackbits(np.frombuffer(b"".join([digest(t) for t, _, _ in part]), np.uint8).reshape(-1, BITS // 8), axis=1)
        # whole numbers, so that sums don't depend on the order of terms
        weights = np.array([round(64 * w * sqrt(c)) for _, c, w in part], np.float64)
        votes += 2 * (weights @ bits) - weights.sum()
    return np.packbits(votes > 0).tobytes()


def fingerprint_udf():
    """A UDF: text to its fingerprint. Null counts as empty."""
    return text_udf(lambda: lambda texts: pa.array([fingerprint(t) for t in texts], pa.binary()), "binary")


def likeness(a: bytes, b: bytes) -> float:
    """Cosine of the angle that the differing bits stand for, 0 at the least."""
    differing = (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()
    return max(0.0, cos(pi * differing / BITS)) if 2 * differing < BITS else 0.0


#: Entries up to which tables go by single blocks.
ONE_BLOCK = 1 << 22


def cuts_of(radius: int, agree: int = 1) -> list[int]:
    """Ends of the radius + agree blocks, of which fingerprints within the radius agree on so many."""
    n = radius + agree
    if not 0 < n <= BITS // 2:
        raise ValueError("the radius must be from 0 to 63")
    return [BITS * k // n for k in range(n + 1)]


def as_words(fps: pa.Array) -> np.ndarray:
    """Fingerprints as rows of two unsigned words."""
    return np.frombuffer(b"".join(fps.to_pylist()), np.uint64).reshape(-1, 2)


def dealt(df: DataFrame, radius: int, agree: int = 1) -> DataFrame:
    """df: fp, n, side. A row for each table: (tab, block, fp, n, side)."""
    cuts = cuts_of(radius, agree)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bits = np.unpackbits(as_words(batch.column("fp")).view(np.uint8), axis=1).astype(np.int64)
            for t, own in enumerate(combinations(range(len(cuts) - 1), agree)):
                of = np.hstack([bits[:, cuts[k] : cuts[k + 1]] for k in own])[:, -62:]
                block = of @ (1 << np.arange(of.shape[1], dtype=np.int64)[::-1])
                yield pa.record_batch([pa.array(np.full(len(block), t, np.int32)), pa.array(block), batch.column("fp"), batch.column("n"), batch.column("side")], ["tab", "block", "fp", "n", "side"])

    return df.select("fp", "n", "side").mapInArrow(deal, "tab int, block long, fp binary, n long, side int")


def matches(queries: np.ndarray, entries: np.ndarray, tab: int, radius: int, agree: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, entry, distance) of the pairs within the radius whose first blocks that agree are this table's, so that each pair is found in one table only."""
    cuts, found = cuts_of(radius, agree), []
    mine = list(combinations(range(len(cuts) - 1), agree))[tab]
    for k in range(0, len(queries), max(1, 1_000_000 // max(1, len(entries)))):
        part = queries[k : k + max(1, 1_000_000 // max(1, len(entries)))]
        d = np.bitwise_count(part[:, None, 0] ^ entries[None, :, 0]) + np.bitwise_count(part[:, None, 1] ^ entries[None, :, 1])
        q, e = np.nonzero(d <= radius)
        bits = np.unpackbits((part[q] ^ entries[e]).view(np.uint8).reshape(-1, BITS // 8), axis=1)
        first = np.ones(len(q), bool)
        for b in range(mine[-1] + 1):
            same = ~bits[:, cuts[b] : cuts[b + 1]].any(1)
            first &= same if b in mine else ~same
        found.append((q[first] + k, e[first], d[q, e][first].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def searched(batches: Iterator[pa.RecordBatch], radius: int, counted: bool, agree: int = 1) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (tab, block, part, side), entries before queries: the entries of a part are held, queries stream by. counted: (qfp, n) a query, else (qfp, efp, distance) a pair."""
    key, held, weights = None, [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("tab", "block", "part", "side")], 1)
        words, n = as_words(batch.column("fp")), np.asarray(batch.column("n"))
        cuts = np.r_[0, np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1, len(keys)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if key != (own := tuple(keys[a, :3].tolist())):
                key, held, weights = own, [], []
            if keys[a, 3] == 0:
                held.append(words[a:b])
                weights.append(n[a:b])
            elif held:
                held, weights = [np.concatenate(held)], [np.concatenate(weights)]
                q, e, d = matches(words[a:b], held[0], own[0], radius, agree)
                if counted:
                    total = np.bincount(q, weights[0][e], b - a).astype(np.int64)
                    hit = np.flatnonzero(total)
                    yield pa.record_batch([pa.array([x.tobytes() for x in words[a:b][hit]], pa.binary()), pa.array(total[hit])], ["qfp", "n"])
                else:
                    yield pa.record_batch([pa.array([x.tobytes() for x in words[a:b][q]], pa.binary()), pa.array([x.tobytes() for x in held[0][e]], pa.binary()), pa.array(d)], ["qfp", "efp", "distance"])


def search(queries: DataFrame, entries: DataFrame, radius: int, bucket_rows: int, counted: bool, agree: int | None) -> DataFrame:
    """queries, entries: fp (distinct), n. agree: blocks of a table's key, by default as many as the number of entries asks for. Blocks without a query are left out; a block of more than bucket_rows entries is cut into parts, and its queries go to each."""
    agree = agree or (1 if entries.count() <= ONE_BLOCK else 2)
    asked, held = dealt(queries.withColumn("side", F.lit(1)), radius, agree), dealt(entries.withColumn("side", F.lit(0)), radius, agree)
    size = held.groupBy("tab", "block").agg(F.count("*").alias("rows")).join(asked.select("tab", "block").distinct(), ["tab", "block"])
    size = size.select("tab", "block", F.greatest(F.lit(1), F.ceil(F.col("rows") / bucket_rows)).cast("int").alias("parts"))
    held = held.join(size, ["tab", "block"]).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    asked = asked.join(size, ["tab", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = held.drop("parts").unionByName(asked.drop("parts")).repartition("tab", "block", "part").sortWithinPartitions("tab", "block", "part", "side")
    return rows.mapInArrow(lambda batches: searched(batches, radius, counted, agree), "qfp binary, n long" if counted else "qfp binary, efp binary, distance long")


def distinct(df: DataFrame) -> DataFrame:
    return df.where("fp is not null").groupBy("fp").agg(F.count("*").alias("n"))


def neighbours(queries: DataFrame, entries: DataFrame, radius: int = 8, bucket_rows: int = 20_000, agree: int | None = None) -> DataFrame:
    """queries, entries: id (long), fp (16 bytes). Returns query_id, id, distance: every entry within the radius of each
    query, other than the query's own id. Null fingerprints find nothing. Repeated rows of one side are found as one.

    Answers are as many as there are pairs within the radius, which is what a search returns; the search compares distinct fingerprints only."""
    near = search(distinct(queries), distinct(entries), radius, bucket_rows, False, agree)
    near = near.join(queries.select(F.col("id").alias("query_id"), F.col("fp").alias("qfp")).distinct(), "qfp")
    near = near.join(entries.select("id", F.col("fp").alias("efp")).distinct(), "efp")
    return near.where(~F.col("query_id").eqNullSafe(F.col("id"))).select("query_id", "id", "distance")


def counts_within(queries: DataFrame, entries: DataFrame, radius: int = 8, bucket_rows: int = 20_000, agree: int | None = None) -> DataFrame:
    """queries: fp; entries: fp, a row a document. Returns fp, n: for each distinct fingerprint asked, the entries within the radius, equal ones included. No pair is listed."""
    near = search(distinct(queries), distinct(entries), radius, bucket_rows, True, agree)
    return near.groupBy(F.col("qfp").alias("fp")).agg(F.sum("n").alias("n"))


def edited(text: str, after: str) -> str:
    """text with its last half replaced by the start of the text after it."""
    n = len(text)
    return text[: n - n // 2] + after[: n // 2]


PAIRS = "id long, n_chars long, edited string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def placed(ids: pa.Array, cuts: list[int]) -> np.ndarray:
    """The number of each id's range: the largest ids are in range 0, null ids in the last."""
    at = len(cuts) - np.searchsorted(np.array(cuts, np.int64), ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), "left")
    return np.where(np.asarray(ids.is_null()), len(cuts) + 1, at)


def range_udf(cuts: list[int]):
    """A UDF: id to the number of its range."""

    @arrow_udf("int")
    def place(ids: pa.Array) -> pa.Array:
        return pa.array(placed(ids, cuts).astype(np.int32))

    return place


def ahead_udf(cuts: list[int], tops: dict[int, int | None], before: dict[int, int]):
    """A UDF: id to the range whose last document it follows if it is the first of its own range, else null."""
    top, to = np.full(len(cuts) + 2, -1, np.int64), np.full(len(cuts) + 2, -1, np.int64)
    none = np.zeros(len(cuts) + 2, bool)
    for r, t in tops.items():
        top[r], none[r], to[r] = t or 0, t is None, before[r]

    @arrow_udf("int")
    def ahead(ids: pa.Array) -> pa.Array:
        at, null = placed(ids, cuts), np.asarray(ids.is_null())
        first = np.where(null, none[at], ~none[at] & (top[at] == ids.fill_null(0).to_numpy(zero_copy_only=False)))
        return pa.array(to[at].astype(np.int32), mask=~(first & (to[at] >= 0)))

    return ahead


def in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows id, text, ahead, in order; those with ahead are only what follows the last row."""
    rows: list[tuple] = []
    now: tuple | None = None  # id, text, fingerprint

    def pair(now: tuple, text: str, fp: bytes) -> tuple:
        other = edited(now[1], text)
        efp = fingerprint(other)
        return now[0], len(now[1]), other, now[2], efp, likeness(now[2], efp), likeness(now[2], fp)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in PAIRS.split(", ")])

    ended = False
    for given in batches:
        for k in range(0, given.num_rows, 256):
            part = given.slice(k, 256)
            for i, text, ahead in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), part.column("ahead").to_pylist(), strict=True):
                if ended:
                    continue
                fp = fingerprint(text)
                if now is not None:
                    rows.append(pair(now, text, fp))
                now, ended = (i, text, fp), ahead
            if rows:
                yield batch(rows)
                rows = []


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Each document beside the next one in descending order of id (after the last: the first): see PAIRS.

    Whole texts move once, to ranges of ids; what moves besides is one document a range, the first of the range after it.
    Null texts count as empty. Null ids stand last; among equal ids the texts' order decides. A single document is its
    own next one. An empty table gives no rows."""
    spark = docs.sparkSession
    bound_batches()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted({int(x) for x in rows.select(F.col("id").cast("double")).approxQuantile("id", [k / n for k in range(1, n)], 0.2 / n)}) if n > 1 else []
    rows = rows.withColumn("range", range_udf(cuts)("id"))
    tops = {r["range"]: r.top for r in rows.groupBy("range").agg(F.max("id").alias("top")).collect()}  # a row a range
    if not tops:
        return rows.select("id", "text").mapInArrow(in_turn_nothing, PAIRS)
    order = sorted(tops)
    before = dict(zip(order[1:] + order[:1], order, strict=True))  # a range, and the one that its first document follows
    ahead = rows.select("id", "text", ahead_udf(cuts, tops, before)("id").alias("range")).where("range is not null").withColumn("ahead", F.lit(True))
    dealt = rows.withColumn("ahead", F.lit(False)).unionByName(ahead)
    ranged = dealt.repartitionById(max(order) + 1, F.col("range")).sortWithinPartitions("ahead", F.col("id").desc_nulls_last(), "text")
    return ranged.select("id", "text", "ahead").mapInArrow(in_turn, PAIRS)


def in_turn_nothing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from ()


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near: the number of other documents
    within 8 bits of its fingerprint, for every document whose id is divisible by 20, null for the others."""
    pairs = with_edits(table(spark, sf_dir, "documents"))
    rows = written(pairs.select(F.col("id").alias("doc_id"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.col("fingerprint").alias("fp"), F.lower(F.hex("fingerprint")).alias("fingerprint"), F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next"), "fingerprints")
    asks = F.col("doc_id") % 20 == 0
    near = counts_within(rows.where(asks), rows).withColumnRenamed("fp", "qfp")
    asked = rows.where(asks).join(near, F.col("fp") == F.col("qfp"), "left").withColumn("n_near", F.coalesce(F.col("n") - 1, F.lit(0)))
    rest = rows.where(~F.coalesce(asks, F.lit(False))).withColumn("n_near", F.lit(None).cast("long"))
    return asked.select(rest.columns).unionByName(rest).drop("fp")
