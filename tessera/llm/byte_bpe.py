"""Byte-level BPE encoding and decoding: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest.

The text is cut by the tokenizer's pattern. A piece that is in the vocabulary as a whole is resolved by one probe of a
minimal perfect hash (as many slots as keys, one displacement a bucket); a piece that isn't is merged from its bytes: the
bytes form a linked list, a heap holds the pairs that the vocabulary ranks, and the lowest rank, leftmost first, merges.
Pieces already resolved are kept in a bounded memory of each worker.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table, text_udf

MASK = (1 << 64) - 1
MIX = 0x9E3779B97F4A7C15
#: Resolved pieces that a worker keeps; when full it starts anew.
MEMORY = 300_000


def slot(h: int, d: int, n: int) -> int:
    """The slot of a key with hash h under displacement d."""
    x = (h ^ (d * MIX)) & MASK
    x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & MASK
    return (x >> 32) % n


class PerfectHash:
    """A minimal perfect hash over distinct byte strings: hash to a bucket, displace the bucket. Buckets of one key name their slot outright (as -slot-1), so that the table can be full."""

    def __init__(self, keys: list[bytes]):
        self.n, self.buckets = len(keys), max(1, len(keys) // 3)
        for self.seed in range(100):
            hashes = [xxhash.xxh3_64_intdigest(k, self.seed) for k in keys]
            if len(set(hashes)) == self.n:
                break
        rows: list[list[int]] = [[] for _ in range(self.buckets)]
        for k, h in enumerate(hashes):
            rows[h % self.buckets].append(k)
        self.moves, self.order = [0] * self.buckets, [-1] * self.n
        free = None
        for b in sorted(range(self.buckets), key=lambda b: -len(rows[b])):
            own = rows[b]
            if not own:
                break
            if len(own) == 1:
                free = free or iter([s for s in range(self.n) if self.order[s] < 0])
                s = next(free)
                self.moves[b], self.order[s] = -s - 1, own[0]
                continue
            d = 0
            while True:
                at = [slot(hashes[k], d, self.n) for k in own]
                if len(set(at)) == len(at) and all(self.order[s] < 0 for s in at):
                    break
                d += 1
            self.moves[b] = d
            for s, k in zip(at, own, strict=True):
                self.order[s] = k

    def __call__(self, key: bytes) -> int:
        """The index of key in the keys if it is one of them; any index else: compare the key."""
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key, self.seed)
        d = self.moves[h % self.buckets]
        return self.order[-d - 1 if d < 0 else slot(h, d, self.n)]


class Vocabulary:
    """keys: byte strings by id; every single byte is among them."""

    def __init__(self, pairs: list[tuple[bytes, int]], pattern: str):
        self.keys = [k for k, _ in pairs]
        self.ids = [i for _, i in pairs]
        self.ranks = dict(pairs)
        self.pattern = pattern
        self.find = PerfectHash(self.keys)
        if missing := [b for b in range(256) if bytes([b]) not in self.ranks]:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")

    def whole(self, piece: bytes) -> int | None:
        """The id of a piece that is a token by itself."""
        k = self.find(piece)
        return self.ids[k] if self.keys[k] == piece else None

    def merged(self, piece: bytes) -> list[int]:
        """The ids of a piece by merging: pairs wait in a heap by (rank, start, end); a pair is stale unless its start still begins a token whose next one ends at its end."""
        rank, n = self.ranks.get, len(piece)
        after = list(range(1, n + 1)) + [n + 1]
        before = list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, end = heappop(heap)
            mid = after[i]
            if mid < 0 or mid >= n or after[mid] != end:
                continue
            after[i], after[mid] = end, -1
            if end <= n:
                before[end] = i
            if end < n and (r := rank(piece[i : after[end]])) is not None:
                heappush(heap, (r, i, after[end]))
            if (j := before[i]) >= 0 and (r := rank(piece[j:end])) is not None:
                heappush(heap, (r, j, end))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def packed(self, piece: str) -> bytes:
        """The ids of a piece as little-endian unsigned 32-bit integers."""
        raw = piece.encode()
        k = self.whole(raw)
        return k.to_bytes(4, "little") if k is not None else np.array(self.merged(raw), "<u4").tobytes()


@lru_cache(4)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """From a file of base64 token and rank a line; read by the driver, its size is that of the vocabulary."""
    with open(path, "rb") as f:
        return Vocabulary([(base64.b64decode(a), int(b)) for a, b in (x.split() for x in f if x.strip())], pattern)


#: Resolved pieces by broadcast id, kept from task to task of a worker.
_memory: dict[int, dict[str, bytes]] = {}


def encoding_of(v: Vocabulary, known: dict[str, bytes]):
    """A function from texts to their packed ids, which keeps resolved pieces in `known`. When that is full, pieces that a second text has had stay, if they are no more than half of it."""
    split = regex.compile(v.pattern).findall
    again: set[str] = set()

    def one(text: str | None) -> bytes:
        pieces = split(text) if text else []
        own = set(pieces)
        new = own.difference(known)
        if len(known) + len(new) > MEMORY:
            kept = {p: known[p] for p in again if p in known} if len(again) <= MEMORY // 2 else {}
            known.clear()
            known.update(kept)
            again.clear()
            new = own.difference(known)
        again.update(own.difference(new))
        for p in new:
            known[p] = v.packed(p)
        return b"".join(map(known.__getitem__, pieces))

    return one


def decoding_of(v: Vocabulary):
    """A function from packed ids to their bytes."""
    by_id = dict(zip(v.ids, v.keys, strict=True))
    return lambda ids: b"".join(map(by_id.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


def encoder(spark: SparkSession, vocab: Vocabulary):
    """A UDF: text to its ids, packed as little-endian unsigned 32-bit integers. A null text is the empty text: no ids."""
    shared = spark.sparkContext.broadcast(vocab)
    key = shared._jbroadcast.id()

    def make():
        one = encoding_of(shared.value, _memory.setdefault(key, {}))
        return lambda texts: pa.array([one(t) for t in texts], pa.binary())

    return text_udf(make, "binary")


def decoder(spark: SparkSession, vocab: Vocabulary):
    """A UDF: packed ids to the bytes they stand for. Null gives no bytes; an id outside the vocabulary is an error."""
    shared = spark.sparkContext.broadcast(vocab)

    def make():
        one = decoding_of(shared.value)
        return lambda rows: pa.array([one(x) for x in rows], pa.binary())

    return text_udf(make, "binary")


def both_ways(spark: SparkSession, vocab: Vocabulary):
    """A UDF: text to (token_ids, decoded), what encoder gives and what decoder makes of it, by one worker instead of two at once."""
    shared = spark.sparkContext.broadcast(vocab)
    key = shared._jbroadcast.id()

    def make():
        encode, decode = encoding_of(shared.value, _memory.setdefault(key, {})), decoding_of(shared.value)

        def work(texts):
            ids = [encode(t) for t in texts]
            return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array([decode(x) for x in ids], pa.binary())], ["token_ids", "decoded"])

        return work

    return text_udf(make, "token_ids binary, decoded binary")


def encode(docs: DataFrame, vocab: Vocabulary, text_col: str = "text", out: str = "token_ids") -> DataFrame:
    """docs with the packed ids of its text added as `out` (replacing a column of that name)."""
    return docs.withColumn(out, encoder(docs.sparkSession, vocab)(F.col(text_col)))


def decode(docs: DataFrame, vocab: Vocabulary, ids_col: str = "token_ids", out: str = "decoded") -> DataFrame:
    """docs with the bytes of its packed ids added as `out`."""
    return docs.withColumn(out, decoder(docs.sparkSession, vocab)(F.col(ids_col)))


def round_trip(docs: DataFrame, vocab: Vocabulary, text_col: str = "text", out: str = "coded") -> DataFrame:
    """docs with a struct (token_ids, decoded) of its text added as `out`: encode and decode after each other in one pass."""
    return docs.withColumn(out, both_ways(docs.sparkSession, vocab)(F.col(text_col)))


def n_tokens(ids: Column) -> Column:
    return F.shiftright(F.length(ids).cast("long"), 2)


def default_vocabulary(path: str | None = None) -> Vocabulary:
    import public_tokenizers

    return vocabulary(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, the digest of its ids and of the bytes that they decode to. Empty and null texts have no ids."""
    v = default_vocabulary()
    back = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), v).select("doc_id", "coded")
    return back.select("doc_id", n_tokens(F.col("coded.token_ids")).alias("n_tokens"), F.sha2("coded.token_ids", 256).alias("ids_sha256"), F.sha2("coded.decoded", 256).alias("decoded_sha256"))
