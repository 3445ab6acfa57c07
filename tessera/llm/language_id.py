"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter is an array of words, bits of each word belonging to languages: one probe of the k places of
an n-gram, and-ed, returns all languages that hold it. Per document and language the hits are counted (popcounts by
bit), corrected for the filter's false positives, and the largest corrected share decides.

What is learned: n-grams of letters (a letter's neighbours that aren't letters count as a space) of a bounded sample of
labelled rows, about `sample_docs` documents a language, chosen by a hash of the id. A language has two slices of the filter: the
first holds every n-gram of its sample, the second those that are its own, whose relative frequency is at least `ratio` of the
n-gram's largest in any language. A document's share for a language is the mean of its shares in both: languages that
share most of their n-grams are told apart by the second, and texts of rare n-grams count by the first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import fold, runs, table, text_udf

UNDECIDED = "und"
#: Lengths of the n-grams; the letters within, all but the ends, must be letters.
LENGTHS = (3, 4)
#: Characters that are turned into n-grams at a time.
PIECE = 250_000
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters (category L)."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of several texts: hashes of their n-grams, the text of each, and per text whether it has a letter. Texts are lower-cased."""
    low = [" " + t.lower() if t else " " for t in texts]
    starts = np.zeros(len(low) + 1, np.int64)
    np.cumsum([len(t) for t in low], out=starts[1:])
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.append(codes, np.uint32(32))
    is_letter = letters()[codes]
    codes = np.where(is_letter, codes, np.uint32(32)).astype(np.uint64)
    owner = np.repeat(np.arange(len(low), dtype=np.int64), np.diff(starts))
    has = np.bincount(owner[is_letter[:-1]], minlength=len(low)) > 0
    hashes, owners = [], []
    for n in LENGTHS:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        ok = is_letter[1 : m + 1].copy()
        for k in range(2, n - 1):
            ok &= is_letter[k : m + k]
        at = np.flatnonzero(ok)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = (h ^ codes[at + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        hashes.append(h)
        owners.append(owner[at + 1])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has, starts
    return np.concatenate(hashes), np.concatenate(owners), has, starts


def pieces(text: str) -> Iterator[str]:
    """A long text in pieces of about PIECE characters, cut behind what isn't a letter, so that no n-gram is cut (within a word of more than PIECE letters, a few are)."""
    at = 0
    while len(text) - at > PIECE:
        end = at + PIECE
        while end > at and text[end - 1].isalpha():
            end -= 1
        end = end if end > at else at + PIECE
        yield text[at:end]
        at = end
    yield text[at:]


@dataclass(frozen=True)
class Model:
    """languages: in order of their bits; masks: the filter's words; probes: places for each n-gram; false: each bit's rate of false positives; slices: bits of a language, those of a slice side by side."""

    languages: tuple[str, ...]
    masks: np.ndarray
    probes: int
    false: np.ndarray
    slices: int = 1

    def holders(self, hashes: np.ndarray) -> np.ndarray:
        """The word of languages that hold each n-gram."""
        out = None
        for p in places(hashes, len(self.masks), self.probes):
            out = self.masks[p] if out is None else out & self.masks[p]
        return out

    def shares(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Corrected share of n-grams of each text by language, whether it has a letter, and its number of n-grams."""
        total, has = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
        hits = np.zeros((len(texts), len(self.false)), np.int64)
        parts = [(k, p) for k, t in enumerate(texts) for p in pieces(t or "")]
        for a, b in runs([len(p) for _, p in parts], 256, PIECE):
            hashes, owner, letter, _ = grams([p for _, p in parts[a:b]])
            text = np.array([k for k, _ in parts[a:b]])
            found, owner = self.holders(hashes), text[owner]
            total += np.bincount(owner, minlength=len(texts))
            for k in range(len(self.false)):
                hits[:, k] += np.bincount(owner[(found >> np.array(k, found.dtype)) & found.dtype.type(1) > 0], minlength=len(texts))
            has[text[letter]] = True
        seen = hits / np.maximum(total, 1)[:, None]
        share = np.clip((seen - self.false) / (1 - self.false), 0, 1)
        return share.reshape(len(texts), self.slices, -1).mean(1), has, total


@dataclass(frozen=True)
class Models:
    """More languages than a word has bits for: a filter for each OF_WORD of them, in order."""

    languages: tuple[str, ...]
    parts: tuple[Model, ...]

    def shares(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [m.shares(texts) for m in self.parts]
        return np.concatenate([f[0] for f in found], 1), found[0][1], found[0][2]


def places(hashes: np.ndarray, size: int, probes: int) -> Iterator[np.ndarray]:
    """Places by double hashing in a table of a power of two."""
    a, b = hashes >> np.uint64(32), hashes | np.uint64(1)
    for k in range(probes):
        yield ((a + np.uint64(k) * b) & np.uint64(size - 1)).astype(np.int64)


def filled(hashes: np.ndarray, words: np.ndarray, languages: list[str], slices: int, probes: int = 3, bits: int = 16) -> Model:
    """hashes: distinct n-grams; words: the bits of each. The table has at least `bits` words for each n-gram of the bit that has most."""
    n = slices * len(languages)
    if n > 64:
        raise ValueError("a word has 64 bits")
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if np.iinfo(k).bits >= n)
    words = words.astype(kind)
    held = lambda masks: np.array([np.count_nonzero(masks & kind(1 << k)) for k in range(n)])
    masks = np.zeros(1 << max(10, int(np.ceil(np.log2(max(1, held(words).max(initial=0)) * bits)))), kind)
    for p in places(hashes, len(masks), probes):
        np.bitwise_or.at(masks, p, words)
    return Model(tuple(languages), masks, probes, (held(masks) / len(masks)) ** probes, slices)


def build(found: list[tuple[str, int]], languages: list[str], probes: int = 3, bits: int = 16) -> Model:
    """found: (language, n-gram hash as a signed long). A filter of one slice."""
    place = {lang: k for k, lang in enumerate(languages)}
    words: dict[int, int] = {}
    for lang, h in found:
        words[h] = words.get(h, 0) | 1 << place[lang]
    return filled(np.array([*words], np.int64).view(np.uint64), np.array([*words.values()], np.uint64), languages, 1, probes, bits)


#: Slices of the filter, and languages of a word.
SLICES = 2
OF_WORD = 64 // SLICES


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 1500, ratio: float = 0.2) -> Model | Models:
    """docs: the rows that may be learned from; those without text or label are passed by. Languages are taken in order of their names."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()}
    if not sizes:
        return Model((), np.zeros(1024, np.uint8), 1, np.zeros(0))
    share = docs.sparkSession.createDataFrame([(lang, min(1.0, sample_docs / n)) for lang, n in sizes.items()], "lang string, share double")
    sample = rows.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("id", "lang"), F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), np.array(batch.column("lang").to_pylist(), object)
            for lang in dict.fromkeys(langs.tolist()):
                own = [p for k in np.flatnonzero(langs == lang) for p in pieces(texts[k])]
                for a, b in runs([len(p) for p in own], 256, PIECE):
                    h, n = np.unique(grams(own[a:b])[0], return_counts=True)
                    yield pa.record_batch([pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n)], ["lang", "h", "n"])

    counts = sample.mapInArrow(count, "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    languages = sorted(sizes)
    signed = lambda k: (1 << k) - (1 << 64 if k == 63 else 0)
    bits = [(lang, k // OF_WORD, signed(k % OF_WORD), signed(k % OF_WORD + len(languages[k // OF_WORD * OF_WORD :][:OF_WORD]))) for k, lang in enumerate(languages)]
    place = docs.sparkSession.createDataFrame(bits, "lang string, part int, holds long, owns long")
    of_lang, of_gram = Window.partitionBy("lang"), Window.partitionBy("h")
    rate = counts.withColumn("rate", F.col("n") / F.sum("n").over(of_lang)).withColumn("most", F.max("rate").over(of_gram)).join(F.broadcast(place), "lang")
    own = (F.col("rate") >= F.col("most") * ratio) & ((F.col("n") > 1) | (F.col("most") == F.col("rate")))
    word = F.col("holds").bitwiseOR(F.when(own, F.col("owns")).otherwise(0))
    words = rate.groupBy("part", "h").agg(F.bit_or(word).alias("word")).toArrow()  # of the sample's n-grams
    part, h, w = (words.column(c).to_numpy() for c in ("part", "h", "word"))
    parts = [filled(h[part == k].view(np.uint64), w[part == k].view(np.uint64), languages[k * OF_WORD :][:OF_WORD], SLICES) for k in range(-(-len(languages) // OF_WORD))]
    return parts[0] if len(parts) == 1 else Models(tuple(languages), tuple(parts))


def detector(spark: SparkSession, model: Model | Models):
    """A UDF: text to (lang, score). lang is the language with the largest corrected share, the first by name among equals, or `und` for texts without a letter (null, empty) and models without a language; score is that share, 0 for `und`."""
    shared = spark.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def work(texts):
            if not texts or not m.languages:
                langs, scores = [UNDECIDED] * len(texts), np.zeros(len(texts))
            else:
                share, has, _ = m.shares(texts)
                best = share.argmax(1)
                langs = [m.languages[b] if ok else UNDECIDED for b, ok in zip(best.tolist(), has.tolist(), strict=True)]
                scores = np.where(has, share[np.arange(len(texts)), best], 0.0)
            return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

        return work

    return text_udf(make, "lang string, score double")


def identify(docs: DataFrame, model: Model | Models, text_col: str = "text", out: str = "language") -> DataFrame:
    """docs with a struct (lang, score) added as `out`."""
    return docs.withColumn(out, detector(docs.sparkSession, model)(F.col(text_col)))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score. Learned from rows whose crc32 of the id modulo 4 isn't 2."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(fold("doc_id", 4) != 2))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
