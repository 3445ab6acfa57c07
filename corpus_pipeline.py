"""The corpus pipeline: language, near duplicates, secrets, mixture, tokens.

STAGES lists (name, function) in order. Each function takes (spark, docs, sf_dir), docs being the Parquet table that the
stage before has written, and returns a DataFrame; all but the last return the columns of documents. run() applies them
to the documents of sf_dir, writing each stage's rows to the shared folder. Counted with the subpackage llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, language_id, mixing, secret_scan, simhash_dedup
from tessera.llm._shared import fold, table, written

#: Least share of a document's n-grams that its language must hold.
LEAST_SHARE = 0.2


def packed(docs: DataFrame) -> DataFrame:
    """Each row as one struct, so that no column of it meets a stage's own."""
    return docs.select(F.struct("*").alias("doc"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter (null and empty texts too) and those of whose n-grams no language holds LEAST_SHARE. The languages are learned from the labelled rows among docs; without any label no document is rejected but those without a letter."""
    model = language_id.learn(docs.where(fold("doc_id", 4) != 2))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language_id.identify(packed(docs), model, text_col="doc.text", out="found")
    return found.where((F.col("found.lang") != language_id.UNDECIDED) & (F.col("found.score") >= LEAST_SHARE)).select("doc.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of linked fingerprints, the one with the smallest id, and of repeated rows one. Rows that share an id but not a text are documents of their own. Documents with a null id can't be told apart by id and all stay."""
    mark = lambda text: F.coalesce(F.xxhash64(text), F.lit(0))
    keys = docs.select(F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id").alias("key"), mark("text").alias("mark"))).alias("row"), "text")
    found = simhash_dedup.near_duplicates(keys, id_col="row")
    keep = found.where("id = component_id").select(F.lit(False).alias("none"), "id.key", "id.mark").distinct().withColumn("keep", F.lit(True))
    keyed = packed(docs).select("doc", F.col("doc.doc_id").isNull().alias("none"), F.coalesce("doc.doc_id", F.xxhash64("doc.text", "doc.source")).alias("key"), mark("doc.text").alias("mark"))  # null ids are spread by their texts
    first = F.row_number().over(Window.partitionBy("none", "key", "mark").orderBy("doc.text", "doc.source", "doc.lang"))
    named = keyed.join(keep, ["none", "key", "mark"], "left").where("none or keep").withColumn("first", first)
    return named.where("none or first = 1").select("doc.*")


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document and replaces each secret in its text by a mark; n_chars follows the new text."""
    clean = docs.withColumn("text", secret_scan.redact_udf(cuts=secret_scan.corpus_cuts(docs))(F.col("text")))
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mixture of sources takes it: 0, 1 or 2 times. Rows are numbered, so that null and repeated ids are documents like any other."""
    rows = written(packed(docs).withColumn("uid", F.monotonically_increasing_id()), "numbered")
    copies = mixing.mix(rows, "doc.doc_id", "doc.text", "doc.source", row_col="uid").select("uid", "copies").where("copies > 0")
    return rows.join(copies, "uid").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per copy of a document: doc_id, source, n_tokens, token_ids (little-endian unsigned 32-bit integers), round_trip (whether the ids decode to the text)."""
    v = byte_bpe.default_vocabulary()
    coded = byte_bpe.round_trip(docs.select("doc_id", "source", "text"), v)
    ids, same = F.col("coded.token_ids"), F.col("coded.decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return coded.select("doc_id", "source", byte_bpe.n_tokens(ids).alias("n_tokens"), ids.alias("token_ids"), same.alias("round_trip"))


STAGES = [
    ("language_id", language_stage),
    ("simhash_dedup", near_duplicate_stage),
    ("secret_scan", secret_stage),
    ("source_mixing", mixing_stage),
    ("byte_bpe", token_stage),
]

#: Learned filters, SimHash and byte merges aren't SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
