"""Operators of a training-data pipeline; nothing else in the library imports them."""

from __future__ import annotations

from . import byte_bpe, chat_format, embedding_dedup, language_id, licenses, mixing, quality_pu, secret_scan, simhash_dedup, simhash_index


def queries() -> dict:
    own = (mixing.op1_source_mixing, quality_pu.op2_quality, licenses.op3_license_scan, embedding_dedup.op4_embedding_dedup, secret_scan.op5_secret_scan, simhash_index.op6_fingerprints, language_id.op7_language_id, simhash_dedup.op8_simhash_dedup, chat_format.op9_chat_format, byte_bpe.op10_byte_bpe)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict:
    return {"op3_license_scan": licenses.OP3_SQL, "op4_embedding_dedup": embedding_dedup.OP4_SQL, "op9_chat_format": chat_format.OP9_SQL}
