"""The queries of this subpackage and the SQL to compare them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, chat, embeddings, exact, licenses, packing, quality, sharding, simhash, store


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": quality.query,
        "op2_embedding_near_dedup": embeddings.query,
        "op3_sharding": sharding.query,
        "op4_byte_bpe": byte_bpe.query,
        "op5_exact_dedup": exact.query,
        "op6_token_store": store.query,
        "op7_chat_perspectives": chat.query,
        "op8_packing": packing.query,
        "op9_license_scan": licenses.query,
        "op10_simhash": simhash.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": exact.SQL, "op7_chat_perspectives": chat.SQL}
