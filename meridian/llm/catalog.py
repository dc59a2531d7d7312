"""The queries and oracle SQL that the entry point adds when this folder exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, language, minhash, mixing, pii, sharding, substring_dedup, suffix_dedup, topk, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_hilbert_shards": sharding.op1_hilbert_shards,
        "op2_minhash_dedup": minhash.op2_minhash_dedup,
        "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
        "op4_source_mix": mixing.op4_source_mix,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_pii_pseudonyms": pii.op6_pii_pseudonyms,
        "op7_exact_topk": topk.op7_exact_topk,
        "op8_decontamination": decontamination.op8_decontamination,
        "op9_substring_dedup": substring_dedup.op9_substring_dedup,
        "op10_language_id": language.op10_language_id,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash_dedup": minhash.OP2_SQL, "op3_suffix_dedup": suffix_dedup.OP3_SQL, "op4_source_mix": mixing.OP4_SQL, "op7_exact_topk": topk.OP7_SQL, "op9_substring_dedup": substring_dedup.OP9_SQL}
