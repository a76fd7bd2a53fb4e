"""The queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import avi, bpe, mixing, ngram_lm, pii, quality, secret_scan, sharding, simhash, substring_dedup

QUERIES = (
    bpe.op1_byte_bpe,
    simhash.op2_simhash_near_dedup,
    ngram_lm.op3_stupid_backoff,
    substring_dedup.op4_substring_dedup,
    pii.op5_pii_surrogates,
    sharding.op6_extendible_shards,
    secret_scan.op7_secret_scan,
    quality.op8_quality_rules,
    mixing.op9_mix_sources,
    avi.op10_avi_media,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op3_stupid_backoff": ngram_lm.ORACLE, "op4_substring_dedup": substring_dedup.ORACLE, "op6_extendible_shards": sharding.ORACLE, "op8_quality_rules": quality.ORACLE, "op9_mix_sources": mixing.ORACLE}
