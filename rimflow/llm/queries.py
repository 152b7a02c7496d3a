"""The queries of this subpackage and, where SQL expresses them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, bitpack, bpe, chat, fingerprint, mixing, neardup, periodic, quality_classifier, quality_rules, sharding, tokencounts, urlfilter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_quality_classifier": quality_classifier.op2_quality_classifier,
        "op3_chat": chat.op3_chat,
        "op4_bitpack": bitpack.op4_bitpack,
        "op5_url_filter": urlfilter.op5_url_filter,
        "op6_sharding": sharding.op6_sharding,
        "op7_fingerprint": fingerprint.op7_fingerprint,
        "op8_near_duplicates": neardup.op8_near_duplicates,
        "op9_quality_rules": quality_rules.op9_quality_rules,
        "op10_bpe": bpe.op10_bpe,
        "op11_token_counts": tokencounts.op11_token_counts,
        "op12_periodic_runs": periodic.op12_periodic_runs,
        "op13_alignment": alignment.op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_chat": chat.OP3_SQL, "op5_url_filter": urlfilter.OP5_SQL, "op7_fingerprint": fingerprint.OP7_SQL, "op9_quality_rules": quality_rules.OP9_SQL}
