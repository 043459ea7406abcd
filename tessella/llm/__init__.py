"""Operators for training-data pipelines: one module each, registered here by name."""

from __future__ import annotations

from . import decontam, jaccard_join, pii, quality, sharding, sp_codec, substring_dedup, token_output, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_url_filter": url_filter.op1_url_filter,
        "op2_token_output": token_output.op2_token_output,
        "op3_sentencepiece": sp_codec.op3_sentencepiece,
        "op4_quality_rules": quality.op4_quality_rules,
        "op5_decontaminate": decontam.op5_decontaminate,
        "op6_substring_dedup": substring_dedup.op6_substring_dedup,
        "op7_personal_data": pii.op7_personal_data,
        "op8_jaccard_join": jaccard_join.op8_jaccard_join,
        "op9_sharding": sharding.op9_sharding,
        "op10_toxicity": toxicity.op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": url_filter.ORACLE,
        "op4_quality_rules": quality.ORACLE,
        "op5_decontaminate": decontam.ORACLE,
        "op8_jaccard_join": jaccard_join.ORACLE,
        "op9_sharding": sharding.ORACLE,
    }
