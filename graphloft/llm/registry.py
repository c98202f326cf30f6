"""The subpackage's queries and their DuckDB equivalents."""

from __future__ import annotations

from graphloft.llm import decontaminate, jaccard, language, mixing, quality, secrets, suffixes, tokens, toxicity, warc


def queries() -> dict:
    return {
        "op1_suffix_dedup": suffixes.op1,
        "op2_quality_rules": quality.op2,
        "op3_source_mixing": mixing.op3,
        "op4_toxicity": toxicity.op4,
        "op5_warc": warc.op5,
        "op6_token_counts": tokens.op6,
        "op7_secret_scans": secrets.op7,
        "op8_decontamination": decontaminate.op8,
        "op9_ngram_jaccard": jaccard.op9,
        "op10_language_id": language.op10,
    }


def oracle_sql() -> dict:
    return {
        "op1_suffix_dedup": suffixes.SQL,
        "op5_warc": warc.SQL,
        "op8_decontamination": decontaminate.SQL,
        "op9_ngram_jaccard": jaccard.SQL,
    }
