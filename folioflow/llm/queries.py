"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from folioflow.llm import decontamination, mixing, near_dedup, ngram_join, periodic_runs, personal_data, phrases, quality, sharding, substring_dedup, token_output, toxicity, vector_search

OPERATORS = {
    "op1_token_ids": token_output,
    "op2_substring_dedup": substring_dedup,
    "op3_toxicity": toxicity,
    "op4_decontamination": decontamination,
    "op5_sharding": sharding,
    "op6_mixing": mixing,
    "op7_near_dedup": near_dedup,
    "op8_vector_search": vector_search,
    "op9_personal_data": personal_data,
    "op10_quality": quality,
    "op11_periodic_runs": periodic_runs,
    "op12_ngram_join": ngram_join,
    "op13_collocations": phrases,
}


def queries() -> dict:
    return {name: getattr(module, name) for name, module in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    """For the operators that SQL can express."""
    return {name: module.SQL for name, module in OPERATORS.items() if hasattr(module, "SQL")}
