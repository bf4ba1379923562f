"""Queries of the training-data operators and the SQL that can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import chat, decontamination, language_model, line_dedup, main_text, mixing, near_dedup, prefix_trie, quality_model, quality_rules, spelling, substring_dedup, token_output


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": mixing.op1,
        "op2_quality_model": quality_model.op2,
        "op3_near_duplicates": near_dedup.op3,
        "op4_chat_format": chat.op4,
        "op5_quality_rules": quality_rules.op5,
        "op6_lm_scores": language_model.op6,
        "op7_token_output": token_output.op7,
        "op8_fuzzy_lines": line_dedup.op8,
        "op9_decontaminate": decontamination.op9,
        "op10_remove_repeats": substring_dedup.op10,
        "op11_spelling_variants": spelling.op11,
        "op12_main_text": main_text.op12,
        "op13_prefix_trie": prefix_trie.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mixing.OP1_SQL, "op4_chat_format": chat.OP4_SQL, "op11_spelling_variants": spelling.OP11_SQL, "op13_prefix_trie": prefix_trie.OP13_SQL}
