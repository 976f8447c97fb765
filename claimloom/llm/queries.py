"""The corpus queries and the SQL that stands against them, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimloom.llm import bpe, conversations, decontaminate, language_model, near_dedup, phrases, repetition, resample, spelling, token_counts, toxicity, url_filter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_importance_resampling": resample.op1_importance_resampling,
        "op2_context_mixing": language_model.op2_context_mixing,
        "op3_host_reputation": url_filter.op3_host_reputation,
        "op4_fast_similarity_sketch": near_dedup.op4_fast_similarity_sketch,
        "op5_token_transducer": token_counts.op5_token_transducer,
        "op6_suffix_array_repetition": repetition.op6_suffix_array_repetition,
        "op7_warc_shards": warc.op7_warc_shards,
        "op8_levenshtein_lexicon": toxicity.op8_levenshtein_lexicon,
        "op9_bpe_rank_queue": bpe.op9_bpe_rank_queue,
        "op10_suffix_automaton": decontaminate.op10_suffix_automaton,
        "op11_symmetric_delete": spelling.op11_symmetric_delete,
        "op12_prefix_free_parsing": phrases.op12_prefix_free_parsing,
        "op13_recursive_repair": conversations.op13_recursive_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_host_reputation": url_filter.ORACLE_SQL, "op7_warc_shards": warc.ORACLE_SQL, "op11_symmetric_delete": spelling.ORACLE_SQL, "op12_prefix_free_parsing": phrases.ORACLE_SQL, "op13_recursive_repair": conversations.ORACLE_SQL}
