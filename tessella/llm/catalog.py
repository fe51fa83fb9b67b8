"""Queries of the training-data operators, and the SQL that states the same results."""

import corpus_pipeline
from tessella.llm import (
    queries_chat,
    queries_decontaminate,
    queries_fingerprints,
    queries_hard_negatives,
    queries_language,
    queries_licenses,
    queries_packing,
    queries_quality,
    queries_sharding,
    queries_simhash,
    queries_suffixes,
    queries_toxicity,
    queries_vector_codes,
)

LLM_QUERIES = {
    "op1_quality": queries_quality.op1_quality,
    "op2_suffix_dedup": queries_suffixes.op2_suffix_dedup,
    "op3_decontaminate": queries_decontaminate.op3_decontaminate,
    "op4_sharding": queries_sharding.op4_sharding,
    "op5_language": queries_language.op5_language,
    "language_of_pages": queries_language.language_of_pages,
    "op6_packing": queries_packing.op6_packing,
    "op7_simhash": queries_simhash.op7_simhash,
    "op8_chat": queries_chat.op8_chat,
    "op9_licenses": queries_licenses.op9_licenses,
    "op10_toxicity": queries_toxicity.op10_toxicity,
    "op11_fingerprints": queries_fingerprints.op11_fingerprints,
    "op12_vector_codes": queries_vector_codes.op12_vector_codes,
    "op13_hard_negatives": queries_hard_negatives.op13_hard_negatives,
    "pipeline": corpus_pipeline.run,
}

LLM_SQL = {
    "op1_quality": queries_quality.SQL,
    "op2_suffix_dedup": queries_suffixes.SQL,
    "op3_decontaminate": queries_decontaminate.SQL,
    "op8_chat": queries_chat.SQL,
    "op11_fingerprints": queries_fingerprints.SQL,
    "op12_vector_codes": queries_vector_codes.SQL,
    "op13_hard_negatives": queries_hard_negatives.SQL,
}
