"""The corpus operators' queries and their DuckDB oracles."""

from __future__ import annotations

from graphlens.llm import ann, codes, decontam, embdup, lexical, linededup, mixing, neardup, sharding, substrings, tokens, toxicity


def queries() -> dict:
    return {
        "op1_nearest_neighbours": ann.op1_nearest_neighbours,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_near_duplicates": neardup.op3_near_duplicates,
        "op4_decontamination": decontam.op4_decontamination,
        "op5_mixing": mixing.op5_mixing,
        "op6_token_counts": tokens.op6_token_counts,
        "op7_repeated_substrings": substrings.op7_repeated_substrings,
        "op8_token_shards": tokens.op8_token_shards,
        "op9_sharding": sharding.op9_sharding,
        "op10_line_dedup": linededup.op10_line_dedup,
        "op11_embedding_duplicates": embdup.op11_embedding_duplicates,
        "op12_lexical_search": lexical.op12_lexical_search,
        "op13_vector_codes": codes.op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_near_duplicates": neardup.ORACLE,
        "op5_mixing": mixing.ORACLE,
        "op7_repeated_substrings": substrings.ORACLE,
        "op9_sharding": sharding.oracle(),
        "op10_line_dedup": linededup.ORACLE,
        "op11_embedding_duplicates": embdup.ORACLE,
        "op12_lexical_search": lexical.ORACLE,
        "op13_vector_codes": codes.ORACLE,
    }
