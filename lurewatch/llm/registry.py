"""The queries of this package and their SQL."""

from __future__ import annotations

from lurewatch.llm import chat, conversation_repair, decontaminate, jaccard_join, lexical_search, mixing, quality, sentence_pieces, substring_dedup, suffix_dedup, token_counts, toxicity, url_filter

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1,
    "op2_source_mixing": mixing.op2,
    "op3_quality_rules": quality.op3,
    "op4_url_filters": url_filter.op4,
    "op5_suffix_dedup": suffix_dedup.op5,
    "op6_decontamination": decontaminate.op6,
    "op7_token_counts": token_counts.op7,
    "op8_preference_formatting": chat.op8,
    "op9_toxicity": toxicity.op9,
    "op10_jaccard_join": jaccard_join.op10,
    "op11_sentence_pieces": sentence_pieces.op11,
    "op12_conversation_repair": conversation_repair.op12,
    "op13_lexical_search": lexical_search.op13,
}
ORACLE = {
    "op1_substring_dedup": substring_dedup.OP1_SQL,
    "op2_source_mixing": mixing.OP2_SQL,
    "op4_url_filters": url_filter.OP4_SQL,
    "op6_decontamination": decontaminate.OP6_SQL,
    "op8_preference_formatting": chat.OP8_SQL,
    "op12_conversation_repair": conversation_repair.OP12_SQL,
    "op13_lexical_search": lexical_search.OP13_SQL,
}
