"""The queries of this subpackage, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from tidemark.llm import bpe, chat_format, decontamination, hard_negatives, html_extraction, jaccard_join, line_dedup, prefix_trie, quality_rules, simhash, substring_dedup, suffix_dedup, url_filter

QUERIES = {
    "op1_html_extraction": html_extraction.op1_html_extraction,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_chat_format": chat_format.op3_chat_format,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_simhash_dedup": simhash.op11_simhash_dedup,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

SQL: dict[str, str] = {
    "op2_suffix_dedup": suffix_dedup.SQL,
    "op3_chat_format": chat_format.SQL,
    "op4_quality_rules": quality_rules.SQL,
    "op5_jaccard_join": jaccard_join.SQL,
    "op6_decontamination": decontamination.SQL,
    "op7_substring_dedup": substring_dedup.SQL,
    "op9_line_dedup": line_dedup.SQL,
    "op10_url_filter": url_filter.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
    "op13_prefix_trie": prefix_trie.SQL,
}
