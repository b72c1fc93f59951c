"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from nimbora.llm import conversation_trie, decontamination, fill_in_middle, fingerprints, jaccard_join, kneser_ney, pieces, quality, secret_scan, substring_dedup, suffix_dedup, token_store, url_filter


def queries() -> dict:
    return {
        "op1_ngram_jaccard_join": jaccard_join.op1_ngram_jaccard_join,
        "op2_token_store": token_store.op2_token_store,
        "op3_quality_classifier": quality.op3_quality_classifier,
        "op4_benchmark_decontamination": decontamination.op4_benchmark_decontamination,
        "op5_secret_scans": secret_scan.op5_secret_scans,
        "op6_substring_dedup": substring_dedup.op6_substring_dedup,
        "op7_url_filters": url_filter.op7_url_filters,
        "op8_lm_scoring": kneser_ney.op8_lm_scoring,
        "op9_sentence_pieces": pieces.op9_sentence_pieces,
        "op10_document_fingerprints": fingerprints.op10_document_fingerprints,
        "op11_suffix_array_dedup": suffix_dedup.op11_suffix_array_dedup,
        "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
        "op13_conversation_prefix_trie": conversation_trie.op13_conversation_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_benchmark_decontamination": decontamination.SQL, "op6_substring_dedup": substring_dedup.SQL, "op7_url_filters": url_filter.SQL,
        "op11_suffix_array_dedup": suffix_dedup.SQL, "op12_fill_in_middle": fill_in_middle.SQL, "op13_conversation_prefix_trie": conversation_trie.SQL,
    }
