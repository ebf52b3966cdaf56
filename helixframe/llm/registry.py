"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from helixframe.llm import embeddings, exact_dedup, filter_audit, jaccard, language, lm_score, packing, pii, sentence_pieces, substring_dedup, token_alignment, warc, window_dedup

QUERIES = {
    "op1_embedding_near_dedup": embeddings.op1_embedding_near_dedup,
    "op2_sentencepiece": sentence_pieces.op2_sentencepiece,
    "op3_language_id": language.op3_language_id,
    "op4_ngram_jaccard_join": jaccard.op4_ngram_jaccard_join,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_warc": warc.op6_warc,
    "op7_lm_scoring": lm_score.op7_lm_scoring,
    "op8_packing": packing.op8_packing,
    "op9_suffix_array_dedup": substring_dedup.op9_suffix_array_dedup,
    "op10_pii_crf": pii.op10_pii_crf,
    "op11_window_dedup": window_dedup.op11_window_dedup,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_token_alignment": token_alignment.op13_token_alignment,
}

ORACLE_SQL = {
    "op1_embedding_near_dedup": embeddings.ORACLE,
    "op4_ngram_jaccard_join": jaccard.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op6_warc": warc.ORACLE,
    "op9_suffix_array_dedup": substring_dedup.ORACLE,
    "op11_window_dedup": window_dedup.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
}
