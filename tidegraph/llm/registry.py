"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from tidegraph.llm import decontaminate, gru_lm, knn, language, line_dedup, minhash, pieces, quality, suffixes, transcripts

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_minhash_dedup": minhash.op2_minhash_dedup,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_language_id": language.op5_language_id,
    "op6_suffix_dedup": suffixes.op6_suffix_dedup,
    "op7_chat_format": transcripts.op7_chat_format,
    "op8_quality_classifier": knn.op8_quality_classifier,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_lm_scoring": gru_lm.op10_lm_scoring,
}

ORACLE_SQL = {
    "op4_quality_rules": quality.OP4_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
}
