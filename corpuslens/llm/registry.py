"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from corpuslens.llm import decontaminate, fill_in_middle, jaccard_join, language_id, license_scan, order_minhash, pii, piece_codec, quality_rules, token_binary, token_counts, toxicity, whitening

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_language_id": language_id.op4_language_id,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_token_binary": token_binary.op7_token_binary,
    "op8_sentencepiece": piece_codec.op8_sentencepiece,
    "op9_pii": pii.op9_pii,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_embedding_whitening": whitening.op11_embedding_whitening,
    "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
    "op13_document_fingerprints": order_minhash.op13_document_fingerprints,
}
ORACLES = {"op10_quality_rules": quality_rules.ORACLE, "op12_fill_in_middle": fill_in_middle.ORACLE}
