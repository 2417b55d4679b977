"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from glyphlake.llm import bpe, conversations, exact_dedup, html_text, licenses, manifest, near_join, packing, personal_data, quality_model, quality_rules, secret_scan, sharding

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_packing": packing.op3_packing,
    "op4_ngram_jaccard": near_join.op4_ngram_jaccard,
    "op5_sharding": sharding.op5_sharding,
    "op6_quality_classifier": quality_model.op6_quality_classifier,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_pii": personal_data.op8_pii,
    "op9_html_extraction": html_text.op9_html_extraction,
    "op10_bpe": bpe.op10_bpe,
    "op11_conversation_repair": conversations.op11_conversation_repair,
    "op12_merkle_manifest": manifest.op12_merkle_manifest,
    "op13_secret_scan": secret_scan.op13_secret_scan,
}
ORACLES = {"op2_exact_dedup": exact_dedup.ORACLE, "op11_conversation_repair": conversations.ORACLE, "op12_merkle_manifest": manifest.ORACLE}
