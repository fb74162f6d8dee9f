"""Queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import ann, bpe, conversation_trie, decontam, importance, langid, licenses, quality, secret_scan, simhash, substring_dedup, token_pack, toxicity

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_langid": langid.op2_langid,
    "op3_token_pack": token_pack.op3_token_pack,
    "op4_simhash": simhash.op4_simhash,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_decontam": decontam.op6_decontam,
    "op7_secrets": secret_scan.op7_secrets,
    "op8_bpe": bpe.op8_bpe,
    "op9_ann": ann.op9_ann,
    "op10_licenses": licenses.op10_licenses,
    "op11_trie": conversation_trie.op11_trie,
    "op12_quality": quality.op12_quality,
    "op13_importance": importance.op13_importance,
}
ORACLES = {"op1_substring_dedup": substring_dedup.ORACLE, "op6_decontam": decontam.ORACLE, "op10_licenses": licenses.ORACLE, "op11_trie": conversation_trie.ORACLE, "op13_importance": importance.ORACLE}
