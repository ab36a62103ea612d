"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from tidegrid.llm import byte_bpe, chat_template, language_id, mixing, multiset_fp, near_dup, onebit_ann, quality, resampling, sharding, spelling, toxicity, url_rules

QUERIES = {
    "op1_minhash_near_dup": near_dup.op1_minhash_near_dup,
    "op2_jump_sharding": sharding.op2_jump_sharding,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_url_rules": url_rules.op4_url_rules,
    "op5_soft_mixing": mixing.op5_soft_mixing,
    "op6_multiset_fingerprints": multiset_fp.op6_multiset_fingerprints,
    "op7_chat_template": chat_template.op7_chat_template,
    "op8_onebit_ann": onebit_ann.op8_onebit_ann,
    "op9_language_id": language_id.op9_language_id,
    "op10_byte_bpe": byte_bpe.op10_byte_bpe,
    "op11_resampling": resampling.op11_resampling,
    "op12_quality_rules": quality.op12_quality_rules,
    "op13_spelling": spelling.op13_spelling,
}
ORACLES = {
    "op2_jump_sharding": sharding.OP2_SQL,
    "op4_url_rules": url_rules.OP4_SQL,
    "op5_soft_mixing": mixing.OP5_SQL,
    "op11_resampling": resampling.OP11_SQL,
    "op13_spelling": spelling.OP13_SQL,
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
