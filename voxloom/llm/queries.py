"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import byte_bpe, conversation_repair, exact_dedup, fill_in_middle, jaccard_join, language_id, lm_scoring, packing, pii, quality_rules, secret_scan, sentencepiece_codec, suffix_dedup


def queries():
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
        "op3_jaccard_join": jaccard_join.op3_jaccard_join,
        "op4_sentencepiece": sentencepiece_codec.op4_sentencepiece,
        "op5_secret_scan": secret_scan.op5_secret_scan,
        "op6_lm_scoring": lm_scoring.op6_lm_scoring,
        "op7_best_fit_packing": packing.op7_best_fit_packing,
        "op8_language_id": language_id.op8_language_id,
        "op9_pii": pii.op9_pii,
        "op10_quality_rules": quality_rules.op10_quality_rules,
        "op11_byte_bpe": byte_bpe.op11_byte_bpe,
        "op12_conversation_repair": conversation_repair.op12_conversation_repair,
        "op13_fill_in_middle": fill_in_middle.op13_fill_in_middle,
    }


def oracle_sql():
    return {
        "op1_exact_dedup": exact_dedup.OP1_SQL,
        "op2_suffix_dedup": suffix_dedup.OP2_SQL,
        "op3_jaccard_join": jaccard_join.OP3_SQL,
        "op12_conversation_repair": conversation_repair.OP12_SQL,
        "op13_fill_in_middle": fill_in_middle.OP13_SQL,
    }
