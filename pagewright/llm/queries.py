"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontam, lang_id, line_dedup, mixing, near_dup, quality_model, quality_rules, repeats, token_counts, toxicity

QUERIES = {
    "op1_remove_repeats": repeats.op1_remove_repeats,
    "op2_decontaminate": decontam.op2_decontaminate,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_language_id": lang_id.op6_language_id,
    "op7_near_duplicates": near_dup.op7_near_duplicates,
    "op8_quality_classifier": quality_model.op8_quality_classifier,
    "op9_curriculum_mix": mixing.op9_curriculum_mix,
    "op9_training_order": mixing.op9_training_order,
    "op10_toxicity": toxicity.op10_toxicity,
}

ORACLE_SQL = {
    "op2_decontaminate": decontam.OP2_SQL,
    "op4_line_dedup": line_dedup.OP4_SQL,
    "op9_curriculum_mix": mixing.OP9_SQL,
}
