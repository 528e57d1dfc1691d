"""The subpackage's queries and, where SQL can express them, the SQL that states their results."""

from __future__ import annotations

import corpus_pipeline

from palaver.llm import chat, decontaminate, jaccard, langid, linededup, lm, merkle, mixing, pii, quality, repeats, resampling, toxicity


def queries() -> dict:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_byte_network_language_id": langid.op1_byte_network_language_id,
        "op2_prefix_filtered_decontamination": decontaminate.op2_prefix_filtered_decontamination,
        "op3_gated_network_toxicity": toxicity.op3_gated_network_toxicity,
        "op4_site_spread_line_dedup": linededup.op4_site_spread_line_dedup,
        "op5_sainte_lague_mixing": mixing.op5_sainte_lague_mixing,
        "op6_parity_sketch_join": jaccard.op6_parity_sketch_join,
        "op7_weak_supervision_quality": quality.op7_weak_supervision_quality,
        "op8_log_bilinear_scoring": lm.op8_log_bilinear_scoring,
        "op9_deep_shallow_dedup": repeats.op9_deep_shallow_dedup,
        "op10_snapshot_collapse_chat": chat.op10_snapshot_collapse_chat,
        "op11_merkle_traversal_manifest": merkle.op11_merkle_traversal_manifest,
        "op12_bootstrapped_pii": pii.op12_bootstrapped_pii,
        "op13_trie_importance_resampling": resampling.op13_trie_importance_resampling,
    }


def oracle_sql() -> dict:
    return {
        "op2_prefix_filtered_decontamination": decontaminate.ORACLE,
        "op4_site_spread_line_dedup": linededup.ORACLE,
        "op6_parity_sketch_join": jaccard.ORACLE,
        "op10_snapshot_collapse_chat": chat.ORACLE,
        "op11_merkle_traversal_manifest": merkle.ORACLE,
        "op13_trie_importance_resampling": resampling.ORACLE,
    }
