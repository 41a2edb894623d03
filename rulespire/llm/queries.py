"""Registered queries of this package and their SQL."""

from __future__ import annotations

from rulespire.llm import chat, decontamination, embeddings, language, language_model, lines, manifest, mixing, near_dedup, sharding, structure, substrings, tokens

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_weighted_mix": mixing.op2_weighted_mix,
    "op3_language_id": language.op3_language_id,
    "op4_token_files": tokens.op4_token_files,
    "op5_line_alignment": lines.op5_line_alignment,
    "op6_cross_polytope": embeddings.op6_cross_polytope,
    "op7_chat_format": chat.op7_chat_format,
    "op8_chosen_path": near_dedup.op8_chosen_path,
    "op9_ring_shards": sharding.op9_ring_shards,
    "op10_log_bilinear": language_model.op10_log_bilinear,
    "op11_substring_dedup": substrings.op11_substring_dedup,
    "op12_structure_repair": structure.op12_structure_repair,
    "op13_merkle_manifest": manifest.op13_merkle_manifest,
}
ORACLES = {
    "op1_decontamination": decontamination.ORACLE,
    "op2_weighted_mix": mixing.ORACLE,
    "op7_chat_format": chat.ORACLE,
    "op11_substring_dedup": substrings.ORACLE,
    "op12_structure_repair": structure.ORACLE,
    "op13_merkle_manifest": manifest.ORACLE,
}
