"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from quarrylens.llm import (
    op1_language_id,
    op2_jaccard_join,
    op3_suffix_array,
    op4_decontamination,
    op5_toxicity,
    op6_embedding_dedup,
    op7_substring_dedup,
    op8_chat,
    op9_packing,
    op10_sharding,
    op11_lm,
    op12_alignment,
    op13_merkle,
)

QUERIES = {
    "op1_language_id": op1_language_id.op1_language_id,
    "op2_partenum_join": op2_jaccard_join.op2_partenum_join,
    "op3_suffix_array_dedup": op3_suffix_array.op3_suffix_array_dedup,
    "op4_minhash_containment": op4_decontamination.op4_minhash_containment,
    "op5_toxicity": op5_toxicity.op5_toxicity,
    "op6_hyperplane_neardup": op6_embedding_dedup.op6_hyperplane_neardup,
    "op7_suffix_tree_dedup": op7_substring_dedup.op7_suffix_tree_dedup,
    "op8_chat_formatting": op8_chat.op8_chat_formatting,
    "op9_cost_balanced_packing": op9_packing.op9_cost_balanced_packing,
    "op10_sampled_splitters": op10_sharding.op10_sampled_splitters,
    "op11_gated_recurrent_lm": op11_lm.op11_gated_recurrent_lm,
    "op12_tokenizer_alignment": op12_alignment.op12_tokenizer_alignment,
    "op13_merkle_manifest": op13_merkle.op13_merkle_manifest,
}

ORACLES = {
    "op2_partenum_join": op2_jaccard_join.ORACLE,
    "op6_hyperplane_neardup": op6_embedding_dedup.ORACLE,
    "op7_suffix_tree_dedup": op7_substring_dedup.ORACLE,
    "op8_chat_formatting": op8_chat.ORACLE,
    "op13_merkle_manifest": op13_merkle.ORACLE,
}
