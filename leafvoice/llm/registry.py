"""Queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from leafvoice.llm import alignment, chat, decontaminate, fmindex, minhash, mixing, quality, ranking, ring, rules, suffixarray, suffixtree, tokens

QUERIES = {
    "op1_pu_quality": quality.op1_pu_quality,
    "op2_token_packs": tokens.op2_token_packs,
    "op3_minhash_near_dedup": minhash.op3_minhash_near_dedup,
    "op4_pareto_mixing": mixing.op4_pareto_mixing,
    "op5_decision_rules": rules.op5_decision_rules,
    "op6_chat_formatting": chat.op6_chat_formatting,
    "op7_suffix_array_dedup": suffixarray.op7_suffix_array_dedup,
    "op8_benchmark_decontamination": decontaminate.op8_benchmark_decontamination,
    "op9_fm_index_dedup": fmindex.op9_fm_index_dedup,
    "op10_suffix_tree_scores": suffixtree.op10_suffix_tree_scores,
    "op11_token_alignment": alignment.op11_token_alignment,
    "op12_ring_shards": ring.op12_ring_shards,
    "op13_hybrid_search": ranking.op13_hybrid_search,
}
ORACLES = {"op6_chat_formatting": chat.OP6_SQL, "op13_hybrid_search": ranking.OP13_SQL}
