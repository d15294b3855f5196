"""Queries of the training-data operators and their DuckDB SQL."""

from plumbline.llm import byte_bpe, chat_windows, dominance_packing, embedding_dedup, order_minhash, quality_cascade, quality_gbt, token_matrices, toxicity_ftrl, url_filter

QUERIES = {
    "op1_embedding_dedup": embedding_dedup.op1_embedding_dedup,
    "op2_best_fit_packing": dominance_packing.op2_best_fit_packing,
    "op3_url_filters": url_filter.op3_url_filters,
    "op4_token_matrices": token_matrices.op4_token_matrices,
    "op5_quality_classifier": quality_gbt.op5_quality_classifier,
    "op6_byte_level_bpe": byte_bpe.op6_byte_level_bpe,
    "op7_toxicity": toxicity_ftrl.op7_toxicity,
    "op8_minhash_near_dedup": order_minhash.op8_minhash_near_dedup,
    "op9_quality_rules": quality_cascade.op9_quality_rules,
    "op10_chat_formatting": chat_windows.op10_chat_formatting,
}

ORACLES = {
    "op1_embedding_dedup": embedding_dedup.ORACLE,
    "op3_url_filters": url_filter.ORACLE,
    "op9_quality_rules": quality_cascade.ORACLE,
}
