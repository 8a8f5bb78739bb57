"""The queries of this subpackage and the DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import context_tree, fingerprint, language_id, main_text, media, merkle, minhash, mixing, packing, secret_scan, token_store, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_huffman_tokens": token_store.op1_huffman_tokens,
    "op2_viterbi_language": language_id.op2_viterbi_language,
    "op3_consistent_sampling": fingerprint.op3_consistent_sampling,
    "op4_conflict_best_fit": packing.op4_conflict_best_fit,
    "op5_context_tree_score": context_tree.op5_context_tree_score,
    "op6_noisy_or_toxicity": toxicity.op6_noisy_or_toxicity,
    "op7_fast_sketch_dedup": minhash.op7_fast_sketch_dedup,
    "op8_randomness_battery": secret_scan.op8_randomness_battery,
    "op9_lossless_webp": media.op9_lossless_webp,
    "op10_curriculum_mix": mixing.op10_curriculum_mix,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_line_blocks": main_text.op12_line_blocks,
}

ORACLES: dict[str, str] = {
    "op7_fast_sketch_dedup": minhash.ORACLE_OP7,
    "op10_curriculum_mix": mixing.ORACLE_OP10,
    "op11_merkle_manifest": merkle.ORACLE_OP11,
}
