"""The queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import byte_bpe, embeddings, exact_dedup, language_id, minhash, mixing, piece_count, sharding, substring_dedup, toxicity


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op10_language_id": language_id.op10_language_id,
        "op2_embedding_near_dedup": embeddings.op2_embedding_near_dedup,
        "op3_mixing": mixing.op3_mixing,
        "op4_bpe": byte_bpe.op4_bpe,
        "op5_minhash_near_dedup": minhash.op5_minhash_near_dedup,
        "op6_token_counts": piece_count.op6_token_counts,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_hilbert_sharding": sharding.op8_hilbert_sharding,
        "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    }


def oracle_sql() -> dict:
    return {"op7_exact_dedup": exact_dedup.OP7_SQL}
