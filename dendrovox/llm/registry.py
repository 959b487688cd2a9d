"""Queries of the subpackage and their SQL."""

from __future__ import annotations

from dendrovox.llm import byte_bpe, decontaminate, embeddings, line_dedup, merkle, phrases, quality, shards, simhash, token_counts, token_files, topk, toxicity


def queries() -> dict:
    import corpus_pipeline

    return {
        "op1_token_counts": token_counts.op1_token_counts,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_simhash": simhash.op3_simhash,
        "op4_token_files": token_files.op4_token_files,
        "op5_line_dedup": line_dedup.op5_line_dedup,
        "op6_hnsw": embeddings.op6_hnsw,
        "op7_quality": quality.op7_quality,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_hilbert_shards": shards.op9_hilbert_shards,
        "op10_byte_bpe": byte_bpe.op10_byte_bpe,
        "op11_merkle": merkle.op11_merkle,
        "op12_kd_search": topk.op12_kd_search,
        "op13_collocations": phrases.op13_collocations,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontaminate": decontaminate.ORACLE_OP2,
        "op11_merkle": merkle.ORACLE_OP11,
        "op12_kd_search": topk.ORACLE_OP12,
        "op13_collocations": phrases.ORACLE_OP13,
    }
