"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from evigraph.llm import alignment, language_id, line_dedup, mixing, packing, quality_model, quality_rules, secret_scan, simhash, suffix_dedup, vector_codes, vector_graph, winnowing


def queries() -> dict:
    return {
        "op1_secret_scans": secret_scan.op1_secret_scans,
        "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
        "op3_language_id": language_id.op3_language_id,
        "op4_quality_classifier": quality_model.op4_quality_classifier,
        "op5_packing": packing.op5_packing,
        "op6_document_fingerprints": winnowing.op6_document_fingerprints,
        "op7_simhash_near_dedup": simhash.op7_simhash_near_dedup,
        "op8_mixing": mixing.op8_mixing,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op10_quality_rules": quality_rules.op10_quality_rules,
        "quality_ablation": quality_rules.quality_ablation,
        "op11_alignment": alignment.op11_alignment,
        "op12_near_vectors": vector_graph.op12_near_vectors,
        "op13_vector_codes": vector_codes.op13_vector_codes,
    }


def oracle_sql() -> dict:
    return {
        "op8_mixing": mixing.OP8_SQL,
        "op9_line_dedup": line_dedup.OP9_SQL,
        "op10_quality_rules": quality_rules.OP10_SQL,
        "quality_ablation": quality_rules.QUALITY_ABLATION_SQL,
        "op12_near_vectors": vector_graph.OP12_SQL,
        "op13_vector_codes": vector_codes.OP13_SQL,
    }
