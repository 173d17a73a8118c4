"""Queries of this subpackage: name -> function of (spark, sf_dir), and their DuckDB SQL where there is one."""

from __future__ import annotations

from lodestone.llm import centroid_clustering, exact_dedup, importance_resampling, jaccard_join, line_dedup, media_jpeg, packing, piece_codec, quality_crf, quality_rules, suffix_dedup, toxicity, url_filter

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_quality_crf": quality_crf.op3_quality_crf,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_packing": packing.op5_packing,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_media_jpeg": media_jpeg.op7_media_jpeg,
    "op8_sentencepiece": piece_codec.op8_sentencepiece,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_quality_rules": quality_rules.op11_quality_rules,
    "op12_centroid_clustering": centroid_clustering.op12_centroid_clustering,
    "op13_importance_resampling": importance_resampling.op13_importance_resampling,
}

ORACLE_SQL = {
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op4_line_dedup": line_dedup.OP4_SQL,
    "op6_url_filter": url_filter.OP6_SQL,
    "op11_quality_rules": quality_rules.OP11_SQL,
    "op12_centroid_clustering": centroid_clustering.OP12_SQL,
    "op13_importance_resampling": importance_resampling.OP13_SQL,
}
