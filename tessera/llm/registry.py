"""Queries of the corpus operators, by the name the driver calls them."""

from __future__ import annotations

from . import bpe, exact_dedup, langid, line_dedup, near_join, packing, quality, token_counts, token_files, urls

QUERIES = {
    "op1_ngram_jaccard_join": near_join.op1_ngram_jaccard_join,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_packing": packing.op4_packing,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_language_id": langid.op7_language_id,
    "op8_url_filters": urls.op8_url_filters,
    "op9_token_files": token_files.op9_token_files,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}
#: DuckDB twins, where SQL can express the operator.
ORACLES = {"op1_ngram_jaccard_join": near_join.OP1_SQL, "op3_quality_rules": quality.OP3_SQL, "op6_exact_dedup": exact_dedup.OP6_SQL, "op10_line_dedup": line_dedup.OP10_SQL}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
