"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from quillspark.llm import bpe, html_extract, importance, knn, lm_score, near_dup, packing, pii, quality, simhash, spelling, token_counts, url_filter


def queries() -> dict:
    return {
        "op1_knn": knn.op1_knn,
        "op2_pii": pii.op2_pii,
        "op3_quality": quality.op3_quality,
        "op4_packing": packing.op4_packing,
        "op5_near_dedup": near_dup.op5_near_dedup,
        "op6_bpe": bpe.op6_bpe,
        "op7_token_counts": token_counts.op7_token_counts,
        "op8_lm_score": lm_score.op8_lm_score,
        "op9_simhash": simhash.op9_simhash,
        "op10_url_filter": url_filter.op10_url_filter,
        "op11_importance": importance.op11_importance,
        "op12_spelling": spelling.op12_spelling,
        "op13_html": html_extract.op13_html,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_knn": knn.ORACLE_SQL,
        "op2_pii": pii.ORACLE_SQL,
        "op5_near_dedup": near_dup.ORACLE_SQL,
        "op8_lm_score": lm_score.ORACLE_SQL,
        "op10_url_filter": url_filter.ORACLE_SQL,
        "op11_importance": importance.ORACLE_SQL,
        "op12_spelling": spelling.ORACLE_SQL,
    }
