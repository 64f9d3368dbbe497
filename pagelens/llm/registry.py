"""The queries of this subpackage by name, and the SQL that checks them where SQL can."""

from __future__ import annotations

from pagelens.llm import byte_bpe, jaccard_join, language_id, quality_model, quality_rules, secret_scan, source_mix, token_files, topk_search, url_filter


def queries() -> dict:
    return {
        "op1_topk_search": topk_search.op1_topk_search,
        "op2_url_filter": url_filter.op2_url_filter,
        "op3_quality_model": quality_model.op3_quality_model,
        "op4_secret_scan": secret_scan.op4_secret_scan,
        "op5_language_id": language_id.op5_language_id,
        "op6_jaccard_join": jaccard_join.op6_jaccard_join,
        "op7_token_files": token_files.op7_token_files,
        "op8_quality_rules": quality_rules.op8_quality_rules,
        "op9_source_mix": source_mix.op9_source_mix,
        "op10_byte_bpe": byte_bpe.op10_byte_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_topk_search": topk_search.ORACLE}
