"""The queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from marksmith.llm import (alignment, decontamination, exact_dedup, filter_audit, html_extract,
                           language_id, near_join, packing, personal_data, sentencepiece_codec,
                           substring_dedup, token_counts, url_filter)

QUERIES = {f.__name__: f for f in (
    decontamination.op1_decontamination,
    sentencepiece_codec.op2_sentencepiece,
    url_filter.op3_url_filter,
    near_join.op4_near_join,
    personal_data.op5_personal_data,
    html_extract.op6_html_extract,
    language_id.op7_language_id,
    exact_dedup.op8_exact_dedup,
    substring_dedup.op9_substring_dedup,
    token_counts.op10_token_counts,
    filter_audit.op11_filter_audit,
    packing.op12_packing,
    alignment.op13_alignment,
)}

ORACLE = {
    "op4_near_join": near_join.ORACLE_SQL,
    "op8_exact_dedup": exact_dedup.ORACLE_SQL,
    "op11_filter_audit": filter_audit.ORACLE_SQL,
}
