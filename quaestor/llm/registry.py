"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from quaestor.llm import chat, decontaminate, exact_dedup, html_extract, langid, lm_score, mixing, quality, simhash, warc

_OPERATORS = {
    "op1_exact_dedup": exact_dedup,
    "op2_html_extract": html_extract,
    "op3_lm_score": lm_score,
    "op4_format_chat": chat,
    "op5_simhash_near_dedup": simhash,
    "op6_mix_sources": mixing,
    "op7_quality_classifier": quality,
    "op8_language_id": langid,
    "op9_warc_revisits": warc,
    "op10_decontaminate": decontaminate,
}


def queries() -> dict:
    return {name: module.query for name, module in _OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in _OPERATORS.items() if getattr(module, "SQL", None)}
