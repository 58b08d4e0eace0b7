"""The queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from . import ann, audit, chat, dac, decontaminate, htmltext, importance, jaccard, langid, mixing, quality, shards, suffixes

QUERIES = {
    "op1_mixing": mixing.query,
    "op2_decontaminate": decontaminate.query,
    "op3_suffix_dedup": suffixes.query,
    "op4_ngram_jaccard": jaccard.query,
    "op5_token_ids": dac.query,
    "op6_language_id": langid.query,
    "op7_multi_index_ann": ann.query,
    "op8_html_text": htmltext.query,
    "op9_chat_format": chat.query,
    "op10_quality": quality.query,
    "op11_importance": importance.query,
    "op12_filter_audit": audit.query,
    "op13_shards": shards.query,
}
ORACLES: dict[str, str] = {
    "op1_mixing": mixing.ORACLE,
    "op9_chat_format": chat.ORACLE,
    "op11_importance": importance.ORACLE,
    "op12_filter_audit": audit.ORACLE,
    "op13_shards": shards.ORACLE,
}
