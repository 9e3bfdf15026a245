"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import chat_format, embedding_dedup, html_render, mixing, piece_codec, quality_classifier, quality_rules, simhash, simhash_sql, suffix_dedup, url_filter

QUERIES = {
    "op1_quality_rules": quality_rules.query,
    "op2_suffix_dedup": suffix_dedup.query,
    "op3_mixing": mixing.query,
    "op4_piece_codec": piece_codec.query,
    "op5_embedding_dedup": embedding_dedup.query,
    "op6_url_filter": url_filter.query,
    "op7_quality_classifier": quality_classifier.query,
    "op8_html_render": html_render.query,
    "op9_chat_format": chat_format.query,
    "op10_simhash": simhash.query,
}

SQL = {
    "op1_quality_rules": quality_rules.SQL,
    "op2_suffix_dedup": suffix_dedup.SQL,
    "op3_mixing": mixing.SQL,
    "op5_embedding_dedup": embedding_dedup.SQL,
    "op6_url_filter": url_filter.SQL,
    "op7_quality_classifier": quality_classifier.SQL,
    "op8_html_render": html_render.SQL,
    "op9_chat_format": chat_format.SQL,
    "op10_simhash": simhash_sql.SQL,
}
