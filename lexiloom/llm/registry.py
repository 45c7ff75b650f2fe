"""Queries of this subpackage and, where SQL can express one, its DuckDB form."""

from __future__ import annotations

from lexiloom.llm import exact_dedup, html_blocks, language_id, media, mixing, near_dedup, piece_dropout, secret_scan, token_count, token_orc


def queries() -> dict:
    return {
        "op1_language_id": language_id.query,
        "op2_near_dedup": near_dedup.query,
        "op3_matroska": media.query,
        "op4_token_orc": token_orc.query,
        "op5_exact_dedup": exact_dedup.query,
        "op6_token_count": token_count.query,
        "op7_secret_scan": secret_scan.query,
        "op8_piece_dropout": piece_dropout.query,
        "op9_mixing": mixing.query,
        "op10_html_blocks": html_blocks.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_near_dedup": near_dedup.SQL, "op5_exact_dedup": exact_dedup.SQL, "op9_mixing": mixing.SQL, "op10_html_blocks": html_blocks.SQL}
