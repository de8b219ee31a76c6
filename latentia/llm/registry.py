"""The queries of this package and their SQL, for the entry module."""

from __future__ import annotations

from latentia.llm import katz, language_id, line_dedup, mixing, near_dedup, packing, quality, token_count, url_filter, winnowing


def queries() -> dict:
    return {
        "op1_language_id": language_id.op1_language_id,
        "op2_katz": katz.op2_katz,
        "op3_url_filter": url_filter.op3_url_filter,
        "op4_token_count": token_count.op4_token_count,
        "op5_near_dedup": near_dedup.op5_near_dedup,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op6_quality": quality.op6_quality,
        "op7_winnowing": winnowing.op7_winnowing,
        "op9_pack": packing.op9_pack,
        "op10_mix": mixing.op10_mix,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": url_filter.ORACLE_SQL}
