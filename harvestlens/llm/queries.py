"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from harvestlens.llm import byte_cnn, caps, chat, dom_model, license_scan, mixing, passages, secrets, simhash, spelling, tiling, token_align, url_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_substring_dedup": passages.op2_substring_dedup,
    "op3_decontaminate": tiling.op3_decontaminate,
    "op4_url_filter": url_rules.op4_url_filter,
    "op5_html_extraction": dom_model.op5_html_extraction,
    "op6_simhash_near_dedup": simhash.op6_simhash,
    "op7_mixing": mixing.op7_mixing,
    "op8_chat_format": chat.op8_chat_format,
    "op9_spherical_caps": caps.op9_spherical_caps,
    "op10_quality": byte_cnn.op10_quality,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_token_alignment": token_align.op12_token_alignment,
    "op13_secret_scan": secrets.op13_secret_scan,
}
# The others fit models, read texts back or follow links through components; their tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op1_license_scan": license_scan.scan_sql(), "op8_chat_format": chat.digests_sql(), "op13_secret_scan": secrets.scan_sql()}
