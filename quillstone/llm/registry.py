"""Queries of this subpackage's operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import conversations, filter_audit, html_text, language_id, license_scan, mixing, near_dedup, order_minhash, pieces, private_data, substrings, top_k, url_rules

MODULES = (order_minhash, license_scan, near_dedup, mixing, language_id, private_data, top_k, html_text, pieces, substrings, url_rules, filter_audit, conversations)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    m.NAME: m.query for m in MODULES
}
ORACLES: dict[str, str] = {m.NAME: m.ORACLE for m in MODULES if m.ORACLE}
