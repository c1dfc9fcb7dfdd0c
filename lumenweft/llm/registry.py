"""The queries of this subpackage and the SQL that states them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenweft.llm import block_dedup, bpe, chat_format, hard_negatives, language, main_text, packing, quality, secret_ledger, set_join, token_files, topk, turn_repair

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

for _module in (main_text, quality, language, token_files, set_join, bpe, packing, block_dedup, secret_ledger, topk, turn_repair, hard_negatives, chat_format):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
