"""Queries of this subpackage by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, html_text, language_id, licences, minhash, repair, sentencepiece_bpe, topk, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": sentencepiece_bpe.op1,
    "op2_repair_ids": repair.op2,
    "op3_language_id": language_id.op3,
    "op4_topk": topk.op4,
    "op5_licences": licences.op5,
    "op6_toxicity": toxicity.op6,
    "op7_html_text": html_text.op7,
    "op8_chat": chat.op8,
    "op9_decontaminate": decontaminate.op9,
    "op10_near_duplicates": minhash.op10,
}

ORACLE_SQL: dict[str, str] = {
    "op4_topk": topk.ORACLE,
    "op9_decontaminate": decontaminate.ORACLE,
}
