"""Queries of this folder's operators and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crawlgrain.llm import (
    bpe, decontaminate, divergence, fim, language_id, licenses, mixing, near_dedup, pii, quality, repeated_bytes, token_files, url_filter,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_token_files": token_files.op2_token_files,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_pii": pii.op4_pii,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_language_id": language_id.op6_language_id,
    "op7_licenses": licenses.op7_licenses,
    "op8_repeated_bytes": repeated_bytes.op8_repeated_bytes,
    "op9_quality": quality.op9_quality,
    "op10_bpe": bpe.op10_bpe,
    "op11_mixing": mixing.op11_mixing,
    "op12_divergence": divergence.op12_divergence,
    "op13_fim": fim.op13_fim,
}

ORACLES: dict[str, str] = {
    "op3_url_filter": url_filter.oracle(),
    "op7_licenses": licenses.oracle(),
    "op9_quality": quality.ORACLE,
    "op12_divergence": divergence.ORACLE,
    "op13_fim": fim.ORACLE,
}
