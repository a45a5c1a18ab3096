"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodetext.llm import audio, html_text, licenses, mixing, packing, quality, simhash, topk, toxicity, warc
from lodetext.llm.shared import prepared


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepared(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = {
        "op1_chroma": audio.op1_chroma,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_mixing": mixing.op3_mixing,
        "op4_topk": topk.op4_topk,
        "op5_warc": warc.op5_warc,
        "op6_quality": quality.op6_quality,
        "op7_html_text": html_text.op7_html_text,
        "op8_simhash": simhash.op8_simhash,
        "op9_licenses": licenses.op9_licenses,
        "op10_packing": packing.op10_packing,
    }
    return {name: shipped(query) for name, query in named.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_mixing": mixing.OP3_SQL,
        "op5_warc": warc.OP5_SQL,
        "op9_licenses": licenses.op9_sql(),
    }
