"""Registered training-data queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from lectern.llm import (decontaminate, divergence, html_text, language, lines, minhash, mixing, packing, pii, quality, secrets, simhash,
                         whitening)
from lectern.llm.common import prepare, table

QueryFn = Callable[[SparkSession, str], DataFrame]


def _documents(build: Callable[[DataFrame], DataFrame]) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return build(table(spark, sf_dir, "documents"))
    return run


def _decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return decontaminate.op10_decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return html_text.op8_main_text(table(spark, sf_dir, "pages"))


def _whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return whitening.op12_whitening(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, QueryFn]:
    return {
        "op1_simhash": _documents(simhash.op1_simhash),
        "op2_mix": _documents(mixing.op2_mix),
        "op3_secrets": _documents(secrets.op3_secrets),
        "op4_pack": _documents(packing.op4_pack),
        "op5_lines": _documents(lines.op5_lines),
        "op6_quality": _documents(quality.op6_quality),
        "op7_language": _documents(language.op7_language),
        "op8_main_text": _main_text,
        "op9_pii": _documents(pii.op9_pii),
        "op10_decontaminate": _decontaminate,
        "op11_divergence": _documents(divergence.op11_divergence),
        "op12_whitening": _whitening,
        "op13_fingerprints": _documents(minhash.op13_fingerprints),
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    out = {
        "op2_mix": mixing.SQL,
        "op6_quality": quality.SQL,
        "op10_decontaminate": decontaminate.SQL,
        "op11_divergence": divergence.SQL,
    }
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
