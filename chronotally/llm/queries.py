"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import attention_lm, content_store, decontaminate, jaccard_join, licences, packing, personal_data, quality_knn, quality_rules, recompression
from .shared import documents


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_recompression": lambda spark, sf_dir: recompression.op1(spark, documents(spark, sf_dir)),
        "op2_attention_lm": lambda spark, sf_dir: attention_lm.op2(spark, documents(spark, sf_dir)),
        "op3_packing": lambda spark, sf_dir: packing.op3(spark, documents(spark, sf_dir)),
        "op4_content_store": lambda spark, sf_dir: content_store.op4(spark, documents(spark, sf_dir)),
        "op5_quality_rules": quality_rules.op5,
        "op6_quality_knn": quality_knn.op6,
        "op7_decontamination": decontaminate.op7,
        "op8_licences": lambda spark, sf_dir: licences.op8(spark, documents(spark, sf_dir)),
        "op9_jaccard_join": lambda spark, sf_dir: jaccard_join.op9(spark, documents(spark, sf_dir)),
        "op10_personal_data": lambda spark, sf_dir: personal_data.op10(spark, documents(spark, sf_dir)),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_recompression": recompression.sql(), "op8_licences": licences.sql(), "op9_jaccard_join": jaccard_join.sql()}
