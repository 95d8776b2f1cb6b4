"""Queries of the operators of this package, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import quality_rules as rules, url_filters, warc
from tessera.llm.decontamination import decontamination
from tessera.llm.jaccard_join import jaccard_join
from tessera.llm.katz import lm_scoring
from tessera.llm.packing import packing
from tessera.llm.quality_classifier import quality_classifier
from tessera.llm.quality_rules import quality_rules
from tessera.llm.token_counts import token_counts
from tessera.llm.toxicity import toxicity



def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": decontamination,
        "op2_packing": packing,
        "op3_token_counts": token_counts,
        "op4_quality_rules": quality_rules,
        "op5_quality_classifier": quality_classifier,
        "op6_warc": warc.warc,
        "op7_jaccard_join": jaccard_join,
        "op8_url_filters": url_filters.url_filters,
        "op9_lm_scoring": lm_scoring,
        "op10_toxicity": toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_quality_rules": rules.SQL,
        "op6_warc": warc.SQL,
        "op8_url_filters": url_filters.SQL,
    }
