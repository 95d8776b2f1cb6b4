"""A training corpus from ``documents``: quality, toxicity, near copies, benchmark passages, then packing.

Each stage is (name, function of (spark, docs, sf_dir)); its result is written as Parquet and read back as the next one's docs. All
but the last return the columns of ``documents``. A table without rows passes through; rows without id, and rows that repeat one, are judged
like others, each for itself; further columns go along.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontamination, jaccard_join, packing, quality_classifier, toxicity
from tessera.llm.common import discard, forget, load, materialise

#: Intermediate tables of the last stage that this thread called.
_last = threading.local()


def _stage(step: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A later stage begins when the one before was written and read back, so that one's intermediate tables can go."""

    @wraps(step)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if step.__name__ != "quality":
            discard(spark, getattr(_last, "made", []))
        forget()
        out = step(spark, docs, sf_dir)
        _last.made = forget()
        return out

    return run_stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose quality score is below the classifier's threshold."""
    model = quality_classifier.fit(docs, load(spark, sf_dir, "labels"))
    return quality_classifier.keep(docs, model)


@_stage
def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are scored as toxic."""
    model = toxicity.fit(docs, load(spark, sf_dir, "labels"))
    return toxicity.keep(docs, model)


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that shares 80 in 100 of its runs of five words, link by link, the document with the least id stays."""
    return jaccard_join.keep(docs, n=5, threshold=80)


@_stage
def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, copied or paraphrased."""
    return decontamination.keep(docs, load(spark, sf_dir, "benchmark"))


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens."""
    return packing.digest(packing.pack(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("toxicity", toxic),
    ("near copies", near_copies),
    ("benchmark decontamination", benchmark_passages),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{i}")
    return docs


#: Trained models and a tokenizer decide; SQL can't express them.
ORACLE_SQL = None
