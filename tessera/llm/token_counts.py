"""Exact length histogram: documents aggregated by encoded length, with suffix sums over the lengths.

From it, for any context limit c: documents and tokens in all, how many documents are longer, how many tokens remain when
each is cut at c, and length quantiles; all exact. ``at_limit`` answers for any limits, ``histogram`` holds every length.

Null texts count as empty (length 0, or 1 with an end id), repeated rows count each time, an empty table gives an empty
histogram, further columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tessera.llm.common import Words, load, materialise, slices, text_of
from tessera.llm.tokens import tokenizer_path, word_tokenizer

#: Lengths that one row of the upper level of the suffix sums covers.
BLOCK = 1024


def lengths(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """key and n_tokens of each document."""
    path = tokenizer or tokenizer_path()

    def run(batches):
        for batch in batches:
            for lo, hi, buf, offsets in slices(batch.column("body")):
                yield pa.RecordBatch.from_arrays([batch.column("key")[lo:hi].cast(pa.int64()), pa.array(word_tokenizer(path).lengths(Words(buf, offsets)))], names=["key", "n_tokens"])

    return text_of(docs, key, text).mapInArrow(run, "key long, n_tokens long").withColumnRenamed("key", key)


def histogram(counted: DataFrame, n_tokens: str = "n_tokens") -> DataFrame:
    """A row for each length that occurs: documents of it, and over all lengths

    docs_at_least, tokens_at_least: suffix sums; docs_below, tokens_below: the rest; truncated_tokens: what remains of all
    documents when cut at this length; share_not_longer: part of the documents that fit whole.

    The sums are made in two levels, so that no task sees all lengths: blocks of ``BLOCK`` lengths among themselves, then
    lengths within their block.
    """
    own = counted.groupBy(F.col(n_tokens).cast("long").alias("n_tokens")).agg(F.count("*").alias("n_docs"))
    own = materialise(own.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs")), "lengths")
    blocks = own.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    above = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, W.currentRow)
    later = blocks.select(
        "block", (F.sum("d").over(above) - F.col("d")).alias("later_docs"), (F.sum("t").over(above) - F.col("t")).alias("later_tokens"),
        F.sum("d").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("all_docs"),
        F.sum("t").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("all_tokens"),
    )
    within = W.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = own.join(later, "block").select(
        "n_tokens", "n_docs", (F.sum("n_docs").over(within) + F.col("later_docs")).alias("docs_at_least"),
        (F.sum("tokens").over(within) + F.col("later_tokens")).alias("tokens_at_least"), "all_docs", "all_tokens",
    )
    return rows.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least", (F.col("all_docs") - F.col("docs_at_least")).alias("docs_below"),
        (F.col("all_tokens") - F.col("tokens_at_least")).alias("tokens_below"),
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_tokens"),
        ((F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_docs")).alias("share_not_longer"),
    )


def at_limit(hist: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents and tokens in all, documents cut, tokens that remain, tokens lost."""
    sums = []
    wanted = sorted({int(v) for v in limits})
    for x in wanted:
        over = F.col("n_tokens") > x
        sums += [F.coalesce(F.sum(F.when(over, F.col("n_docs"))), F.lit(0)).alias(f"cut_{x}"), F.coalesce(F.sum(F.least(F.col("n_tokens"), F.lit(x)) * F.col("n_docs")), F.lit(0)).alias(f"kept_{x}")]
    one = hist.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum(F.col("n_tokens") * F.col("n_docs")), F.lit(0)).alias("tokens"), *sums)
    rows = F.array(*(F.struct(F.lit(x).cast("long").alias("context_limit"), F.col(f"cut_{x}").alias("docs_cut"), F.col(f"kept_{x}").alias("truncated_tokens")) for x in wanted))
    return one.select("docs", "tokens", F.inline(rows)).select("context_limit", "docs", "tokens", "docs_cut", "truncated_tokens", (F.col("tokens") - F.col("truncated_tokens")).alias("tokens_lost"))


def quantile(hist: DataFrame, shares: list[float]) -> DataFrame:
    """The smallest length that at least the given share of the documents does not exceed."""
    one = hist.agg(*(F.min(F.when(F.col("share_not_longer") >= s, F.col("n_tokens"))).alias(f"q{i}") for i, s in enumerate(shares)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(float(s)).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, s in enumerate(shares)))))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(lengths(load(spark, sf_dir, "documents")))
