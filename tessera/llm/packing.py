"""Concatenate and cut: documents' ids one after another, cut into windows of a fixed number of tokens.

Two passes: the first writes each document's ids with its start inside its partition; the partitions' totals, summed in
order, give every partition's global offset; the second cuts at the global multiples of the window. Nothing is shuffled but
one total per partition. A document that crosses a boundary gives a piece on either side.

Null texts count as empty (the closing id alone), repeated rows are packed each time they occur, an empty table gives no
pieces, and further columns are ignored. A text of any length is encoded whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tessera.llm.common import Words, load, materialise, ragged_bytes, slices, text_of
from tessera.llm.tokens import tokenizer_path, word_tokenizer

ENCODED = "key long, part int, start long, n long, ids binary"


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int | None = 2) -> DataFrame:
    """Each document's ids (little-endian, 32 bits each), and its start among the ids of its partition."""
    path = tokenizer or tokenizer_path()

    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi, buf, offsets in slices(batch.column("body")):
                ids, bounds = word_tokenizer(path).ids(Words(buf, offsets), end_id)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key")[lo:hi].cast(pa.int64()), pa.array(np.full(hi - lo, part, np.int32)), pa.array(bounds[:-1] + at), pa.array(np.diff(bounds)), ragged_bytes(ids, bounds)],
                    names=["key", "part", "start", "n", "ids"],
                )
                at += int(bounds[-1])

    return text_of(docs, key, text).mapInArrow(run, ENCODED)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 4096, tokenizer: str | None = None, end_id: int | None = 2) -> DataFrame:
    """Pieces: the document, start and length in its ids, the ids themselves, its number of ids, sequence_id, and offset there.

    Sequences are numbered from 0 in the order of partitions and rows; all but the last hold exactly ``window`` tokens.
    """
    coded = materialise(encode(docs, key, text, tokenizer, end_id), "encoded")
    # One row per input partition: this window and the broadcast grow with their number alone.
    totals = coded.groupBy("part").agg(F.sum("n").alias("total"))
    base = totals.select("part", (F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("total")).alias("base"))
    placed = coded.where("n > 0").join(F.broadcast(base), "part").withColumn("g", F.col("base") + F.col("start"))
    size = F.lit(window).cast("long")

    def piece(k):
        lo = F.greatest(k * size, F.col("g")) - F.col("g")
        hi = F.least((k + 1) * size, F.col("g") + F.col("n")) - F.col("g")
        return F.struct(
            lo.alias("start"), (hi - lo).alias("length"), F.substring(F.col("ids"), (lo * 4 + 1).cast("int"), ((hi - lo) * 4).cast("int")).alias("ids"),
            k.alias("sequence_id"), (F.col("g") + lo - k * size).alias("offset"),
        )

    first, last = F.floor(F.col("g") / size).cast("long"), F.floor((F.col("g") + F.col("n") - 1) / size).cast("long")
    pieces = placed.select(F.col("key").alias(key), F.col("n").alias("doc_tokens"), F.transform(F.sequence(first, last), piece).alias("pieces"))
    return pieces.select(key, "doc_tokens", F.inline("pieces"))


def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(load(spark, sf_dir, "documents")))


def digest(pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    return pieces.select(key, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
