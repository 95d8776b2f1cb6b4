"""Streams of finished tiles: rows that are complete, and bands in order.

Completion is by count, not by time: a row is done when all its tiles are. With a timeout, state is given up after it, and rows
that never got whole are told as partial; without one, a told row keeps an empty state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "row long, tiles long, at long, status string"


def completed_rows(done: DataFrame, columns: int, timeout_ms: int | None = None) -> DataFrame:
    """done: a stream of (row, tile, at). Emits each row once, when its last tile arrives; repeats of a tile are ignored.

    State is a bit mask and the latest time, one for each row; told rows keep it, so that late repeats don't open them again."""

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        row = int(key[0])
        seen, at, told = state.get if state.exists else ("0", -1, False)
        if state.hasTimedOut:
            state.remove()
            if not told:
                yield pd.DataFrame({"row": [row], "tiles": [int(seen).bit_count()], "at": [at], "status": ["partial"]})
            return
        mask = int(seen)
        for df in frames:
            for tile, t in df[["tile", "at"]].itertuples(index=False):
                if 0 <= tile < columns and not told and not mask >> int(tile) & 1:
                    mask |= 1 << int(tile)
                    at = max(at, int(t))
        full = mask.bit_count() == columns
        state.update((str(mask), at, bool(told or full)))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)
        if full and not told:
            yield pd.DataFrame({"row": [row], "tiles": [columns], "at": [at], "status": ["whole"]})

    return done.groupBy("row").applyInPandasWithState(step, OUT, "mask string, at long, told boolean", "append", GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout)


def in_order(write_band, first: int = 0, state: str | None = None):
    """For foreachBatch: hands finished rows to ``write_band(row, at)`` strictly from ``first`` up; rows that are early wait.

    Rows of tiles are few (an image's height over a tile's), so a batch's numbers come to the driver. With ``state``, a file in any store that Spark writes,
    what waits is kept from batch to batch, so a restarted stream goes on where it stopped; a batch that is run again after it was kept is passed over."""
    held: dict = {"batch": -1, "following": first, "waiting": {}, "read": state is None}

    def take(batch: DataFrame, number: int) -> None:
        if not held["read"]:
            kept = _load(batch.sparkSession, state)
            held.update(kept and {"batch": kept["batch"], "following": kept["following"], "waiting": {int(k): v for k, v in kept["waiting"].items()}} or {}, read=True)
        if state and number <= held["batch"]:
            return
        waiting = held["waiting"]
        for r in batch.select("row", "at").collect():
            if r["row"] >= held["following"]:
                waiting[r["row"]] = r["at"]
        while held["following"] in waiting:
            write_band(held["following"], waiting.pop(held["following"]))
            held["following"] += 1
        held["batch"] = number
        if state:
            _store(batch.sparkSession, state, {k: held[k] for k in ("batch", "following", "waiting")})

    return take


def _place(spark, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _load(spark, path: str) -> dict | None:
    p, store = _place(spark, path)
    for one in (p, p.suffix(".new")):  # a restart may fall between removing and renaming
        if store.exists(one):
            with_stream = store.open(one)
            text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(with_stream, "UTF-8")
            with_stream.close()
            try:
                return json.loads(text)
            except ValueError:
                continue
    return None


def _store(spark, path: str, value: dict) -> None:
    p, store = _place(spark, path)
    new = p.suffix(".new")
    out = store.create(new, True)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    store.delete(p, False)
    store.rename(new, p)
