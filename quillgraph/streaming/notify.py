"""Reduction of notification streams: strictly increasing sequence numbers of an
operation are accepted, a finished operation is frozen, the last state wins."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TERMINAL = ("succeeded", "failed", "cancelled")


def reduce_batch(events: DataFrame) -> DataFrame:
    """Events (operation_id, sequence, kind, message) in any order -> the last
    accepted event of each operation.  Delivered in order of sequence, everything
    after the first terminal event is dropped."""
    end = events.filter(F.col("kind").isin(*TERMINAL)).groupBy("operation_id").agg(F.min("sequence").alias("_end"))
    kept = events.join(end, "operation_id", "left").filter(F.col("_end").isNull() | (F.col("sequence") <= F.col("_end")))
    last = kept.groupBy("operation_id").agg(F.max_by(F.struct("sequence", "kind", "message"), "sequence").alias("e"), F.countDistinct("sequence").alias("accepted"))
    return last.select("operation_id", "e.sequence", "e.kind", F.substring("e.message", 1, 2000).alias("message"), "accepted", F.col("e.kind").isin(*TERMINAL).alias("finished"))


OUT = "operation_id long, sequence long, kind string, message string, accepted long, finished boolean"
STATE = "sequence long, kind string, message string, accepted long, finished boolean"


def _step(key: tuple, frames: Iterator, state) -> Iterator:
    import pandas as pd

    last, kind, message, accepted, done = state.get if state.exists else (-1, "", "", 0, False)
    for frame in frames:
        for seq, k, m in sorted(zip(frame["sequence"], frame["kind"], frame["message"])):
            if done or seq <= last:
                continue
            last, kind, message, accepted, done = int(seq), k, (m or "")[:2000], accepted + 1, k in TERMINAL
    state.update((last, kind, message, accepted, done))
    yield pd.DataFrame([[key[0], last, kind, message, accepted, done]], columns=["operation_id", "sequence", "kind", "message", "accepted", "finished"])


def reduce_stream(events: DataFrame) -> DataFrame:
    """The same over a stream: one small state row an operation, in update mode.
    Sequences at or below the last accepted one are late and dropped."""
    rows = events.select(F.col("operation_id").cast("long"), F.col("sequence").cast("long"), "kind", "message")
    return rows.groupBy("operation_id").applyInPandasWithState(_step, OUT, STATE, "update", "NoTimeout")


def latest_per_key(stream: DataFrame, key: str, order: str) -> DataFrame:
    """Conflation: per trigger, the last row of each key (update mode)."""
    rest = [c for c in stream.columns if c not in (key, order)]
    return stream.groupBy(key).agg(F.max(order).alias(order), *[F.max_by(c, order).alias(c) for c in rest])
