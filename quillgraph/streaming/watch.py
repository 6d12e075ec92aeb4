"""Watching a workspace: change batches and incremental commits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.functions.ranking import global_rank
from quillgraph.functions.scan import PIECE, running
from quillgraph.functions.storage import written
from quillgraph.sources.files import ignored_segment

CHANGES = "ts timestamp, action string, old_path string, new_path string"


def _following(times: DataFrame, key: str, delay: int) -> DataFrame:
    """(key, _t, _next): the first time of the key beyond each time and the delay,
    where there is one.  Times and ends of delays are merged in descending order;
    the least time met so far is the next one."""
    met = times.select(key, F.col("_t").alias("_v"), F.lit(0).alias("_end"), "_t")
    both = met.unionByName(times.select(key, (F.col("_t") + delay).alias("_v"), F.lit(1).alias("_end"), "_t"))
    order = [F.col(key).desc(), F.col("_v").desc(), F.col("_end").desc()]
    ranked = global_rank(both, order, "_m", "batch-times")
    scanned = running(ranked, key, ["_m"], {"_next": ("min", F.when(F.col("_end") == 0, F.col("_v")))}, PIECE)
    return scanned.filter("_end = 1 and _next is not null").select(key, "_t", "_next")


def openers(times: DataFrame, key: str, delay: int) -> DataFrame:
    """(key, _t): the times that open a batch: the first of a key, then always the
    first beyond the one before and the delay.  Every time points to the one that
    would open the next batch; pointers are doubled until none is left, and those
    of 2^k steps, from the longest to the single ones, lead from the first time to
    all openers.  So many rounds as the logarithm of a key's batches has bits."""
    jumps = [written(_following(times, key, delay), "batch-jumps")]
    while True:
        last = jumps[-1]
        further = last.select(key, "_t", F.col("_next").alias("_at")).join(last.select(key, F.col("_t").alias("_at"), "_next"), [key, "_at"]).select(key, "_t", "_next")
        further = written(further, "batch-jumps")
        if further.isEmpty():
            break
        jumps.append(further)
    found = times.groupBy(key).agg(F.min("_t").alias("_t"))
    for jump in reversed(jumps):
        found = written(found.unionByName(found.join(jump, [key, "_t"]).select(key, F.col("_next").alias("_t"))), "batch-openers")
    return found


def batches(changes: DataFrame, key: str, ts: str = "ts", delay_ms: int = 250) -> DataFrame:
    """Event-time batches: the first event of a key opens a batch that takes
    everything within the delay (fixed from the first event, not sliding).
    Adds ``batch`` from 1.  Events without a key or a time are in none and left
    out.  No step gathers a key's events in one task."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    times = written(changes.select(key, micros.alias("_t")).filter(F.col(key).isNotNull() & F.col("_t").isNotNull()).distinct(), "batch-times")
    begins = openers(times, key, delay_ms * 1000)
    both = begins.select(key, "_t", F.lit(0).alias("_event")).unionByName(times.select(key, "_t", F.lit(1).alias("_event")))
    ranked = global_rank(both, [F.col(key), F.col("_t"), F.col("_event")], "_m", "batch-events")
    numbered = running(ranked, key, ["_m"], {"batch": ("sum", (F.col("_event") == 0).cast("long"))}, PIECE).filter("_event = 1")
    own = changes.withColumn("_t", micros)
    return own.join(numbered.select(key, "_t", "batch"), [key, "_t"]).select(*changes.columns, "batch")


def normalise(changes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(ts, action, path): renames become a delete and an add by whether each
    side matters; Markdown not yet known is Added, a known path that is Added is
    Modified."""

    def matters(c):
        return c.isNotNull() & ~ignored_segment(c)

    rename = F.col("action").isin("Renamed", "DirectoryRenamed")
    deleted = F.when(F.col("action") == "DirectoryRenamed", "DirectoryDeleted").otherwise("Deleted")
    parts = F.when(rename, F.array(
        F.when(matters(F.col("old_path")), F.struct(deleted.alias("action"), F.col("old_path").alias("path"))),
        F.when(matters(F.col("new_path")), F.struct(F.lit("Added").alias("action"), F.col("new_path").alias("path"))),
    )).otherwise(F.array(F.when(matters(F.coalesce("new_path", "old_path")), F.struct(F.col("action").alias("action"), F.coalesce("new_path", "old_path").alias("path")))))
    out = changes.select("ts", F.explode(F.filter(parts, lambda p: p.isNotNull())).alias("c")).select("ts", "c.action", X.normal_path(F.col("c.path")).alias("path"))
    if known is None:
        return out
    seen = known.select("path").distinct().withColumn("_known", F.lit(True))
    out = out.join(seen, "path", "left")
    markdown = X.extension(F.col("path")).isin(*X.MARKDOWN)
    action = F.when(F.col("_known") & (F.col("action") == "Added"), "Modified").when(F.col("_known").isNull() & markdown & (F.col("action") == "Modified"), "Added").otherwise(F.col("action"))
    return out.select("ts", action.alias("action"), "path")


def watch(changes: DataFrame, handle: Callable[[DataFrame], None], checkpoint: str, trigger: str | None = "250 milliseconds"):
    """Run ``handle`` on every micro-batch that holds relevant changes.  Without
    a trigger, everything that is there is handled and the query ends (the first
    snapshot and the catch-up); on failure the checkpoint resumes it."""

    def each(frame: DataFrame, epoch: int) -> None:
        changed = normalise(frame)
        if not changed.isEmpty():
            handle(changed)

    writer = changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if trigger is None else writer.trigger(processingTime=trigger)).start()


def windowed_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling event-time counts with a watermark; batch or stream."""
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    w = F.window(ts, size)
    return events.groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a key that end after a gap; batch or stream."""
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    s = events.groupBy(F.session_window(ts, gap).alias("s"), key).agg(F.count(F.lit(1)).alias("n"))
    return s.select(key, F.col("s.start").alias("start"), "n")
