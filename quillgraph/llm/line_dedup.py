"""Line dedup by overlapping three-line windows (DataFrame only).

Every run of three consecutive lines that holds a word is hashed (64 + 32
bits).  A window found more than once anywhere is repeated; its first
occurrence, by (doc_id, text hash, position), stays, and the lines that later
occurrences cover are removed after merging overlapping stretches.

Scale: only hashes and positions are shuffled, pre-aggregated by window; the
text moves once, in the join with the stretches, and not at all where those are
few enough to be sent to every task (``STARTS`` positions, counted first).  A window that a third of all documents
share is one row after the partial aggregate, and the join that finds its later
occurrences reads two written tables, so adaptive execution can split it.

Defined results: null text stays null; a text of fewer than three lines has no
window and stays; lines are split at "\\n" only and compared exactly; rows equal
in id and text are repeats of one document and keep the same lines; a text all
of whose lines go becomes empty; ``n_chars``, where present, is counted anew;
other columns pass through, but for an
earlier ``n_removed``, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import KEYS, let, materialise, shuffled

SPAN = 3
#: Positions up to which the stretches are sent to every task (4 bytes each).
STARTS = 4_000_000


def windows(docs: DataFrame) -> DataFrame:
    """(doc_id, text hash, position, window hash) of every window with a word."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("_th"), F.split("text", "\n").alias("_lines"))
    at = F.sequence(F.lit(0), F.size("_lines") - SPAN)

    def hashed(i: Column) -> Column:
        three = [F.get("_lines", i + k) for k in range(SPAN)]
        full = F.concat(*three).rlike(r"[^\x20\x09-\x0D]")
        return F.when(full, F.struct(F.xxhash64(*three).alias("w64"), F.hash(*three).alias("w32")))

    found = lines.filter(F.size("_lines") >= SPAN).select("doc_id", "_th", F.posexplode(F.transform(at, hashed)).alias("_pos", "_w"))
    return found.filter("_w is not null").select("doc_id", "_th", "_pos", F.col("_w.w64").alias("_w64"), F.col("_w.w32").alias("_w32"))


def repeated_positions(docs: DataFrame) -> DataFrame:
    """(_id, _h, _starts): where later occurrences of repeated windows begin."""
    found = materialise(windows(docs), "line-windows")
    place = F.struct("doc_id", "_th", "_pos")
    first = found.groupBy("_w64", "_w32").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n"))
    first = materialise(first.filter("_n > 1").select("_w64", "_w32", "_first"), "line-repeats")
    later = found.join(shuffled(first), ["_w64", "_w32"]).filter(~place.eqNullSafe(F.col("_first")))
    starts = later.groupBy(F.col("doc_id").alias("_id"), F.col("_th").alias("_h")).agg(F.sort_array(F.collect_set("_pos")).alias("_starts"))
    return materialise(starts, "line-starts")


def _without(lines: Column, starts: Column) -> Column:
    """The lines outside the merged stretches [p, p + 2] of sorted starts."""

    def cut(s: Column) -> Column:
        begins = F.filter(s, lambda p, i: (i == 0) | (p > F.get(s, i - 1) + SPAN))
        ends = F.filter(s, lambda p, i: (i == F.size(s) - 1) | (F.get(s, i + 1) > p + SPAN))

        def kept(pair: Column) -> Column:
            b, e, n = pair["b"], pair["e"], pair["n"]
            part = F.transform(
                F.sequence(F.lit(0), F.size(b)),
                lambda j: let(
                    F.when(j == 0, F.lit(0)).otherwise(F.get(e, j - 1) + SPAN),
                    lambda lo: F.slice(lines, lo + 1, F.greatest(F.coalesce(F.get(b, j), n) - lo, F.lit(0))),
                ),
            )
            return F.flatten(part)

        return let(F.struct(begins.alias("b"), ends.alias("e"), F.size(lines).alias("n")), kept)

    return let(starts, cut)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated windows removed, and ``n_removed`` lines."""
    docs = docs.drop("n_removed")
    starts = repeated_positions(docs)
    rows, size = starts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("_starts")), F.lit(0))).first()
    starts = F.broadcast(starts) if rows <= KEYS and size <= STARTS else shuffled(starts)
    same = docs["doc_id"].eqNullSafe(starts["_id"]) & (F.xxhash64(docs["text"]) == starts["_h"])
    both = docs.join(starts, same, "left")
    lines = F.split(docs["text"], "\n")
    left = F.when(starts["_starts"].isNotNull(), let(lines, lambda x: _without(x, starts["_starts"])))
    kept = both.select(*[docs[c].alias(c) for c in docs.columns], F.size(lines).alias("_qg_lines"), left.alias("_qg_left"))
    text = F.when(F.col("_qg_left").isNull(), F.col("text")).otherwise(F.array_join("_qg_left", "\n"))
    removed = F.when(F.col("_qg_left").isNull(), F.lit(0)).otherwise(F.col("_qg_lines") - F.size("_qg_left"))
    changed = {"text": text, "n_chars": F.when(F.col("_qg_left").isNull(), F.col("n_chars")).otherwise(F.length(F.array_join("_qg_left", "\n")).cast("long"))}
    return kept.select(*[changed.get(c, F.col(c)).alias(c) for c in docs.columns], removed.cast("long").alias("n_removed"))
