"""Reduction of captured output: matching lines with context, within budgets.

All operators take lines (log_id, line_number, text), so many logs are reduced at
once.  Running values inside a log are scanned piece by piece (``functions.scan``),
so one log of any length is worked on by many tasks; texts of lines that no block
holds do not move.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.functions.match import Phrase, fold
from quillgraph.functions.scan import PIECE, running


def split_lines(logs: DataFrame, column: str = "text") -> DataFrame:
    """(log_id, line_number from 1, text); CR, LF and CRLF end a line, and a last
    line without an end counts."""
    parts = F.split(F.col(column), "\r\n|\r|\n")
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return logs.select("log_id", F.posexplode(parts).alias("_pos", "text")).select("log_id", (F.col("_pos") + 1).cast("long").alias("line_number"), "text")


def capture(lines: DataFrame, max_lines: int = 5000, max_bytes: int = 1 << 20, piece: int = PIECE) -> DataFrame:
    """The lines within the line and byte budgets; the line at which the bytes
    run out keeps the characters that fit.  Adds ``cut``."""
    sizes = running(lines.filter(F.col("line_number") <= max_lines), "log_id", ["line_number"], {"_before": ("sum", F.octet_length("text"))}, piece)
    kept = sizes.withColumn("_before", F.coalesce("_before", F.lit(0))).filter((F.col("_before") < max_bytes) | ((F.col("_before") == max_bytes) & (F.octet_length("text") == 0)))
    room = F.lit(max_bytes) - F.col("_before")
    over = F.octet_length("text") > room
    # a prefix of characters whose bytes fit: bytes are at least as many as characters
    chars = F.split("text", "")
    fits = F.aggregate(
        chars, F.struct(F.lit(0).cast("long").alias("n"), F.lit("").alias("s"), F.lit(True).alias("go")),
        lambda a, c: F.when(a["go"] & (a["n"] + F.octet_length(c) <= room), F.struct((a["n"] + F.octet_length(c)).alias("n"), F.concat(a["s"], c).alias("s"), F.lit(True).alias("go"))).otherwise(F.struct(a["n"].alias("n"), a["s"].alias("s"), F.lit(False).alias("go"))),
    )["s"]
    return kept.select("log_id", "line_number", F.when(over, fits).otherwise(F.col("text")).alias("text"), over.alias("cut"))


def matches(text: Column, any_of=(), all_of=(), none_of=()) -> Column:
    """Lines by terms: a term may end in ``*`` (prefix) or hold blanks (phrase).
    At least one of ``any_of``, all of ``all_of``, none of ``none_of``.  For
    expressions with AND, OR and NOT see ``functions.match.match``."""

    def has(terms: Column, term: str) -> Column:
        words = fold(term) or [term.rstrip("*").lower()]
        return Phrase(tuple(words), term.endswith("*")).test(terms)

    def all_tests(terms: Column) -> Column:
        out = F.lit(True)
        if any_of:
            out = out & reduce(lambda a, b: a | b, [has(terms, t) for t in any_of])
        for t in all_of:
            out = out & has(terms, t)
        for t in none_of:
            out = out & ~has(terms, t)
        return out

    return X.let(X.index_terms(text), all_tests)


def blocks(lines: DataFrame, matched: Column, context: int = 3, piece: int = PIECE) -> DataFrame:
    """(log_id, block, start, stop, n_matches): windows around matching lines,
    merged where they touch or overlap."""
    total = lines.groupBy("log_id").agg(F.max("line_number").alias("_total"))
    marked = lines.filter(matched).select("log_id", "line_number").join(total, "log_id")
    spans = marked.select("log_id", F.greatest(F.lit(1), F.col("line_number") - context).alias("start"), F.least(F.col("_total"), F.col("line_number") + context).alias("stop"), "line_number")
    reached = running(spans, "log_id", ["start", "line_number"], {"_reach": ("max", F.col("stop"))}, piece)
    opened = reached.withColumn("_open", (F.col("start") > F.coalesce("_reach", F.lit(-1)) + 1).cast("long"))
    numbered = running(opened, "log_id", ["start", "line_number"], {"_opened": ("sum", F.col("_open"))}, piece)
    block = F.coalesce("_opened", F.lit(0)) + F.col("_open")
    return numbered.groupBy("log_id", block.alias("block")).agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count(F.lit(1)).alias("n_matches"))


def line_range(lines: DataFrame, first: int, last: int) -> DataFrame:
    return lines.filter(F.col("line_number").between(first, last))


def _inside(lines: DataFrame, block_table: DataFrame, piece: int) -> DataFrame:
    """Lines with the block that holds them: joined by log and piece of it."""
    at = F.explode(F.sequence(F.floor(F.col("start") / piece), F.floor(F.col("stop") / piece)))
    spans = block_table.select("log_id", F.col("block").cast("long").alias("block"), "start", "stop", at.alias("_at"))
    put = lines.withColumn("_at", F.floor(F.col("line_number") / piece))
    return put.join(spans, ["log_id", "_at"]).filter(F.col("line_number").between(F.col("start"), F.col("stop"))).drop("_at")


def render(lines: DataFrame, block_table: DataFrame, max_chars: int = 4000, piece: int = PIECE) -> DataFrame:
    """(log_id, block, line_number, shown): lines as ``number| text`` while the
    characters (UTF-16 units, with the ends of lines and blocks) last; the line
    that does not fit is cut to ``...`` if there is room for more than that."""
    first = block_table.groupBy("log_id").agg(F.min("start").alias("_first"))
    inside = _inside(lines, block_table, piece).join(first, "log_id")
    rows = inside.select("log_id", "block", "line_number", "start", "_first", F.concat(F.col("line_number").cast("string"), F.lit("| "), F.col("text")).alias("full"))
    gap = F.when(F.col("line_number") == F.col("_first"), 0).when(F.col("line_number") == F.col("start"), 2).otherwise(1)
    rows = rows.withColumn("_gap", gap)
    rows = running(rows, "log_id", ["line_number"], {"_used": ("sum", F.col("_gap") + X.utf16_length(F.col("full")))}, piece)
    rows = rows.withColumn("_used", F.coalesce("_used", F.lit(0))).filter(F.col("_used") < max_chars)
    room = F.lit(max_chars) - F.col("_used") - F.col("_gap")
    fits = X.utf16_length(F.col("full")) <= room
    keep = room - 3
    # a cut at ``keep`` UTF-16 units that never splits a character of two
    prefix = F.aggregate(
        F.split("full", ""), F.struct(F.lit(0).alias("n"), F.lit("").alias("s"), F.lit(True).alias("go")),
        lambda a, c: F.when(a["go"] & (a["n"] + X.utf16_length(c) <= keep), F.struct((a["n"] + X.utf16_length(c)).alias("n"), F.concat(a["s"], c).alias("s"), F.lit(True).alias("go"))).otherwise(F.struct(a["n"].alias("n"), a["s"].alias("s"), F.lit(False).alias("go"))),
    )["s"]
    shown = F.when(fits, F.col("full")).when(room > 3, F.concat(prefix, F.lit("...")))
    rows = rows.withColumn("shown", shown).withColumn("_fits", fits)
    return rows.filter(F.col("shown").isNotNull()).select("log_id", "block", "line_number", "shown", (~F.col("_fits")).alias("cut"))


def result(lines: DataFrame, block_table: DataFrame, max_chars: int = 4000) -> DataFrame:
    """(log_id, summary, body, n_shown, truncated), a row a log: the summary, and
    the shown lines as one text with an empty line between blocks; truncated where
    the characters ran out before the blocks did."""
    shown = render(lines, block_table, max_chars)
    first = F.struct("line_number", F.struct("block", "shown").alias("x"))
    ordered = F.transform(F.array_sort(F.collect_list(first)), lambda r: r["x"])

    def joined(rows: Column) -> Column:
        gap = lambda x, i: F.when(i == 0, "").when(x["block"] != F.get(rows, i - 1)["block"], "\n\n").otherwise("\n")
        return F.array_join(F.transform(rows, lambda x, i: F.concat(gap(x, i), x["shown"])), "")

    texts = shown.groupBy("log_id").agg(X.let(ordered, joined).alias("body"), F.count(F.lit(1)).alias("n_shown"), F.max("cut").alias("cut"), F.max("line_number").alias("last"))
    ends = block_table.groupBy("log_id").agg(F.max("stop").alias("stop"))
    both = summary(lines, block_table).join(texts, "log_id", "left").join(ends, "log_id", "left")
    truncated = F.col("stop").isNotNull() & (F.coalesce("cut", F.lit(True)) | (F.col("last") < F.col("stop")))
    return both.select("log_id", "summary", F.coalesce("body", F.lit("")).alias("body"), F.coalesce("n_shown", F.lit(0)).alias("n_shown"), truncated.alias("truncated"))


def summary(lines: DataFrame, block_table: DataFrame) -> DataFrame:
    """(log_id, total_lines, matched, n_blocks, summary) of every log; a log
    without a match gets its summary and no tail of lines."""
    total = lines.groupBy("log_id").agg(F.max("line_number").alias("total_lines"))
    found = block_table.groupBy("log_id").agg(F.sum("n_matches").alias("matched"), F.count(F.lit(1)).alias("n_blocks"))
    both = total.join(found, "log_id", "left").select("log_id", "total_lines", F.coalesce("matched", F.lit(0)).alias("matched"), F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"))
    text = F.when(F.col("matched") == 0, F.format_string("no match in %s lines", F.col("total_lines").cast("string"))).otherwise(F.format_string("%s of %s lines match, in %s blocks", *[F.col(c).cast("string") for c in ("matched", "total_lines", "n_blocks")]))
    return both.withColumn("summary", text)
