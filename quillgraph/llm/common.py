"""Helpers shared by the corpus operators.

Identity of a row: operators that must find a document again after a shuffle
use ``(doc_id, xxhash64(text))`` and compare ``doc_id`` null-safely, so a null
id, or one id on two different texts, is still told apart.  Rows equal in both
are repeats of one document and always receive the same verdict.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions.storage import written

#: Words of the corpus contracts: runs of anything but ASCII white space.
GAP = r"[\x20\x09-\x0D]+"
#: Words made of ASCII letters and digits and of anything beyond ASCII.
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage, gives later joins exact sizes, and survives lost executors.
    """
    return written(df, tag)


#: Key rows (an id, a hash and a number or two) up to which they are sent to every
#: task: about 100 bytes each in a task's hash table.
KEYS = 100_000


def shuffled(rows: DataFrame) -> DataFrame:
    """A side of a join that grows with the corpus.  It is shuffled, never gathered in
    the driver to be sent to every task: Spark goes by its size on disk, which for
    short rows is a small part of what its hash table takes in memory."""
    return rows.hint("merge")


def checked(keys: DataFrame, rows: int = KEYS) -> DataFrame:
    """A written table for the small side of a join: sent to every task if it has
    ``rows`` rows or fewer, so that the other side need not move; else shuffled."""
    return F.broadcast(keys) if keys.count() <= rows else shuffled(keys)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable."""
    return F.transform(F.array(value), body).getItem(0)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def alnum_words(text: Column) -> Column:
    """Lower-cased words; case folding is full Unicode, for matching only."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_ALNUM), "")


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def is_remainder(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, as the contracts split the corpus; a null id
    counts as the empty text."""
    key = F.coalesce(doc_id.cast("string"), F.lit(""))
    return (F.crc32(key.cast("binary")) % modulus) == remainder


def drawn(marks: DataFrame, most: int, label: str, *by: Column, of: Column | None = None) -> DataFrame:
    """The first ``most`` rows of each value of ``label`` in the order of ``by``.
    If the first of these is a number from 0 to 1 without a pattern, ``of`` such rows
    of the label, those that are surely too late are left out before any are ranked."""
    order = Window.partitionBy(label).orderBy(*by)
    marks = marks if of is None else marks.filter(by[0] < (4.0 * most + 100) / of)
    return marks.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")


def bounded(rows: DataFrame, most: int, label: str, salt: str) -> DataFrame:
    """At most ``most`` rows of ``rows`` (doc_id, text, ...) for each value of
    ``label``, drawn by a hash of id and text.  Rows equal in id, text and label
    count, and come out, once, so repeats change neither the bound nor any weight.

    Hashes are thinned first by their number (estimated), so few rows are ranked;
    each task keeps no more than ``most`` of a label on the way to the ranking.
    """
    keyed = rows.withColumn("_th", F.xxhash64("text"))
    own = F.xxhash64("doc_id", "_th", F.lit(salt))
    marks = keyed.select("doc_id", "_th", F.col(label).alias("_label"), own.alias("_mark"))
    sizes = marks.groupBy("_label").agg(F.approx_count_distinct("_mark").alias("_size"))
    share = F.pmod("_mark", F.lit(1 << 30)) / float(1 << 30)
    few = marks.join(F.broadcast(sizes), "_label").filter(share < 4.0 * most / F.col("_size")).drop("_size").distinct()
    chosen = drawn(few, most, "_label", F.col("_mark"), F.col("doc_id"), F.col("_th"))
    chosen = F.broadcast(chosen.select(F.col("doc_id").alias("_id"), F.col("_th").alias("_h"), "_label"))
    same = keyed["doc_id"].eqNullSafe(chosen["_id"]) & (keyed["_th"] == chosen["_h"]) & (keyed[label] == chosen["_label"])
    return keyed.join(chosen, same, "left_semi").dropDuplicates(["doc_id", "_th", label]).drop("_th")


def unit_hash(*columns: Column) -> Column:
    """A repeatable number in [0, 1) for a row."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / float(1 << 30)
