"""Row numbers over whole tables without one task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.storage import written


def global_rank(df: DataFrame, order: list, name: str, tag: str = "rank") -> DataFrame:
    """``df`` with ``name`` = 1, 2, ... in the given order.  Rows are cut into
    ranges, numbered inside each, and shifted by the sizes of the ranges before;
    only as many numbers as there are partitions meet in one task."""
    ranged = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), tag)
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(F.col("_range"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("_range").orderBy(*order)
    ranked = ranged.withColumn("_inside", F.row_number().over(inside)).join(F.broadcast(shift), "_range")
    return ranked.select(*df.columns, (F.col("_inside") + F.col("_shift")).cast("long").alias(name))


def top(df: DataFrame, order: list, limit: int, name: str) -> DataFrame:
    """The first ``limit`` rows, numbered: the limit comes first, so the window
    sees no more than that."""
    return df.orderBy(*order).limit(limit).withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
