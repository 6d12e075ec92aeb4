"""Running sums, greatest and least values inside a key, without one task a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Steps of the order column that make one piece of a key.
PIECE = 10_000


def running(df: DataFrame, key: str | list[str], order: list[str], values: dict[str, tuple[str, Column]], piece: int = PIECE) -> DataFrame:
    """``df`` with, for each name of ``values`` (a name -> ("sum", "max" or "min",
    column)), the running value over the rows of the key before this one; null
    where there is none.

    A key is cut into pieces of the first order column, a whole number.  Each piece
    is scanned by itself; what the pieces before it come to, a row a piece, is
    scanned likewise, by pieces of pieces while there are many, and added.  So the
    rows of one key are worked on by as many tasks as it has pieces.
    """
    keys = [key] if isinstance(key, str) else key
    kinds = {"sum": F.sum, "max": F.max, "min": F.min}
    put = df.withColumn("_piece", F.floor(F.col(order[0]) / piece).cast("long")).withColumns({f"_v_{n}": v for n, (_, v) in values.items()})
    totals = put.groupBy(*keys, "_piece").agg(*[kinds[k](f"_v_{n}").alias(f"_t_{n}") for n, (k, _) in values.items()])
    whole = Window.partitionBy(*keys, F.floor(F.col("_piece") / piece)).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    near = totals.select(*keys, "_piece", *[kinds[k](f"_t_{n}").over(whole).alias(f"_c_{n}") for n, (k, _) in values.items()])
    far = totals.groupBy(*keys, F.floor(F.col("_piece") / piece).alias("_far")).agg(*[kinds[k](f"_t_{n}").alias(f"_t_{n}") for n, (k, _) in values.items()])
    beyond = Window.partitionBy(*keys).orderBy("_far").rowsBetween(Window.unboundedPreceding, -1)
    far = far.select(*keys, "_far", *[kinds[k](f"_t_{n}").over(beyond).alias(f"_d_{n}") for n, (k, _) in values.items()])
    carried = near.withColumn("_far", F.floor(F.col("_piece") / piece)).join(far, [*keys, "_far"]).drop("_far")
    inside = Window.partitionBy(*keys, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = put.withColumns({f"_l_{n}": kinds[k](f"_v_{n}").over(inside) for n, (k, _) in values.items()})
    both = local.join(carried, [*keys, "_piece"])
    return both.select(*[c for c in df.columns if c not in values], *[_joined(k, [F.col(f"_{x}_{n}") for x in "lcd"]).alias(n) for n, (k, _) in values.items()])


def _joined(kind: str, parts: list[Column]) -> Column:
    if kind == "sum":
        some = F.coalesce(*parts)
        return F.when(some.isNotNull(), sum((F.coalesce(p, F.lit(0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0))))
    return F.greatest(*parts) if kind == "max" else F.least(*parts)
