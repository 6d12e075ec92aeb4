"""Connected components of a link table by alternating large and small stars.

The links stay distributed; every round is written to the shared folder, so a
lost executor costs one round at most.  The number of rounds grows with the
logarithm of the number of vertices, not with the diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import materialise, shuffled


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Large: hang every larger neighbour of u on u's least neighbour.  Small:
    hang u's smaller neighbours, and u, on the least of them."""
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    near = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else down
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    hung = near.join(shuffled(least), "u")
    if large:
        out = hung.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = hung.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a, b: long) -> (id, component) for every linked vertex, where
    component is the least id that can be reached.  No link, no row."""
    links = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    seen = links.agg(F.count(F.lit(1)), mark).first()
    while True:
        links = materialise(_star(_star(links, large=True), large=False), "links")
        now = links.agg(F.count(F.lit(1)), mark).first()
        if now == seen:
            break
        seen = now
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
