"""Notes attached to nodes: attach, read, staleness, delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.graph import Graph


def normal_tags(tags: Column) -> Column:
    """Trimmed, lower-cased, distinct, sorted; blanks go."""
    clean = F.filter(F.transform(tags, lambda t: F.lower(F.trim(t))), lambda t: t != "")
    return F.array_sort(F.array_distinct(F.coalesce(clean, F.array().cast("array<string>"))))


def attach(graph: Graph, notes: DataFrame, embed=None) -> DataFrame:
    """notes (id, node_id, content, tags, intent, created_at) -> memory rows.
    The target's body hash is captured; a vector is reused from any memory with
    the same content, else made by ``embed`` (a column function) if given."""
    content = F.trim("content")
    rows = notes.select("id", F.col("node_id").alias("target_code_node_id"), content.alias("content"), F.sha2(content, 256).alias("content_hash"), normal_tags(F.col("tags")).alias("tags"), F.coalesce("intent", F.lit("Convention")).alias("intent"), "created_at")
    target = graph["code_nodes"].select(F.col("id").alias("target_code_node_id"), F.coalesce("body_hash", F.lit("")).alias("target_code_hash"))
    rows = rows.join(target, "target_code_node_id")
    known = graph["memory_nodes"].filter("vector_embedding is not null").groupBy("content_hash").agg(F.min_by("vector_embedding", "id").alias("_known"))
    rows = rows.join(known, "content_hash", "left")
    fresh = embed(F.col("content")) if embed else F.lit(None).cast("array<float>")
    rows = rows.withColumn("vector_embedding", F.coalesce("_known", fresh))
    return rows.select("id", "target_code_node_id", "target_code_hash", "content", "content_hash", "tags", "intent", "vector_embedding", "created_at")


def with_staleness(graph: Graph, memories: DataFrame | None = None) -> DataFrame:
    """Memories with ``stale``: the target's hash is not the one captured."""
    rows = memories if memories is not None else graph["memory_nodes"]
    now = graph["code_nodes"].select(F.col("id").alias("target_code_node_id"), F.coalesce("body_hash", F.lit("")).alias("_now"))
    return rows.join(now, "target_code_node_id").withColumn("stale", F.col("_now") != F.col("target_code_hash")).drop("_now")


def of_nodes(graph: Graph, node_ids: DataFrame, intents=None) -> DataFrame:
    """(node_id, memories array by creation) for every asked node."""
    rows = with_staleness(graph)
    if intents:
        rows = rows.filter(F.col("intent").isin(*intents))
    one = F.struct("created_at", "id", "content", "intent", F.array_join("tags", ",").alias("tags"), "stale")
    grouped = rows.groupBy(F.col("target_code_node_id").alias("node_id")).agg(F.sort_array(F.collect_list(one)).alias("memories"))
    asked = node_ids.select("node_id").filter("node_id > 0").distinct()
    empty = F.array().cast(grouped.schema["memories"].dataType)
    return asked.join(grouped, "node_id", "left").select("node_id", F.coalesce("memories", empty).alias("memories"))


def batch(graph: Graph, ids: DataFrame) -> DataFrame:
    """Every asked id, with its memory or nulls."""
    return ids.select("id").join(with_staleness(graph), "id", "left")


def delete(graph: Graph, memory_id: str) -> DataFrame:
    """The memories without one; it must exist."""
    if graph["memory_nodes"].filter(F.col("id") == memory_id).isEmpty():
        raise KeyError(memory_id)
    return graph["memory_nodes"].filter(F.col("id") != memory_id)
