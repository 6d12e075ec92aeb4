"""Compact text and JSON output, made by grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as X

# One-letter marks of the node types.
MARKS = {"Method": "M", "Class": "C", "Component": "UI", "Interface": "I", "Property": "P", "Field": "F", "Document": "D"}


def mark(node_type: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv])[node_type], F.lit("*"))


def search_groups(hits: DataFrame) -> DataFrame:
    """Hits (rank, id, display_name, node_type, start_line, end_line,
    relative_path) -> (ord, directory, body): files under their folder, hits under
    their file, in order of first rank."""
    line = F.format_string("    [%s] `%s` %s L%s-%s", mark(F.col("node_type")), F.col("id").cast("string"), F.col("display_name"), F.col("start_line").cast("string"), F.col("end_line").cast("string"))
    lines = hits.select(X.parent_path(F.col("relative_path")).alias("directory"), X.file_name(F.col("relative_path")).alias("file"), "rank", line.alias("line"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n")
    files = lines.groupBy("directory", "file").agg(F.min("rank").alias("rank"), joined.alias("lines"))
    block = F.struct("rank", F.concat(F.lit("  "), "file", F.lit("\n"), "lines").alias("text"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["text"]), "\n")
    return files.groupBy("directory").agg(F.min("rank").cast("long").alias("ord"), body.alias("body"))


def chain_lines(paths: DataFrame, names: DataFrame) -> DataFrame:
    """Paths (arrays of ids from the root outwards) -> text from leaf to root."""
    spread = paths.select(F.col("path").alias("p"), F.posexplode("path").alias("i", "id")).join(names.select("id", "name"), "id")
    text = F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("i", "name")))), lambda x: x["name"]), " -> ")
    return spread.groupBy("p").agg(text.alias("chain")).select(F.array_join("p", ">").alias("ids"), "chain")


def tree_lines(paths: DataFrame, names: DataFrame) -> DataFrame:
    """Paths (arrays of ids from the root outwards) -> (ids, depth, line): every
    node of the tree once for each way to it, two blanks a level; sorted by the
    array ``path`` the lines are the tree."""
    prefixes = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", 1, n))).alias("path")).distinct()
    named = prefixes.withColumn("id", F.element_at("path", -1)).join(names.select("id", "name"), "id")
    depth = F.size("path") - 1
    return named.select("path", depth.cast("long").alias("depth"), F.concat(F.repeat(F.lit("  "), depth), "name").alias("line")).orderBy("path")


def node_list(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", F.format_string("[%s] `%s` %s", mark(F.col("node_type")), F.col("id").cast("string"), F.col("fully_qualified_name")).alias("line"))


def as_json(df: DataFrame) -> DataFrame:
    """One JSON object a row, camelCase names, nulls left out."""

    def camel(name: str) -> str:
        head, *rest = name.split("_")
        return head + "".join(w.capitalize() for w in rest)

    return df.select(F.to_json(F.struct(*[F.col(c).alias(camel(c)) for c in df.columns])).alias("json"))


def context_lines(lists: DataFrame) -> DataFrame:
    """The lists of ``navigation.context`` -> (relation, n, body), a line a node."""
    one = F.struct("ord", F.format_string("  %s (%s) `%s`", F.col("name"), F.col("type"), F.col("id").cast("string")).alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["line"]), "\n")
    return lists.groupBy("relation").agg(F.count(F.lit(1)).alias("n"), body.alias("body"))


def memory_blocks(memories: DataFrame) -> DataFrame:
    """Memories (id, node_id, intent, tags, content, stale) -> (node_id, n, stale,
    body): a block a memory, with a hint where the code has changed since."""
    hint = F.when(F.col("stale"), F.lit(" [stale: the code has changed]")).otherwise(F.lit(""))
    block = F.concat(F.lit("- "), F.upper("intent"), hint, F.lit(" #"), F.array_join("tags", " #"), F.lit("\n  "), F.col("content"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", block.alias("text")))), lambda x: x["text"]), "\n")
    return memories.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("stale"), 1)).alias("stale"), body.alias("body"))
