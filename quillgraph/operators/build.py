"""From contributions to a committed graph: merge, canonicalise, compare, keep
identities, derive directories.

Staging tables: projects (id, name, relative_file_path, content_hash), nodes
(canonical_id, project_id, fqn, display, node_type, path, start, end, summary,
search_text, body_hash, vector), edges (caller_id, callee_id, edge_type,
metadata), each with contribution_id and ingest_ordinal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.functions.ranking import global_rank
from quillgraph.functions.storage import dealt

NODE_FIELDS = ("project_id", "fqn", "display", "node_type", "path", "start", "end", "summary", "search_text", "body_hash")


def row_hash(*columns) -> Column:
    """One hash of several columns that tells null from empty."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns])), 256)


def conflicts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Canonical ids whose contributions differ in a field (vectors aside) or in
    their outgoing edges: (canonical_id, n_variants)."""
    each = dealt(edges.withColumnRenamed("caller_id", "canonical_id"), "canonical_id")
    out = each.groupBy("contribution_id", "canonical_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_set(row_hash("callee_id", "edge_type", "metadata"))), ","), 256).alias("_edges"))
    # a row a node and contribution: never sent to every task, however small its files are
    both = dealt(nodes, "canonical_id").join(out.hint("merge"), ["contribution_id", "canonical_id"], "left").withColumn("_row", F.concat_ws("/", row_hash(*NODE_FIELDS), F.coalesce("_edges", F.lit(""))))
    return both.groupBy("canonical_id").agg(F.countDistinct("_row").alias("n_variants")).filter("n_variants > 1")


def merge(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row a node, distinct edges; raises on conflicting contributions."""
    bad = [r["canonical_id"] for r in conflicts(nodes, edges).orderBy("canonical_id").limit(5).collect()]
    if bad:
        raise ValueError(f"contributions disagree on {', '.join(bad)}")
    return first_wins(nodes, ["canonical_id"], "ingest_ordinal"), edges.select("caller_id", "callee_id", "edge_type", "metadata").distinct()


def last_wins(df: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    return dealt(df, *key).groupBy(*key).agg(F.max_by(F.struct(*rest), ordinal).alias("_r")).select(*key, *[F.col("_r")[c].alias(c) for c in rest])


def first_wins(df: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    return dealt(df, *key).groupBy(*key).agg(F.min_by(F.struct(*rest), ordinal).alias("_r")).select(*key, *[F.col("_r")[c].alias(c) for c in rest])


def is_synthetic(canonical: Column) -> Column:
    return canonical.startswith("http:") | canonical.startswith("package:")


def canonicalise(projects: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Normal paths, last row of each id and edge key, and only edges whose
    caller is known and whose callee is known or synthetic."""
    projects = last_wins(projects.withColumn("relative_file_path", X.normal_path(F.col("relative_file_path"))), ["id"], "ingest_ordinal")
    nodes = last_wins(nodes.withColumn("path", X.normal_path(F.col("path"))), ["canonical_id"], "ingest_ordinal")
    known = nodes.select("canonical_id").unionByName(projects.select(F.col("id").alias("canonical_id"))).distinct()
    edges = edges.join(known.select(F.col("canonical_id").alias("caller_id")), "caller_id", "left_semi")
    made = edges.filter(is_synthetic(F.col("callee_id")))
    real = edges.filter(~is_synthetic(F.col("callee_id"))).join(known.select(F.col("canonical_id").alias("callee_id")), "callee_id", "left_semi")
    return projects, nodes, last_wins(made.unionByName(real), ["caller_id", "callee_id", "edge_type"], "ingest_ordinal")


def synthetic_nodes(edges: DataFrame) -> DataFrame:
    """(canonical_id, kind) of http and package callees."""
    c = F.col("canonical_id")
    made = edges.select(F.col("callee_id").alias("canonical_id")).filter(is_synthetic(c)).distinct()
    return made.withColumn("kind", F.when(c.startswith("http:"), "Http").otherwise("Package"))


def diff(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Keys that are added, removed or changed, compared by a hash of all other
    columns: (key..., change)."""
    rest = sorted(c for c in before.columns if c not in key)
    hashed = [df.select(*key, F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), 256).alias(name)) for df, name in ((before, "_b"), (after, "_a"))]
    both = hashed[0].join(hashed[1], key, "full_outer")
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.col("_b") != F.col("_a"), "changed")
    return both.select(*key, change.alias("change")).filter("change is not null")


def assign_ids(canonical: DataFrame, previous: DataFrame) -> DataFrame:
    """(canonical_id) and earlier (canonical_id, id) -> (canonical_id, id): known
    ids stay, new ones follow the largest in order of canonical id."""
    joined = canonical.select("canonical_id").distinct().join(previous, "canonical_id", "left")
    largest = previous.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    fresh = global_rank(joined.filter("id is null").select("canonical_id"), ["canonical_id"], "_n", "ids")
    return joined.filter("id is not null").select("canonical_id", "id").unionByName(fresh.select("canonical_id", (F.col("_n") + largest).alias("id")))


def moved(before: DataFrame, after: DataFrame, key: str, content: list[str]) -> DataFrame:
    """Rows that vanished and came back under another key with equal content,
    where that content is unique on both sides: (old, new)."""
    gone = before.join(after.select(key), key, "left_anti")
    come = after.join(before.select(key), key, "left_anti")

    def unique(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*content).agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias(name)).filter("_n = 1").drop("_n")

    return unique(gone, "old").join(unique(come, "new"), content).select("old", "new")


def directories(paths: DataFrame, path: str = "path") -> DataFrame:
    """(path, name, parent_path, level): every ancestor of every file, the root
    '' named '/', without recursion."""
    folder = paths.select(X.parent_path(X.normal_path(F.col(path))).alias("p")).distinct()
    parts = F.when(F.col("p") == "", F.array().cast("array<string>")).otherwise(F.split("p", "/"))
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    every = folder.select(F.explode(prefixes).alias("path")).distinct()
    level = F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/")))
    name = F.when(F.col("path") == "", "/").otherwise(X.file_name(F.col("path")))
    return every.select("path", name.alias("name"), F.when(F.col("path") != "", X.parent_path(F.col("path"))).alias("parent_path"), level.alias("level"))


def directory_table(paths: DataFrame, path: str = "path") -> DataFrame:
    """(id, parent_id, path, name), numbered by level, then path."""
    ranked = global_rank(directories(paths, path), ["level", "path"], "id", "directories")
    parent = ranked.select(F.col("path").alias("parent_path"), F.col("id").alias("parent_id"))
    return ranked.join(parent, "parent_path", "left").select("id", "parent_id", "path", "name")


def closure(dirs: DataFrame) -> DataFrame:
    """(ancestor, descendant, depth) of (id, path), from path prefixes."""
    parts = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split("path", "/"))
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("up"), (F.size(parts) - n).alias("depth")))
    spread = dirs.select(F.col("id").alias("descendant_directory_id"), F.explode(ups).alias("u")).select("descendant_directory_id", "u.up", "u.depth")
    return spread.join(dirs.select(F.col("path").alias("up"), F.col("id").alias("ancestor_directory_id")), "up").select("ancestor_directory_id", "descendant_directory_id", F.col("depth").cast("int").alias("depth"))


def embedding_plan(nodes: DataFrame, previous: DataFrame) -> DataFrame:
    """Nodes (canonical_id, search_text, body_hash) against earlier ones with a
    vector: adds ``vector_embedding`` where it may be reused, and ``action``."""
    old = previous.filter("vector_embedding is not null and size(vector_embedding) > 0").select("canonical_id", F.col("search_text").alias("_s"), F.coalesce("body_hash", F.lit("")).alias("_h"), "vector_embedding")
    joined = nodes.join(old, "canonical_id", "left")
    same = (F.col("search_text") == F.col("_s")) & (F.coalesce("body_hash", F.lit("")) == F.col("_h"))
    same = F.coalesce(same, F.lit(False))
    return joined.select(*nodes.columns, F.when(same, F.col("vector_embedding")).alias("vector_embedding"), F.when(same, "reused").otherwise("generated").alias("action"))


def emitted_only(nodes: DataFrame, edges: DataFrame, project_id: str) -> tuple[DataFrame, DataFrame]:
    """Only one project's nodes and what goes out of it."""
    own = nodes.filter(F.col("project_id") == project_id)
    ids = own.select(F.col("canonical_id").alias("caller_id"))
    mine = edges.filter(F.col("caller_id") == project_id)
    return own, edges.join(ids, "caller_id", "left_semi").unionByName(mine.select(*edges.columns)).distinct()
