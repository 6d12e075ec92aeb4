"""Counts and health of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph import schemas
from quillgraph.functions import text as X
from quillgraph.graph import Graph


def counts(graph: Graph) -> DataFrame:
    """(name, n): the counts of a statistics or overview page, each table read
    once and pre-aggregated."""

    def of(table: str, *named) -> DataFrame:
        made = [F.count(F.when(cond, 1)).alias(name) for name, cond in named]
        one = graph[table].agg(*made)
        stacked = ", ".join(f"'{name}', {name}" for name, _ in named)
        return one.selectExpr(f"stack({len(named)}, {stacked}) AS (name, n)")

    yes = F.lit(True)
    vector = F.col("vector_embedding").isNotNull() & (F.size("vector_embedding") > 0)
    parts = [
        of("documents", ("documents", yes)),
        of("directories", ("directories", yes)),
        of("project_nodes", ("projects", yes)),
        of("code_nodes", ("code_nodes", yes), ("code_vectors", vector)),
        of("dependency_edges", ("edges", yes)),
        of("memory_nodes", ("memories", yes)),
        of("graph_nodes", ("http_nodes", F.col("kind") == "Http"), ("package_nodes", F.col("kind") == "Package")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def by_language(graph: Graph) -> DataFrame:
    """(language, documents, nodes, vectors) over documents and their nodes."""
    code = graph["code_nodes"].groupBy("document_id").agg(F.count(F.lit(1)).alias("nodes"), F.count(F.when(F.size("vector_embedding") > 0, 1)).alias("vectors"))
    docs = graph["documents"].select(F.col("id").alias("document_id"), X.language(F.col("extension")).alias("language"))
    joined = docs.join(code, "document_id", "left")
    return joined.groupBy("language").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("nodes"), F.lit(0)).alias("nodes"), F.coalesce(F.sum("vectors"), F.lit(0)).alias("vectors"))


def by_edge_type(graph: Graph) -> DataFrame:
    return graph.edges.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


def unknown_values(df: DataFrame, column: str, known) -> DataFrame:
    """At most one value outside an enumeration: the readability check."""
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*known)).select(column).limit(1)


def health(graph: Graph, applied: set[str] | None = None, supported: set[str] | None = None) -> str:
    """missing, incompatible, upgrade_required, unreadable or ready."""
    applied, supported = applied or set(), supported or set()
    if not graph.tables:
        return "missing"
    if applied - supported:
        return "incompatible"
    if supported - applied:
        return "upgrade_required"
    checks = (("graph_nodes", "kind", schemas.NODE_KINDS), ("dependency_edges", "edge_type", schemas.EDGE_TYPES), ("documents", "kind", schemas.DOCUMENT_KINDS))
    if any(not unknown_values(graph[t], c, known).isEmpty() for t, c, known in checks):
        return "unreadable"
    return "ready"


def latest_runs(attempts: DataFrame) -> DataFrame:
    """Attempts (workspace, completed_at, outcome, ordinal) -> the last attempt
    and, kept apart, the last success of each workspace."""
    place = F.struct("completed_at", "ordinal")
    good = F.when(F.col("outcome") == "success", place)
    return attempts.groupBy("workspace").agg(
        F.max(place).getField("completed_at").alias("last_attempt"),
        F.max_by("outcome", place).alias("last_outcome"),
        F.max(good).getField("completed_at").alias("last_success"),
    )


def bounded_diagnostics(runs: DataFrame, column: str = "diagnostics", most: int = 20, length: int = 512) -> DataFrame:
    """Diagnostics (array of severity, message) sorted by severity, cut to
    ``most`` with a last row that says how many are missing, messages shortened."""
    rank = lambda s: F.when(s == "error", 0).when(s == "cancelled", 1).otherwise(2)
    keyed = F.transform(column, lambda d, i: F.struct(rank(d["severity"]).alias("r"), i.alias("i"), d["severity"].alias("severity"), F.when(F.length(d["message"]) > length, F.concat(F.substring(d["message"], 1, length - 1), F.lit("…"))).otherwise(d["message"]).alias("message")))
    ordered = F.transform(F.sort_array(keyed), lambda d: F.struct(d["severity"].alias("severity"), d["message"].alias("message")))
    more = F.array(F.struct(F.lit("truncated").alias("severity"), F.concat((F.size(column) - (most - 1)).cast("string"), F.lit(" more")).alias("message")))
    return runs.withColumn(column, F.when(F.size(column) <= most, ordered).otherwise(F.concat(F.slice(ordered, 1, most - 1), more)))


RUN = "outcome string, kind string, scope string, started_at timestamp, completed_at timestamp, duration_ms double, phases array<struct<name string, duration_ms double>>, diagnostics array<struct<code string, severity string, message string>>"
# What a stored run may hold.
LIMITS = {"json": 524_288, "scope": 512, "phases": 16, "phase": 64, "diagnostics": 20, "code": 64, "severity": 16, "message": 1024}
OUTCOMES, KINDS = ("succeeded", "failed", "cancelled"), ("full", "incremental")


def _limited(c: Column, name: str) -> Column:
    return F.when(F.length(c) > LIMITS[name], F.concat(F.substring(c, 1, LIMITS[name] - 1), F.lit("…"))).otherwise(c)


def _bounded(run: Column) -> Column:
    """A run within its limits: errors first, then a cancellation, then the rest in
    their order; a last row says how many were left out."""
    most = LIMITS["diagnostics"]
    all_ = F.coalesce(run["diagnostics"], F.array().cast("array<struct<code string, severity string, message string>>"))
    rank = lambda d: F.when(d["severity"] == "error", 0).when(d["code"] == "index-cancelled", 1).otherwise(2)
    ordered = F.array_sort(F.transform(all_, lambda d, i: F.struct(rank(d).alias("r"), i.alias("i"), d.alias("d"))))
    kept = F.transform(
        F.slice(ordered, 1, F.when(F.size(all_) > most, most - 1).otherwise(most)),
        lambda x: F.struct(_limited(x["d"]["code"], "code").alias("code"), _limited(x["d"]["severity"], "severity").alias("severity"), _limited(x["d"]["message"], "message").alias("message")),
    )
    left = F.concat((F.size(all_) - (most - 1)).cast("string"), F.lit(" more are left out"))
    more = F.array(F.struct(F.lit("diagnostics-truncated").alias("code"), F.lit("info").alias("severity"), left.alias("message")))
    phases = F.transform(F.slice(F.coalesce(run["phases"], F.array().cast("array<struct<name string, duration_ms double>>")), 1, LIMITS["phases"]), lambda p: F.struct(_limited(p["name"], "phase").alias("name"), p["duration_ms"].alias("duration_ms")))
    plain = [run[c].alias(c) for c in ("outcome", "kind")]
    times = [run[c].alias(c) for c in ("started_at", "completed_at", "duration_ms")]
    return F.struct(*plain, _limited(run["scope"], "scope").alias("scope"), *times, phases.alias("phases"), F.when(F.size(all_) > most, F.concat(kept, more)).otherwise(kept).alias("diagnostics"))


def encode_run(run: Column) -> Column:
    """A run (a struct of RUN) as JSON within its limits."""
    return F.to_json(_bounded(run))


def decode_run(json: Column) -> Column:
    """The run that a JSON text holds, within its limits; null if the text is too
    long or a field has no allowed value."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (c >= 0) & (c < float("inf"))

    def checked(run: Column) -> Column:
        known = run["outcome"].isin(*OUTCOMES) & run["kind"].isin(*KINDS) & (F.trim(run["scope"]) != "")
        times = (run["completed_at"] >= run["started_at"]) & finite(run["duration_ms"])
        phases = F.coalesce(F.forall(run["phases"], lambda p: p["name"].isNotNull() & finite(p["duration_ms"])), F.lit(True))
        notes = F.coalesce(F.forall(run["diagnostics"], lambda d: d["code"].isNotNull() & d["severity"].isNotNull() & d["message"].isNotNull()), F.lit(True))
        return F.when((F.length(json) <= LIMITS["json"]) & known & times & phases & notes, _bounded(run))

    return X.let(F.from_json(json, RUN), checked)


def snapshot(graph: Graph) -> DataFrame:
    """One row: revision, state, all counts, and languages and edge types as arrays."""
    whole = counts(graph).agg(F.map_from_entries(F.collect_list(F.struct("name", "n"))).alias("c")).first()["c"]
    languages = [tuple(r) for r in by_language(graph).orderBy("language").collect()]
    types = [tuple(r) for r in by_edge_type(graph).orderBy("edge_type").collect()]
    ddl = ", ".join(["revision string", "state string", *[f"{n} bigint" for n in whole], "languages array<struct<language string, documents bigint, nodes bigint, vectors bigint>>", "edge_types array<struct<edge_type string, n bigint>>"])
    return graph.spark.createDataFrame([(graph.revision, health(graph), *whole.values(), languages, types)], ddl)
