"""Revisions of a graph on plain Parquet.

A table lies in a folder that never changes: nodes sorted by id, edges twice,
sorted by caller and by callee, and the keyword index of the nodes.  A revision is
a file in the ``commits`` log that names the folder of each table.  A commit writes
only the tables that differ and shares the others; of the keyword index it writes
the rows that differ, laid over the older layers.  The file of a commit is named by
its number and must not exist yet, so of two writers that began at one revision the
second fails and the first one's commit stays.  The current revision is the one
with the largest number; readers that pinned one keep a consistent state.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import schemas
from quillgraph.functions.storage import create, exists, remove
from quillgraph.graph import Graph
from quillgraph.operators import search

#: How tables are clustered: range by range, sorted inside.
CLUSTERED = {"graph_nodes": ["id"], "code_nodes": ["id"], "dependency_edges": ["caller_node_id", "callee_node_id", "edge_type"]}
INWARD, KEYWORDS = "edges_by_callee", "keywords"
#: Tables that the keyword index is made from.
SEARCHED = ("graph_nodes", "code_nodes", "documents", "project_nodes", "directories")
LOG = "number bigint, revision string, fingerprint string, tables map<string, struct<folder string, mark string>>, keywords array<string>"


def _log(spark: SparkSession, root: str) -> DataFrame:
    if not exists(spark, f"{root}/commits"):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).json(f"{root}/commits")


def current(spark: SparkSession, root: str):
    """The last committed row, or None."""
    rows = _log(spark, root).orderBy(F.desc("number")).limit(1).collect()
    return rows[0] if rows else None


def _row(spark: SparkSession, root: str, revision: str | None):
    rows = _log(spark, root) if revision is None else _log(spark, root).filter(F.col("revision") == revision)
    rows = rows.orderBy(F.desc("number")).limit(1).collect()
    if not rows:
        raise FileNotFoundError(f"{root}: {revision or 'no revision'}")
    return rows[0]


def fingerprint(table: DataFrame, name: str) -> str:
    """One hash of a table, whatever the order of its rows: their number, and sums of
    the halves of two 64-bit hashes of each row, which tell null from empty."""
    columns = sorted(table.columns)
    rows = table.select(*[F.xxhash64(F.lit(seed), *columns, *[F.col(c).isNull() for c in columns]).alias(f"_h{seed}") for seed in (0, 1)])
    halves = [half for seed in (0, 1) for half in (F.shiftrightunsigned(f"_h{seed}", 32), F.col(f"_h{seed}").bitwiseAND(F.lit((1 << 32) - 1)))]
    sums = [F.coalesce(F.sum(half), F.lit(0)).cast("string") for half in halves]
    return rows.agg(F.concat_ws(":", F.lit(name), F.count(F.lit(1)).cast("string"), *sums)).first()[0]


def _read(spark: SparkSession, root: str, folder: str, name: str) -> DataFrame:
    return spark.read.schema(schemas.schema("dependency_edges" if name == INWARD else name)).parquet(f"{root}/{folder}/{name}")


def commit(graph: Graph, root: str, keywords: bool = True) -> str:
    """Write what differs from the current revision, and give the new revision, or
    the current one if nothing differs.  Without ``keywords`` a revision whose log has
    no keyword index yet gets none; ``keyword_index`` makes it when it is first asked.

    A table that the graph holds as it was loaded is shared unread; others are
    written, compared as written, and dropped again if they are the same.  The log
    file is written last, so a failed commit leaves the earlier state in place.
    Raises ``RevisionChanged`` if another commit came first since the graph was
    loaded, or since this commit began."""
    spark, now, revision = graph.spark, current(graph.spark, root), uuid.uuid4().hex
    number, held = (now["number"] if now else 0) + 1, dict(now["tables"]) if now else {}
    if graph.stored and now and graph.revision != now["revision"]:
        raise schemas.RevisionChanged(f"revision {graph.revision} is no longer current")

    def write(df: DataFrame, name: str, order: list[str]) -> None:
        clustered = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
        clustered.write.parquet(f"{root}/{revision}/{name}")

    tables: dict[str, dict[str, str]] = {}
    for name in schemas.DDL:
        if graph.stored.get(name) is graph[name] and name in held:
            tables[name] = {"folder": held[name]["folder"], "mark": held[name]["mark"]}
            continue
        write(graph[name], name, CLUSTERED.get(name, []))
        mark = fingerprint(_read(spark, root, revision, name), name)
        same = name in held and held[name]["mark"] == mark
        tables[name] = {"folder": held[name]["folder"] if same else revision, "mark": mark}
        if same:
            remove(spark, f"{root}/{revision}/{name}")
    fresh = {name for name, at in tables.items() if at["folder"] == revision}
    if now and not fresh:
        remove(spark, f"{root}/{revision}")
        return now["revision"]
    made = Graph(spark, {name: _read(spark, root, at["folder"], name) for name, at in tables.items()})
    layers_held = list(now["keywords"]) if now else []
    if not layers_held:
        if keywords:
            search.write_index(made.code(wide=True), f"{root}/{revision}/{KEYWORDS}")
            layers_held = [revision]
    elif fresh & set(SEARCHED):
        layers = search.write_changes(made.code(wide=True), f"{root}/{revision}/{KEYWORDS}", [f"{root}/{k}/{KEYWORDS}" for k in layers_held])
        layers_held = [*layers_held, revision] if len(layers) > 1 else [revision]
    tables[INWARD] = {"folder": tables["dependency_edges"]["folder"], "mark": ""}
    if "dependency_edges" in fresh:
        write(made["dependency_edges"], INWARD, ["callee_node_id", "caller_node_id", "edge_type"])
    mark = "|".join(sorted(at["mark"] for at in tables.values() if at["mark"]))
    entry = {"number": number, "revision": revision, "fingerprint": mark, "tables": tables, "keywords": layers_held}
    if not create(spark, f"{root}/commits/{number:012d}.json", json.dumps(entry)):
        remove(spark, f"{root}/{revision}")
        raise schemas.RevisionChanged(f"commit {number} was made by another writer")
    return revision


def load(spark: SparkSession, root: str, revision: str | None = None) -> Graph:
    """The graph of a revision, the current one by default."""
    row = _row(spark, root, revision)
    tables = {name: _read(spark, root, row["tables"][name]["folder"], name) for name in schemas.DDL}
    return Graph(spark, tables, row["revision"], _read(spark, root, row["tables"][INWARD]["folder"], INWARD), dict(tables))


def keyword_index(spark: SparkSession, root: str, revision: str) -> search.KeywordIndex:
    """The keyword index of a revision's code nodes; where it was committed without
    one, the index is made beside its tables on the first call."""
    held = _row(spark, root, revision)["keywords"]
    if not held:
        named = f"{root}/{revision}/{KEYWORDS}.txt"
        if not exists(spark, named):
            folder = f"{KEYWORDS}-{uuid.uuid4().hex}"
            search.write_index(load(spark, root, revision).code(wide=True), f"{root}/{revision}/{folder}")
            create(spark, named, folder)  # of two readers that make it, the first one's stands
        return search.open_index(spark, f"{root}/{revision}/{spark.read.text(named).first()[0]}")
    return search.open_index(spark, [f"{root}/{k}/{KEYWORDS}" for k in held])


def expect(spark: SparkSession, root: str, revision: str) -> None:
    """Raise if the graph has moved on since a revision was pinned."""
    now = current(spark, root)
    if now is None or now["revision"] != revision:
        raise schemas.RevisionChanged(f"revision {revision} is no longer current")
