"""Directory-scoped, keyset-paged views of the graph, and the workspace tree.

What a scope shows is worked out once for each revision and set of directories,
and stored in the order of the page key, so a page is a filter on that key that
reads the row groups it needs.
"""

from __future__ import annotations

import base64
import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph import schemas
from quillgraph.functions import text as X
from quillgraph.functions.ranking import global_rank
from quillgraph.functions.storage import kept, written
from quillgraph.graph import Graph
from quillgraph.operators import navigation

ORDER_NODES = ["phase", "id"]
ORDER_EDGES = ["caller", "callee", "edge_type"]


@dataclass(frozen=True)
class Cursor:
    """Where a page ended, bound to what was asked."""

    kind: str
    scope: str
    revision: str
    key: tuple

    def encode(self) -> str:
        raw = json.dumps([self.kind, self.scope, self.revision, list(self.key)], separators=(",", ":"))
        return base64.urlsafe_b64encode(raw.encode()).decode().rstrip("=")

    @staticmethod
    def decode(token: str, kind: str, scope: str, revision: str) -> Cursor:
        if len(token) > 2048:
            raise ValueError("cursor is too long")
        try:
            k, s, r, key = json.loads(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)))
        except Exception as error:
            raise ValueError("cursor can't be read") from error
        if k != kind or s != scope:
            raise ValueError("cursor belongs to another request")
        if r != revision:
            raise schemas.RevisionChanged("the graph has a new revision; start again")
        return Cursor(k, s, r, tuple(key))


def scope_hash(directory_ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, sorted(set(directory_ids)))).encode()).hexdigest()


def _checked(directory_ids: list[int], page_size: int) -> list[int]:
    if not 1 <= page_size <= 5000:
        raise ValueError("page size must be 1 to 5000")
    if any(d <= 0 for d in directory_ids):
        raise ValueError("directory ids must be positive")
    return sorted(set(directory_ids))


def selected(graph: Graph, directory_ids: list[int]) -> DataFrame:
    """Ids of code and project nodes whose document lies below a directory."""
    scope = graph["directory_closures"].filter(F.col("ancestor_directory_id").isin(*directory_ids)).select(F.col("descendant_directory_id").alias("directory_id")).distinct()
    docs = graph["documents"].join(scope, "directory_id", "left_semi").select(F.col("id").alias("document_id"))
    code = graph["code_nodes"].join(docs, "document_id", "left_semi").select("id")
    projects = graph["project_nodes"].join(docs, F.col("project_document_id") == docs["document_id"], "left_semi").select("id")
    return code.unionByName(projects).distinct()


def boundary(graph: Graph, chosen: DataFrame) -> DataFrame:
    """Neighbours of the chosen nodes that are not chosen."""
    e = graph.edges
    out = e.join(chosen.withColumnRenamed("id", "caller"), "caller", "left_semi").select(F.col("callee").alias("id"))
    into = e.join(chosen.withColumnRenamed("id", "callee"), "callee", "left_semi").select(F.col("caller").alias("id"))
    return out.unionByName(into).distinct().join(chosen, "id", "left_anti")


def scoped_nodes(graph: Graph, directory_ids: list[int]) -> DataFrame:
    """(phase, id, label, type, scope, project_id): selected, then boundary.
    With the root directory everything that has a document is selected, and the
    boundary is the http and package nodes that touch it."""
    root = graph["directories"].filter(F.col("path") == "").filter(F.col("id").isin(*directory_ids)) if directory_ids else None
    shown = graph.display()
    if root is not None and not root.isEmpty():
        chosen = written(shown.filter(F.col("kind").isin("Code", "Project") & F.col("document_id").isNotNull()).select("id"), "scope")
        rest = boundary(graph, chosen).join(graph["graph_nodes"].filter(F.col("kind").isin("Http", "Package")), "id", "left_semi")
    else:
        chosen = written(selected(graph, directory_ids), "scope")
        rest = boundary(graph, chosen)
    both = chosen.withColumn("phase", F.lit(0)).unionByName(rest.withColumn("phase", F.lit(1)))
    out = both.join(shown, "id").filter("label is not null and type is not null")
    scope = F.when(F.col("phase") == 0, "selected").otherwise("external")
    return out.select("phase", "id", "canonical_id", "label", "type", scope.alias("scope"), "project_id")


def _stored(graph: Graph, kind: str, directory_ids: list[int]) -> DataFrame:
    """The scoped nodes or edges, kept for a stored revision."""
    build, order = (scoped_nodes, ORDER_NODES) if kind == "nodes" else (scoped_edges, ORDER_EDGES)
    if graph.revision == "initial":
        return build(graph, directory_ids)
    name = f"scope-{kind}-{graph.revision}-{scope_hash(directory_ids)}"
    return kept(graph.spark, name, lambda: build(graph, directory_ids).repartitionByRange(*order).sortWithinPartitions(*order))


def _later(rows: DataFrame, order: list[str], key: tuple) -> DataFrame:
    """Rows after a key; its first column alone is a filter that a scan can use."""
    at = [F.lit(v).cast(rows.schema[c].dataType).alias(c) for v, c in zip(key, order)]
    return rows.filter((F.col(order[0]) >= at[0]) & (F.struct(*order) > F.struct(*at)))


def nodes_page(graph: Graph, directory_ids: list[int], page_size: int = 2000, after: tuple[int, int] = (-1, 0)) -> DataFrame:
    """Nodes after the key (phase, id), by that key."""
    ids = _checked(directory_ids, page_size)
    return _later(_stored(graph, "nodes", ids), ORDER_NODES, after).orderBy(*ORDER_NODES).limit(page_size)


def scoped_edges(graph: Graph, directory_ids: list[int]) -> DataFrame:
    """Edges that touch a selected node: internal if both ends are selected."""
    nodes = graph.display().filter("label is not null and type is not null").select("id", "canonical_id")
    chosen = written(selected(graph, directory_ids), "scope").withColumn("in", F.lit(True))
    a = nodes.join(chosen, "id", "left").select(F.col("id").alias("caller"), F.col("canonical_id").alias("caller_canonical_id"), F.coalesce("in", F.lit(False)).alias("a_in"))
    b = nodes.join(chosen, "id", "left").select(F.col("id").alias("callee"), F.col("canonical_id").alias("callee_canonical_id"), F.coalesce("in", F.lit(False)).alias("b_in"))
    both = graph.edges.join(a, "caller").join(b, "callee").filter("a_in or b_in")
    scope = F.when(F.col("a_in") & F.col("b_in"), "internal").otherwise("boundary")
    return both.select("caller", "callee", "edge_type", "caller_canonical_id", "callee_canonical_id", X.edge_label(F.col("edge_type")).alias("label"), scope.alias("scope"), "metadata")


def edges_page(graph: Graph, directory_ids: list[int], page_size: int = 2000, after: tuple | None = None) -> DataFrame:
    """Edges after the key (caller, callee, type as text), by that key."""
    ids = _checked(directory_ids, page_size)
    every = _stored(graph, "edges", ids or [-1])
    if after is not None:
        every = _later(every, ORDER_EDGES, after)
    return every.orderBy(*ORDER_EDGES).limit(page_size)


@dataclass
class Page:
    items: list
    next_cursor: str | None
    revision: str
    total: int | None = None


def page(graph: Graph, kind: str, directory_ids: list[int], page_size: int = 2000, cursor: str | None = None, include_total: bool = False) -> Page:
    """One page for a client: at most ``page_size`` rows, and the next cursor."""
    scope = scope_hash(directory_ids)
    at = Cursor.decode(cursor, kind, scope, graph.revision).key if cursor else None
    ids = _checked(directory_ids, page_size)
    if not ids:
        return Page([], None, graph.revision, 0 if include_total else None)
    every, order = _stored(graph, kind, ids), ORDER_NODES if kind == "nodes" else ORDER_EDGES
    rows = (every if at is None else _later(every, order, at)).orderBy(*order).limit(page_size + 1).collect()
    more = len(rows) > page_size
    rows = rows[:page_size]
    token = Cursor(kind, scope, graph.revision, tuple(rows[-1][c] for c in order)).encode() if more else None
    return Page(rows, token, graph.revision, every.count() if include_total else None)


def pages(graph: Graph, kind: str, directory_ids: list[int], page_size: int = 2000) -> DataFrame:
    """(page, n, first, last, total): the key of the first and the last row of every
    page that a client gets who follows the cursors, in one pass over the scope."""
    ids, order = _checked(directory_ids, page_size), ORDER_NODES if kind == "nodes" else ORDER_EDGES
    ranked = global_rank(_stored(graph, kind, ids or [-1]).select(*order), order, "_rank", "pages")
    number = F.floor((F.col("_rank") - 1) / page_size) + 1
    cut = ranked.groupBy(number.alias("page")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("first"), F.max(F.struct(*order)).alias("last"))
    total = ranked.agg(F.count(F.lit(1)).alias("total"))
    return cut.crossJoin(F.broadcast(total))


def connections_page(graph: Graph, node_id: int, page_size: int = 100, cursor: str | None = None, include_total: bool = False) -> Page:
    """One page of a node's peers for a client, by id, bound to the revision."""
    if node_id <= 0:
        raise ValueError("node id must be positive")
    at = Cursor.decode(cursor, "connections", str(node_id), graph.revision).key[0] if cursor else 0
    rows = navigation.connections(graph, node_id, page_size, at, more=1).orderBy("peer").collect()
    later, rows = len(rows) > page_size, rows[:page_size]
    token = Cursor("connections", str(node_id), graph.revision, (rows[-1]["peer"],)).encode() if later else None
    return Page(rows, token, graph.revision, navigation.connection_total(graph, node_id) if include_total else None)


def tree_parent(graph: Graph, path: str) -> DataFrame:
    """(path, parent_path, parent_directory_id) of a directory; no row if unknown."""
    here = graph["directories"].filter(F.col("path") == path)
    parent = graph["directories"].select(F.col("id").alias("parent_id"), F.col("path").alias("parent_path"))
    return here.join(parent, "parent_id", "left").select("path", "parent_path", F.col("parent_id").alias("parent_directory_id"))


def tree(graph: Graph, path: str) -> DataFrame:
    """Children of a directory: (kind_order, kind, label, path, id, child_count,
    has_children, project_id), folders, then project files, then other files."""
    d, f = graph["directories"], graph["documents"]
    here = d.filter(F.col("path") == path).select(F.col("id").alias("parent_id"))
    below = d.join(F.broadcast(here), "parent_id", "left_semi")
    subdirs = d.select(F.col("parent_id").alias("id")).join(below, "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("n_dirs"))
    files = f.select(F.col("directory_id").alias("id")).join(below, "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("n_files"))
    folders = below.join(subdirs, "id", "left").join(files, "id", "left")
    n = F.coalesce("n_dirs", F.lit(0)) + F.coalesce("n_files", F.lit(0))
    folders = folders.select(F.lit(0).alias("kind_order"), F.lit("folder").alias("kind"), F.col("name").alias("label"), "path", "id", n.cast("long").alias("child_count"), (n > 0).alias("has_children"), F.lit(None).cast("long").alias("project_id"))
    own = f.join(F.broadcast(here.withColumnRenamed("parent_id", "directory_id")), "directory_id", "left_semi")
    users = graph["project_nodes"].select(F.col("project_document_id").alias("id"), "name", F.col("id").alias("pid")).join(own, "id", "left_semi")
    own = own.join(users.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name"), F.min("pid").alias("pid")), "id", "left")
    project = F.col("kind") == "ProjectFile"
    one = project & (F.col("n") == 1)
    leaves = own.select(
        F.when(project, 1).otherwise(2).alias("kind_order"), F.when(project, "project").otherwise("file").alias("kind"),
        F.when(one, F.col("name")).otherwise(F.col("file_name")).alias("label"), F.col("relative_path").alias("path"), "id",
        F.lit(0).cast("long").alias("child_count"), F.lit(False).alias("has_children"), F.when(one, F.col("pid")).alias("project_id"),
    )
    return folders.unionByName(leaves).orderBy("kind_order", "label", "path")
