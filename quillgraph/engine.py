"""The facade: one object a workspace and revision, one method an operation.

Methods return lazy DataFrames, but for those that page or write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import match
from quillgraph.graph import Graph
from quillgraph.operators import logs, memories, navigation, paging, render, search, statistics
from quillgraph.sources import revisions


class CodeGraph:
    """A committed graph.  Without a revision the current one is pinned."""

    def __init__(self, spark: SparkSession, root: str | None = None, revision: str | None = None, graph: Graph | None = None):
        self.spark, self.root = spark, root
        self.graph = graph or revisions.load(spark, root, revision)

    def _root(self, identifier: str | int) -> DataFrame:
        asked = self.spark.createDataFrame([(str(identifier),)], "identifier string")
        found = navigation.resolve(self.graph, asked).filter("id is not null").select("id")
        if found.isEmpty():
            raise KeyError(identifier)
        return found

    def search(self, text: str, query: list[float] | None = None, limit: int = 10, project_id: int | None = None, node_types=None, include_memories: bool = False, tags=None) -> DataFrame:
        """(rank, score, node fields) by fused rank."""
        corpus = self.graph.code(wide=True)
        notes = self._notes() if include_memories else None
        index = revisions.keyword_index(self.spark, self.root, self.graph.revision) if self.root else None
        ranked = search.hybrid(corpus, text, query, limit, project_id, node_types, notes, tags, index)
        return self.graph.code().join(F.broadcast(ranked.drop("canonical_id")), "id").orderBy("rank")

    def _notes(self) -> DataFrame:
        owner = self.graph.code().select(F.col("id").alias("target_code_node_id"), "canonical_id", F.col("fully_qualified_name").alias("owner"), "node_type", "project_node_id")
        m = self.graph["memory_nodes"].join(owner, "target_code_node_id")
        return m.select(F.col("id").alias("memory_id"), F.col("target_code_node_id").alias("id"), "canonical_id", "content", "owner", "tags", "vector_embedding", "node_type", "project_node_id")

    def impact(self, identifier: str | int, max_depth: int = 3, transitive: bool = True, edge_types=None) -> navigation.Walk:
        return navigation.impact(self.graph, self._root(identifier), max_depth, transitive, edge_types)

    def callees(self, identifier: str | int, edge_types=None) -> DataFrame:
        return navigation.callees(self.graph, self._root(identifier), edge_types).orderBy("fully_qualified_name", "id")

    def trace(self, node_id: int, direction: str = "callee", max_depth: int = 3, budget: int = 1000) -> navigation.Walk:
        return navigation.trace(self.graph, node_id, direction, max_depth, budget)

    def context(self, node_id: int, limit: int = 10) -> DataFrame:
        return navigation.context(self.graph, node_id, limit)

    def node(self, node_id: int) -> DataFrame:
        """The target of a context: its fields, or no row."""
        return self.graph.code(only=[node_id])

    def inheritors(self, node_id: int) -> DataFrame:
        if node_id <= 0:
            raise ValueError("node id must be positive")
        return navigation.inheritors(self.graph, self.spark.createDataFrame([(node_id,)], "id bigint")).orderBy("fully_qualified_name", "id")

    def connections(self, node_id: int, page_size: int = 100, after: int = 0) -> DataFrame:
        return navigation.connections(self.graph, node_id, page_size, after)

    def connections_page(self, node_id: int, **options) -> paging.Page:
        """A page of connections with cursor, revision and, if asked, the total."""
        return paging.connections_page(self.graph, node_id, **options)

    def highlight(self, node_id: int) -> DataFrame:
        return navigation.highlight(self.graph, node_id)

    def nodes_page(self, directory_ids: list[int], **options) -> paging.Page:
        return paging.page(self.graph, "nodes", directory_ids, **options)

    def edges_page(self, directory_ids: list[int], **options) -> paging.Page:
        return paging.page(self.graph, "edges", directory_ids, **options)

    def tree(self, path: str = "") -> DataFrame:
        return paging.tree(self.graph, path)

    def tree_parent(self, path: str) -> DataFrame:
        return paging.tree_parent(self.graph, path)

    def stats(self) -> DataFrame:
        return statistics.snapshot(self.graph)

    def counts(self) -> DataFrame:
        return statistics.counts(self.graph)

    def languages(self) -> DataFrame:
        return statistics.by_language(self.graph)

    def edge_types(self) -> DataFrame:
        return statistics.by_edge_type(self.graph)

    def memories(self, node_ids: list[int], intents=None) -> DataFrame:
        return memories.of_nodes(self.graph, self.spark.createDataFrame([(i,) for i in node_ids], "node_id bigint"), intents)

    def memories_by_id(self, memory_ids: list[str]) -> DataFrame:
        return memories.batch(self.graph, self.spark.createDataFrame([(i,) for i in memory_ids], "id string"))

    def _recommitted(self, rows: DataFrame) -> CodeGraph:
        tables = dict(self.graph.tables) | {"memory_nodes": rows}
        changed = Graph(self.spark, tables, self.graph.revision, self.graph.inward, self.graph.stored)
        return CodeGraph(self.spark, self.root, revisions.commit(changed, self.root))

    def attach_memories(self, notes: DataFrame, embed=None) -> CodeGraph:
        """The graph of the new revision, with notes attached."""
        return self._recommitted(self.graph["memory_nodes"].unionByName(memories.attach(self.graph, notes, embed)))

    def delete_memory(self, memory_id: str) -> CodeGraph:
        return self._recommitted(memories.delete(self.graph, memory_id))

    def reduce_output(self, lines: DataFrame, any_of=(), all_of=(), none_of=(), context: int = 3, max_chars: int = 4000, max_lines: int = 5000, max_bytes: int = 1 << 20, expression: str | None = None) -> DataFrame:
        """What is left of captured logs: lines by terms, or by a match expression."""
        kept = logs.capture(lines, max_lines, max_bytes).drop("cut")
        test = logs.matches(F.col("text"), any_of, all_of, none_of) if expression is None else match.match(F.col("text"), expression)
        found = logs.blocks(kept, test, context)
        return logs.result(kept, found, max_chars)

    def as_json(self, df: DataFrame) -> DataFrame:
        return render.as_json(df)
