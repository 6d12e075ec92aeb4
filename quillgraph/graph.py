"""The graph: its tables as lazy DataFrames, and the facade over them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import schemas
from quillgraph.functions import text as X


def _edges(table: DataFrame) -> DataFrame:
    return table.select(F.col("caller_node_id").alias("caller"), F.col("callee_node_id").alias("callee"), "edge_type", "metadata")


def _among(table: DataFrame, ids: list[int] | None) -> DataFrame:
    return table if ids is None else table.filter(F.col("id").isin(ids))


@dataclass
class Graph:
    """Tables of one revision.  ``revision`` names it; all reads see one state,
    since a revision's files never change.  A stored revision has its nodes
    clustered by id, its edges by caller, and a copy of them, ``inward``, by callee,
    so that a filter on a few ids reads a few row groups."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    revision: str = "initial"
    inward: DataFrame | None = None
    #: The tables as they were loaded; a commit shares those that still stand.
    stored: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.tables:
            self.tables[name] = self.spark.createDataFrame([], schemas.schema(name))
        return self.tables[name]

    @property
    def edges(self) -> DataFrame:
        return _edges(self["dependency_edges"])

    @property
    def edges_in(self) -> DataFrame:
        """The same edges, for looking up callees."""
        return self.edges if self.inward is None else _edges(self.inward)

    def code(self, wide: bool = False, only: list[int] | None = None) -> DataFrame:
        """Code nodes with canonical id and document path; the project id is null
        where there is no such project.  ``wide`` adds search text, hash and
        vector; ``only`` names the ids asked for."""
        c, g, d = _among(self["code_nodes"], only), _among(self["graph_nodes"], only), self["documents"]
        narrow = ["id", "canonical_id", "project_node_id", "document_id", "fully_qualified_name", "display_name", "node_type", "start_line", "end_line", "summary"]
        columns = narrow + (["search_text", "body_hash", "vector_embedding"] if wide else [])
        out = c.join(g.select("id", "canonical_id"), "id")
        out = out.join(d.select(F.col("id").alias("document_id"), "relative_path"), "document_id")
        out = out.join(self["project_nodes"].select(F.col("id").alias("_known")), F.col("project_node_id") == F.col("_known"), "left")
        return out.withColumn("project_node_id", F.col("_known")).select(*columns, "relative_path")

    def projects(self) -> DataFrame:
        p, g, d = self["project_nodes"], self["graph_nodes"], self["documents"]
        out = p.join(g.select("id", "canonical_id"), "id").join(d.select(F.col("id").alias("project_document_id"), "relative_path"), "project_document_id")
        return out.select("id", "canonical_id", "name", "content_hash", "project_document_id", "relative_path")

    def edge_list(self) -> DataFrame:
        """Edges with the canonical ids of both ends."""
        g = self["graph_nodes"]
        a = g.select(F.col("id").alias("caller"), F.col("canonical_id").alias("caller_canonical_id"))
        b = g.select(F.col("id").alias("callee"), F.col("canonical_id").alias("callee_canonical_id"))
        return self.edges.join(a, "caller").join(b, "callee").select("caller", "callee", "caller_canonical_id", "callee_canonical_id", "edge_type", "metadata")

    def display(self, only: list[int] | None = None) -> DataFrame:
        """Every node, or those of a few ids, with label, lower-cased type, project
        and document."""
        g = _among(self["graph_nodes"], only)
        c = _among(self["code_nodes"], only).select("id", "fully_qualified_name", "node_type", "project_node_id", F.col("document_id").alias("_cd"))
        p = _among(self["project_nodes"], only).select("id", "name", F.col("project_document_id").alias("_pd"))
        joined = g.join(c, "id", "left").join(p, "id", "left")
        name = F.coalesce("fully_qualified_name", "name")
        kind = F.when(F.col("node_type").isNotNull(), F.lower("node_type")).when(F.col("name").isNotNull(), F.lit("project")).otherwise(F.lower("kind"))
        project = F.when(F.col("name").isNotNull(), F.col("id")).otherwise(F.col("project_node_id"))
        return joined.select("id", "canonical_id", "kind", X.node_label(F.col("canonical_id"), name).alias("label"), kind.alias("type"), project.alias("project_id"), F.coalesce("_cd", "_pd").alias("document_id"))
