"""Tables of the graph model and its enumerations.

A graph is a set of immutable tables; a revision is one directory of Parquet
files with exactly these schemas (``quillgraph.sources.revisions``).
"""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


DDL = {
    "graph_nodes": "id bigint, canonical_id string, kind string",
    "code_nodes": "id bigint, project_node_id bigint, document_id bigint, fully_qualified_name string, display_name string, node_type string, start_line int, end_line int, summary string, search_text string, body_hash string, vector_embedding array<float>",
    "project_nodes": "id bigint, name string, project_document_id bigint, content_hash string",
    "dependency_edges": "caller_node_id bigint, callee_node_id bigint, edge_type string, metadata string",
    "directories": "id bigint, parent_id bigint, path string, name string",
    "directory_closures": "ancestor_directory_id bigint, descendant_directory_id bigint, depth int",
    "documents": "id bigint, directory_id bigint, file_name string, extension string, relative_path string, kind string",
    "memory_nodes": "id string, target_code_node_id bigint, target_code_hash string, content string, content_hash string, tags array<string>, intent string, vector_embedding array<float>, created_at timestamp",
}

RUN_STATE = "id int, graph_revision string, last_successful struct<completed_at timestamp, outcome string, diagnostics array<struct<severity string, message string>>>, last_attempt struct<completed_at timestamp, outcome string, diagnostics array<struct<severity string, message string>>>"


def schema(table: str) -> T.StructType:
    return _schema(DDL[table])


# Enumerations of the model, in their order.
NODE_TYPES = ("Class", "Interface", "Method", "Property", "Field", "Document", "Memory", "Component")
EDGE_TYPES = ("ProjectReference", "ParentOf", "MethodCall", "Implements", "Instantiates", "FieldAccess", "ServiceRegistration", "DocumentLink", "Import", "HttpRequest")
NODE_KINDS = ("Project", "Code", "Http", "Package")
DOCUMENT_KINDS = ("Source", "ProjectFile", "Markdown", "Other")
INTENTS = ("Convention", "Invariant", "Todo", "Warning", "Decision")
ACTIONS = ("Added", "Modified", "Deleted", "Renamed", "DirectoryDeleted", "DirectoryRenamed")

#: What impact and trace follow unless told otherwise.
FUNCTIONAL = tuple(t for t in EDGE_TYPES if t != "ParentOf")
EDGE_ORDINAL = {t: i for i, t in enumerate(EDGE_TYPES)}


class RevisionChanged(RuntimeError):
    """A page was asked of a revision that is no longer the current one."""
