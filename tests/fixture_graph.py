"""A small graph about a harbour: two projects, nine code nodes, twelve edges."""

import datetime

from quillgraph import schemas
from quillgraph.graph import Graph

DIRECTORIES = [(1, None, "", "/"), (2, 1, "lib", "lib"), (3, 2, "lib/api", "api"), (4, 2, "lib/model", "model")]
CLOSURES = [(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 0), (1, 2, 1), (2, 3, 1), (2, 4, 1), (1, 3, 2), (1, 4, 2)]
DOCUMENTS = [
    (31, 3, "api.csproj", ".csproj", "lib/api/api.csproj", "ProjectFile"),
    (32, 4, "model.csproj", ".csproj", "lib/model/model.csproj", "ProjectFile"),
    (33, 3, "Berths.cs", ".cs", "lib/api/Berths.cs", "Source"),
    (34, 3, "Desk.cs", ".cs", "lib/api/Desk.cs", "Source"),
    (35, 4, "Vessel.cs", ".cs", "lib/model/Vessel.cs", "Source"),
    (36, 3, "notes.md", ".md", "lib/api/notes.md", "Markdown"),
]
PROJECTS = [(500, "Harbour.Api", 31, "p1"), (501, "Harbour.Model", 32, "p2")]
CODE = [
    (11, "berth-type", 500, 33, "Harbour.Api.Berths", "Berths", "Class", 3, 40, "Keeps the berths of a harbour.", [0.1, 0.9]),
    (12, "berth-assign", 500, 33, "Harbour.Api.Berths.Assign(Vessel)", "Berths.Assign(Vessel)", "Method", 8, 19, "Assigns a berth to a vessel.", [0.8, 0.3]),
    (13, "berth-free", 500, 33, "Harbour.Api.Berths.Free()", "Berths.Free()", "Method", 21, 30, "Lists free berths.", [0.3, 0.6]),
    (14, "tariff-type", 500, 34, "Harbour.Api.Tariffs", "Tariffs", "Class", 1, 25, "Knows the fees.", [0.5, 0.5]),
    (15, "tariff-fee", 500, 34, "Harbour.Api.Tariffs.Fee(Vessel)", "Tariffs.Fee(Vessel)", "Method", 4, 12, "Computes what a vessel pays.", [0.6, 0.2]),
    (16, "desk-arrive", 500, 34, "Harbour.Api.Desk.Arrive(Vessel)", "Desk.Arrive(Vessel)", "Method", 30, 44, "Takes in an arriving vessel.", [0.7, 0.1]),
    (17, "desk-plan", 500, 34, "Harbour.Api.Desk.Plan()", "Desk.Plan()", "Method", 46, 60, "Plans the day.", [0.2, 0.7]),
    (18, "vessel", 501, 35, "Harbour.Model.Vessel", "Vessel", "Class", 1, 20, "A vessel with a draught.", [0.9, 0.05]),
    (19, "floating", 501, 35, "Harbour.Model.Floating", "Floating", "Interface", 22, 26, "What floats.", [0.4, 0.45]),
]
EDGES = [
    (500, 11, "ParentOf"), (11, 12, "ParentOf"), (11, 13, "ParentOf"), (14, 15, "ParentOf"), (500, 501, "ProjectReference"),
    (16, 12, "MethodCall"), (16, 15, "MethodCall"), (17, 16, "MethodCall"), (12, 13, "MethodCall"),
    (12, 18, "Instantiates"), (15, 18, "FieldAccess"), (18, 19, "Implements"),
]


def harbour_graph(spark, vectors=True, extra_edges=(), notes=()) -> Graph:
    rows = {
        "directories": DIRECTORIES,
        "directory_closures": CLOSURES,
        "documents": DOCUMENTS,
        "graph_nodes": [(r[0], r[1], "Code") for r in CODE] + [(i, f"project:{path}", "Project") for i, path in ((500, "lib/api/api.csproj"), (501, "lib/model/model.csproj"))],
        "project_nodes": PROJECTS,
        "code_nodes": [(i, p, d, fqn, shown, kind, a, b, text, f"{shown} {text}", f"hash{i}", v if vectors else None) for i, _, p, d, fqn, shown, kind, a, b, text, v in CODE],
        "dependency_edges": [(a, b, t, None) for a, b, t in [*EDGES, *extra_edges]],
        "memory_nodes": list(notes),
    }
    return Graph(spark, {n: spark.createDataFrame(r, schemas.schema(n)) for n, r in rows.items()})


def note(i, node, content, tags, intent="Convention", target_hash=None, vector=None, minute=0):
    return (i, node, target_hash if target_hash is not None else f"hash{node}", content, "c" + content, tags, intent, vector, datetime.datetime(2024, 1, 1, 0, minute))
