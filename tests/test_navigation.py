"""Walks, context, search and notes on the harbour graph, and invariants on
generated graphs."""

import random

import pytest
from fixture_graph import harbour_graph, note
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph import schemas
from quillgraph.functions import text as X
from quillgraph.graph import Graph
from quillgraph.operators import memories, navigation, paging, render, search, statistics


@pytest.fixture(scope="module")
def graph(spark):
    return harbour_graph(spark)


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id bigint")


def resolved(graph, *texts):
    asked = graph.spark.createDataFrame([(t,) for t in texts], "identifier string")
    return {r["identifier"]: r["id"] for r in navigation.resolve(graph, asked).collect()}


def edge_set(df):
    return {(r["caller"], r["callee"], r["edge_type"]) for r in df.collect()}


def test_resolution(graph):
    got = resolved(graph, "11", "vessel", "Harbour.Api.Berths", "harbour.api.berths.assign(vessel)", "77", "nothing")
    assert got == {"11": 11, "vessel": 18, "Harbour.Api.Berths": 11, "harbour.api.berths.assign(vessel)": 12, "77": None, "nothing": None}


def test_impact(graph, spark):
    direct = navigation.impact(graph, ids(spark, 18), transitive=False)
    assert {r["id"] for r in direct.nodes.collect()} == {12, 15}
    assert edge_set(direct.edges) == {(12, 18, "Instantiates"), (15, 18, "FieldAccess")}
    deep = navigation.impact(graph, ids(spark, 13), 2, edge_types=["MethodCall"])
    assert [r["id"] for r in deep.nodes.orderBy("fully_qualified_name", "id").collect()] == [12, 16]
    assert edge_set(deep.edges) == {(12, 13, "MethodCall"), (16, 12, "MethodCall")}
    shown = navigation.ordered_edges(graph, navigation.impact(graph, ids(spark, 18), 2).edges).collect()
    assert [(r["caller_canonical_id"], r["callee_canonical_id"]) for r in shown] == [("berth-assign", "vessel"), ("desk-arrive", "berth-assign"), ("desk-arrive", "tariff-fee"), ("tariff-fee", "vessel")]


def test_cycle_brings_the_root_in(spark):
    g = harbour_graph(spark, extra_edges=[(13, 17, "MethodCall")])
    got = navigation.impact(g, ids(spark, 13), 10)
    assert {r["id"] for r in got.nodes.collect()} == {12, 13, 16, 17}
    assert (13, 17, "MethodCall") in edge_set(got.edges)


def test_large_frontiers_are_joined(graph, spark, monkeypatch):
    monkeypatch.setattr(navigation, "FEW", 1)
    got = navigation.impact(graph, ids(spark, 18), 3)
    assert {r["id"] for r in got.nodes.collect()} == {12, 15, 16, 17} and got.edges.count() == 5
    assert {r["id"] for r in navigation.callees(graph, ids(spark, 12, 16)).collect()} == {12, 13, 15, 18}
    assert {r["identifier"]: r["id"] for r in navigation.resolve(graph, spark.createDataFrame([("vessel",), ("12",), ("x",)], "identifier string")).collect()} == {"vessel": 18, "12": 12, "x": None}


def test_projects_are_no_result_but_keep_their_edges(graph, spark):
    got = navigation.impact(graph, ids(spark, 11), 1, edge_types=schemas.EDGE_TYPES)
    assert got.nodes.count() == 0 and edge_set(got.edges) == {(500, 11, "ParentOf")}


def test_callees_and_inheritors(graph, spark):
    assert [r["id"] for r in navigation.callees(graph, ids(spark, 12)).orderBy("fully_qualified_name").collect()] == [13, 18]
    got = navigation.callees(graph, ids(spark, 11), schemas.EDGE_TYPES).orderBy("fully_qualified_name")
    assert [r["id"] for r in got.collect()] == [12, 13]
    g = harbour_graph(spark, extra_edges=[(14, 19, "Implements"), (13, 19, "Implements")])
    assert {r["id"] for r in navigation.inheritors(g, ids(spark, 19)).collect()} == {14, 18}


def test_context(graph):
    def lists(node):
        out = {}
        for r in navigation.context(graph, node).orderBy("relation", "ord").collect():
            out.setdefault(r["relation"], []).append(r["name"].removeprefix("Harbour.Api.").removeprefix("Harbour."))
        return out

    assert lists(12) == {"callers": ["Desk.Arrive(Vessel)"], "callees": ["Berths.Free()", "Model.Vessel"], "parents": ["Berths"]}
    assert lists(11) == {"parents": ["Api"], "children": ["Berths.Assign", "Berths.Free"]}
    with pytest.raises(ValueError):
        navigation.context(graph, 0)


@pytest.mark.parametrize("n", [999, 1000])
def test_trace_budget(spark, n):
    rows = [(i, None, 1, f"n{i:05d}", "x", "Method", 1, 1, "", "", None, None) for i in range(1, n + 2)]
    g = Graph(spark, {
        "code_nodes": spark.createDataFrame(rows, schemas.schema("code_nodes")),
        "graph_nodes": spark.createDataFrame([(r[0], f"c{r[0]}", "Code") for r in rows], schemas.schema("graph_nodes")),
        "documents": spark.createDataFrame([(1, 1, "a.cs", ".cs", "a.cs", "Source")], schemas.schema("documents")),
        "dependency_edges": spark.createDataFrame([(1, i, "MethodCall", None) for i in range(2, n + 2)], schemas.schema("dependency_edges")),
    })
    got = navigation.trace(g, 1, "callee", 1)
    kept = [r["id"] for r in got.nodes.orderBy("ord").collect()]
    assert kept == list(range(1, 1001)) and got.truncated == (n == 1000)
    assert got.edges.count() == 999


def test_connections_of_a_star(spark):
    peers = range(2, 612)
    code = [(i, None, 1, f"n{i}", "x", "Class", 1, 1, "", "", None, None) for i in [1, *peers, 900]]
    nodes = [(i, f"code:{i}", "Code") for i in [1, *peers, 900]] + [(800, "project:p", "Project"), (801, "http:GET:%2Fapi%2Fitems", "Http"), (802, "package:react:useEffect", "Package")]
    edges = [(1, p, "MethodCall", "call") for p in peers] + [(1, 2, "Instantiates", None), (2, 1, "FieldAccess", None), (1, 1, "MethodCall", None), (800, 1, "ParentOf", None), (1, 801, "HttpRequest", None), (1, 802, "Import", None)]
    g = Graph(spark, {
        "code_nodes": spark.createDataFrame(code, schemas.schema("code_nodes")),
        "graph_nodes": spark.createDataFrame(nodes, schemas.schema("graph_nodes")),
        "project_nodes": spark.createDataFrame([(800, "P", 1, "h")], schemas.schema("project_nodes")),
        "documents": spark.createDataFrame([(1, 1, "a.cs", ".cs", "a.cs", "Source")], schemas.schema("documents")),
        "dependency_edges": spark.createDataFrame(edges, schemas.schema("dependency_edges")),
    })
    met, after = {}, 0
    while page := navigation.connections(g, 1, 500, after).orderBy("peer").collect():
        met |= {r["peer"]: r for r in page}
        after = page[-1]["peer"]
    assert len(met) == 614
    assert {(x["type"], x["direction"]) for x in met[2]["relationships"]} == {("methodcall", "outgoing"), ("instantiates", "outgoing"), ("fieldaccess", "incoming")}
    assert [x["direction"] for x in met[1]["relationships"]] == ["self"]
    assert (met[801]["label"], met[802]["label"]) == ("GET /api/items", "react/useEffect")
    assert met[801]["relationships"][0]["type"] == "http-request" and met[800]["type"] == "project"
    assert navigation.connections(g, 900).count() == 0


def test_chains_go_from_root_to_leaves(graph, spark):
    up = navigation.impact(graph, ids(spark, 18), 3)
    paths = sorted(tuple(r["path"]) for r in navigation.chains(up.edges, 18, 3).collect())
    assert paths == [(18, 12, 16, 17), (18, 15, 16, 17)]
    with pytest.raises(ValueError, match="more than 1 chains"):
        navigation.chains(up.edges, 18, 3, limit=1)
    text = {r["ids"]: r["chain"] for r in render.chain_lines(navigation.chains(up.edges, 18, 3), graph["code_nodes"].select("id", F.col("display_name").alias("name"))).collect()}
    assert text["18>12>16>17"] == "Desk.Plan() -> Desk.Arrive(Vessel) -> Berths.Assign(Vessel) -> Vessel"


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(edges=st.sets(st.tuples(st.integers(1, 9), st.integers(1, 9)), max_size=25), depth=st.integers(1, 4))
def test_impact_equals_a_plain_walk(spark, edges, depth):
    rows = [(i, None, 1, f"n{i}", "x", "Method", 1, 1, "", "", None, None) for i in range(1, 10)]
    g = Graph(spark, {
        "code_nodes": spark.createDataFrame(rows, schemas.schema("code_nodes")),
        "graph_nodes": spark.createDataFrame([(i, f"c{i}", "Code") for i in range(1, 10)], schemas.schema("graph_nodes")),
        "documents": spark.createDataFrame([(1, 1, "a.cs", ".cs", "a.cs", "Source")], schemas.schema("documents")),
        "dependency_edges": spark.createDataFrame([(a, b, "MethodCall", None) for a, b in edges], schemas.schema("dependency_edges")),
    })
    got = navigation.impact(g, ids(spark, 1), depth)
    frontier, visited, met, kept = {1}, {1}, {}, set()
    for level in range(1, depth + 1):
        step = {(a, b) for a, b in edges if b in frontier}
        kept |= step
        for a, _ in step:
            met.setdefault(a, level)
        frontier = {a for a, _ in step} - visited
        visited |= frontier
    assert {r["id"]: r["depth"] for r in got.nodes.collect()} == met
    assert {(r["caller"], r["callee"]) for r in got.edges.collect()} == kept


# --- paging ------------------------------------------------------------------------


def ring(spark, n):
    half = n // 2
    code = [(i, 100_000 + (i > half), 1 + (i > half), f"Node{i}", "x", "Class", 1, 1, "", "", None, None) for i in range(1, n + 1)]
    edges = [(i, i % n + 1, t, None) for i in range(1, n + 1) for t in ("MethodCall", "Implements")] + [(100_000, 100_001, "ProjectReference", None)]
    return Graph(spark, {
        "code_nodes": spark.createDataFrame(code, schemas.schema("code_nodes")),
        "graph_nodes": spark.createDataFrame([(r[0], f"c{r[0]}", "Code") for r in code] + [(100_000, "project:A", "Project"), (100_001, "project:B", "Project")], schemas.schema("graph_nodes")),
        "project_nodes": spark.createDataFrame([(100_000, "A", 1, "h"), (100_001, "B", 2, "h")], schemas.schema("project_nodes")),
        "documents": spark.createDataFrame([(1, 2, "Node.cs", ".cs", "A/Node.cs", "Source"), (2, 3, "Node.cs", ".cs", "B/Node.cs", "Source")], schemas.schema("documents")),
        "directories": spark.createDataFrame([(1, None, "", "/"), (2, 1, "A", "A"), (3, 1, "B", "B")], schemas.schema("directories")),
        "directory_closures": spark.createDataFrame([(1, 1, 0), (2, 2, 0), (3, 3, 0), (1, 2, 1), (1, 3, 1)], schemas.schema("directory_closures")),
        "dependency_edges": spark.createDataFrame(edges, schemas.schema("dependency_edges")),
    }, revision="r1")


def walk(graph, kind, dirs, size):
    out, cursor = [], None
    while True:
        page = paging.page(graph, kind, dirs, size, cursor)
        out += page.items
        cursor = page.next_cursor
        if cursor is None:
            return out


def test_pages_are_complete_and_ordered(spark):
    n = 600
    g = ring(spark, n)
    nodes = walk(g, "nodes", [2], 250)
    keys = [(r["phase"], r["id"]) for r in nodes]
    assert keys == sorted(set(keys))
    assert {r["id"] for r in nodes if r["scope"] == "selected"} == set(range(1, n // 2 + 1)) | {100_000}
    assert {r["id"] for r in nodes if r["scope"] == "external"} == {n // 2 + 1, n, 100_001}
    edges = walk(g, "edges", [2], 401)
    keys = [(r["caller"], r["callee"], r["edge_type"]) for r in edges]
    assert keys == sorted(set(keys)) and len(keys) == n + 3
    assert {r["scope"] for r in edges} == {"internal", "boundary"}
    ends = {r["id"] for r in nodes}
    assert all(r["caller"] in ends and r["callee"] in ends for r in edges)
    assert paging.page(g, "nodes", [2], 5000, include_total=True).total == len(nodes)
    root = walk(g, "nodes", [1], 5000)
    assert len(root) == n + 2 and {r["scope"] for r in root} == {"selected"}
    assert paging.page(g, "nodes", [], 10, include_total=True).total == 0


def test_cursors_are_bound(spark):
    g = ring(spark, 20)
    token = paging.page(g, "nodes", [2], 3).next_cursor
    with pytest.raises(ValueError):
        paging.page(g, "edges", [2], 3, token)
    with pytest.raises(ValueError):
        paging.page(g, "nodes", [3], 3, token)
    g.revision = "r2"
    with pytest.raises(schemas.RevisionChanged):
        paging.page(g, "nodes", [2], 3, token)
    with pytest.raises(ValueError):
        paging.page(g, "nodes", [2], 5001)
    with pytest.raises(ValueError):
        paging.Cursor.decode("x" * 3000, "nodes", "", "")


def test_tree(graph):
    got = [(r["kind"], r["label"], r["child_count"], r["project_id"]) for r in paging.tree(graph, "lib").collect()]
    assert got == [("folder", "api", 4, None), ("folder", "model", 2, None)]
    got = [(r["kind"], r["label"], r["project_id"]) for r in paging.tree(graph, "lib/model").collect()]
    assert got == [("project", "Harbour.Model", 501), ("file", "Vessel.cs", None)]
    assert paging.tree(graph, "none").count() == 0


# --- search ------------------------------------------------------------------------


def search_rows(graph, **options):
    return [r["id"] for r in search.hybrid(graph.code(wide=True), **options).orderBy("rank").collect()]


def fused(graph, word, query, limit):
    """The fusion by SQLite's full-text index and plain cosine."""
    import math
    import sqlite3

    rows = [tuple(r) for r in graph.code(wide=True).select("id", "canonical_id", "vector_embedding", "display_name", "fully_qualified_name", "search_text", "relative_path").collect()]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(a, b, c, d, tokenize='unicode61')")
    db.executemany("INSERT INTO t(rowid, a, b, c, d) VALUES (?, ?, ?, ?, ?)", [(r[0], *r[3:]) for r in rows])
    name = {r[0]: r[1] for r in rows}
    found = dict(db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (f'"{word}"*',)))
    lists = [sorted(found, key=lambda i: (found[i], name[i]))]
    near = {r[0]: sum(a * b for a, b in zip(r[2], query)) / math.hypot(*r[2]) / math.hypot(*query) for r in rows}
    lists.append(sorted(near, key=lambda i: (-near[i], name[i])))
    score = {i: sum(1 / (60 + x.index(i) + 1) for x in lists if i in x) for i in name}
    return sorted(score, key=lambda i: (-round(score[i], 12), name[i]))[:limit]


def test_fusion_golden(graph):
    for word, limit in (("Vessel", 3), ("Berth", 5)):
        assert search_rows(graph, text=word, query=[1.0, 0.0], limit=limit) == fused(graph, word, [1.0, 0.0], limit)
    got = search_rows(graph, text="Vessel", query=[1.0, 0.0], limit=10, project_id=500, node_types=["Method"])
    assert got and set(got) <= {12, 13, 15, 16, 17}
    assert search_rows(graph, text="Vessel", query=None, limit=0) == []
    assert search_rows(graph, text="a ...", query=[1.0, 0.0]) == []
    with pytest.raises(ValueError):
        search.hybrid(graph.code(wide=True), " ", None)
    for text in ('"Vessel', "*.cs", "C# vessel", "What's a vessel?", "http://localhost:* vessel"):
        assert search_rows(graph, text=text, query=[1.0, 0.0]), text


def notes_of(graph):
    m = graph["memory_nodes"].join(graph.code(wide=True).select(F.col("id").alias("target_code_node_id"), "canonical_id", F.col("fully_qualified_name").alias("owner"), "node_type", "project_node_id"), "target_code_node_id")
    return m.select(F.col("id").alias("memory_id"), F.col("target_code_node_id").alias("id"), "canonical_id", "content", "owner", "tags", "vector_embedding", "node_type", "project_node_id")


def test_notes_take_part_by_tag(spark):
    g = harbour_graph(spark, vectors=False, notes=[note("m1", 12, "Check security", ["security"]), note("m2", 15, "Slow security path", ["performance"])])
    assert search_rows(g, text="security", query=None, memories=notes_of(g), tags=["Security"]) == [12]
    assert set(search_rows(g, text="security", query=None, memories=notes_of(g))) == {12, 15}


def test_match_expressions():
    assert X.match_expression("Message Get") == '"Message"* OR "Get"*'
    assert X.match_expression("a") == "" and X.match_expression("...") == ""
    assert X.match_phrases("null? C# it's") == [["null"], ["c"], ["it", "s"]]


@pytest.mark.parametrize("text,n", [("*Payment", 2), ("*.cs", 2), ("Payment.Service*", 2), ("DisplayName:Payment", 2), ("Payment NOT Other", 3), ("Payment AND Unused", 3), ("NEAR(Payment Other)", 2), ('"Payment audit"', 2), ("http://localhost:*", 0), ("DisplayName:", 0)])
def test_operators_are_plain_terms(spark, text, n):
    rows = [("Payment", "Example.Payment", "charge card", "src/Payment.cs"), ("Other", "Example.Other", "Payment audit", "src/Other.cs"), ("Unused", "Example.Unused", "nothing", "src/Unused.ts")]
    corpus = spark.createDataFrame([(i, f"c{i}", *r) for i, r in enumerate(rows)], "id bigint, canonical_id string, display_name string, fully_qualified_name string, search_text string, relative_path string")
    assert search.keyword_scores(corpus, text).count() == n


def test_bm25_equals_the_full_text_index_of_sqlite(spark):
    import sqlite3

    rnd = random.Random(3)
    vocabulary = "message messages get getter café payment audit log line run".split()
    rows = [tuple(" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 12))) for _ in range(4)) for _ in range(30)]
    corpus = spark.createDataFrame([(i, f"c{i:02d}", *r) for i, r in enumerate(rows)], "id bigint, canonical_id string, display_name string, fully_qualified_name string, search_text string, relative_path string")
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(a, b, c, d, tokenize='unicode61')")
    db.executemany("INSERT INTO t(rowid, a, b, c, d) VALUES (?, ?, ?, ?, ?)", [(i + 1, *r) for i, r in enumerate(rows)])
    for text in ("mess", "get audit", "cafe log run"):
        want = {i - 1: -s for i, s in db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (" OR ".join(f'"{w}"*' for w in text.split()),))}
        got = {r["id"]: r["score"] for r in search.keyword_scores(corpus, text).collect()}
        assert got == pytest.approx(want)


def test_the_index_answers_as_the_corpus(spark, tmp_path):
    rnd = random.Random(4)
    vocabulary = "message messages get getter café payment audit log line run".split()
    rows = [tuple(" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 9))) for _ in range(4)) for _ in range(40)] + [("", "", "", ""), (None, None, "get", None)]
    corpus = spark.createDataFrame([(i, f"c{i:02d}", *r) for i, r in enumerate(rows)], "id bigint, canonical_id string, display_name string, fully_qualified_name string, search_text string, relative_path string")
    search.write_index(corpus, str(tmp_path / "k"))
    index = search.open_index(spark, str(tmp_path / "k"))
    for text in ("mess", "get audit cafe", "log'line run'ge get'get'mes", "nothing", "a ."):
        want = {r["id"]: r["score"] for r in search.keyword_scores(corpus, text).collect()}
        assert {r["id"]: r["score"] for r in search.keyword_scores(corpus, text, index=index).collect()} == pytest.approx(want)


# --- notes, statistics ----------------------------------------------------------------


def test_notes_attach_and_go_stale(spark):
    import datetime

    g = harbour_graph(spark, notes=[note("old", 11, "kept", ["x"], vector=[0.5, 0.25])])
    rows = [("n1", 12, " Needs authentication review ", [" Security ", "tech-debt", "SECURITY"], None, datetime.datetime(2024, 1, 2)), ("n2", 13, "fresh", None, "Todo", datetime.datetime(2024, 1, 3))]
    made = memories.attach(g, spark.createDataFrame(rows, "id string, node_id bigint, content string, tags array<string>, intent string, created_at timestamp"))
    got = {r["id"]: r for r in made.collect()}
    assert got["n1"]["content"] == "Needs authentication review" and got["n1"]["tags"] == ["security", "tech-debt"] and got["n1"]["target_code_hash"] == "hash12"
    assert got["n2"]["tags"] == [] and got["n1"]["intent"] == "Convention"
    g2 = harbour_graph(spark, notes=[note("a", 11, "one", ["t"], minute=2), note("b", 11, "two", ["t"], target_hash="other", minute=1), note("c", 12, "three", [], intent="Todo")])
    asked = spark.createDataFrame([(11,), (12,), (15,), (-1,)], "node_id bigint")
    by_node = {r["node_id"]: [(m["content"], m["stale"]) for m in r["memories"]] for r in memories.of_nodes(g2, asked).collect()}
    assert by_node == {11: [("two", True), ("one", False)], 12: [("three", False)], 15: []}
    assert {r["id"]: r["content"] for r in memories.batch(g2, spark.createDataFrame([("a",), ("zz",)], "id string")).collect()} == {"a": "one", "zz": None}
    assert {r["id"] for r in memories.delete(g2, "a").collect()} == {"b", "c"}
    with pytest.raises(KeyError):
        memories.delete(g2, "zz")


def test_statistics(graph, spark):
    got = {r["name"]: r["n"] for r in statistics.counts(graph).collect()}
    assert got == {"documents": 6, "directories": 4, "projects": 2, "code_nodes": 9, "code_vectors": 9, "edges": 12, "memories": 0, "http_nodes": 0, "package_nodes": 0}
    assert {r["language"]: (r["documents"], r["nodes"]) for r in statistics.by_language(graph).collect()} == {"C#": (3, 9), "Other": (2, 0), "Markdown": (1, 0)}
    assert statistics.health(graph) == "ready" and statistics.health(Graph(spark)) == "missing"
    assert statistics.health(graph, applied={"m9"}) == "incompatible" and statistics.health(graph, supported={"m1"}) == "upgrade_required"
    assert statistics.health(harbour_graph(spark, extra_edges=[(11, 12, "Odd")])) == "unreadable"
    runs = spark.createDataFrame([("w", [("info", "x" * 600)] * 20 + [("error", "bad")])], "workspace string, diagnostics array<struct<severity string, message string>>")
    (r,) = statistics.bounded_diagnostics(runs).collect()
    assert len(r["diagnostics"]) == 20 and r["diagnostics"][0]["severity"] == "error" and r["diagnostics"][-1]["message"] == "2 more" and len(r["diagnostics"][1]["message"]) == 512


def test_pages_of_chains_are_the_chains_in_order(spark):
    rnd = random.Random(8)
    pairs = {(rnd.randint(1, 9), rnd.randint(1, 9)) for _ in range(30)} | {(k, 10) for k in (1, 2, 3)}
    edges = spark.createDataFrame([p for p in sorted(pairs)], "caller long, callee long")
    want = sorted(list(r["path"]) for r in navigation.chains(edges, 10, 3).collect())
    got, cursor = [], None
    while True:
        page = [list(r["path"]) for r in navigation.chains_page(edges, 10, 3, 5, cursor).collect()]
        got += page
        if len(page) < 5:
            break
        cursor = page[-1]
    assert got == want and len(want) > 10
    assert [list(r["path"]) for r in navigation.chains_page(edges, 99, 3).collect()] == [[99]]


def test_a_page_of_millions_of_chains(spark):
    wide = [(100 * k + i, 100 * (k - 1) + j) for k in range(1, 5) for i in range(60) for j in range(60)]
    edges = spark.createDataFrame([(100 + i, 0) for i in range(60)] + [(a, b) for a, b in wide if b >= 100], "caller long, callee long")
    page = [list(r["path"]) for r in navigation.chains_page(edges, 0, 4, 5, [0, 130, 230, 359, 459]).collect()]
    assert page == [[0, 130, 231, 300, 400 + k] for k in range(5)]
