"""Reconciliation, revisions, extraction, logs, files and streams."""

import datetime
import hashlib
import random
from pathlib import Path

import pytest
from fixture_graph import harbour_graph
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph import schemas
from quillgraph.engine import CodeGraph
from quillgraph.functions import text as X
from quillgraph.functions.ranking import global_rank
from quillgraph.graph import Graph
from quillgraph.operators import build, extraction, facts, logs, modules, render, search, typescript
from quillgraph.sources import files, revisions
from quillgraph.streaming import notify, watch

STAGED = "contribution_id string, canonical_id string, project_id string, fqn string, display string, node_type string, path string, start int, end int, summary string, search_text string, body_hash string, ingest_ordinal int"
LINKS = "contribution_id string, caller_id string, callee_id string, edge_type string, metadata string, ingest_ordinal int"


def node(contribution, canonical, ordinal=1, display="d", path="a/b.cs", body="h"):
    return (contribution, canonical, "p", canonical, display, "Class", path, 1, 2, "s", "t", body, ordinal)


# --- build ------------------------------------------------------------------------


def test_merge_accepts_equal_and_refuses_different(spark):
    nodes = spark.createDataFrame([node("1", "x"), node("2", "x", 2), node("2", "y", 3)], STAGED)
    edges = spark.createDataFrame([("1", "x", "y", "MethodCall", None, 1), ("2", "x", "y", "MethodCall", None, 2)], LINKS)
    merged, links = build.merge(nodes, edges)
    assert {r["canonical_id"] for r in merged.collect()} == {"x", "y"} and links.count() == 1
    with pytest.raises(ValueError, match="x"):
        build.merge(nodes.unionByName(spark.createDataFrame([node("3", "x", 4, display="other")], STAGED)), edges)
    more = edges.unionByName(spark.createDataFrame([("2", "x", "z", "MethodCall", None, 3)], LINKS))
    with pytest.raises(ValueError, match="x"):
        build.merge(nodes, more)


def test_canonicalise(spark):
    projects = spark.createDataFrame([("p", "/A\\B.csproj", 1), ("p", "C.csproj", 2)], "id string, relative_file_path string, ingest_ordinal int")
    nodes = spark.createDataFrame([node("1", "x", 1, display="old"), node("1", "x", 2, display="new", path="/src\\a.cs/"), node("1", "y", 3)], STAGED)
    edges = spark.createDataFrame([("1", "x", "y", "MethodCall", "first", 1), ("1", "x", "y", "MethodCall", "last", 2), ("1", "x", "gone", "MethodCall", None, 3), ("1", "gone", "y", "MethodCall", None, 4), ("1", "x", "http:GET:%2Fa", "HttpRequest", None, 5), ("1", "p", "x", "ParentOf", None, 6)], LINKS)
    p, n, e = build.canonicalise(projects, nodes, edges)
    assert [r["relative_file_path"] for r in p.collect()] == ["C.csproj"]
    assert {(r["canonical_id"], r["display"], r["path"]) for r in n.collect()} == {("x", "new", "src/a.cs"), ("y", "d", "a/b.cs")}
    assert {(r["caller_id"], r["callee_id"], r["metadata"]) for r in e.collect()} == {("x", "y", "last"), ("x", "http:GET:%2Fa", None), ("p", "x", None)}
    assert [(r["canonical_id"], r["kind"]) for r in build.synthetic_nodes(e).collect()] == [("http:GET:%2Fa", "Http")]
    own, out = build.emitted_only(n, e, "p")
    assert own.count() == 2 and out.count() == 3


def test_identity_and_moves(spark):
    before = spark.createDataFrame([("a", 5), ("b", 9)], "canonical_id string, id bigint")
    now = spark.createDataFrame([("z",), ("b",), ("c",), ("c",)], "canonical_id string")
    assert {r["canonical_id"]: r["id"] for r in build.assign_ids(now, before).collect()} == {"b": 9, "c": 10, "z": 11}
    old = spark.createDataFrame([("p1", "n", "h"), ("p2", "twin", "h"), ("p3", "twin", "h"), ("p4", "stays", "h")], "id string, name string, hash string")
    new = spark.createDataFrame([("q1", "n", "h"), ("q2", "twin", "h"), ("p4", "stays", "h")], "id string, name string, hash string")
    assert [tuple(r) for r in build.moved(old, new, "id", ["name", "hash"]).collect()] == [("p1", "q1")]


def test_directories_and_closure(spark):
    d = build.directory_table(spark.createDataFrame([("a/b/f.cs",), ("a/g.cs",), ("h.cs",), ("\\x\\y.cs",)], "path string"))
    rows = {r["path"]: r for r in d.collect()}
    assert [p for p, _ in sorted(rows.items(), key=lambda x: x[1]["id"])] == ["", "a", "x", "a/b"]
    assert rows[""]["name"] == "/" and rows["a/b"]["parent_id"] == rows["a"]["id"] and rows[""]["parent_id"] is None
    got = {(r["ancestor_directory_id"], r["descendant_directory_id"], r["depth"]) for r in build.closure(d).collect()}
    assert got == {(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 0), (1, 2, 1), (1, 3, 1), (1, 4, 2), (2, 4, 1)}


def test_global_rank_numbers_everything(spark):
    rnd = random.Random(1)
    values = [rnd.randint(0, 50) for _ in range(400)]
    got = global_rank(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v int"), ["v", "i"], "n").collect()
    assert [r["i"] for r in sorted(got, key=lambda r: r["n"])] == [i for _, i in sorted((v, i) for i, v in enumerate(values))]
    assert sorted(r["n"] for r in got) == list(range(1, 401))


def test_embedding_plan(spark):
    now = spark.createDataFrame([("a", "s", "h"), ("b", "s", "new"), ("c", "s", None), ("d", "s", "h")], "canonical_id string, search_text string, body_hash string")
    old = spark.createDataFrame([("a", "s", "h", [1.0]), ("b", "s", "h", [1.0]), ("c", "s", None, [2.0]), ("d", "s", "h", [])], "canonical_id string, search_text string, body_hash string, vector_embedding array<float>")
    assert {r["canonical_id"]: r["action"] for r in build.embedding_plan(now, old).collect()} == {"a": "reused", "b": "generated", "c": "reused", "d": "generated"}


def test_revisions_are_immutable_and_skip_equal_graphs(spark, tmp_path):
    root = str(tmp_path / "graph")
    assert revisions.current(spark, root) is None
    first = revisions.commit(harbour_graph(spark), root)
    assert revisions.commit(harbour_graph(spark), root) == first
    pinned = revisions.load(spark, root)
    second = revisions.commit(harbour_graph(spark, extra_edges=[(13, 15, "MethodCall")]), root)
    assert second != first and revisions.load(spark, root).edges.count() == 13
    assert pinned.edges.count() == 12 and revisions.load(spark, root, first).edges.count() == 12
    with pytest.raises(schemas.RevisionChanged):
        revisions.expect(spark, root, first)
    revisions.expect(spark, root, second)


def folders(root):
    """Tables that each revision folder holds, for as many folders as there are."""
    return [sorted(p.name for p in f.iterdir() if p.is_dir()) for f in Path(root).iterdir() if f.name != "commits"]


def test_a_commit_writes_only_what_differs(spark, tmp_path):
    root = str(tmp_path / "graph")
    revisions.commit(harbour_graph(spark), root)
    whole = folders(root)
    g = CodeGraph(spark, root)
    note = spark.createDataFrame([("m", 12, "Check security", ["x"], "Todo", datetime.datetime(2024, 1, 1))], "id string, node_id bigint, content string, tags array<string>, intent string, created_at timestamp")
    noted = g.attach_memories(note)
    assert sorted(folders(root)) == sorted([*whole, ["memory_nodes"]])
    assert noted.graph.edges.count() == g.graph.edges.count() and noted.graph["memory_nodes"].count() == 1
    with pytest.raises(schemas.RevisionChanged):  # made from a revision that is no longer current
        g.attach_memories(note)
    assert CodeGraph(spark, root).graph.revision == noted.graph.revision and len(folders(root)) == 2


def test_two_writers_of_one_number(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "graph")
    revisions.commit(harbour_graph(spark), root)
    stale = revisions.current(spark, root)
    first = revisions.commit(harbour_graph(spark, extra_edges=[(13, 15, "MethodCall")]), root)
    with monkeypatch.context() as m:
        m.setattr(revisions, "current", lambda *_: stale)
        with pytest.raises(schemas.RevisionChanged, match="another writer"):
            revisions.commit(harbour_graph(spark, extra_edges=[(15, 13, "MethodCall")]), root)
    assert revisions.current(spark, root)["revision"] == first and revisions.load(spark, root).edges.count() == 13


def test_layers_of_the_keyword_index_equal_a_rebuild(spark, tmp_path):
    root = str(tmp_path / "graph")
    revisions.commit(harbour_graph(spark), root)
    layers = []
    for k in range(3):
        g = revisions.load(spark, root)
        changed = g["code_nodes"].withColumn("search_text", F.when(F.col("id") == 11 + k, F.concat(F.lit(f"vessel tide{k} "), F.coalesce("search_text", F.lit("")))).otherwise(F.col("search_text")))
        revisions.commit(Graph(spark, dict(g.tables) | {"code_nodes": changed.filter(F.col("id") != (18 if k == 2 else -1))}, g.revision, g.inward, g.stored), root)
        now = revisions.load(spark, root)
        layered = revisions.keyword_index(spark, root, now.revision)
        for text in ("vessel tide1", "berth assign"):
            plain = {r["id"]: round(r["score"], 9) for r in search.keyword_scores(now.code(wide=True), text).collect()}
            assert {r["id"]: round(r["score"], 9) for r in search.keyword_scores(now.code(wide=True), text, index=layered).collect()} == plain
        layers.append(len(revisions.current(spark, root)["keywords"]))
    assert layers == [2, 3, 1]  # the last commit changes over a fifth of the rows


def test_diff(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, ""), (4, "w")], "k int, v string")
    assert {r["k"]: r["change"] for r in build.diff(a, b, ["k"]).collect()} == {2: "changed", 3: "removed", 4: "added"}


# --- text --------------------------------------------------------------------------


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(alphabet=st.sampled_from(list("aB 9-_É#\t/~*+%é")), max_size=12), min_size=1, max_size=20))
def test_text_rules(spark, texts):
    import re
    from urllib.parse import quote

    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.slug(F.col("t")).alias("slug"), X.uri_encode(F.col("t")).alias("u"), X.uri_decode(X.uri_encode(F.col("t"))).alias("back")).collect()
    for r in got:
        t = texts[r["i"]]
        want = re.sub(r"[\W_]+", "-", t.strip(" ").lower()).strip("-") or "section"
        assert (r["slug"], r["u"], r["back"]) == (want, quote(t, safe="-_.~"), t)


# --- markdown ------------------------------------------------------------------------

GUIDE = "Intro text.\n\n# Overview\nText.\n\n## Details\nMore.\n\n# Overview\nAgain."


def md(spark, *rows):
    return spark.createDataFrame(list(rows), "relative_path string, text string")


def test_chunks_of_a_guide(spark):
    f = md(spark, ("docs/Guide.md", GUIDE))
    got = {r["canonical_id"].split("#")[1]: r for r in extraction.markdown_chunks(f).collect()}
    assert {k: (r["start_line"], r["end_line"]) for k, r in got.items()} == {"document-root": (1, 1), "overview": (3, 4), "details": (6, 7), "overview-l9": (9, 10)}
    assert {r["display_name"] for r in got.values()} == {"Guide", "Guide#overview", "Guide#details", "Guide#overview-l9"}
    name = "code:doc:docs/Guide.md#"
    edges = {(r["caller_id"].removeprefix(name), r["callee_id"].removeprefix(name), r["edge_type"]) for r in extraction.markdown_edges(f).collect()}
    assert edges == {("document-root", "overview", "ParentOf"), ("document-root", "overview-l9", "ParentOf"), ("overview", "details", "ParentOf")}
    assert extraction.markdown_chunks(md(spark, ("a.md", "  \n\n"))).count() == 1
    assert extraction.markdown_edges(md(spark, ("a.md", "  \n\n"))).count() == 0


@pytest.mark.parametrize("target,want", [("space%20target.md", "docs/space target.md#document-root"), ("caf%C3%A9.md#Details", "docs/café.md#details"), ("hash%23target.md", "docs/hash#target.md#document-root"), ("query%3Ftarget.md", "docs/query?target.md#document-root"), ("literal%2520target.md", "docs/literal%20target.md#document-root"), ("../top.md", "top.md#document-root"), ("https://a.b/c.md", None), ("mailto:x@y.md", None), ("picture.png", None), ("../../out.md", None)])
def test_link_targets(spark, target, want):
    links = extraction.raw_links(md(spark, ("docs/Guide.md", f"See [it]({target}) here.")))
    assert links.count() == 1
    assert [r["target_id"] for r in extraction.link_targets(links).collect()] == ([f"code:doc:{want}"] if want else [])


def test_links_in_code_are_no_links(spark):
    text = "```\n[[fenced]]\n```\n\n    [[indented]]\n\n> ```\n> [[quoted]]\n> ```\n\n- ```\n  [[listed]]\n  ```\n\nA `[[span]]` and ![image](i.md) and [[Prose|alias]] and [bad](nul%00.md)."
    found = extraction.raw_links(md(spark, ("docs/wiki/Home.md", text)))
    assert [(r["kind"], r["target"]) for r in found.filter("kind = 'wiki'").collect()] == [("wiki", "Prose|alias")]
    assert {r["target_id"] for r in extraction.link_targets(found).collect()} == {"code:doc:docs/wiki/Prose.md#document-root"}
    both = md(spark, ("docs/a.md", "# One\nto [b](b.md#two)"), ("docs/b.md", "# Two\nback [a](a.md)"))
    links = {(r["caller_id"][9:], r["callee_id"][9:]) for r in extraction.markdown_edges(both).filter("edge_type = 'DocumentLink'").collect()}
    assert links == {("docs/a.md#one", "docs/b.md#two"), ("docs/b.md#two", "docs/a.md#document-root")}


def test_fences_close_with_their_own_mark(spark):
    text = "# One\n```js\n~~~\n# code\n``\n````\n# Two\n~~~ note\n```\n# code\n~~~~\nafter\n``` a`b\n# Three\n```\n# open to the end"
    got = {r["title"]: (r["start_line"], r["end_line"]) for r in extraction.markdown_chunks(md(spark, ("a.md", text))).filter("level > 0").collect()}
    assert got == {"One": (1, 6), "Two": (7, 13), "Three": (14, 16)}


def test_underlined_headings(spark):
    text = "Top line\n===\n\nSome words\ngo on\n---\n\n- item\n---\n\n> quote\n===\n\n---\n\n    code\n    ===\n\nLast\n-"
    rows = extraction.markdown_chunks(md(spark, ("docs/a.md", text))).collect()
    got = {r["title"]: (r["level"], r["start_line"], r["end_line"], (r["parent_id"] or "").split("#")[-1]) for r in rows if r["level"]}
    assert got == {"Top line": (1, 1, 2, "document-root"), "Some words go on": (2, 4, 17, "top-line"), "Last": (2, 19, 20, "top-line")}


def test_reference_links(spark):
    text = "See [the guide][G], [other][] and [short]; not ![img][g] or `[g]` or [none].\n\n[g]: guide.md#top\n[Other]:  <other.md> \"t\"\n[short]: s.md\n[g]: second.md\n"
    found = extraction.raw_links(md(spark, ("docs/a.md", text)))
    assert sorted(r["target"] for r in found.collect()) == ["guide.md#top", "other.md", "s.md"]


def test_modules_resolve_by_paths_base_and_package(spark):
    f = spark.createDataFrame([
        ("web/tsconfig.json", '{"compilerOptions": {"baseUrl": "src", "paths": {"@/*": ["./missing/*", "*"], "@/ui/*": ["kit/*"], "@/exact": ["one.ts"]}}}'),
        ("packages/core/package.json", '{"name": "@a/core", "types": "entry.ts"}'), ("packages/core/entry.ts", ""), ("packages/core/deep/x.ts", ""),
        ("web/src/one.ts", ""), ("web/src/kit/button.tsx", ""), ("web/src/api/index.ts", ""), ("web/src/app/main.ts", ""), ("web/src/kit.ts", ""),
    ], "relative_path string, text string")
    wanted = {"@/ui/button": "web/src/kit/button.tsx", "@/exact": "web/src/one.ts", "@/api": "web/src/api/index.ts", "one": "web/src/one.ts", "@a/core": "packages/core/entry.ts", "@a/core/deep/x": "packages/core/deep/x.ts", "../one.js": "web/src/one.ts", "@/ui/one": None, "react": None, "./gone": None}
    asks = spark.createDataFrame([("web/src/app/main.ts", m) for m in wanted], "relative_path string, module string")
    got = {r["module"]: r["target"] for r in modules.resolve_modules(asks, f, modules.tsconfigs(f), modules.packages(f)).collect()}
    assert got == {m: t for m, t in wanted.items() if t}
    paths = ["web/a.ts", "web/src/b.ts", "web/src/deep/c.tsx", "web/dist/d.ts", "other/e.ts", "web/f.d.ts"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    taken = lambda **o: [r["p"] for r in rows.filter(modules.configured(F.col("p"), "web", **o)).collect()]
    assert taken() == ["web/a.ts", "web/src/b.ts", "web/src/deep/c.tsx", "web/dist/d.ts", "web/f.d.ts"]
    assert taken(include=["src"]) == ["web/src/b.ts", "web/src/deep/c.tsx"]
    assert taken(files=["a.ts"], include=["**/*.tsx"], exclude=["dist"]) == ["web/a.ts", "web/src/deep/c.tsx"]
    assert taken(files=["a.ts"]) == ["web/a.ts"] and taken(exclude=["dist", "*.ts"]) == ["web/src/b.ts", "web/src/deep/c.tsx"]


def test_reexports_end_where_they_began(spark):
    f = spark.createDataFrame([
        ("m/a.ts", "export class A {}\nexport class Same {}\nexport default class Hidden {}\nclass Own {}\nexport { Own as Renamed };"),
        ("m/b.ts", "export * from './a';\nexport class Same {}\nexport { default as H } from './a';"),
        ("m/c.ts", "export * from './b';\nexport * from './d';\nexport * as all from './a';"),
        ("m/d.ts", "export * from './c';\nexport { useMemo as memo } from 'react';\nexport { A as B } from './c';"),
        ("app.tsx", "import D, { B, memo, Same } from './m/d';\nimport * as Lib from 'lib';\nimport * as Plain from 'plain';\nimport './m/a';\nimport type { all } from './m/c';\nimport './none';\nexport function App() { return <Lib.Button.Big><Lib.Text/></Lib.Button.Big>; }"),
    ], "relative_path string, text string")
    read = typescript.read_files(f)
    asks = modules.imports(read).select("relative_path", "module").unionByName(modules.reexports(read).select("relative_path", "module"))
    found = modules.exports(read, modules.resolve_modules(asks, f))
    by = {}
    for r in found.collect():
        by.setdefault((r["relative_path"][2:-3], r["name"]), set()).add(r["canonical_id"].removeprefix("code:ts:"))
    assert by["b", "Same"] == {"m/b.ts:Same"} and by["c", "Same"] == {"m/b.ts:Same"} and by["d", "B"] == {"m/a.ts:A"}
    assert by["b", "H"] == {"m/a.ts:Hidden"} and ("b", "default") not in by and by["c", "memo"] == {"package:react:useMemo"}
    assert by["c", "all"] == {"m/a.ts:A", "m/a.ts:Same", "m/a.ts:Hidden", "m/a.ts:Own"} and by["a", "Renamed"] == {"m/a.ts:Own"}
    targets = {r["callee_id"].removeprefix("code:ts:") for r in modules.import_targets(read, f).collect()}
    assert targets == {"m/a.ts:A", "package:react:useMemo", "m/b.ts:Same", "package:lib:Button.Big", "package:lib:Text", "package:plain", "m/a.ts:Same", "m/a.ts:Hidden", "m/a.ts:Own"}
    edges = {(r["caller_id"], r["callee_id"].removeprefix("code:ts:")) for r in modules.import_edges(f).collect()}
    assert edges == {("code:ts:app.tsx:App", t) for t in targets}


def test_partial_declarations_are_one_node(spark):
    doc = '/// <summary>\n/// Adds <see cref="B{T}"/> to<paramref name="x" />, &lt;fast&gt;.\n/// </summary>\n/// <remarks>Twice\n///  over.</remarks>'
    rows = [
        ("p", "T:A", "N.A", "A", "Class", "a2.cs", 5, 9, "/// <summary>Other</summary>", "BB", 2), ("p", "T:A", "N.A", "A", "Class", "a1.cs", 1, 4, doc, "AA", 1), ("p", "T:A", "N.A", "A", "Class", "a3.cs", 1, 4, None, None, 3),
        ("q", "T:A", "N.A", "A", "Class", "a1.cs", 1, 4, None, None, 1), ("p", None, "x", "x", "Class", "x.cs", 1, 1, None, "CC", 1),
    ]
    parts = spark.createDataFrame(rows, "project_id string, symbol string, fully_qualified_name string, display_name string, node_type string, path string, start_line int, end_line int, documentation string, token_hash string, ordinal int")
    found = {r["canonical_id"]: r for r in facts.nodes_of_facts(parts).collect()}
    assert set(found) == {"code:p:T:A", "code:q:T:A"}
    one = found["code:p:T:A"]
    assert (one["path"], one["start_line"], one["n_parts"], one["body_hash"]) == ("a1.cs", 1, 3, hashlib.sha256(b"AABB").hexdigest())
    assert one["summary"] == "Adds B{T} to x, <fast>.\nTwice over." and one["search_text"] == "A\n" + one["summary"]
    assert (found["code:q:T:A"]["summary"], found["code:q:T:A"]["search_text"], found["code:q:T:A"]["body_hash"]) == ("", "A", None)


def script(spark, *files):
    return typescript.read_files(spark.createDataFrame(list(files), "relative_path string, text string"))


def test_typescript_facts(spark):
    read = script(
        spark,
        ("src/app.tsx", 'import React from "react";\nimport { load } from "./api";\n// export class Gone {}\nexport function App() { return <Api/>; }\nexport const helper = 1;\nexport function Plain() { return 1 }'),
        ("src/api.ts", 'export async function load() { return fetch("/api/items", { method: "post" }); }\nexport interface Item {}\naxios.get("/x?y=1")\nimport "./missing"'),
    )
    found = typescript.nodes(read)
    assert {(r["name"], r["node_type"]) for r in found.collect()} == {("App", "Component"), ("helper", "Field"), ("load", "Method"), ("Item", "Interface"), ("Plain", "Method")}
    assert {(r["module"], r["kind"], r["local"]) for r in modules.imports(read).collect()} == {("react", "default", "React"), ("./api", "named", "load"), ("./missing", "side", "")}
    assert [tuple(r) for r in typescript.http_edges(read, found).collect()] == [("code:ts:src/api.ts:load", "http:POST:%2Fapi%2Fitems", "HttpRequest")]
    seeds = spark.createDataFrame([("src/app.tsx",)], "relative_path string")
    known = spark.createDataFrame([("src/app.tsx", ""), ("src/api.ts", "")], "relative_path string, text string")
    met = modules.resolve_modules(modules.imports(read), known)
    assert {r["relative_path"] for r in extraction.reachable_files(met, seeds).collect()} == {"src/app.tsx", "src/api.ts"}


@pytest.mark.parametrize("text,want", [
    ("const glob = 'src/*'; const t = '*/x';\nexport class Kept {}", {"Kept": "Class"}),
    ("const r = /[/*'\"`{]/g; export class Kept {}", {"Kept": "Class"}),
    ("const t = `a ${f({ b: `}` })} export class Gone {}`\nexport const kept = 4 / 2 / 1, more = (a) => a", {"kept": "Field", "more": "Method"}),
    ("export class M {}\ninterface M { a: 1 }\nexport interface M { b(): void }", {"M": "Class"}),
    ("export interface T { a: 1; 'b c'(): void; [k: string]: any; (x: 1): 2 }\nexport type U = { x: 1 } | (() => void)", {"T": "Interface", "T.a": "Property", "T.b c": "Method", "U": "Interface"}),
    ("export function f(a: 1): void\nexport function f(a: any) { return 1 }\nexport declare function g(): { a: 1 }", {"f": "Method", "g": "Method"}),
    ("export class A<T extends { a: 1 } = {}> extends B<{ b: 1 }>(C) {\n a = 1\n b: Map<string, number> = new Map<string, number>()\n #c = 2\n static { x() }\n @dec({ a: '}' }) async *d() {}\n abstract e?(): { f: 1 };\n declare g\n}", {"A": "Class", "A.a": "Property", "A.b": "Property", "A.d": "Method", "A.e": "Method", "A.g": "Property"}),
    ("class Own { x = 1 }\nfunction no() {}\nexport { Own as Other }", {"Own": "Class", "Own.x": "Property"}),
    ("export default () => 1", {"default": "Method"}), ("export default class extends X { run() {} }", {"default": "Class", "default.run": "Method"}),
    ("export default 5\nexport enum E { A, B = 1, 'c' = 'x' }", {"E": "Class", "E.B": "Field", "E.c": "Field"}),
    ("declare module 'x' { export class Gone {} }\nnamespace N { export const gone = 1 }\nexport abstract class Kept { static get v() { return 1 } }", {"Kept": "Class", "Kept.v": "Property"}),
    ("export const a = async <T,>(x: T): Promise<T> => { return x }\nexport const b = x => y => x\nexport const c = cond ? (a) : (b)\nexport const { d } = o, e = 1", {"a": "Method", "b": "Method", "c": "Field", "e": "Field"}),
    ("", {}), ("export class Broken { run( { '", {"Broken": "Class", "Broken.run": "Method"}), ("}}} export class Kept {}", {"Kept": "Class"}),
])
def test_typescript_declarations(spark, text, want):
    assert {r["name"]: r["node_type"] for r in typescript.nodes(script(spark, ("a.ts", text))).collect()} == want


def test_typescript_members_and_bodies(spark):
    text = "/** Adds.\n * More. */\nexport class S {\n  run(a: 1): void;\n  run(a: any) { go() }\n  get v() { return 1 }\n  set v(x) {}\n  static v = 2;\n}\n"
    found = {r["canonical_id"].rpartition("a.ts:")[2]: r for r in typescript.nodes(script(spark, ("a.ts", text))).collect()}
    assert set(found) == {"S", "S.run", "S.v:get", "S.v:set", "S.v:static"}
    assert (found["S"]["summary"], found["S"]["start_line"], found["S"]["end_line"]) == ("Adds.\nMore.", 3, 9)
    assert found["S.run"]["start_line"] == 5 and found["S.run"]["body_hash"] == hashlib.sha256(b"run(a: any) { go() }").hexdigest()
    assert found["S.v:static"]["display_name"] == "S.v [static]" and found["S.v:static"]["body_hash"] == hashlib.sha256(b"static v = 2;").hexdigest()
    edges = typescript.parent_edges(typescript.nodes(script(spark, ("a.ts", text)))).collect()
    assert {r["callee_id"].rpartition("a.ts:")[2] for r in edges} == set(found) - {"S"} and {r["caller_id"] for r in edges} == {"code:ts:a.ts:S"}


@pytest.mark.parametrize("call,want", [
    ("fetch('/a')", "GET"), ("fetch(`/a`, { headers: { method: 'put' } })", "GET"), ("fetch('/a', { method: 'put', method: 'Patch' })", "PATCH"),
    ("fetch('/a', { ...o })", None), ("fetch('/a', { [k]: 1 })", None), ("fetch('/a', { method })", None), ("fetch('/a', o)", None), ("fetch(url)", None), ("fetch(`/a/${b}`)", None),
    ("x.fetch('/a')", None), ("axios.head('/a', {}, 1)", "HEAD"), ("axios.request('/a')", None), ("fetch('  ')", None), ("fetch('/a' + b)", None),
])
def test_typescript_calls(spark, call, want):
    read = script(spark, ("a.ts", f"export const f = () => {{ {call} }}"))
    assert [r["callee_id"] for r in typescript.http_edges(read, typescript.nodes(read)).collect()] == ([f"http:{want}:%2Fa"] if want else [])


def test_tsconfig_settings(spark):
    def fold(*files):
        f = spark.createDataFrame([*files, ("x.ts", "")], "relative_path string, text string")
        return {r["directory"]: r for r in modules.tsconfigs(f).collect()}

    usual = fold(("tsconfig.json", '\ufeff{ "compilerOptions": { "baseUrl": ".", "paths": { "@app/*": ["src/*"] } }, // "c"\n "include": ["src/**/*", "**/*.ts",], }'))[""]
    assert usual["base"] == "" and usual["include"] == ["src/**/*", "**/*.ts"] and [(e["key"], e["value"]) for e in usual["patterns"]] == [("@app/*", ["src/*"])]
    chain = fold(
        ("a/tsconfig.json", '{"extends": ["../one", "./two.json"], "compilerOptions": {"baseUrl": " "}}'), ("one.json", '{"extends": "./zero", "compilerOptions": {"baseUrl": "b1"}, "files": ["f1"]}'),
        ("a/two.json", '{"extends": "pkg/conf", "include": ["i2"]}'), ("zero.json", '{"compilerOptions": {"paths": {"z": ["z"]}}, "include": ["i0"], "exclude": ["e0"]}'), ("node_modules/pkg/conf.json", '{"files": ["fp"]}'), ("a/b/tsconfig.json", "{}"),
    )
    a = chain["a"]
    assert (a["base"], a["files"], a["include"], a["exclude"], a["patterns_directory"]) == ("b1", ["node_modules/pkg/fp"], ["a/i2"], ["e0"], "")
    assert chain["a/b"]["base"] is None and chain["a/b"]["exclude"] == []
    with pytest.raises(ValueError, match="extends itself"):
        fold(("tsconfig.json", '{"extends": "./x"}'), ("x.json", '{"extends": "./tsconfig.json"}'))
    with pytest.raises(ValueError, match="missing"):
        fold(("tsconfig.json", '{"extends": "./gone"}'))


def test_root_files_of_tsconfigs(spark):
    f = spark.createDataFrame([("web/tsconfig.json", '{"files": ["a.ts"], "include": ["src", "../lib/*.ts"], "exclude": ["src/gen"]}'), ("plain/tsconfig.json", "{}"), *[(p, "") for p in ("web/a.ts", "web/b.ts", "web/src/x/c.ts", "web/src/gen/d.ts", "lib/e.ts", "lib/x/f.ts", "plain/g/h.tsx", "web/src.ts")]], "relative_path string, text string")
    got = {tuple(r) for r in modules.root_files(f.filter("relative_path rlike '[.]tsx?$'"), modules.tsconfigs(f)).collect()}
    assert got == {("web", "web/a.ts"), ("web", "web/src/x/c.ts"), ("web", "lib/e.ts"), ("plain", "plain/g/h.tsx")}


# --- logs ---------------------------------------------------------------------------


def log(spark, text):
    return logs.split_lines(spark.createDataFrame([(1, text)], "log_id bigint, text string"))


def test_log_blocks_and_render(spark):
    lines = log(spark, "start\nerror one\nstep\r\nstep\rerror two\nend")
    assert [r["text"] for r in lines.orderBy("line_number").collect()] == ["start", "error one", "step", "step", "error two", "end"]
    found = logs.blocks(lines, logs.matches(F.col("text"), any_of=["error"]), 3)
    assert [(r["start"], r["stop"], r["n_matches"]) for r in found.collect()] == [(1, 6, 2)]
    two = logs.blocks(lines, logs.matches(F.col("text"), all_of=["error", "tw*"], none_of=["one"]), 0)
    assert [(r["start"], r["stop"]) for r in two.collect()] == [(5, 5)]
    shown = [r["shown"] for r in logs.render(lines, found, 28).orderBy("line_number").collect()]
    assert shown == ["1| start", "2| error one", "3| ..."]


@pytest.mark.parametrize("text,want", [("VeryLongLine", "1| VeryLo..."), ("12345😀67890", "1| 12345...")])
def test_log_budget_counts_utf16(spark, text, want):
    lines = log(spark, text)
    found = logs.blocks(lines, F.lit(True), 3)
    (r,) = logs.render(lines, found, 12).collect()
    assert r["shown"] == want and r["cut"]


def test_capture_cuts_on_a_character(spark):
    got = logs.capture(log(spark, "abc\néé é\nlast"), 10, 6).orderBy("line_number").collect()
    assert [(r["text"], r["cut"]) for r in got] == [("abc", False), ("é", True)]
    assert logs.capture(log(spark, "a\nb\nc"), 2, 99).count() == 2


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(hits=st.sets(st.integers(1, 40), max_size=12), context=st.integers(0, 4))
def test_blocks_equal_a_plain_merge(spark, hits, context):
    lines = log(spark, "\n".join("hit" if i in hits else "no" for i in range(1, 41)))
    want = []
    for m in sorted(hits):
        a, b = max(1, m - context), min(40, m + context)
        if want and a <= want[-1][1] + 1:
            want[-1][1] = max(want[-1][1], b)
        else:
            want.append([a, b])
    got = logs.blocks(lines, logs.matches(F.col("text"), any_of=["hit"]), context).orderBy("start").collect()
    assert [[r["start"], r["stop"]] for r in got] == want


# --- files ---------------------------------------------------------------------------


def test_discovery(spark):
    names = ["a.md", "docs/b.md", "docs/deep/c.MD", "bin/x.md", "src/Obj/y.md", "src/a.cs", "gen/keep.md", "gen/drop.md", "docs/b.md", "app/tsconfig.json", "app/App.csproj"]
    f = spark.createDataFrame([(n,) for n in names], "relative_path string")
    got = {r["relative_path"] for r in files.discover(f, ["**/*.md"], ["gen/*", "!gen/keep.md"]).collect()}
    assert got == {"a.md", "docs/b.md", "gen/keep.md"}
    assert {(r["kind"], r["path"]) for r in files.sources(f).collect()} == {("CSharp", "app/App.csproj"), ("TypeScript", "app/tsconfig.json"), ("Markdown", "*.md"), ("Markdown", "docs/*.md"), ("Markdown", "docs/deep/*.md"), ("Markdown", "gen/*.md")}


def test_readers(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a b.md").write_text("# T\nx")
    (tmp_path / "c.txt").write_text("no")
    assert {(r["relative_path"], r["text"]) for r in files.texts(spark, str(tmp_path), "*.md").collect()} == {("docs/a b.md", "# T\nx")}
    assert {(r["relative_path"], r["bytes"]) for r in files.listing(spark, str(tmp_path)).collect()} == {("docs/a b.md", 5), ("c.txt", 2)}


def test_render(spark):
    hits = spark.createDataFrame([(1, 7, "B", "Class", 1, 2, "src/b.cs"), (2, 8, "A", "Method", 3, 4, "src/a.cs"), (3, 9, "C", "Odd", 5, 6, "src/b.cs"), (4, 1, "R", "Document", 1, 1, "r.md")], "rank int, id bigint, display_name string, node_type string, start_line int, end_line int, relative_path string")
    got = {r["directory"]: (r["ord"], r["body"]) for r in render.search_groups(hits).collect()}
    assert got == {"src": (1, "  b.cs\n    [C] `7` B L1-2\n    [*] `9` C L5-6\n  a.cs\n    [M] `8` A L3-4"), "": (4, "  r.md\n    [D] `1` R L1-1")}


# --- streams ---------------------------------------------------------------------------


def run(df, mode, tmp_path, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_notification_stream_equals_the_batch_form(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(op, s, "succeeded" if s == 7 and op % 2 else "progress", f"m{s}") for op in range(4) for s in range(12)]
    table = spark.createDataFrame(rows + [(0, 3, "progress", "m3")], "operation_id bigint, sequence bigint, kind string, message string")
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    last = {}
    for r in run(notify.reduce_stream(stream), "update", tmp_path, "notified"):
        last[r["operation_id"]] = tuple(r)
    assert set(last.values()) == {tuple(r) for r in notify.reduce_batch(table).collect()}
    assert {k: v[1] for k, v in last.items()} == {0: 11, 1: 7, 2: 11, 3: 7}
    assert rnd


def test_watch_commits_only_relevant_batches(spark, tmp_path):
    now = datetime.datetime(2024, 1, 1)
    rows = [(now, "Modified", None, "src/a.cs"), (now, "Renamed", "docs/a.md", "bin/a.md"), (now, "Added", None, "node_modules/x.ts")]
    spark.createDataFrame(rows, watch.CHANGES).coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(watch.CHANGES).parquet(str(tmp_path / "in"))
    q = watch.watch(stream, lambda df: seen.extend((r["action"], r["path"]) for r in df.collect()), str(tmp_path / "ck"), trigger=None)
    assert q.awaitTermination(120)
    assert sorted(seen) == [("Deleted", "docs/a.md"), ("Modified", "src/a.cs")]
    known = spark.createDataFrame([("src/a.cs",)], "path string")
    changes = spark.createDataFrame([(now, "Added", None, "src/a.cs"), (now, "Modified", None, "new.md")], watch.CHANGES)
    assert {(r["action"], r["path"]) for r in watch.normalise(changes, known).collect()} == {("Modified", "src/a.cs"), ("Added", "new.md")}


def test_batches_open_with_their_first_event(spark):
    base = datetime.datetime(2024, 1, 1)
    rows = [("k", base + datetime.timedelta(milliseconds=m), m) for m in (0, 100, 250, 251, 400, 502, 503)]
    got = watch.batches(spark.createDataFrame(rows, "k string, ts timestamp, m int"), "k").collect()
    assert {r["m"]: r["batch"] for r in got} == {0: 1, 100: 1, 250: 1, 251: 2, 400: 2, 502: 3, 503: 3}


def test_windowed_stream(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    table = spark.createDataFrame([(base + datetime.timedelta(minutes=30 * i), "a") for i in range(6)], "ts timestamp, event_type string")
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    got = {tuple(r) for r in run(watch.windowed_counts(stream), "complete", tmp_path, "windows")}
    assert got == {tuple(r) for r in watch.windowed_counts(table).collect()} and len(got) == 3


def test_hashing_embedder(spark):
    from quillgraph.functions.embedding import embedder, hashing_model

    embed = embedder(lambda: hashing_model(16), batch=2)
    rows = spark.createDataFrame([(1, "a b"), (2, "b a"), (3, "zz"), (4, None)], "i int, t string").select("i", embed(F.col("t")).alias("v")).collect()
    v = {r["i"]: r["v"] for r in rows}
    assert v[1] == v[2] != v[3] and abs(sum(x * x for x in v[3]) - 1) < 1e-6 and v[4] == [0.0] * 16
