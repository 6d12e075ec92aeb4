"""The facade end to end, and every registered graph query against its SQL twin
on an independent engine."""

import datetime

import duckdb
import pytest
from fixture_graph import harbour_graph

from test_navigation import fused

from quillgraph.engine import CodeGraph
from quillgraph.plans import catalogue
from quillgraph.sources import revisions

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_twin(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = plain(tuple(r[c] for c in columns) for r in df.collect())
    cursor = duck.execute(catalogue.SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    assert got == plain(tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall())
    assert got


def test_every_query_has_a_twin():
    assert set(catalogue.QUERIES) == set(catalogue.SQL) and catalogue.FLAGSHIP in catalogue.QUERIES


def test_facade(spark, tmp_path):
    root = str(tmp_path / "g")
    revisions.commit(harbour_graph(spark), root)
    g = CodeGraph(spark, root)
    assert [r["id"] for r in g.search("Vessel", [1.0, 0.0], 3).collect()] == fused(g.graph, "Vessel", [1.0, 0.0], 3)
    assert {r["id"] for r in g.impact("harbour.model.vessel", transitive=False).nodes.collect()} == {12, 15}
    assert [r["id"] for r in g.callees("berth-assign").collect()] == [13, 18]
    first = g.connections_page(12, page_size=2, include_total=True)
    assert [r["peer"] for r in first.items] == [11, 13] and first.total == 4 and first.revision == g.graph.revision
    last = g.connections_page(12, page_size=2, cursor=first.next_cursor)
    assert [r["peer"] for r in last.items] == [16, 18] and last.next_cursor is None
    with pytest.raises(ValueError):
        g.connections_page(13, cursor=first.next_cursor)
    assert {r["id"]: r["role"] for r in g.highlight(12).collect()} == {12: "selected", 11: "incoming", 13: "outgoing", 16: "incoming", 18: "outgoing"}
    with pytest.raises(KeyError):
        g.impact("nobody")
    notes = spark.createDataFrame([("m", 12, "Check security", ["security"], "Todo", datetime.datetime(2024, 1, 1))], "id string, node_id bigint, content string, tags array<string>, intent string, created_at timestamp")
    g2 = g.attach_memories(notes)
    assert g2.graph.revision != g.graph.revision
    assert [r["id"] for r in g2.search("security", None, include_memories=True).collect()] == [12]
    assert len(g2.memories([12]).first()["memories"]) == 1 and g.graph["memory_nodes"].count() == 0
    assert g2.delete_memory("m").memories([12]).first()["memories"] == []
    lines = spark.createDataFrame([(1, i, f"line {i}") for i in range(1, 20)], "log_id bigint, line_number bigint, text string")
    (out,) = g.reduce_output(lines, any_of=["7", "12"], context=1).collect()
    assert out["body"] == "6| line 6\n7| line 7\n8| line 8\n\n11| line 11\n12| line 12\n13| line 13"
    assert (out["summary"], out["n_shown"], out["truncated"]) == ("2 of 19 lines match, in 2 blocks", 6, False)
    (out,) = g.reduce_output(lines, any_of=["7", "12"], context=1, max_chars=30).collect()
    assert (out["body"], out["truncated"]) == ("6| line 6\n7| line 7\n8| line 8", True)
    assert g.reduce_output(lines, any_of=["77"]).first()["body"] == ""
    assert g.node(18).first()["fully_qualified_name"] == "Harbour.Model.Vessel" and g.node(77).count() == 0
    assert tuple(g.tree_parent("lib/api").first()) == ("lib/api", "lib", 2) and g.tree_parent("x").count() == 0
    assert {r["id"]: r["content"] for r in g2.memories_by_id(["m", "zz"]).collect()} == {"m": "Check security", "zz": None}
    s = g.stats().first()
    assert (s["state"], s["revision"], s["code_nodes"], len(s["edge_types"])) == ("ready", g.graph.revision, 9, 6)
    assert g.as_json(g.edge_types()).count() == 6
