"""All pages of a scope in one pass."""

from fixture_graph import harbour_graph

from quillgraph.operators import paging
from quillgraph.sources import revisions


def test_pages_are_those_of_the_cursors(spark, tmp_path):
    root = str(tmp_path / "graph")
    revisions.commit(harbour_graph(spark), root, keywords=False)
    g = revisions.load(spark, root)
    for kind, order in (("nodes", paging.ORDER_NODES), ("edges", paging.ORDER_EDGES)):
        want, cursor = [], None
        while True:
            p = paging.page(g, kind, [2], 3, cursor, include_total=True)
            want.append((len(want) + 1, len(p.items), tuple(p.items[0][c] for c in order), tuple(p.items[-1][c] for c in order), p.total))
            cursor = p.next_cursor
            if cursor is None:
                break
        got = [(r["page"], r["n"], tuple(r["first"]), tuple(r["last"]), r["total"]) for r in paging.pages(g, kind, [2], 3).orderBy("page").collect()]
        assert got == want and len(got) > 1
