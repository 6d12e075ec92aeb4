"""A keyword index that nobody has asked for is not made by a commit."""

import glob

from fixture_graph import harbour_graph

from quillgraph.operators import search
from quillgraph.sources import revisions


def test_an_index_is_made_when_it_is_asked(spark, tmp_path):
    root = str(tmp_path / "graph")
    revision = revisions.commit(harbour_graph(spark), root, keywords=False)
    assert not glob.glob(f"{root}/*/keywords*")
    now = revisions.load(spark, root)
    for _ in range(2):
        index = revisions.keyword_index(spark, root, revision)
        for text in ("vessel", "berth assign"):
            plain = {r["id"]: round(r["score"], 9) for r in search.keyword_scores(now.code(wide=True), text).collect()}
            assert plain and {r["id"]: round(r["score"], 9) for r in search.keyword_scores(now.code(wide=True), text, index=index).collect()} == plain
    assert len(glob.glob(f"{root}/*/keywords-*")) == 1
    assert revisions.commit(now, root, keywords=False) == revision


def test_places_are_gathered_without_a_shuffle(spark):
    rows = [(1, "a", "x y x", "y", "b x", None), (1, "a", "x y x", "y", "b x", None), (2, "b", "", None, " ", "")]
    corpus = spark.createDataFrame(rows, "id long, canonical_id string, display_name string, fully_qualified_name string, search_text string, relative_path string")
    made = search._postings(corpus, search.INDEXED)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    # an empty term stands between columns
    assert sorted((r["term"], r["id"], r["places"]) for r in made.collect()) == sorted(2 * [("x", 1, [0, 2, 7]), ("y", 1, [1, 4]), ("b", 1, [6])])
