"""Block structure of Markdown: containers, fences, HTML, headings."""

import pytest

from quillgraph.operators.blocks import structure
from quillgraph.operators.extraction import markdown_chunks


def heads(text):
    return [(i + 1, level, title) for i, (_, level, title) in enumerate(structure(text.split("\n"))) if level is not None]


def code(text):
    return [i + 1 for i, (c, _, _) in enumerate(structure(text.split("\n"))) if c]


@pytest.mark.parametrize("text,want", [
    ("# A\n\n## B ##\ntext\n### C", [(1, 1, "A"), (3, 2, "B"), (5, 3, "C")]), ("#no\n####### no\n    # no\n#", [(4, 1, "")]),
    ("A\nb\n===\n\nC\n---", [(1, 1, "A b"), (5, 2, "C")]), ("---\n# A\n***\n- - -\nB\n---", [(2, 1, "A"), (5, 2, "B")]),
    ("> # no\n> text\nlazy\n# yes", [(4, 1, "yes")]), ("> no\n===\n# yes", [(3, 1, "yes")]), ("> a\n> ---\n\nB\n---", [(4, 2, "B")]),
    ("- item\n\n  # no\n\n  more\n\n# yes", [(7, 1, "yes")]), ("- # no\n- b\n # yes", [(3, 1, "yes")]), ("1. a\n   - b\n\n     # no\n\n   # no\n\n  # yes", [(8, 1, "yes")]), ("10) a\n\n    ## no\n\n## yes", [(5, 2, "yes")]),
    ("para\n2. no item\n   ===\n", [(1, 1, "para 2. no item")]), ("para\n- item\n  # no", []), ("> - a\n>\n>   # no\n\n# yes", [(5, 1, "yes")]),
    ("<div>\n# no\n</div>\n\n# yes", [(5, 1, "yes")]), ("<!-- a\n\n# no\n-->\n# yes", [(5, 1, "yes")]), ("<script>\n\n# no\n</script>\n# yes", [(5, 1, "yes")]), ("<x-y a='1'>\n# no\n\n# yes", [(4, 1, "yes")]), ("text\n<x-y>\n# yes", [(3, 1, "yes")]), ("<?php\n# no\n?>\n# yes", [(4, 1, "yes")]),
    ("```\n# no\n~~~\n```\n# yes", [(5, 1, "yes")]), ("- ```\n  # no\n# yes", [(3, 1, "yes")]), ("> ~~~\n> # no\n\n# yes", [(4, 1, "yes")]), ("``` a`b\n# yes", [(2, 1, "yes")]), ("```\n# no", []), ("", []),
])
def test_headings(text, want):
    assert heads(text) == want


@pytest.mark.parametrize("text,want", [
    ("    a\n\n    b\nc\n    d", [1, 3]), ("\ta\nb", [1]), ("- a\n\n      code\n\n  text", [3]), ("~~~\nx\n~~~\ny", [1, 2, 3]), ("<div>\n[a](b)\n\n[c](d)", [1, 2]), ("- ```\n  x\n  ```\n  y", [1, 2, 3]), (">     a\n> b", [1]), ("-     a", [1]),
])
def test_code(text, want):
    assert code(text) == want


def test_chunks_of_nested_sources(spark):
    text = "# Top\n\n> # quoted\n\n- item\n\n  ## inside\n\n<div>\n\n## after\n</div>\n\n## End\n"
    rows = markdown_chunks(spark.createDataFrame([("a.md", text), ("b.md", None)], "relative_path string, text string")).collect()
    assert sorted((r["relative_path"], r["title"] or "", r["start_line"], r["end_line"]) for r in rows) == [("a.md", "", 1, 1), ("a.md", "End", 14, 14), ("a.md", "Top", 1, 9), ("a.md", "after", 11, 12), ("b.md", "", 1, 1)]
