"""Match expressions against a full-text table of SQLite."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from quillgraph.functions.match import match, parse

WORDS = ["error", "timeout", "retry", "connection", "refused", "err", "café", "conn_reset", "42"]
EXPRESSIONS = [
    "error", "ERROR timeout", "error AND timeout OR retry", "error OR timeout AND retry", "error NOT retry", "error timeout NOT retry", "error NOT retry OR refused", "(error OR retry) NOT (timeout OR refused)",
    '"connection refused"', "conn*", '"connection ref" *', "connection + refused", '"error" + time*', "^error", "^ error + timeout", "^err*", "cafe", "CAFÉ", "conn_reset", '"conn-reset"',
    "NEAR(error retry)", "NEAR(error retry, 0)", 'NEAR("connection refused" error, 1)', "NEAR(error timeout retry, 2)", "NEAR(err* refused, 1) AND retry", "a OR error", '"!" AND error', "error OR \"?\"", 'error NOT "!"', '"!"', "((error))", '"!" error', 'error "!"', '"!" NOT error', "NEAR(error \"!\")",
    "error AND (timeout OR (retry NOT refused)) AND NOT_A_WORD OR 42", "error NOT timeout NOT retry", "err* NOT error", "retry retry",
]
BAD = ["AND", "error AND", "NOT error", "(error", "error)", "error OR OR retry", "error-timeout", '"open', "*", "NEAR(error retry, x)", "+ error", "error AND NOT retry"]


@pytest.fixture(scope="module")
def table():
    rnd = random.Random(5)
    rows = [" ".join(rnd.choice(WORDS + ["a", "b!", "c-d"]) for _ in range(rnd.randint(0, 9))) for _ in range(400)]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE lines USING fts5(text, tokenize='unicode61')")
    con.executemany("INSERT INTO lines(rowid, text) VALUES (?, ?)", enumerate(rows))
    return con, rows


def test_expressions_match_sqlite(spark, table):
    con, rows = table
    df = spark.createDataFrame(list(enumerate(rows)), "i int, text string")
    tests = [match(F.col("text"), e).alias(f"e{k}") for k, e in enumerate(EXPRESSIONS)]
    got = df.select("i", *tests).collect()
    for k, e in enumerate(EXPRESSIONS):
        want = {i for (i,) in con.execute("SELECT rowid FROM lines WHERE lines MATCH ?", (e,))}
        assert {r["i"] for r in got if r[f"e{k}"]} == want, e


@pytest.mark.parametrize("expression", BAD)
def test_what_sqlite_rejects_raises(table, expression):
    with pytest.raises(sqlite3.OperationalError):
        table[0].execute("SELECT rowid FROM lines WHERE lines MATCH ?", (expression,)).fetchall()
    with pytest.raises(ValueError):
        parse(expression)


def test_nothing_matches_nothing(spark):
    df = spark.createDataFrame([(None,), ("",), ("x",)], "text string")
    assert df.filter(match(F.col("text"), "x")).count() == 1 and df.filter(match(F.col("text"), "  ")).count() == 0
