"""Corpus queries that SQL can express, against their twins."""

import duckdb
import pytest

from quillgraph.llm import registry

DATA = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    cursor = con.execute(registry.SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    assert plain(tuple(r[c] for c in columns) for r in df.collect()) == plain(tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall())
