"""The driver contract with and without the corpus subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]
CODE = """
import duckdb
from pyspark.sql import SparkSession
import __spark_entry__ as e
q, sql = e.queries(), e.oracle_sql()
assert "pipeline" not in q and len(q) > 90 and not any(k.startswith("op") for k in q) and set(sql) == set(q)
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
con = duckdb.connect()
for t in ("customer", "supplier", "nation", "conversations", "events"):
    con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{e.SMOKE}/{t}.parquet'")
for name in ("json_rows", "snapshot_diff", "normalised_tags", "first_wins"):
    rows = q[name](spark, e.SMOKE)
    assert rows.count() == len(con.execute(sql[name]).fetchall()) > 0, name
"""


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    shutil.copytree(REPO / "quillgraph", tmp_path / "quillgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    (tmp_path / "run.py").write_text(CODE)
    subprocess.run([sys.executable, "run.py"], cwd=tmp_path, check=True, timeout=300)


def test_nothing_else_imports_the_corpus_operators():
    for path in (REPO / "quillgraph").rglob("*.py"):
        if "llm" not in path.relative_to(REPO).parts:
            assert "quillgraph.llm" not in path.read_text(), path
