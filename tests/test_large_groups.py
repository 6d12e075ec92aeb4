"""Results and cost where many rows share a key."""

import random
import time

from pyspark.sql import functions as F

from quillgraph.graph import Graph
from quillgraph.operators import build, facts, navigation, typescript


def test_enclosing_equals_brute_force(spark):
    rnd = random.Random(4)
    declared = [(i, rnd.choice("ab"), s, s + rnd.choice([-1, 0, 1, 3, 10, 70, 900])) for i in range(250) for s in [rnd.randint(-40, 400)]]
    declared += [(900, "a", None, 5), (901, None, 1, 9)]
    calls = [(i, rnd.choice(["a", "b", "c", None]), rnd.choice([None, *range(-60, 1300)])) for i in range(600)]
    calls += [(7, "a", 33), (None, "b", 50)]
    want = {}
    for call, path, line in calls:
        for i, p, s, e in declared:
            if path is not None and p == path and line is not None and s is not None and s <= line <= e:
                want[call] = min(want.get(call, (10**9,)), (e - s, s, i))
    made = facts.enclosing(spark.createDataFrame(calls, "call_id int, path string, line int"), spark.createDataFrame(declared, "declaration_id int, path string, start_line int, end_line int"))
    rows = [(r["call_id"], r["declaration_id"]) for r in made.collect()]
    assert len(rows) == len(set(rows)) and dict(rows) == {c: w[2] for c, w in want.items()}


def test_enclosing_does_not_pair_all_calls_with_all_declarations_of_a_file(spark):
    n = 100_000
    declared = spark.range(n).select(F.col("id").alias("declaration_id"), F.lit("a").alias("path"), (F.col("id") % 30).alias("start_line"), (F.col("id") % 30 + 30 + F.col("id") % 7).alias("end_line"))
    calls = spark.range(n).select(F.col("id").alias("call_id"), F.lit("a").alias("path"), (F.col("id") % 30 + 20).alias("line"))
    began = time.time()
    assert facts.enclosing(calls, declared).agg(F.count(F.lit(1))).first()[0] == n
    assert time.time() - began < 60  # 10^10 pairs take longer


def test_fact_nodes_takes_the_last_line_where_parts_number_millions(spark, tmp_path):
    from quillgraph.plans.catalogue_sources import fact_nodes

    rows = [(3, 2, 5), (3, 1, 1_200_000), (4, 1, 2_500_000), (4, 3, 7), (4, 3, 8)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["path"]: "Part" + str(p) in r["search_text"] for p, r in zip((5, 8), fact_nodes(spark, str(tmp_path)).orderBy("path").collect())}
    assert got == {"src/3/2.cs": True, "src/4/3.cs": True}


def test_small_scripts_of_one_part_are_read_by_many_tasks(spark):
    files = spark.range(400).coalesce(1).select(F.concat(F.lit("a"), F.col("id").cast("string"), F.lit(".ts")).alias("relative_path"), F.concat(F.lit("export const k"), F.col("id").cast("string"), F.lit(" = 1;\n")).alias("text"))
    read = typescript.facts(files).select("relative_path", F.col("declarations")[0]["name"].alias("name"), F.spark_partition_id().alias("task")).collect()
    assert {(r["relative_path"], r["name"]) for r in read} == {(f"a{i}.ts", f"k{i}") for i in range(400)}
    assert len({r["task"] for r in read}) >= 2 * spark.sparkContext.defaultParallelism


def test_contributions_of_one_part_are_merged_by_many_tasks(spark):
    ids = spark.range(4_000).coalesce(1)
    who = F.explode(F.array(F.lit("a"), F.lit("b"))).alias("contribution_id")
    name = F.concat(F.lit("n"), F.col("id").cast("string"))
    nodes = ids.select(who, name.alias("canonical_id"), F.col("id").alias("ingest_ordinal"), *[F.lit("").alias(c) for c in build.NODE_FIELDS])
    edges = ids.select(who, name.alias("caller_id"), F.lit("x").alias("callee_id"), F.lit("Import").alias("edge_type"), F.lit(None).cast("string").alias("metadata"))
    merged, linked = build.merge(nodes, edges)
    assert merged.select("canonical_id").distinct().count() == merged.count() == linked.count() == 4_000
    assert len({r["task"] for r in merged.select(F.spark_partition_id().alias("task")).distinct().collect()}) >= 2 * spark.sparkContext.defaultParallelism
    changed = nodes.withColumn("path", F.when((F.col("canonical_id") == "n7") & (F.col("contribution_id") == "b"), "y").otherwise(F.col("path")))
    assert [tuple(r) for r in build.conflicts(changed, edges).collect()] == [("n7", 2)]


def test_edges_among_many_nodes_are_joined_by_many_tasks_without_sending_ids_to_all(spark):
    n = 3_000
    edges = spark.range(n).coalesce(1).select(F.col("id").alias("caller_node_id"), ((F.col("id") * 7) % n).alias("callee_node_id"), F.lit("MethodCall").alias("edge_type"), F.lit(None).cast("string").alias("metadata"))
    found = navigation.edges_among(Graph(spark, {"dependency_edges": edges}), spark.range(n).filter("id % 2 = 0"))
    rows = found.select("caller", "callee", F.spark_partition_id().alias("task")).collect()
    assert sorted((r["caller"], r["callee"]) for r in rows) == [(i, i * 7 % n) for i in range(0, n, 2)]
    assert len({r["task"] for r in rows}) >= 2 * spark.sparkContext.defaultParallelism
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
