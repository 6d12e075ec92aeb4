"""A keyword index is written where its rows were read; texts do not move to be indexed."""

import uuid

from pyspark.sql import functions as F

from quillgraph.operators import search
from quillgraph.plans import catalogue, derive


def stages(spark, run):
    """The stages of the jobs that ``run`` starts."""
    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, group)
    try:
        run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    tracker = sc.statusTracker()
    return [s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]


def shuffled(spark) -> int:
    """Bytes that the application has shuffled so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    held = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(held.apply(i).shuffleWriteBytes() for i in range(held.size()))


def test_postings_are_written_once_by_one_stage(spark, tmp_path):
    corpus = spark.range(500).selectExpr("id", "concat('c', id) AS canonical_id", "'a' AS display_name", "'b' AS fully_qualified_name", "concat('word', id % 7, ' tion') AS search_text", "'d' AS relative_path")
    assert len(stages(spark, lambda: search._write_postings(corpus, str(tmp_path / "k"), search.INDEXED))) == 1
    for f in (tmp_path / "k" / "postings").glob("*.parquet"):
        terms = [r["term"] for r in spark.read.parquet(str(f)).select("term").collect()]
        assert terms == sorted(terms)


def test_a_corpus_without_vectors_has_the_same_rows(spark, tmp_path):
    d = str(tmp_path)
    docs = spark.createDataFrame([(1, "one", "en", "web"), (2, "two", "en", "web"), (2, "two", "en", "web"), (3, None, None, "web"), (None, "none", "en", None)], "doc_id long, text string, lang string, source string")
    docs.repartition(5).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, [0.5]), (2, [0.5]), (2, [0.5]), (2, None), (None, [1.0]), (None, [1.0]), (9, [1.0])], "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    own = [c for c in derive.corpus(spark, d).columns if c != "vector_embedding"]
    rows = lambda df: sorted(map(repr, df.select(own).collect()))
    with_none = derive.corpus(spark, d, vectors=False)
    assert with_none.dtypes == derive.corpus(spark, d).dtypes
    assert rows(with_none) == rows(derive.corpus(spark, d)) and with_none.filter("id = 2").count() == 6
    assert "SortMergeJoin" not in with_none._jdf.queryExecution().executedPlan().toString()


def test_the_texts_of_layers_are_not_shuffled(spark, tmp_path):
    d = str(tmp_path)
    text = F.concat_ws(" ", *[F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"-{k}")), 256) for k in range(40)])
    spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("reand tion "), text).alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source")).repartition(8).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, [0.5])], "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    before = shuffled(spark)
    assert catalogue.QUERIES["bm25_layers"](spark, d).count() == 200
    assert shuffled(spark) - before < 300_000  # the texts have 1,050,000 bytes
