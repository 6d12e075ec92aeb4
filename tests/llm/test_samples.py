"""The samples that models are fitted on: bounds, repeats, null ids."""

from pyspark.sql import functions as F

from quillgraph.llm import language_id, mixing, quality_ranker, quality_rules
from quillgraph.llm.common import bounded

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(spark):
    one = spark.range(100).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("label"))
    many = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("text 7").alias("text"), F.lit("b").alias("label"))
    null = spark.range(5_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("other "), F.col("id") % 300).alias("text"), F.lit("a").alias("label"))
    return one.unionByName(many).unionByName(null).repartition(6)


def test_repeats_count_once_and_the_bound_holds(spark):
    got = bounded(rows(spark), 40, "label", "x").collect()
    assert len({(r["doc_id"], r["text"], r["label"]) for r in got}) == len(got)
    assert {k: sum(r["label"] == k for r in got) for k in "ab"} == {"a": 40, "b": 40}
    assert sorted(map(tuple, bounded(rows(spark), 40, "label", "x").collect()), key=str) == sorted(map(tuple, got), key=str)
    every = bounded(rows(spark), 10_000, "label", "x").collect()
    assert len(every) == 100 + 300


def test_fits_see_no_more_than_the_bound(spark, monkeypatch):
    docs = rows(spark).withColumn("lang", F.col("label"))
    seen = []
    real = language_id.vectors
    monkeypatch.setattr(language_id, "vectors", lambda d, label: seen.append(d.count()) or real(d, label))
    names, _ = language_id.fit(docs, F.lit(True), per_class=30)
    assert names == ["a", "b"] and seen == [60]
    labels = spark.range(100).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    real = quality_ranker.featurise
    monkeypatch.setattr(quality_ranker, "featurise", lambda d, c: seen.append(d.count()) or real(d, c))
    assert quality_ranker.fit(docs, labels, per_class=20) is not None and seen[-1] <= 40
    monkeypatch.setattr(quality_rules, "learn", lambda r: seen.append(len(r)) or [])
    quality_rules.fit(docs, labels, sample=25)
    assert seen[-1] == 25


def test_rows_without_an_id_are_spread_over_salts(spark):
    docs = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("w"), "id").alias("text"), F.lit("a").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    plan = mixing.draw(docs)
    assert plan.count() == 20_000
    spread = plan.select(F.substring(F.md5(F.concat_ws(",", "_text_hash", "_row_hash").cast("binary")), 1, 2).alias("s")).groupBy("s").count().agg(F.count("*"), F.max("count")).first()
    assert spread[0] == 256 and spread[1] < 200
    taken = mixing.mix(docs).agg(F.sum("taken"), F.max("copies")).first()
    assert abs(taken[0] - 30_000) <= 1 and taken[1] == 2
