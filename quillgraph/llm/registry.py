"""Registered corpus queries: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from quillgraph.llm import decontamination, language_id, lexical_search, license_scan, line_dedup, lm_scoring, mixing, periodic_runs, quality_ranker, quality_rules, simhash_dedup, substring_dedup, token_counts
from quillgraph.llm.common import is_remainder, table
from quillgraph.llm.oracles import SQL as SQL


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.counts(docs, token_counts.stamp_and_redact(F.col("text"), F.col("source")))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.clusters(table(spark, sf_dir, "documents")).drop("_th")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"), is_remainder(F.col("doc_id"), 3, 1))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = is_remainder(F.col("doc_id"), 5, 1)
    return lm_scoring.score(table(spark, sf_dir, "documents"), ~held_out).withColumn("held_out", held_out)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_digest(table(spark, sf_dir, "documents"))


def op8_quality_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(~is_remainder(F.col("doc_id"), 5, 0))
    return quality_ranker.rank(table(spark, sf_dir, "documents"), labels, is_remainder(F.col("doc_id"), 5, 0))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_th")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(table(spark, sf_dir, "documents"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_language_id": op3_language_id,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_line_dedup": op5_line_dedup,
    "op6_mixing": op6_mixing,
    "op7_license_scan": op7_license_scan,
    "op8_quality_ranker": op8_quality_ranker,
    "op9_quality_rules": op9_quality_rules,
    "op10_decontamination": op10_decontamination,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_lexical_search": op13_lexical_search,
}
