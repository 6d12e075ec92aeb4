"""The quality ranker learns from every labelled document."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import quality_ranker


def test_every_labelled_document_is_fitted(spark, monkeypatch):
    n = 5600  # 2,800 a label, more than any sample of before
    docs = spark.range(n + 50).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.repeat(F.when(F.col("id") % 2 == 0, "# ").otherwise("it. "), (F.col("id") % 9).cast("int")), F.col("id")).alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    real, seen = quality_ranker.featurise, []
    monkeypatch.setattr(quality_ranker, "featurise", lambda d, c: seen.append(d.count()) or real(d, c))
    assert quality_ranker.fit(docs, labels) is not None
    assert sum(seen) >= n


def table(spark, n_good, n_bad):
    rnd = np.random.default_rng(8)
    x = rnd.normal(size=(n_good + n_bad, quality_ranker.N_FEATURES))
    good = np.arange(len(x)) < n_good
    x[good, 0] += 1.0
    return x, good, spark.createDataFrame([(i, int(g), r.tolist()) for i, (r, g) in enumerate(zip(x, good))], "doc_id long, q int, x array<double>")


def test_packs_hold_each_row_once_and_enough_of_the_rarer_label(spark, monkeypatch):
    monkeypatch.setattr(quality_ranker, "PACK", 50)
    x, good, rows = table(spark, 970, 30)
    packs = quality_ranker.packed(rows, 970, 30).collect()
    own = np.concatenate([np.frombuffer(p["x"]).reshape(-1, x.shape[1])[np.frombuffer(p["own"], dtype=bool)] for p in packs])
    assert len(packs) == 20 and sorted(map(tuple, own)) == sorted(map(tuple, x))
    assert all(0 < (~np.frombuffer(p["good"], dtype=bool)).sum() for p in packs)


def test_a_fit_over_packs_is_the_fit_in_memory(spark, monkeypatch):
    x, good, rows = table(spark, 500, 200)
    one = quality_ranker.Model(x, good, 2 / 7)
    same = quality_ranker.Model.of(quality_ranker.over(quality_ranker.packed(rows, 500, 200)), 2 / 7)
    assert same.w == pytest.approx(one.w, abs=1e-6) and same.cut == pytest.approx(one.cut, abs=1e-6) and same.slope == one.slope
    # the loss of all pairs is at its least
    pairs = (good.sum() * (~good).sum())
    s = quality_ranker._spread((x - one.mid) / one.scale, one.knots)
    slope = quality_ranker.pairwise(one.w, s[good], s[~good])[1] / pairs + quality_ranker.RIDGE * one.w
    assert np.abs(slope).max() < 1e-5
    # many packs: the threshold is the quantile of all worths
    monkeypatch.setattr(quality_ranker, "PACK", 60)
    many = quality_ranker.Model.of(quality_ranker.over(quality_ranker.packed(rows, 500, 200).repartition(3)), 2 / 7)
    worth = np.sort(many.worth(x))
    weight = np.where(good, (5 / 7) / 500, (2 / 7) / 200)[np.argsort(many.worth(x))]
    at = int(np.searchsorted(np.cumsum(weight), 2 / 7 + 1e-9, side="right"))
    assert many.cut == pytest.approx((worth[at - 1] + worth[at]) / 2, abs=1e-6)
    assert np.corrcoef(many.scores(x), one.scores(x))[0, 1] > 0.9
