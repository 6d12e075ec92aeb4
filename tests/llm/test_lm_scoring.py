"""Language-model scores: every word keeps its own bigrams."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import lm_scoring

DOCS = "doc_id long, text string"


def test_every_word_keeps_its_bigrams_beyond_131072_words(spark):
    rnd = random.Random(31)
    words = [f"w{i}" for i in range(140_000)]
    rows = []
    for i in range(3):
        rnd.shuffle(words)
        rows += [(1000 * i + k, " ".join(words[k::300])) for k in range(300)]
    rows += [(5000 + i, f"w1 w2 w{i + 10}") for i in range(20)] + [(5100 + i, f"w3 w4 w{i + 10}") for i in range(20)]
    rows += [(9000, "w1 w2"), (9001, "w1 w4"), (9002, "unseen w2")]
    table = spark.createDataFrame(rows, DOCS)
    training = F.col("doc_id") < 9000
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score(table, training, buckets=3).collect()}
    assert got[9000] > got[9001] + 1  # w2 and w4 are equally frequent; only w2 follows w1

    model = lm_scoring.fit(lm_scoring.marked(table, training))
    one, two, context = Counter(), Counter(), Counter()
    for i, t in rows:
        if i < 9000:
            w = ["<s>", *t.split(), ""]
            one.update(w[1:]), context.update(w[:-1]), two.update(zip(w, w[1:]))
    total = sum(one.values())
    assert (model.tokens, model.types) == (total, len(one))
    for i, t in rows[::7] + rows[-3:]:
        w, want = ["<s>", *t.split(), ""], 0.0
        for v, x in zip(w, w[1:]):
            a = model.a[int(math.log2(context[v]))] if context[v] else 0.0
            p1 = model.m * one[x] / total + (1 - model.m) / (len(one) + 1)
            want += math.log10(a * two[v, x] / max(1, context[v]) + (1 - a) * p1)
        assert got[i] == pytest.approx(want, rel=1e-9)


def test_groups_of_chunks_count_together(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK", 150)
    rnd = random.Random(33)
    table = spark.createDataFrame([(i, " ".join(f"w{int(rnd.paretovariate(0.8))}" for _ in range(rnd.randint(0, 40)))) for i in range(300)], DOCS)
    training = F.col("doc_id") % 4 != 0
    one = lm_scoring.score(table, training, buckets=3).orderBy("doc_id").collect()
    many = lm_scoring.score(table, training, buckets=2, groups=4).orderBy("doc_id").collect()
    for a, b in zip(one, many):
        assert a["base_score"] == pytest.approx(b["base_score"], rel=1e-12) and a["score"] == pytest.approx(b["score"], rel=1e-9)
        assert (a["doc_id"], a["n_tokens"], a["n_known"], a["train_tokens"]) == (b["doc_id"], b["n_tokens"], b["n_known"], b["train_tokens"])


def test_small_training_sets_and_clashing_columns(spark):
    table = spark.createDataFrame([(1, "a b"), (2, None), (None, "a"), (1, "a b")], DOCS)
    model = lm_scoring.fit(lm_scoring.marked(table, F.lit(True), deleted=0))
    assert (model.m, set(model.a)) == (0.9, {0.2}) and model.tokens == 9 and model.types == 3
    clash = table.withColumn("_train", F.lit("x")).withColumn("chunk", F.lit(1)).withColumn("score", F.lit(2))
    got = lm_scoring.score(clash, F.col("doc_id") == 1).collect()
    assert len(got) == 4 and len({tuple(r) for r in got if r["doc_id"] == 1}) == 1
    by = {r["doc_id"]: r for r in got}
    assert (by[2]["n_tokens"], by[2]["n_known"], by[None]["n_known"], by[1]["train_tokens"]) == (1, 1, 2, 6)
    base = math.log10(2.5 / (6 + 0.5 * 4))
    assert by[2]["base_score"] == pytest.approx(base) and by[1]["base_score"] == pytest.approx(3 * base)
    none = lm_scoring.score(table, F.lit(False)).collect()
    assert {r["n_known"] for r in none} == {0} and all(r["score"] == pytest.approx(0.0) or r["score"] < 0 for r in none)


def test_a_tenth_is_held_out_at_every_size(spark):
    table = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    model = lm_scoring.fit(lm_scoring.marked(table, F.lit(True)))
    assert model.deleted == pytest.approx(0.1 * model.tokens, rel=0.1)


def test_weights_match_brute_force(spark):
    rnd = random.Random(32)
    table = spark.createDataFrame([(i, " ".join(f"w{int(rnd.paretovariate(0.7))}" for _ in range(30))) for i in range(400)], DOCS)
    marked = lm_scoring.marked(table, F.lit(True))
    model = lm_scoring.fit(marked)
    one, two, context = ([Counter(), Counter()] for _ in range(3))
    for r in marked.collect():
        w = ["<s>", *r["text"].split(), ""]
        k = int(r["_deleted"])
        one[k].update(w[1:]), context[k].update(w[:-1]), two[k].update(zip(w, w[1:]))
    total, types, m = sum(one[0].values()), len(one[0] | one[1]), 0.9
    p1 = lambda x: m * one[0][x] / total + (1 - m) / (types + 1)
    for _ in range(40):
        m = min(1 - 1e-3, max(1e-3, sum(n * m * one[0][x] / total / p1(x) for x, n in one[1].items()) / sum(one[1].values())))
    assert model.m == pytest.approx(m, abs=1e-3)
    weights = [0.2] * 64
    for _ in range(40):
        whole, share = Counter(), Counter()
        for (v, x), n in two[1].items():
            if context[0][v]:
                b = int(math.log2(context[0][v]))
                own = weights[b] * two[0][v, x] / context[0][v]
                whole[b] += n
                share[b] += n * own / (own + (1 - weights[b]) * p1(x))
        for b in whole:
            weights[b] = share[b] / whole[b]
    assert list(model.a) == pytest.approx([min(0.999, x) for x in weights], abs=0.01)
