"""Near-dedup keeps one document of each component, whatever the ids."""

import random

from test_models import docs, prose

from quillgraph.llm import simhash_dedup
from quillgraph.llm.common import checked, materialise


def test_unlike_texts_without_an_id_or_with_one_id_all_stay(spark):
    rnd = random.Random(41)
    a, b, c, d, e, f = (prose(rnd, 60) for _ in range(6))
    rows = [(None, a, "en"), (None, b, "en"), (None, c, "en"), (None, a, "en"), (1, d, "en"), (1, e, "en"), (2, d, "en"), (1, e, "en"), (3, f, "en"), (None, f, "en")]
    got = sorted(((r["doc_id"] or 0), r["text"]) for r in simhash_dedup.keep_one(docs(spark, rows)).collect())
    assert got == sorted([(0, a), (0, b), (0, c), (1, d), (1, e), (3, f)])
    assert simhash_dedup.clusters(docs(spark, rows)).columns == ["doc_id", "fingerprint", "component_id", "_th"]


def test_no_table_that_grows_with_the_corpus_is_gathered_in_the_driver(spark):
    rnd = random.Random(42)
    rows = [(i, prose(rnd, 30), "en") for i in range(20)]
    kept = simhash_dedup.keep_one(docs(spark, [*rows, (90, rows[0][1], "en")]))
    assert {r["doc_id"] for r in kept.collect()} == set(range(20))
    found = simhash_dedup.clusters(docs(spark, rows))
    keys = materialise(docs(spark, rows).select("doc_id"), "test-keys")
    beyond = docs(spark, rows).join(checked(keys, 19), "doc_id", "left_semi")
    assert beyond.count() == 20
    for df in (kept, found, beyond):
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
