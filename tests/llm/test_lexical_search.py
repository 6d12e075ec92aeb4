"""Ranked search against a plain version: shards, ties, repeats, nulls, blocks."""

import math
import random
import re
from array import array
from collections import Counter

import numpy as np

from quillgraph.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=20):
    split = [(i, Counter(terms(t))) for i, t in docs]
    split = [(i, c, sum(c.values())) for i, c in split if c]
    n_docs, total = len(split), sum(n for _, _, n in split)
    df = Counter(t for _, c, _ in split for t in c)
    out = []
    for item_id, text in set(items):
        found = []
        for i, c, n in split:
            m = 75 + 25 * n * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item_id, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def test_packing_is_lossless():
    rnd = random.Random(1)
    for _ in range(50):
        v = [rnd.randrange(1 << rnd.choice([1, 7, 8, 14, 40, 62])) for _ in range(rnd.randint(0, 50))]
        assert lexical_search.unpack(lexical_search.pack(v)).tolist() == v


def test_merge_matches_full_sums():
    rnd = random.Random(2)
    for _ in range(300):
        n, k = rnd.randint(1, 60), rnd.randint(1, 8)
        lists, sums = [], Counter()
        for _ in range(rnd.randint(0, 8)):
            docs = sorted(rnd.sample(range(n), rnd.randint(1, n)))
            adds = [rnd.choice([0, 1, 2, 3, 50]) for _ in docs]
            lists.append((array("q", docs), array("q", adds), max(adds)))
            sums.update(dict(zip(docs, adds)))
        want = sorted(((s, -d) for d, s in sums.items() if s > 0), reverse=True)[:k]
        assert sorted(lexical_search.best(lists, k), reverse=True) == want


def test_search_matches_plain_version(spark):
    rnd = random.Random(3)
    voc = [f"w{int(rnd.paretovariate(0.7)) % 300}" for _ in range(4000)]
    docs = [(i * 7 - 50, " ".join(rnd.choices(voc, k=rnd.randint(0, 80)))) for i in range(250)]
    docs += [(None, "w1 w2 rare"), (None, "w1 w2 rare"), (5000, "w1 W2, RARE!"), (5000, "w1 w2 rare"), (1, None), (2, ""), (3, "?!"), (9000, "été ÉTÉ Été"), (9001, "w3 " * 3000)]
    items = [(i, " ".join(rnd.choices(voc, k=rnd.randint(1, 30)))) for i in range(25)] + [(30, "rare w2 rare"), (30, "rare w2 rare"), (31, None), (32, "été nowhere"), (33, "nowhere"), (None, "w1 w2")]
    rnd.shuffle(docs)
    frame = spark.createDataFrame([(a, b, 1, 2) for a, b in docs], "doc_id long, text string, term int, score int").repartition(5)
    asked = spark.createDataFrame([(a, b, "x") for a, b in items], "item_id int, text string, doc_id string")
    want = plain(docs, items)
    for shard, block in ((16_384, 1000), (9, 7)):
        got = lexical_search.search(frame, asked, shard=shard, block=block)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search(docs.limit(0), items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0
    assert lexical_search.search(docs, items).count() == 1


def test_a_shard_keeps_negative_and_wide_ids():
    shard = lexical_search.Shard({b"a": 0})
    for i in (2**62, -(2**62), None, 0):
        shard.add(i, b"a a")
    found = lexical_search.search_shard([dict(zip(("shard", "term", "n", "total", "base", "nulls", "data", "counts"), r)) for r in shard.rows(1)], [(7, 0, {0: 1})], {0: 5}, 4, 8, 9)
    assert sorted((r[2] for r in found), key=str) == sorted([2**62, -(2**62), None, 0], key=str)
    assert len({r[3] for r in found}) == 1 and np.all([r[0] == 7 for r in found])
