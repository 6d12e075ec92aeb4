"""Periodic runs against brute force, in Python and through Spark."""

import hashlib
import random
import re
from zlib import crc32

import numpy as np
import pytest

from quillgraph.llm import periodic_runs
from quillgraph.llm.common import table
from quillgraph.llm.registry import QUERIES

DATA = "/root/testdata/sf0.001"


def brute(w, least=24, times=3):
    """(start, length, period) of every run, straight from the definition."""
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, times * q) and (i, length) not in out:
                out[i, length] = q
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def split(text):
    return [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def looped(rnd, n, letters):
    w = [rnd.randrange(letters) for _ in range(n)]
    if n > 5 and rnd.random() < 0.7:
        a = rnd.randrange(n)
        p = 1 + (n - a) // rnd.randint(3, 9)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if rnd.random() < 0.5:
            w[rnd.randrange(n)] = 99
    return w


@pytest.mark.parametrize("least,times", [(24, 3), (6, 3), (4, 2), (10, 4)])
def test_runs_match_brute_force(least, times):
    rnd = random.Random(least)
    for _ in range(300):
        w = looped(rnd, rnd.randint(0, 90), rnd.choice([1, 2, 3, 5, 20]))
        assert periodic_runs.find_runs(np.array(w, dtype=np.int64), least, times) == brute(w, least, times), w


def test_the_vocabulary_holds_every_primitive_square():
    rnd = random.Random(9)
    for _ in range(60):
        w = looped(rnd, rnd.randint(4, 60), rnd.choice([2, 3]))
        suffixes = periodic_runs.Suffixes(np.array(w))
        start, period = periodic_runs.covering_squares(suffixes, periodic_runs.blocks(suffixes), len(w) // 2)
        squares = {tuple(w[i : i + 2 * q]) for q in range(1, len(w) // 2 + 1) for i in range(len(w) - 2 * q + 1) if w[i : i + q] == w[i + q : i + 2 * q]}
        whole = {s for s in squares if not any(len(s) // 2 % p == 0 and s == s[:p] * (len(s) // p) for p in range(1, len(s) // 2))}
        tree = periodic_runs.SuffixTree(suffixes)
        found = {tuple(w[tree.order[tree.first[v]] :][: 2 * q]) for v, q in (periodic_runs.vocabulary(tree, start, period) if len(start) else [])}
        assert found == whole


def test_a_long_looped_text_takes_linear_memory_and_time():
    rnd = random.Random(3)
    w = [rnd.randrange(3000) for _ in range(120_000)]
    w[40_000:] = [w[40_000 + i % 16_000] for i in range(80_000)]
    assert periodic_runs.find_runs(np.array(w)) == [(40_000, 80_000, 16_000)]
    assert periodic_runs.find_runs(np.zeros(50_000, dtype=np.int64)) == [(0, 50_000, 1)]


def test_query_matches_brute_force(spark):
    got = {r["doc_id"]: r for r in QUERIES["op11_periodic_runs"](spark, DATA).collect()}
    rows = table(spark, DATA, "documents").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    met = 0
    for doc_id, text in rows:
        w = split(text)
        h, n = crc32(str(doc_id).encode()), len(w)
        if n > 3000:
            continue
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute(w)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        r = got[doc_id]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
        met += bool(runs)
    assert met > 5


def test_edges(spark):
    tail = " ".join(["a b c"] * 10)
    rows = [(1, None, 7), (1, "", 7), (None, "  \t ", 7), (None, f"x {tail} y", 7), (2, "é é " * 12, 7), (2, "é é " * 12, 7), (3, "w " * 23, 7), (4, " ".join("pqrstuvwxyz"[i % 9] for i in range(26)), 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs long")
    got = periodic_runs.collapse_runs(docs)
    assert got.columns == ["doc_id", "text", "n_words", "runs", "collapsed"]
    found = sorted((r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got.collect())
    assert found == sorted([(0, [], ""), (0, [], ""), (0, [], ""), (32, [(1, 30, 3)], "x a b c y"), (24, [(0, 24, 1)], "é"), (24, [(0, 24, 1)], "é"), (23, [], " ".join(["w"] * 23)), (26, [], rows[-1][1])])
    assert periodic_runs.digest(docs.limit(0)).count() == 0
    ties = periodic_runs.digest(spark.createDataFrame([(3, f"{'a ' * 24}x {'b ' * 24}", 1)], "doc_id long, text string, runs long")).first()
    assert (ties["n_runs"], ties["start"], ties["length"], ties["exponent_milli"]) == (2, 0, 24, 24000)
