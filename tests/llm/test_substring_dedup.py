"""Removal of repeated passages against brute force; FM-index against counting."""

import random
from collections import Counter

import numpy as np

from quillgraph.llm import substring_dedup
from quillgraph.llm.fm_index import FMIndex, WaveletMatrix, repeated_spans


def plain(texts, window):
    """(words, kept text) of each text."""
    split = [[w.decode() for w in (t or "").encode().split()] for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = {i + k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(window)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_wavelet_matrix_counts():
    rnd = random.Random(1)
    for _ in range(30):
        s = np.array([rnd.randrange(rnd.choice([2, 9, 300])) for _ in range(rnd.randint(1, 300))])
        m = WaveletMatrix(s, int(s.max()))
        for _ in range(20):
            c, at = rnd.randrange(int(s.max()) + 1), rnd.randint(0, len(s))
            got = m.descend(np.array([c, c]), np.array([at, 0]))
            assert got[0] - got[1] == (s[:at] == c).sum()


def test_backward_search_weighs_occurrences():
    rnd = random.Random(2)
    for _ in range(40):
        seqs = [np.array([rnd.randint(1, 3) for _ in range(rnd.randint(1, 25))]) for _ in range(rnd.randint(1, 8))]
        weights = np.array([rnd.randint(1, 3) for _ in seqs])
        index = FMIndex(seqs, weights)

        def weight(p):
            return sum(w * sum(tuple(s[i : i + len(p)]) == p for i in range(len(s) - len(p) + 1)) for s, w in zip(seqs, weights))

        for s in seqs:
            ends = np.arange(1, len(s) + 1)
            got = index.statistics(s, ends, np.zeros_like(ends), 2)
            for e, size in zip(ends, got):
                assert size == max(n for n in range(e + 1) if n == 0 or weight(tuple(s[e - n : e])) >= 2)
        for t in (1, 2, 4):
            for s, spans in zip(seqs, repeated_spans(index, seqs, t)):
                covered = {i for a, b in spans for i in range(a, b)}
                assert covered == {i + k for i in range(len(s) - t + 1) if weight(tuple(s[i : i + t])) >= 2 for k in range(t)}


def test_equal_windows_have_equal_anchors_and_lie_in_one_piece():
    rnd = random.Random(3)
    names, window = substring_dedup.Hashes(), 12
    for gram in substring_dedup.grams(window):
        at = {}
        for _ in range(20):
            w = [f"w{rnd.randint(0, 3)}".encode() for _ in range(rnd.randint(0, 80))]
            h = substring_dedup._hashed(names, w)
            covered = []
            for start, n, anchor, whole in zip(*(x.tolist() for x in substring_dedup.cut(h, window, gram))):
                covered += range(start, start + n)
                assert at.setdefault(("piece", tuple(w[start : start + n + window - 1])), (anchor, whole)) == (anchor, whole)
                for i in range(start, start + n):
                    assert at.setdefault(tuple(w[i : i + window]), anchor) == anchor
            assert covered == list(range(max(0, len(w) - window + 1)))


def corpus(rnd):
    shared = [" ".join(f"s{rnd.randint(0, 50)}" for _ in range(rnd.randint(8, 60))) for _ in range(6)]
    line = " ".join(f"l{k}" for k in range(9))
    texts = [None, "", " \n ", "one two", "x " * 40, "y " * 11, "y " * 12]
    for _ in range(120):
        parts = [" ".join(f"w{rnd.randint(0, 4000)}" for _ in range(rnd.randint(0, 30)))]
        parts += [rnd.choice(shared) for _ in range(rnd.randint(0, 2))] + [line] * rnd.randint(0, 1)
        parts += [" ".join(f"w{rnd.randint(0, 4000)}" for _ in range(rnd.randint(0, 30)))]
        texts.append(rnd.choice(["\n", " ", "\t "]).join(parts))
    return texts + texts[20:30] + ["É" + texts[40], "a b " * 20]


def test_removal_matches_brute_force(spark):
    texts = corpus(random.Random(4))
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, start int, kept int").repartition(5)
    for window, shard, hot in ((12, 300_000, 2_000), (12, 300, 3), (35, 500, 1), (1, 1000, 2), (3, 1000, 2)):
        got = substring_dedup.remove_passages(docs, window, shard, hot)
        assert got.columns == ["doc_id", "text", "start", "n_words", "n_removed", "kept"]
        rows = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in got.collect()}
        assert rows == dict(enumerate(plain(texts, window))), (window, shard, hot)


def test_null_and_repeated_ids(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(None, a), (None, f"z {a}"), (1, b), (1, b), (2, f"{b[:-1]}"), (2, "c " * 3)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, _id string, _qg_spans string")
    got = sorted((r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.remove_passages(docs, 25).collect())
    assert got == sorted(plain([t for _, t in rows], 25))
    assert substring_dedup.digest(docs.limit(0)).count() == 0
