"""Near-dedup, token counts, licence scans and the three models against
brute force, exact round trips and held-out accuracy."""

import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quillgraph.llm import components, language_id, license_scan, lm_scoring, quality_ranker, simhash_dedup, token_counts
from quillgraph.llm.common import is_remainder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in river stone cloud paper lamp green seven window market signal".split()


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], DOCS)


def prose(rnd, n, words=WORDS):
    return " ".join(rnd.choice(words) + str(rnd.randint(0, 60)) for _ in range(n))


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


# --- near-dedup --------------------------------------------------------------------


def fingerprint(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", w) if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_clusters_match_brute_force(spark):
    rnd = random.Random(1)
    texts = [prose(rnd, rnd.randint(1, 90)) for _ in range(60)] + [None, "", "  ", "One", "one", "a b c d", "A  b\tc\nd", "É é"]
    for _ in range(120):
        w = rnd.choice(texts[:60]).split()
        for _ in range(rnd.randint(0, 2)):
            w[rnd.randrange(len(w))] = rnd.choice(WORDS)
        texts.append(" ".join(w))
    rows = [(i * 3, t, "en") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in simhash_dedup.clusters(docs(spark, rows)).collect()}
    fp = {i: fingerprint(t) for i, t, _ in rows}
    parent = {i: i for i in fp}
    for i in fp:
        for j in fp:
            if i < j and (fp[i] ^ fp[j]).bit_count() <= 4:
                a, b = sorted((find(parent, i), find(parent, j)))
                parent[b] = a
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{x:016x}" for i, x in fp.items()}
    assert {i: r["component_id"] for i, r in got.items()} == {i: find(parent, i) for i in fp}
    kept = {r["doc_id"] for r in simhash_dedup.keep_one(docs(spark, rows)).collect()}
    assert kept == {find(parent, i) for i in fp}


def test_dense_group_of_near_fingerprints_is_linked_whole(spark):
    rnd = random.Random(2)
    centre = rnd.getrandbits(64)
    prints = {centre} | {centre ^ 1 << a ^ 1 << b for a in range(64) for b in range(a)} | {rnd.getrandbits(64) for _ in range(300)}
    prints = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    table = spark.createDataFrame([(x,) for x in prints], "fp long")
    links = [(r["x"], r["y"]) for r in simhash_dedup.links(table).collect()]
    mask = (1 << 64) - 1
    assert all(((x ^ y) & mask).bit_count() <= 4 for x, y in links)
    parent = {x: x for x in prints}
    for x, y in links:
        parent[find(parent, x)] = find(parent, y)
    brute = {x: x for x in prints}
    for k, x in enumerate(prints):
        for y in prints[k + 1 :]:
            if ((x ^ y) & mask).bit_count() <= 4:
                brute[find(brute, x)] = find(brute, y)
    same = {}
    for x in prints:
        assert same.setdefault(find(parent, x), find(brute, x)) == find(brute, x)
    assert len(same) == len({find(brute, x) for x in prints})


def test_pivot_tables_bring_all_links_together_and_few_other_pairs(spark):
    rnd = random.Random(6)
    mask, signed = (1 << 64) - 1, lambda x: x - (1 << 64) if x >> 63 else x
    prints = [rnd.getrandbits(64) for _ in range(3000)]
    for k in range(600):
        x = prints[k]
        for bit in rnd.sample(range(64), rnd.randint(1, 7)):
            x ^= 1 << bit
        prints.append(x)
    prints = sorted({signed(x) for x in prints})
    table = simhash_dedup._level(spark.createDataFrame([(x, 0, 0) for x in prints], "fp long, tied int, key long"), 0)
    a, b = table.alias("a"), table.alias("b")
    met = {(r[0], r[1]) for r in a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp"))).select("a.fp", "b.fp").collect()}
    kept = {(r[0], r[1]) for r in simhash_dedup._pairs(table.withColumn("tied", F.lit(0))).select("a.fp", "b.fp").collect()}
    linked = {(x, y) for i, x in enumerate(prints) for y in prints[i + 1 :] if ((x ^ y) & mask).bit_count() <= 4}
    assert linked <= kept <= met
    every = len(prints) * (len(prints) - 1) // 2
    assert len(met) < every / 5000 and len(linked) > 250
    assert len(kept) - len(linked) < 0.8 * (len(met) - len(linked))  # total distances discard some of the rest


def test_crowded_groups_are_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "CROWD", 12)
    rnd = random.Random(8)
    mask, signed = (1 << 64) - 1, lambda x: x - (1 << 64) if x >> 63 else x
    centre, prints = rnd.getrandbits(64), set()
    for _ in range(900):
        x = centre
        for bit in rnd.sample(range(64), rnd.randint(0, 5)):
            x ^= 1 << bit
        prints.add(signed(x))
    prints = sorted(prints)
    parent, brute = {x: x for x in prints}, {x: x for x in prints}
    for r in simhash_dedup.links(spark.createDataFrame([(x,) for x in prints], "fp long")).collect():
        assert ((r["x"] ^ r["y"]) & mask).bit_count() <= 4
        parent[find(parent, r["x"])] = find(parent, r["y"])
    for i, x in enumerate(prints):
        for y in prints[i + 1 :]:
            if ((x ^ y) & mask).bit_count() <= 4:
                brute[find(brute, x)] = find(brute, y)
    pairs = {(find(parent, x), find(brute, x)) for x in prints}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_fingerprint_of_a_text_longer_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "CHUNK", 50)
    rnd = random.Random(9)
    rows = [(i, prose(rnd, n), "en") for i, n in enumerate((49, 50, 51, 53, 54, 200, 333))]
    got = {r["doc_id"]: r["fingerprint"] for r in simhash_dedup.clusters(docs(spark, rows)).collect()}
    assert got == {i: f"{fingerprint(t):016x}" for i, t, _ in rows}


def test_near_dedup_edges(spark):
    assert simhash_dedup.clusters(docs(spark, [])).count() == 0
    assert simhash_dedup.keep_one(docs(spark, [])).count() == 0
    rows = docs(spark, [(1, "same text here now", "en"), (1, "same text here now", "en"), (None, "same text here now", "en"), (7, None, "en")]).withColumn("fp", F.lit(0)).withColumn("component_id", F.lit(0))
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in simhash_dedup.clusters(rows).collect())
    assert got == [(0, 1), (1, 1), (1, 1), (7, 7)]
    assert sorted(r["doc_id"] for r in simhash_dedup.keep_one(rows).collect()) == [1, 7]


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(500, k) for k in range(501, 540)] + [(3, 2), (2, 3), (9, 9)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {k: 500 for k in range(500, 540)} | {2: 2, 3: 2}


# --- token counts ------------------------------------------------------------------


def test_edited_counts_equal_counting_anew(spark):
    rnd = random.Random(4)
    counter = token_counts.Counter(token_counts.rank_file())
    alphabet = ["a", "b ", "  ", "\n", "'", "'ll", "s", "é", "12", ".", "\t", "語", "😀", " word", "!!"]
    make = lambda n: "".join(rnd.choice(alphabet) for _ in range(n))
    rows = []
    for i in range(150):
        text = make(rnd.randint(0, 900))
        edits = []
        for _ in range(rnd.randint(0, 6)):
            a = rnd.randint(0, len(text) + 3)
            edits.append((a, a + rnd.choice([0, 0, 1, 2, 40, 700]), make(rnd.choice([0, 1, 2, 3, 30, 900]))))
        rows.append((i, text, edits))
    rows += [(900, None, None), (901, "", [(0, 0, "new text")]), (902, "x", [(0, 1, None), None]), (903, "word " * 40_000, [(100_000, 100_010, "!")])]
    table = spark.createDataFrame(rows, f"doc_id long, text string, edits {token_counts.EDITS}").withColumn("n_tokens", F.lit("old"))
    treed = token_counts.trees(table)
    before = {r["doc_id"]: r for r in treed.collect()}
    after = {r["doc_id"]: r for r in token_counts.apply_edits(treed).collect()}
    for i, text, edits in rows:
        now = text or ""
        assert before[i]["n_tokens"] == len(counter.encoding.encode_ordinary(now)) == sum(before[i]["leaf_tokens"])
        for e in edits or []:
            if e is not None:
                a, b, new = e
                a = min(a, len(now))
                now = now[:a] + (new or "") + now[max(a, b) :]
        r = after[i]
        assert (r["text"] or "") == now
        assert r["n_tokens"] == len(counter.encoding.encode_ordinary(now)) == sum(r["leaf_tokens"])
        assert sum(r["leaf_chars"]) == len(now)
    assert after[903]["n_reencoded"] < 2000


def test_repeated_rows_are_counted_each(spark):
    table = spark.createDataFrame([(1, "one two", None), (1, "one two", None), (None, "x", [(0, 1, "yy")])], f"doc_id long, text string, edits {token_counts.EDITS}")
    got = token_counts.apply_edits(token_counts.trees(table)).collect()
    assert sorted((r["doc_id"] or 0, r["text"], r["n_tokens"]) for r in got)[1:] == [(1, "one two", 2)] * 2 and len(got) == 3


# --- licence scans ------------------------------------------------------------------


def test_base_places_match_brute_force(spark):
    rnd = random.Random(6)
    pool = "cc by general public license all rights reserved the of".split()
    texts = [" ".join(rnd.choice(pool) + rnd.choice(["", "", ",", "-"]) for _ in range(rnd.randint(0, 60))) for _ in range(80)] + [None, "", "CC-BY", "GENERAL public\nLicense", "x " * 30_000]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in license_scan.scan_digest(docs(spark, rows)).collect()}
    for i, t, _ in rows:
        w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        places = [(k, label) for p, label in license_scan.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert r["first_word"] == min((k for k, _ in places), default=None)
        assert r["last_word"] == max((k for k, _ in places), default=None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_automaton_finds_every_long_match():
    rnd = random.Random(8)
    for _ in range(60):
        templates = [[rnd.randrange(5) for _ in range(rnd.randint(1, 25))] for _ in range(4)]
        text = [rnd.randrange(5) for _ in range(60)]
        automaton = license_scan.SuffixAutomaton(templates)
        got = {(t, i, i + shift) for (t, shift), runs in automaton.diagonals(text, 0, 3).items() for a, b in runs for i in range(a, b + 1)}
        want = set()
        for t, seq in enumerate(templates):
            for i in range(len(text)):
                for e in range(len(seq)):
                    n = 0
                    while i - n >= 0 and e - n >= 0 and text[i - n] == seq[e - n]:
                        n += 1
                    if n >= 3:
                        want |= {(t, i - k, e - k) for k in range(n)}
        assert got == want


def best_chain(pieces, size, gap):
    """The most covered tokens of any chain, by trying all of them."""
    best = 0

    def grow(last, covered):
        nonlocal best
        best = max(best, covered)
        for p in pieces:
            if last is None or (last[1] < p[0] <= last[1] + 1 + gap and last[2] + last[1] - last[0] < p[2] <= last[2] + last[1] - last[0] + 1 + gap):
                grow(p, covered + p[1] - p[0] + 1)

    grow(None, 0)
    return best / size


def test_chains_match_brute_force():
    rnd = random.Random(9)
    for _ in range(200):
        size, gap, pieces = 30, rnd.randint(1, 6), set()
        for _ in range(rnd.randint(1, 7)):
            a, s = rnd.randint(0, 40), rnd.randint(0, 26)
            pieces.add((a, a + rnd.randint(0, 29 - s), s))
        spans = license_scan.chain(list(pieces), size, gap, cover=0.01)
        assert max(share for _, _, share in spans) == pytest.approx(best_chain(pieces, size, gap))
        assert all(b < x or y < a for i, (a, b, _) in enumerate(spans) for x, y, _ in spans[:i])


def test_whole_licences_are_told_apart(spark):
    texts = dict(license_scan.TEMPLATES[13:])
    rows = [(i, f"Copyright 2020 Some Body\n\n{t}\nand code follows here", "en") for i, t in enumerate(texts.values())]
    rows += [(100, texts["mit"].replace("sublicense", "resell").replace("THE AUTHORS OR", "ANY"), "en"), (101, texts["isc"][:200], "en"), (102, texts["zlib"] + texts["zlib"], "en")]
    table = docs(spark, rows + rows[:1]).withColumn("places", F.lit(1)).withColumn("spans", F.lit("x"))
    got = {}
    for r in license_scan.scan_digest(table).collect():
        got.setdefault(r["doc_id"], []).append((set(r["labels"].split(",")), r["score"]))
    for i, label in enumerate(texts):
        assert label in got[i][0][0] and got[i][0][1] >= 0.99, label
    assert "bsd-2-clause" not in got[2][0][0] and "bsd-3-clause" not in got[1][0][0] and "isc" in got[3][0][0]
    assert "mit" in got[100][0][0] and got[0][0] == got[0][1] and len(got[0]) == 2
    spans = license_scan.scan(docs(spark, [(1, texts["zlib"] + texts["zlib"], "en")])).first()["spans"]
    assert [s["label"] for s in spans] == ["zlib", "zlib"]


def test_spans_cover_changed_notices(spark):
    text = dict((label, t) for label, t in reversed(license_scan.TEMPLATES) if label == "gpl-3.0")["gpl-3.0"]
    long = license_scan.TEMPLATES[1][1]
    changed = long.replace("obtaining", "getting").replace("deal in", "use")
    rows = [(1, f"// {text.upper()}\ncode", "en"), (2, f"intro words here {changed} more", "en"), (3, "permission is hereby granted to nobody at all", "en"), (4, f"{long} and again {long}", "en")]
    got = {r["doc_id"]: r for r in license_scan.scan(docs(spark, rows)).collect()}
    assert {s["label"] for s in got[1]["spans"]} == {"gpl-3.0"}
    (span,) = got[2]["spans"]
    assert span["label"] == "mit" and span["first"] == 3 and 0.75 <= span["share"] < 1
    assert got[3]["spans"] == []
    assert [s["share"] for s in got[4]["spans"]] == [1.0, 1.0]
    assert license_scan.scan(docs(spark, [])).count() == 0


# --- language model ----------------------------------------------------------------


@pytest.mark.parametrize("head", [5, 1 << 17])
def test_scores_match_brute_force(spark, head):
    rnd = random.Random(9)
    rows = [(i, prose(rnd, rnd.randint(0, 50)).upper() if i % 7 == 0 else prose(rnd, rnd.randint(0, 50)), "en") for i in range(120)]
    rows += [(500, None, "en"), (501, "", "en"), (502, "never seen words", "en"), (None, "river1 river1", "en"), (503, "river1 " * 20_000, "en")]
    table = docs(spark, rows)
    held = is_remainder(F.col("doc_id"), 5, 1)
    got = {r["doc_id"]: r for r in lm_scoring.score(table, ~held, head=head, buckets=3).collect()}
    train = {i for i, _, _ in rows if crc32(str("" if i is None else i).encode()) % 5 != 1}
    split = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()
    c = Counter(w for i, t, _ in rows if i in train for w in [*split(t), ""])
    total, types = sum(c.values()), len(c)
    for i, t, _ in rows:
        w = [*split(t), ""]
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.5) / (total + 0.5 * (types + 1))) for x in w))
    # the model itself, with the weights that were learned
    share = min(0.1, lm_scoring.DELETED / len(train))
    marked = table.withColumn("_train", ~held).withColumn("_deleted", ~held & (lm_scoring.unit_hash(F.coalesce(F.col("doc_id"), F.lit(-1)), F.lit("deleted")) < share))
    model = lm_scoring.fit(marked, head)
    cls = lambda x: x if x == "" or (xxh64_intdigest(x.encode(), 42) & lm_scoring._MASK) in model.classes else None
    bi, ctx = Counter(), Counter()
    for i, t, _ in rows:
        if i in train:
            before = "<s>"
            for x in [*split(t), ""]:
                bi[before, cls(x)] += 1
                ctx[before] += 1
                before = cls(x)
    p1 = lambda x: model.m * c[x] / total + (1 - model.m) / (types + 1)
    known = {x for x in c if cls(x) is not None}
    rest = 1 - sum(p1(x) for x in known)
    for i, t, _ in rows:
        before, want = "<s>", 0.0
        for x in [*split(t), ""]:
            a = model.a[int(math.log2(ctx[before]))] if ctx[before] else 0.0
            ml = bi[before, cls(x)] / ctx[before] if ctx[before] else 0.0
            want += math.log10(a * ml * (1 if cls(x) is not None else p1(x) / rest) + (1 - a) * p1(x))
            before = cls(x)
        assert got[i]["score"] == pytest.approx(want, rel=1e-6)


def test_score_edges(spark):
    always = F.lit(True)
    assert lm_scoring.score(docs(spark, []), always).count() == 0
    (r,) = lm_scoring.score(docs(spark, [(1, "a b", "en")]), ~always).collect()
    assert (r["n_known"], r["train_tokens"]) == (0, 0) and r["base_score"] == pytest.approx(0.0) and math.isfinite(r["score"])
    assert lm_scoring.score(docs(spark, [(1, "a b", "en"), (1, "a b", "en")]), always).count() == 2


# --- language identification ----------------------------------------------------------


def test_languages_are_told_apart(spark):
    rnd = random.Random(10)
    syllables = {"aa": "ka ti mo lu".split(), "bb": "shr wen ob ulk".split(), "cc": "çé öß ñu ãi".split()}
    make = lambda lang: " ".join("".join(rnd.choice(syllables[lang]) for _ in range(3)) for _ in range(rnd.randint(2, 30)))
    rows = [(i, make(lang), lang) for i, lang in enumerate(rnd.choice(sorted(syllables)) for _ in range(300))]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "12 %% !!", "cc"), (903, "kati " * 40_000, None), (None, "moluka ti", "aa")]
    table = docs(spark, rows).withColumn("score", F.lit("x")).withColumn("_text", F.lit(1))
    got = {r["doc_id"]: r for r in language_id.identify(table, is_remainder(F.col("doc_id"), 3, 1)).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    assert got[903]["lang_pred"] == "aa"
    right = [got[i]["lang_pred"] == lang for i, _, lang in rows[:300] if got[i]["held_out"]]
    assert len(right) > 60 and sum(right) >= 0.98 * len(right)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (crc32(str("" if i is None else i).encode()) % 3 == 1) for i, r in got.items())


def test_language_edges(spark):
    assert language_id.identify(docs(spark, []), F.lit(False)).count() == 0
    (r,) = language_id.identify(docs(spark, [(1, "words", None)]), F.lit(False)).collect()
    assert (r["lang_pred"], r["score"]) == ("und", 0.0)


def gram_counts(text):
    """Places of all 1- to 3-grams of letters, runs of anything else one space."""
    letters = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.replace("\n", " ").lower())).removeprefix(" ")
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(letters) - n + 1):
            gram, code = letters[i : i + n], 0
            if gram == " ":
                continue
            for k, c in enumerate(gram, 1):
                code = (code * 0x9E3779B1 + ord(c) + k) % 2**32
            out[code * 0x85EBCA6B % 2**32 >> 17] += 1
    return out


def test_features_match_brute_force(spark):
    rnd = random.Random(12)
    alphabet = "abcdéÈß 語。、😀　1,.\n\t-İǅ"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(60)] + ["", None, "123 !?", "。😀", "a" * 5000]
    table = docs(spark, [(i, t, "en") for i, t in enumerate(texts)] + [(3, texts[3], "en")])
    want = [gram_counts(t or "") for t in texts]
    import numpy as np

    for r in language_id.vectors(table, "lang").collect():
        got = dict(zip(np.frombuffer(r["places"], np.int32).tolist(), np.frombuffer(r["counts"], np.int32).tolist()))
        assert got == dict(want[r["id"]]), texts[r["id"]]
    times = Counter(p for w in [*want, want[3]] for p in w)
    assert language_id.document_frequencies(table) == dict(times)


def test_ftrl_matches_a_plain_loop():
    import numpy as np

    rnd = random.Random(14)
    dims, classes, alpha, beta, l1, l2 = 7, 3, 0.5, 1.0, 0.05, 0.5
    model = language_id.Ftrl(dims, classes, alpha, beta, l1, l2)
    z, n = ([[0.0] * classes for _ in range(dims)] for _ in range(2))

    def weight(i, k):
        if abs(z[i][k]) <= l1:
            return 0.0
        return -(z[i][k] - math.copysign(l1, z[i][k])) / ((beta + math.sqrt(n[i][k])) / alpha + l2)

    for _ in range(60):
        at = sorted(rnd.sample(range(dims), 4))
        x, truth = [rnd.uniform(0, 2) for _ in at], rnd.randrange(classes)
        w = {(i, k): weight(i, k) for i in at for k in range(classes)}
        logits = [sum(v * w[i, k] for i, v in zip(at, x)) for k in range(classes)]
        e = [math.exp(v - max(logits)) for v in logits]
        for i, v in zip(at, x):
            for k in range(classes):
                g = v * (e[k] / sum(e) - (k == truth))
                z[i][k] += g - (math.sqrt(n[i][k] + g * g) - math.sqrt(n[i][k])) / alpha * w[i, k]
                n[i][k] += g * g
        model.step(np.array(at), np.array(x), truth)
    assert model.z == pytest.approx(np.array(z)) and model.n == pytest.approx(np.array(n))
    assert model.weights() == pytest.approx(np.array([[weight(i, k) for k in range(classes)] for i in range(dims)]))
    assert (model.weights() == 0).any()  # the l1 part keeps some weights away


def test_ties_and_repeated_rows_change_no_language(spark):
    rows = [(i, "abc abc" if i % 2 else "xyz xyz", "en" if i % 2 else "fr") for i in range(12)]
    table = docs(spark, rows + rows).withColumn("lang_pred", F.lit("mine")).withColumn("_text", F.lit(1))
    got = language_id.identify(table, F.col("doc_id") > 9).collect()
    assert len(got) == 24 and {(r["doc_id"], r["lang_pred"], r["score"]) for r in got} == {(r["doc_id"], r["lang_pred"], r["score"]) for r in got[:12]} | {(r["doc_id"], r["lang_pred"], r["score"]) for r in got[12:]}
    one = language_id.identify(docs(spark, [(i, "same words", lang) for i, lang in enumerate(["de", "en"] * 5)]), F.lit(False)).collect()
    assert len({(r["lang_pred"], r["score"]) for r in one}) == 1


def test_temperature_lowers_the_loss():
    import numpy as np

    rnd = np.random.default_rng(0)
    truth = rnd.integers(0, 3, 400)
    logits = rnd.normal(size=(400, 3)) * 8
    logits[np.arange(400), truth] += 6
    loss = lambda t: -np.log(language_id.softmax(logits / t)[np.arange(400), truth]).mean()
    t = language_id.temperature(logits, truth)
    assert loss(t) <= min(loss(x) for x in (0.5, 1, 2, 4, 8)) + 1e-6


# --- quality ranker -------------------------------------------------------------------


def test_ranker_follows_the_gradient_of_the_pairwise_loss():
    import numpy as np

    random_ = np.random.default_rng(3)
    d, w = random_.normal(size=(40, 5)), random_.normal(size=5)
    loss = lambda w: np.log1p(np.exp(-(d @ w))).mean() + 0.05 * (w @ w)
    steps = np.eye(5) * 1e-6
    numeric = [(loss(w + s) - loss(w - s)) / 2e-6 for s in steps]
    assert quality_ranker.gradient(w, d, 0.1) == pytest.approx(np.array(numeric), abs=1e-6)
    # the threshold is the quantile of worth at the share of bad labels
    x = random_.normal(size=(400, 3))
    model = quality_ranker.Model(x, x[:, 0] + 0.3 * random_.normal(size=400) > 0, bad_share=0.25)
    good = x[:, 0] > 0
    score = model.scores(x)
    assert np.corrcoef(score, x[:, 0])[0, 1] > 0.8 and score[good].mean() > score[~good].mean() + 0.3


def test_features_of_texts_match_plain_counts():
    table = quality_ranker._classes()
    for text in ("One two two three! 4 #x\n\nsame line.\nsame line.\n", "É a\tb", "word", "ABC " * 50):
        w, f = text.split(), quality_ranker.features(text, table)
        lines = [x for x in text.split("\n") if x.strip()]
        want = {
            0: math.log1p(len(w)), 1: sum(map(len, w)) / len(w), 4: sum(len(x) <= 2 for x in w) / len(w), 5: sum(c != c.lower() for c in text) / len(text),
            7: text.count("!") / len(w), 8: sum(c.isdigit() for c in text) / len(text), 11: len(set(w)) / len(w), 13: max(map(w.count, w)) / len(w),
            16: sum(a == b for a, b in zip(w, w[1:])) / len(w), 17: 1 - len(set(lines)) / len(lines),
        }
        assert {k: f[k] for k in want} == pytest.approx(want)
    assert quality_ranker.features(" \n", table) == [0.0] * quality_ranker.N_FEATURES


def test_ranker_ties_and_repeated_rows(spark):
    rows = [(i, "good words flow here. " * 8 if i % 2 else "!! ## " * 30, "en") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    table = docs(spark, rows + rows[:5]).withColumn("x", F.lit(0)).withColumn("q", F.lit("mine"))
    got = quality_ranker.rank(table, labels, F.col("doc_id") >= 40).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"] % 2, set()).add((r["score"], r["predicted"]))
    assert len(got) == 65 and all(len(v) == 1 for v in by.values())
    assert {k: next(iter(v))[1] for k, v in by.items()} == {0: 0, 1: 1}


def test_ranker_orders_held_out_documents(spark):
    rnd = random.Random(12)
    rows = [(i, prose(rnd, rnd.randint(20, 90)), "en") for i in range(300)]
    rows += [(i, " ".join([rnd.choice(WORDS).upper() + "###"] * 30), "en") for i in range(300, 400)]
    rows += [(900, None, "en"), (901, "", "en"), (902, "x " * 40_000, "en"), (None, "a b", "en")]
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(400)] + [(900, 1, 0), (900, 0, 0)], "doc_id long, quality int, toxic int")
    held = is_remainder(F.col("doc_id"), 5, 0)
    table = docs(spark, rows).withColumn("score", F.lit(1)).withColumn("q", F.lit(1))
    got = {r["doc_id"]: r for r in quality_ranker.rank(table, labels.filter(~held), held).collect()}
    assert len(got) == len(rows)
    judged = [(got[i]["predicted"], i < 300) for i in range(400) if got[i]["held_out"]]
    assert sum(p == q for p, q in judged) >= 0.97 * len(judged)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())


def test_ranker_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_ranker.rank(docs(spark, []), none, F.lit(False)).count() == 0
    (r,) = quality_ranker.rank(docs(spark, [(1, "words", "en")]), none, F.lit(False)).collect()
    assert (r["score"], r["predicted"]) == (0.5, 1)
