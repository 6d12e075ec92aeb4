"""Mixing, line dedup, quality rules and decontamination against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import decontamination, line_dedup, mixing, quality_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in river stone cloud paper lamp green seven window market signal".split()


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 60)) for _ in range(n))


# --- mixing -----------------------------------------------------------------


def water_fill(sizes, weights, budget=1.5, cap=2.0):
    left, open_, out = budget * sum(sizes), set(range(len(sizes))), {}
    while open_:
        share = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if share * weights[i] > cap * sizes[i]}
        if not over:
            return out | {i: share * weights[i] for i in open_}
        for i in over:
            out[i] = cap * sizes[i]
            left -= out[i]
        open_ -= over
    return out


def test_targets_are_water_filling_and_mix_is_near(spark):
    rnd = random.Random(3)
    rows = [(i, prose(rnd, rnd.randint(1, 60)), rnd.choice(["a", "b", "b", "b", "c", "d", "é", None])) for i in range(600)]
    got = mixing.mix(docs(spark, rows)).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(by_id) == 600
    order = ["a", "b", "c", "d", "é", None]
    size = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in order}
    target = water_fill([size[s] for s in order], [3, 1, 2, 3, 1, 2])
    taken = defaultdict(int)
    for i, t, s in rows:
        r = by_id[i]
        assert r["size"] == len(t.split()) and r["source_size"] == size[s]
        assert r["target"] == pytest.approx(target[order.index(s)])
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
        taken[s] += r["taken"]
    for k, s in enumerate(order):
        assert abs(taken[s] - target[k]) <= 60
    assert sorted(got) == sorted(mixing.mix(docs(spark, rows)).collect())


def test_rows_alike_are_documents_of_their_own(spark):
    rnd = random.Random(4)
    rows = [(i, prose(rnd, rnd.randint(5, 40)), "ab"[i % 2]) for i in range(60)]
    rows += [rows[0]] * 7 + [(None, rows[1][1], "a"), (None, rows[1][1], "a"), (None, rows[3][1], "a"), (5, rows[9][1], "b"), (5, rows[9][1], "b")]
    table = docs(spark, rows)
    got = mixing.mix(table).collect()
    assert len(got) == len(rows)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(t.split())) for i, t, _ in rows)
    assert {r["source_size"] for r in got} == {sum(len(t.split()) for _, t, x in rows if x == s) for s in "ab"}
    drawn = Counter()
    for r in got:
        drawn[r["doc_id"], r["size"]] += r["copies"]
    emitted = Counter((r["doc_id"], len(r["text"].split())) for r in mixing.expand(table).collect())
    assert +drawn == emitted
    other = table.withColumn("lang", F.when(F.col("doc_id") == 5, F.lit(None)).otherwise(F.col("lang"))).withColumn("rows", F.lit(3))
    both = mixing.expand(table.withColumn("rows", F.lit(None).cast("int")).unionByName(other))
    assert {(r["doc_id"], r["rows"]) for r in both.collect()} >= {(0, 3), (0, None)}


def test_mix_edges(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    rows = [(1, None, "a"), (2, "", "a"), (3, "x " * 50_000, "b"), (None, "one two", None), (4, "same", "b"), (4, "same", "b")]
    got = mixing.mix(docs(spark, rows)).collect()
    assert {r["size"] for r in got if r["source_size"] == 0} == {0}
    assert all(r["target"] == 0 for r in got if r["source_size"] == 0)
    clash = docs(spark, rows).withColumn("copies", F.lit("mine")).withColumn("_key", F.lit(1))
    out = mixing.expand(clash)
    assert out.columns == [*clash.columns, "copy"]
    assert {r["copies"] for r in out.collect()} == {"mine"}


def test_expand_emits_the_drawn_copies(spark):
    rnd = random.Random(5)
    rows = docs(spark, [(i, prose(rnd, rnd.randint(1, 30)), rnd.choice("ab")) for i in range(100)])
    drawn = {r["doc_id"]: r["copies"] for r in mixing.mix(rows).collect()}
    emitted = Counter(r["doc_id"] for r in mixing.expand(rows).collect())
    assert {k: v for k, v in drawn.items() if v} == dict(emitted)


# --- line dedup ---------------------------------------------------------------


def brute_lines(rows):
    seen, out = set(), {}
    for i, text, _ in sorted(rows, key=lambda r: r[0]):
        if text is None:
            out[i] = None
            continue
        lines = text.split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if not "".join(w).strip():
                continue
            if w in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(w)
        out[i] = "\n".join(x for p, x in enumerate(lines) if p not in gone)
    return out


def test_line_dedup_matches_brute_force(spark):
    rnd = random.Random(7)
    pool = [f"line {k}" for k in range(12)] + ["", "  "]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 40))), "a") for i in range(120)]
    rows += [(200, None, "a"), (201, "", "a"), (202, "a\nb", "a"), (203, "\n".join(str(k) for k in range(3000)), "a"), (204, "\n" * 50, "a")]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    want = brute_lines(rows)
    assert {k: r["text"] for k, r in got.items()} == want
    for i, text, _ in rows:
        if text is not None and got[i]["text"]:
            assert got[i]["n_removed"] == len(text.split("\n")) - len(want[i].split("\n"))
        assert got[i]["n_chars"] == len(want[i] or "")


def test_line_dedup_edges(spark):
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0
    text = "a\nb\nc"
    rows = docs(spark, [(1, text, "s"), (1, text, "s"), (None, text, "s"), (2, text, "s")]).withColumn("_lines", F.lit(1)).withColumn("_left", F.lit(2))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in line_dedup.dedup_lines(rows).collect())
    # the null id comes first in order, so it keeps the lines; repeats share a verdict
    assert got == [(False, 1, ""), (False, 1, ""), (False, 2, ""), (True, 0, text)]


# --- quality rules ----------------------------------------------------------------


def base(text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    wins = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    marked = {i + k for i in range(len(w) - 7) if wins[tuple(w[i : i + 8])] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def test_statistics_match_brute_force(spark):
    rnd = random.Random(11)
    texts = [prose(rnd, rnd.randint(0, 60)) for _ in range(40)]
    texts += [" ".join(rnd.choice("abc") for _ in range(n)) for n in range(0, 60, 3)]
    texts += ["a b c d e f g h " * 3, "x\ny\nx\n \n \nx", "## $$ %% | <b> & *", "é ß 語   x\x0by", None, "", "ÉCOLE!! 12", "w " * 30_000]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in quality_rules.judge(docs(spark, rows), []).collect()}
    for i, t, _ in rows:
        n, chars, sym, dup, rep = base(t)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, sym, dup, rep), t
        assert r["base_failed"] == (n < 20 or 100 * rep > 30 * n)
        assert r["kept"] == (not r["base_failed"])


def test_rules_are_learned_and_ordered(spark):
    rnd = random.Random(13)
    good = [(i, prose(rnd, 80), "s") for i in range(150)]
    bad = [(1000 + i, " ".join(w + "###" for w in prose(rnd, 80).split()), "s") for i in range(60)]
    loud = [(2000 + i, prose(rnd, 80).upper(), "s") for i in range(60)]
    table = docs(spark, good + bad + loud)
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _, _ in good + bad + loud], "doc_id long, quality int, toxic int")
    rules = quality_rules.fit(table, labels)
    assert rules and rules == quality_rules.fit(table, labels)
    kept = {r["doc_id"] for r in quality_rules.keep_good(table, rules).collect()}
    assert kept == {i for i, _, _ in good}
    assert {r["doc_id"] for r in quality_rules.judge(table, rules).collect() if r["kept"]} == kept


def test_best_test_has_the_highest_foil_gain():
    rnd = random.Random(15)
    for _ in range(40):
        rows = [({f: float(rnd.randint(0, 4)) for f in quality_rules.FEATURES}, rnd.random() < 0.4) for _ in range(rnd.randint(4, 30))]
        bad = sum(b for _, b in rows)
        if not bad:
            continue
        gains = {}
        for f in quality_rules.FEATURES:
            values = sorted({r[f] for r, _ in rows})
            for low, high in zip(values, values[1:]):
                for sign in (">=", "<="):
                    rule = quality_rules.Rule(((f, sign, (low + high) / 2),))
                    hit = [b for r, b in rows if rule.covers(r)]
                    if sum(hit):
                        gains[rule.tests[0]] = sum(hit) * (math.log2(sum(hit) / len(hit)) - math.log2(bad / len(rows)))
        best = quality_rules._best_test(rows)
        top = max(gains.values(), default=0.0)
        assert best is None and top <= 1e-9 or gains[best] == pytest.approx(top)


def test_rules_keep_columns_of_clashing_names(spark):
    table = docs(spark, [(1, "good words " * 30, "s"), (None, "x " * 3, "s")]).withColumn("s", F.lit(1)).withColumn("n_words", F.lit("mine")).withColumn("kept", F.lit(0))
    out = quality_rules.keep_good(table, [quality_rules.Rule((("n_words", ">=", 60.0),))])
    assert out.columns == table.columns and out.count() == 0
    assert {r["kept"] for r in quality_rules.judge(table, []).collect()} == {False}


def test_rules_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    table = docs(spark, [(1, "few words", "s")])
    assert quality_rules.fit(table, none) == []
    assert quality_rules.fit(docs(spark, []), spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")) == []
    assert quality_rules.keep_good(table, []).count() == 0


# --- decontamination ------------------------------------------------------------


def norm(text):
    return [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()) if x]


def brute_leaks(rows, items):
    def grams(w, n):
        return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))

    out = {}
    for i, text, _ in rows:
        w = norm(text)
        for k, t in items:
            x = norm(t)
            if not x:
                continue
            n = min(5, len(x))
            b = grams(x, n)
            best = 0.0
            for at in range(max(1, len(w) - len(x) + 1)):
                a = grams(w[at : at + len(x)], n)
                top = sum((a | b).values())
                best = max(best, sum((a & b).values()) / top if top else 0.0)
            if best >= 0.8:
                out[i, k] = best
    return out


def test_leaks_match_brute_force(spark):
    rnd = random.Random(17)
    items = [(k, prose(rnd, rnd.randint(12, 50))) for k in range(12)] + [(90, "too short"), (91, "")]
    rows = [(i, prose(rnd, rnd.randint(0, 120)), "s") for i in range(60)]
    for i in range(60, 110):
        k, t = items[rnd.randrange(12)]
        w = t.split()
        if i % 3 == 0:  # the last word differs: similarity about 0.9
            w[-1] = "changed"
        if i % 3 == 1:
            w = [x.upper() + rnd.choice(["", ",", "!"]) for x in w]
        rows.append((i, prose(rnd, rnd.randint(0, 40)) + " " + " ".join(w) + ". " + prose(rnd, rnd.randint(0, 40)), "s"))
    rows += [(200, None, "s"), (201, "", "s"), (202, " ".join(items[0][1].split()[:-1]), "s"), (203, (items[1][1] + " ") * 2, "s"), (204, prose(rnd, 20_000) + " " + items[2][1], "s")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontamination.contaminated(docs(spark, rows), bench).collect()}
    want = brute_leaks(rows[:-1], items) | {(204, 2): 1.0}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    clean = {r["doc_id"] for r in decontamination.remove_contaminated(docs(spark, rows), bench).collect()}
    assert clean == {i for i, _, _ in rows} - {i for i, _ in want}


def test_leaks_in_any_order_are_found(spark):
    """Rotated, cut, widened and repetitive items against all windows."""
    rnd = random.Random(19)
    items = [(k, prose(rnd, rnd.randint(60, 140))) for k in range(16)] + [(50, "one two three four"), (51, "zebra"), (52, "a b a b a b a b a b a b"), (53, prose(rnd, 9))]
    rows = []
    for i in range(96):
        w = items[i % 16][1].split()
        cut = rnd.randrange(5, len(w) - 5)
        if i % 6 == 0:
            w = w[cut:] + w[:cut]
        if i % 6 == 1:
            w.insert(cut, "inserted")
        if i % 6 == 2:
            w[cut : cut + 1] = ["other", "words"]
        if i % 6 == 3:
            rnd.shuffle(w)
        if i % 6 == 4:
            del w[cut]
        if i % 6 == 5:
            w[cut], w[cut - 4] = "x", "y"
        rows.append((i, prose(rnd, rnd.randint(0, 60)) + " " + " ".join(w) + " " + prose(rnd, rnd.randint(0, 60)), "s"))
    rows += [(200, "say ONE two, three four now", "s"), (201, "one two three", "s"), (202, "one two three four", "s"), (203, "zebra", "s"), (204, "a b " * 30, "s"), (205, " ".join(items[19][1].split()[:8]), "s")]
    rows += [(None, items[0][1], "s"), (200, items[1][1], "s"), (200, items[1][1], "s"), (206, items[2][1] + " " + items[2][1], "s"), (207, prose(rnd, 150_000) + " " + items[3][1], "s")]
    bench = spark.createDataFrame([*items, (0, items[0][1]), (50, items[5][1]), (60, items[6][1]), (61, None)], "item_id long, text string")
    found = decontamination.contaminated(docs(spark, rows), bench).collect()
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in found}
    assert len(found) == len({(r["doc_id"], r["_th"], r["item_id"]) for r in found})
    want = {}
    for i, t, _ in rows[:-1]:
        for (_, k), v in brute_leaks([(i, t, "")], [*items, (50, items[5][1]), (60, items[6][1])]).items():
            want[i, k] = max(v, want.get((i, k), 0))
    for k in (50, 5):
        want |= {(i, k): max(brute_leaks([(i, t, "")], [(k, x)]).get((i, k), 0) for x in (items[5][1], *(["one two three four"] * (k == 50)))) for i, t, _ in rows[:102] if brute_leaks([(i, t, "")], [(k, items[5][1])])}
    want[207, 3] = 1.0
    assert len([1 for i, _ in want if i is not None and i < 96 and i % 6 == 0]) >= 12  # most rotations reach 0.8
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k]) for k in want if k[1] != 50)


def test_index_finds_all_items_within_the_radius_and_few_others(spark):
    rnd = random.Random(23)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    items = [(k, 30, signed(rnd.getrandbits(64))) for k in range(80)]
    prints = []
    for i in range(120):
        x = items[i % 80][2]
        for bit in rnd.sample(range(64), rnd.randint(0, 22)):
            x = signed((x ^ 1 << bit) & ((1 << 64) - 1))
        prints.append((i, 30, x))
    got = decontamination.candidates(spark.createDataFrame(prints, "n long, length int, fp long"), spark.createDataFrame(items, "_k long, length int, print long"))
    want = {(i, k) for i, _, x in prints for k, _, y in items if ((x ^ y) & ((1 << 64) - 1)).bit_count() <= 19}
    assert {(r["n"], r["_k"]) for r in got.collect()} == want and len(want) > 80
    met = sum(any(bin((x ^ y) >> first & (1 << bits) - 1).count("1") <= 3 for first, bits in decontamination.blocks()) for _, _, x in prints for _, _, y in items)
    assert met < 0.35 * len(prints) * len(items)


def test_leaks_edges(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(docs(spark, [(1, "a b c d e f", "s")]), bench).count() == 0
    bench = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "item_id long, text string")
    rows = docs(spark, [(None, "a b c d e f", "s"), (5, "x a b c d e f", "s"), (5, "x a b c d e f", "s")]).withColumn("window", F.lit(0)).withColumn("_at", F.lit(0))
    got = decontamination.contaminated(rows, bench).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in got) == [(0, 1), (0, 2), (5, 1), (5, 2)]
    assert decontamination.remove_contaminated(rows, bench).count() == 0
    assert decontamination.contaminated(docs(spark, []), bench).count() == 0
