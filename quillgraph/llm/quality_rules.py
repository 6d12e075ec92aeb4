"""Quality rules: a learned decision list (DataFrame only).

Statistics are native expressions over whole texts.  Rules are learned by
sequential covering: a conjunction of thresholds is grown on two thirds of a
bounded labelled sample by FOIL gain, pruned back on the other third, kept only
while it is precise there, and the rows it covers are set aside for the next.
The list becomes one ordered ``CASE WHEN`` that Spark evaluates with the
statistics, without a shuffle.

Bound: the learner reads at most ``SAMPLE`` labelled rows (their numbers
only), chosen by a hash of the id; the statistics and the verdict cover all.

Defined results: null text has no words and fails the base rules (fewer than
20 words); without labels the learned list is empty and the base rules alone
decide; ties between thresholds go to the first feature and lower threshold;
labels with a null or contradictory quality for one id teach nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import bounded, drawn, let, unit_hash, words

WINDOW = 8
SAMPLE = 6000
FEATURES = ("symbol_share", "upper_share", "dup_line_share", "repeat_share", "mean_word", "n_words", "distinct_share", "bang_share", "digit_share")


def _repeat_words(w: Column) -> Column:
    """Words in windows of eight words that the text has twice or more."""

    def over(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - WINDOW)
        wins = F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

        def marked(v: Column) -> Column:
            ranked = F.sort_array(F.transform(v, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

            def covered(s: Column) -> Column:
                twice = F.filter(s, lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)))
                places = F.sort_array(F.transform(twice, lambda x: x["i"]))
                spans = let(places, lambda p: F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))))
                return F.aggregate(spans, F.lit(0), lambda acc, x: acc + x)

            return F.when(F.size(F.array_distinct(v)) == F.size(v), F.lit(0)).otherwise(let(ranked, covered))

        return let(wins, marked)

    return F.when(F.size(w) < WINDOW, F.lit(0)).otherwise(let(F.transform(w, lambda x: F.xxhash64(x)), over))


def _kept_chars(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def statistics(text: Column) -> Column:
    """A struct of everything that rules may test, in one pass over the text."""
    whole = F.coalesce(text, F.lit(""))

    def of_words(w: Column) -> Column:
        full = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        dup = let(full, lambda x: F.size(x) - F.size(F.array_distinct(x)))
        joined = F.array_join(w, "")
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(joined).cast("long").alias("word_chars"),
            (F.length(whole) - _kept_chars(whole, r"[#*$%&|<>]+")).cast("long").alias("n_symbols"),
            dup.cast("long").alias("n_dup_lines"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            (F.length(joined) - _kept_chars(joined, r"\p{Lu}+")).cast("long").alias("n_upper"),
            (F.length(joined) - _kept_chars(joined, r"[0-9]+")).cast("long").alias("n_digits"),
            (F.length(joined) - _kept_chars(joined, r"!+")).cast("long").alias("n_bangs"),
        )

    return let(words(text), of_words)


def _feature(s: Column, name: str) -> Column:
    n, chars = F.greatest(s["n_words"], F.lit(1)), F.greatest(s["word_chars"], F.lit(1))
    made = {
        "symbol_share": s["n_symbols"] / chars,
        "upper_share": s["n_upper"] / chars,
        "digit_share": s["n_digits"] / chars,
        "bang_share": s["n_bangs"] / n,
        "dup_line_share": s["n_dup_lines"] / n,
        "repeat_share": s["n_repeat_words"] / n,
        "distinct_share": s["n_distinct"] / n,
        "mean_word": s["word_chars"] / n,
        "n_words": s["n_words"].cast("double"),
    }
    return made[name]


@dataclass(frozen=True)
class Rule:
    """Reject where every (feature, sign, threshold) holds."""

    tests: tuple[tuple[str, str, float], ...]

    def covers(self, row: dict) -> bool:
        return all(row[f] >= t if sign == ">=" else row[f] <= t for f, sign, t in self.tests)

    def column(self, s: Column) -> Column:
        out = F.lit(True)
        for f, sign, t in self.tests:
            out = out & (_feature(s, f) >= t if sign == ">=" else _feature(s, f) <= t)
        return out


def _best_test(rows: list[tuple[dict, bool]]):
    """The threshold with the highest FOIL gain for the rows marked True."""
    bad = sum(b for _, b in rows)
    base, best = log2(bad / len(rows)), (1e-9, None)
    for f in FEATURES:
        ordered = sorted(((r[f], b) for r, b in rows), key=lambda x: x[0])
        for sign, run in ((">=", ordered[::-1]), ("<=", ordered)):
            p = n = 0
            for i, (v, b) in enumerate(run):
                p, n = p + b, n + (not b)
                if i + 1 < len(run) and run[i + 1][0] != v and p:
                    gain = p * (log2(p / (p + n)) - base)
                    if gain > best[0]:
                        best = (gain, (f, sign, (v + run[i + 1][0]) / 2))
    return best[1]


def learn(rows: list[tuple[dict, bool]], precision: float = 0.95, support: int = 4, most: int = 12) -> list[Rule]:
    """rows: (features, is bad). Sequential covering with growing and pruning."""
    grow, prune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if not i % 3]
    out: list[Rule] = []

    def value(tests, data) -> tuple[float, int, int]:
        hit = [b for r, b in data if Rule(tuple(tests)).covers(r)]
        p = sum(hit)
        return ((2 * p - len(hit)) / len(hit) if hit else -1.0), p, len(hit)

    while len(out) < most and any(b for _, b in grow):
        tests, left = [], grow
        while len(tests) < 4 and any(not b for _, b in left):
            test = _best_test(left)
            if test is None:
                break
            tests.append(test)
            left = [(r, b) for r, b in left if Rule((test,)).covers(r)]
        if not tests:
            break
        tests = max((tests[:k] for k in range(len(tests), 0, -1)), key=lambda t: value(t, prune)[0])
        (_, p, n), (_, gp, gn) = value(tests, prune), value(tests, grow)
        if n == 0 or p / n < precision or gp / max(gn, 1) < precision or gp + p < support:
            break
        rule = Rule(tuple(tests))
        out.append(rule)
        grow, prune = [x for x in grow if not rule.covers(x[0])], [x for x in prune if not rule.covers(x[0])]
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Learn from the statistics of at most ``sample`` labelled documents."""
    marks = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("q2"))
    marks = marks.filter("q = q2 and doc_id is not null").select(F.col("doc_id").alias("_label_id"), (F.col("q") == 0).alias("_bad"))
    n = marks.count()
    if not n:
        return []
    chosen = drawn(marks.withColumn("_all", F.lit(0)), sample, "_all", unit_hash(F.col("_label_id"), F.lit("rules")), F.col("_label_id"), of=F.lit(n))
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_label_id")).drop("_label_id")
    stats = bounded(joined, sample, "_all", "rules").select("doc_id", "_bad", F.explode(F.array(statistics(F.col("text")))).alias("s"))
    got = stats.select("doc_id", "_bad", *[_feature(F.col("s"), f).alias(f) for f in FEATURES]).collect()
    got.sort(key=lambda r: (r["doc_id"], *[r[f] for f in FEATURES]))
    return learn([({f: r[f] for f in FEATURES}, r["_bad"]) for r in got])


def _base_failed(s: Column) -> Column:
    return (s["n_words"] < 20) | (100 * s["n_repeat_words"] > 30 * s["n_words"])


def kept(s: Column, rules: list[Rule]) -> Column:
    """The ordered conditional expression: base rules, then the learned list."""
    out = F.when(_base_failed(s), False)
    for rule in rules:
        out = out.when(rule.column(s), False)
    return out.otherwise(True)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept; a row a document."""
    s = docs.select("doc_id", F.explode(F.array(statistics(F.col("text")))).alias("s"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return s.select("doc_id", *[F.col("s")[c].alias(c) for c in base], _base_failed(F.col("s")).alias("base_failed"), kept(F.col("s"), rules).alias("kept"))


def keep_good(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents that the list keeps, columns unchanged."""
    return docs.filter(let(statistics(F.col("text")), lambda s: kept(s, rules)))
