"""Benchmark decontamination by SimHash windows (DataFrame only).

For every benchmark item of L words, windows of L words of each document are
fingerprinted (64-bit SimHash of their five-word shingles, weighed by how often
they occur).  Multi-index blocks: the word is cut into ``BLOCKS`` blocks; of two
fingerprints within ``RADIUS`` bits, one block has at most ``RADIUS // BLOCKS``
differing bits, so an item is listed under every value that near each of its
blocks, and a window finds, with one look a block, all items within the radius.
Candidates are verified by the weighted Jaccard similarity of their shingle
multisets; 0.8 or more is contamination.

Which windows are fingerprinted: similarity 0.8 of n shingles against k needs
4/9 (n + k) common ones, so a window in which fewer positions hold a shingle of
any item of its length, in whatever order, cannot reach it.  All others are
fingerprinted, and the index tells which items they may be.  A random pair of
the same length meets with probability 0.23.  Of windows with similarity 0.8
about one in a thousand lies beyond 19 bits (10 differing bits, standard deviation
3) and is missed; for documents of four or five shingles that are shorter than the
item it is one in a hundred.

Scale: documents stream through one join with the item shingles, sent to every
task only after their number is checked (``SMALL``), else shuffled; nothing of a
document moves until it holds an item's shingle.  Positions are grouped by
document and length, so a group is bounded by one text; windows are summed by a
partial aggregate where they are cut.

Defined results: words are lower-cased runs of letters and digits; null or empty
texts and items hold nothing; an item of fewer than five words is one shingle of
all of them, which a document holds wherever these words stand in a row; a
document shorter than the item is one window; repeated items are reported each;
a row is (doc_id, item_id) with the best window, ties to the first; repeated rows
are reported once.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import alnum_words, checked, let, materialise, shuffled

SHINGLE, THRESHOLD, RADIUS, BLOCKS = 5, 0.8, 19, 5
#: Item shingles up to which they are sent to every task (24 bytes each).
SMALL = 500_000


def _grams(h: Column, n: int) -> Column:
    """Hashes of all runs of n word hashes; empty for fewer words."""
    at = F.sequence(F.lit(0), F.size(h) - n)
    return F.when(F.size(h) >= n, F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))).otherwise(F.array().cast("array<bigint>"))


def shingles(w: Column, sizes: list[int]) -> Column:
    """For each size (gram, s): the hashes of all runs of so many words."""
    return let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.array(*[F.struct(F.lit(n).alias("gram"), _grams(h, n).alias("s")) for n in sizes]))


def blocks() -> list[tuple[int, int]]:
    """First bit and number of bits of each block."""
    sizes = [64 // BLOCKS + (i < 64 % BLOCKS) for i in range(BLOCKS)]
    return [(sum(sizes[:i]), n) for i, n in enumerate(sizes)]


def near_values(bits: int) -> list[int]:
    """All masks of at most RADIUS // BLOCKS bits."""
    return [sum(1 << i for i in chosen) for n in range(RADIUS // BLOCKS + 1) for chosen in combinations(range(bits), n)]


def _block(fp: Column, first: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def fingerprints(windows: DataFrame, keys: list[str], s: str) -> DataFrame:
    """Rows (keys, array ``s`` of shingle hashes) -> (keys, fp): bit i is set if
    more than half of the hashes have it.  Two counters share a long."""
    lanes = (1 << 32) + 1
    one = windows.select(*keys, F.explode(s).alias("_x"))
    sums = [F.sum(F.shiftrightunsigned("_x", j).bitwiseAND(F.lit(lanes))).alias(f"_c{j}") for j in range(32)]
    found = one.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *sums)

    def bit(count: Column, at: int) -> Column:
        return F.when(count * 2 > F.col("_n"), F.shiftleft(F.lit(1).cast("long"), at)).otherwise(F.lit(0).cast("long"))

    low = [bit(F.col(f"_c{j}").bitwiseAND(F.lit((1 << 32) - 1)), j) for j in range(32)]
    high = [bit(F.shiftrightunsigned(f"_c{j}", 32), j + 32) for j in range(32)]
    return found.select(*keys, reduce(lambda a, b: a.bitwiseOR(b), low + high).alias("fp"))


def _numbered(w: Column) -> Column:
    """A multiset as a set: the n-th repeat of a hash becomes a hash of both."""

    def nth(x: Column, i: Column) -> Column:
        return let(F.size(F.filter(F.slice(w, 1, i), lambda y: y == x)), lambda n: F.when(n == 0, x).otherwise(F.xxhash64(x, n)))

    return F.when(F.size(F.array_distinct(w)) == F.size(w), w).otherwise(F.transform(w, nth))


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two multisets: sum of minima over sum of maxima."""
    return let(F.size(F.array_intersect(_numbered(a), _numbered(b))), lambda m: m / (F.size(a) + F.size(b) - m))


def item_table(benchmark: DataFrame) -> DataFrame:
    """(item_id, length, item, _k): the shingles of each item that has a word, and
    a hash of them, which tells items of clashing ids apart."""
    items = benchmark.select("item_id", alnum_words(F.col("text")).alias("_w")).filter(F.size("_w") > 0)
    every = shingles(F.col("_w"), list(range(1, SHINGLE + 1)))
    found = items.select("item_id", F.size("_w").alias("length"), F.get(every, F.least(F.size("_w"), F.lit(SHINGLE)) - 1)["s"].alias("item"))
    return found.select("*", F.xxhash64("item").alias("_k"))


def spots(docs: DataFrame, items: DataFrame, sizes: list[int]) -> DataFrame:
    """(_id, _h, length, span, starts): the windows to fingerprint, a row for a
    document and length; span is a window's number of shingles."""
    placed = materialise(items.select("length", F.explode("item").alias("s")).groupBy("s").agg(F.collect_set("length").alias("lengths")), "decon-shingles")
    texts = docs.select("doc_id", F.xxhash64("text").alias("_th"), F.explode(shingles(alnum_words(F.col("text")), sizes)).alias("g"))
    each = texts.select("doc_id", "_th", F.size("g.s").alias("_n"), F.posexplode("g.s").alias("_pos", "s"))
    hit = each.join(checked(placed, SMALL), "s").select("doc_id", "_th", "_n", "_pos", F.explode("lengths").alias("length"))
    at = hit.groupBy(F.col("doc_id").alias("_id"), F.col("_th").alias("_h"), "length").agg(F.sort_array(F.collect_set("_pos")).alias("p"), F.first("_n").alias("_n"))
    whole = F.greatest(F.col("length") - SHINGLE + 1, F.lit(1))
    sized = at.select("*", F.least(whole, F.col("_n")).alias("span"), whole.alias("_whole"))
    need = F.floor((4 * (F.col("_whole") + F.col("span")) + 8) / 9).cast("int")
    dense = sized.select("*", need.alias("_need")).filter(F.size("p") >= F.col("_need"))
    p, span = F.col("p"), F.col("span")

    def run(i: Column) -> Column:
        """Starts whose first hit is the i-th and that hold enough of them."""
        lo = F.greatest(F.get(p, i - 1) + 1, F.get(p, i + F.col("_need") - 1) - span + 1, F.lit(0))
        return F.struct(lo.alias("lo"), F.least(F.get(p, i), F.col("_n") - span).alias("hi"))

    runs = F.filter(F.transform(F.sequence(F.lit(0), F.size(p) - F.col("_need")), run), lambda r: r["lo"] <= r["hi"])
    starts = F.flatten(F.transform(runs, lambda r: F.sequence(r["lo"], r["hi"])))
    return materialise(dense.select("_id", "_h", "length", "span", starts.alias("starts")).filter(F.size("starts") > 0), "decon-spots")


def candidates(prints: DataFrame, items: DataFrame) -> DataFrame:
    """Windows (.., length, fp) and items (_k, length, print) -> the windows'
    columns and _k for all pairs of a length within RADIUS bits."""

    def listed(i: int, first: int, bits: int) -> Column:
        value = _block(F.col("print"), first, bits)
        return F.transform(F.lit(near_values(bits)), lambda m: F.struct(F.lit(i).alias("block"), value.bitwiseXOR(m.cast("long")).alias("value")))

    looks = [F.struct(F.lit(i).alias("block"), _block(F.col("fp"), *b).alias("value")) for i, b in enumerate(blocks())]
    every = F.concat(*[listed(i, *b) for i, b in enumerate(blocks())])
    index = items.select("_k", "length", "print", F.explode(every).alias("b")).select("_k", "length", "print", "b.*")
    probe = prints.select("*", F.explode(F.array(*looks)).alias("b")).select(*prints.columns, "b.*")
    within = F.bit_count(F.col("fp").bitwiseXOR(F.col("print"))) <= RADIUS
    return probe.join(index, ["length", "block", "value"]).filter(within).select(*prints.columns, "_k").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, start, length, _th), best window a pair."""
    items = materialise(item_table(benchmark), "decon-items")
    # at most four different lengths
    sizes = [SHINGLE, *sorted(r["length"] for r in items.filter(F.col("length") < SHINGLE).select("length").distinct().collect())]
    where = spots(docs, items, sizes)
    whose = materialise(where.select("_id", "_h").distinct(), "decon-documents")
    texts = docs.select("doc_id", F.xxhash64("text").alias("_th"), "text")
    met = texts.join(checked(whose), texts["doc_id"].eqNullSafe(whose["_id"]) & (texts["_th"] == whose["_h"]), "left_semi")
    met = met.select("doc_id", "_th", shingles(alnum_words(F.col("text")), sizes).alias("_g")).dropDuplicates(["doc_id", "_th"])
    met = materialise(met, "decon-texts")

    def cut(rows: DataFrame) -> DataFrame:
        """rows (.., _id, _h, start, length, span) with their window's shingles."""
        own = F.filter("_g", lambda g: g["gram"] == F.least(F.col("length"), F.lit(SHINGLE)))[0]["s"]
        both = rows.join(shuffled(met), met["doc_id"].eqNullSafe(rows["_id"]) & (met["_th"] == rows["_h"]))
        return both.select(*rows.columns, F.slice(own, F.col("start") + 1, F.col("span")).alias("window"))

    keys = ["_id", "_h", "start", "length", "span"]
    each = where.select("_id", "_h", F.explode("starts").alias("start"), "length", "span")
    seen = materialise(fingerprints(cut(each), keys, "window"), "decon-windows")
    texts_of = items.dropDuplicates(["_k"]).select("_k", "length", "item")
    pairs = candidates(seen, fingerprints(texts_of, ["_k", "length"], "item").withColumnRenamed("fp", "print"))
    full = cut(pairs.drop("fp")).join(items.select("_k", "item_id", "item"), "_k")
    scored = full.withColumn("similarity", similarity(F.col("window"), F.col("item"))).filter(F.col("similarity") >= THRESHOLD)
    best = scored.groupBy("_id", "_h", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("_back"), "length")).alias("best"))
    return best.select(F.col("_id").alias("doc_id"), "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best._back")).alias("start"), F.col("best.length").alias("length"), F.col("_h").alias("_th"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item."""
    bad = materialise(contaminated(docs, benchmark).select(F.col("doc_id").alias("_bad_id"), F.col("_th").alias("_bad_th")).distinct(), "decon-bad")
    same = docs["doc_id"].eqNullSafe(bad["_bad_id"]) & (F.xxhash64(docs["text"]) == bad["_bad_th"])
    return docs.join(checked(bad), same, "left_anti")
