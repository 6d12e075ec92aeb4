"""SimHash near-dedup with pivot distance tables.

Fingerprint: bit i is set if more than half of the XXH64 hashes (seed 42) of
the 4-word shingles, repeats included, have it.  Texts link at 4 or fewer
differing bits; the answer is the connected component of each document.

Steps, all on distinct fingerprints:

1. Pivot table: each fingerprint's Hamming distances to ``PIVOTS`` reference
   fingerprints, in parts (the distance over each of seven groups of bits) and in
   total.
2. Candidates: four differing bits leave three of the seven parts untouched, so
   two linked fingerprints have equal part distances to every reference in one
   of the 35 triples of parts.  The table is joined with itself on those
   distances; nothing else brings a pair together.
3. Discard: by the triangle inequality a pair goes if its total distances to any
   reference differ by more than the radius.
4. Survivors are verified bit by bit.

Random 64-bit fingerprints lie 32 +- 4 bits from any reference, so a total
distance keeps over half of all pairs, whereas equal distances over three parts
keep one in 2^27.  Inside a group of equal distances, fingerprints within the
radius of the group's least one hang on it like a star, and only pairs that no
star connects are paired, so a large group of near copies gives about as many
links as members.  A group of more than ``CROWD`` is not paired but dealt again by
distances over other parts (``LEVELS``), so a fingerprint is compared with at most
``CROWD`` others in a group, but at the last level.

Scale: copies collapse before anything is paired; the shuffle is 35 rows of 16
bytes for each distinct fingerprint; the hot fingerprint of a large group of
copies is one row, and the join that carries components back to documents reads
written tables, which adaptive execution splits.

Defined results: text that is null or has no word has fingerprint zero and
links like any other; fewer than four words: one shingle of all of them; rows
with a null id have a fingerprint and take part in linking only through rows
with an id (their component_id is the least id reachable, null if none);
repeated rows return once each; other columns are ignored by ``clusters`` and
passed through by ``keep_one``.  ``keep_one`` groups by the component's own key
(``_group``, its least fingerprint), never by an id, which may be null or repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import materialise, shuffled
from quillgraph.llm.components import components

RADIUS = 4
PIVOTS = 10
#: Parts of the word and how many of them agree in a key.  Four differing bits
#: leave n - 4 of n parts untouched; 10 references tell all values of a part of 10 bits.
LEVELS = (
    ([((1 << size) - 1) << first for first, size in ((0, 10), (10, 9), (19, 9), (28, 9), (37, 9), (46, 9), (55, 9))], 3),
    ([sum(1 << i for i in range(k, 64, 6)) for k in range(6)], 2),
    ([sum(1 << i for i in range(64) if i // 4 % 6 == k) for k in range(6)], 2),
)
#: Fingerprints of a group up to which they are compared with each other.
CROWD = 2_000
#: Shingles whose bits are counted at once; bounds a task's memory at 64 bytes each.
CHUNK = 200_000


def _fingerprints(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa
    from xxhash import xxh64_intdigest

    def bits_of(hashes: list[int], sizes: list[int]):
        rows = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        starts = np.cumsum([0, *sizes[:-1]])
        return np.add.reduceat(rows, starts, axis=0, dtype=np.int32)

    for batch in batches:
        out = np.zeros(batch.num_rows, dtype="<u8")
        hashes: list[int] = []
        sizes: list[int] = []
        whose: list[int] = []

        def settle():
            if whose:
                over = bits_of(hashes, sizes) * 2 > np.array(sizes)[:, None]
                out[whose] = np.packbits(over, axis=1, bitorder="little").view("<u8")[:, 0]
                hashes.clear(), sizes.clear(), whose.clear()

        for i, text in enumerate(batch.column("_text")):
            w = (text.as_py() or b"").lower().split()
            if not w:
                continue
            if len(w) < 4:
                found = [xxh64_intdigest(b" ".join(w), 42)]
            elif len(w) > CHUNK:  # a very long text is counted piece by piece
                settle()
                total, n = np.zeros(64, dtype=np.int64), len(w) - 3
                for lo in range(0, n, CHUNK):
                    part = [xxh64_intdigest(b" ".join(w[j : j + 4]), 42) for j in range(lo, min(n, lo + CHUNK))]
                    total += bits_of(part, [len(part)])[0]
                out[i] = np.packbits(total * 2 > n, bitorder="little").view("<u8")[0]
                continue
            else:
                found = [xxh64_intdigest(b" ".join(s), 42) for s in zip(w, w[1:], w[2:], w[3:])]
            hashes += found
            sizes.append(len(found))
            whose.append(i)
            if len(hashes) >= CHUNK:
                settle()
        settle()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_th"), pa.array(out.view("<i8"))], names=["doc_id", "_th", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, _th, fp): the fingerprint as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("_th"), F.col("text").cast("binary").alias("_text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, _th long, fp long")


def pivots(n: int = PIVOTS) -> list[int]:
    """Fixed reference fingerprints: the SplitMix64 sequence from seed 1."""
    out, state = [], 1
    for _ in range(n):
        state = (state + 0x9E3779B97F4A7C15) % (1 << 64)
        z = state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) % (1 << 64)
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) % (1 << 64)
        z ^= z >> 31
        out.append(z - (1 << 64) if z >= 1 << 63 else z)
    return out


def _distance(x: Column, y: Column) -> Column:
    return F.bit_count(x.bitwiseXOR(y))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _part(fp: Column, mask: int) -> Column:
    """Distances to all references over the bits of a mask, four bits each."""
    return reduce(
        lambda x, y: x.bitwiseOR(y),
        [F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(p)).bitwiseAND(F.lit(_signed(mask)))).cast("long"), 4 * i) for i, p in enumerate(pivots())],
    )


def _keyed(rows: DataFrame, masks: list[int], free: int) -> DataFrame:
    """(fp, tied, key): a key for each choice of ``free`` parts, from the key that
    a row has and all distances over those parts."""
    parts = rows.select("fp", "tied", "key", *[_part(F.col("fp"), m).alias(f"c{j}") for j, m in enumerate(masks)])
    chosen = [F.xxhash64("key", F.lit(i), *[f"c{j}" for j in js]) for i, js in enumerate(combinations(range(len(masks)), free))]
    return parts.select("fp", "tied", F.explode(F.array(*chosen)).alias("key"))


def _totals(fp: Column) -> list[Column]:
    return [F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("byte").alias(f"p{i}") for i, p in enumerate(pivots())]


def _pairs(table: DataFrame) -> DataFrame:
    """Pairs with equal keys: (a.*, b.*), a < b, discarded by total distances."""
    a, b = table.alias("a"), table.alias("b")
    alike = reduce(lambda p, q: p & q, [F.abs(F.col(f"a.p{i}") - F.col(f"b.p{i}")) <= RADIUS for i in range(PIVOTS)])
    met = (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & (F.col("a.tied").bitwiseAND(F.col("b.tied")) == 0)
    return a.join(b, met & alike)


def _level(rows: DataFrame, level: int) -> DataFrame:
    """(fp, key, hub, n, tied, p0..) of every group of two or more."""
    masks, free = LEVELS[level]
    spread = _keyed(rows, masks, free)
    groups = spread.groupBy("key").agg(F.min("fp").alias("hub"), F.max("fp").alias("_far"), F.count(F.lit(1)).alias("n")).filter("hub <> _far").select("key", "hub", "n")
    near = _distance(F.col("fp"), F.col("hub")) <= RADIUS
    tied = F.col("tied").bitwiseOR(F.when(near, F.lit(1 << level)).otherwise(F.lit(0)))
    shared = spread.join(shuffled(groups), "key").select("fp", "key", "hub", "n", tied.cast("int").alias("tied"), *_totals(F.col("fp")))
    return materialise(shared, "simhash-pivots")


def links(prints: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) -> links (x, y) that connect exactly what all
    pairs within ``RADIUS`` differing bits connect."""
    rows, found = prints.select("fp", F.lit(0).alias("tied"), F.lit(0).cast("long").alias("key")), []
    for level in range(len(LEVELS)):
        table = _level(rows, level)
        found.append(table.filter((F.col("tied").bitwiseAND(1 << level) != 0) & (F.col("fp") != F.col("hub"))).select(F.col("hub").alias("x"), F.col("fp").alias("y")))
        crowded = F.col("n") > CROWD
        last = level == len(LEVELS) - 1
        few = table.filter(F.col("fp") != F.col("hub")) if last else table.filter((F.col("fp") != F.col("hub")) & ~crowded)
        found.append(_pairs(few).filter(_distance(F.col("a.fp"), F.col("b.fp")) <= RADIUS).select(F.col("a.fp").alias("x"), F.col("b.fp").alias("y")))
        rows = table.filter(crowded).select("fp", "tied", "key")
        if last or rows.isEmpty():
            break
    return reduce(DataFrame.unionByName, found).distinct()


def clusters(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id, _th): one row for each row of docs."""
    return _grouped(docs).drop("_group")


def _grouped(docs: DataFrame) -> DataFrame:
    """``clusters`` with _group, the least fingerprint of the component."""
    rows = materialise(fingerprints(docs), "simhash-rows")
    prints = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-prints")
    found = materialise(links(prints), "simhash-links")
    # number the linked fingerprints by a signed order, so that components need only longs
    linked = components(found.select(F.col("x").alias("a"), F.col("y").alias("b")))
    with_least = linked.join(shuffled(prints), linked["id"] == prints["fp"])
    group = with_least.groupBy("component").agg(F.min("least").alias("component_id"))
    renamed = with_least.join(shuffled(group), "component").select("fp", F.col("component_id").alias("_joined"), F.col("component").alias("_linked"))
    owner = materialise(prints.join(shuffled(renamed), "fp", "left").select("fp", F.coalesce("_joined", "least").alias("component_id"), F.coalesce("_linked", "fp").alias("_group")), "simhash-owner")
    out = rows.join(shuffled(owner), "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "_th", "_group")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component: its least id; where rows repeat that id,
    the least text hash, and one row of it."""
    found = _grouped(docs)
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_th")
    rows = found.groupBy("_group", "doc_id", "_th").agg(F.count(F.lit(1)).alias("_rows"))
    best = rows.groupBy("_group").agg(F.min(place).alias("_best"), F.min_by("_rows", place).alias("_rows"))
    best = materialise(best.select(F.col("_best.doc_id").alias("_keep_id"), F.col("_best._th").alias("_keep_th"), "_rows"), "simhash-keep")
    same = docs["doc_id"].eqNullSafe(best["_keep_id"]) & (F.xxhash64(docs["text"]) == best["_keep_th"])
    kept = docs.join(shuffled(best), same, "left_semi")
    # texts move once more only where a kept row is repeated as it is
    if best.filter("_rows > 1").isEmpty():
        return kept
    return kept.withColumn("_text_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "_text_hash"]).drop("_text_hash")
