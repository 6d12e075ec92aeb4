"""Mixing sources to target weights by systematic sampling (DataFrame only).

Targets: the sources, in code-point order with null last, weigh 3, 1, 2 in
turn and share ``budget`` times all words; a target stops at ``cap`` times its
source's words and the excess goes to the others by weight.

Sampling: each document of a source expects ``target / source_size`` copies.
Documents are laid out by size (so neighbours are alike and the drawn words
stay near the target), their expected copies are prefix-summed, one random
offset per source is added, and a document is emitted once for each integer
boundary that its stretch crosses.

Scale: the prefix sum never puts a source into one task.  A source is cut into
cells (size class x 256 salts); ranks are taken inside cells and shifted by the
prefix sums of the classes of the source (90 for each number of digits) and of the
cells of the class, whose lengths do not depend on the number of documents.
Repeated rows are one row with a number until the end, so they fill no cell.

Defined results: null text has size 0; a source without words has target 0 and
gives no copies; null source is a source of its own, last in order; rows alike in
all columns are documents of their own, next to each other in the layout, and get
a row each from ``mix``; an empty table gives an empty result; other columns,
whatever their names, are passed through by ``expand`` untouched (an earlier
``copy`` is replaced); ``expand`` numbers the copies of rows alike as one series.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import materialise, shuffled

WEIGHTS = (3.0, 1.0, 2.0)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def source_targets(sized: DataFrame, budget: float, cap: float, weights=WEIGHTS) -> DataFrame:
    """One row a source: words, target.  Water filling in closed form: in order
    of cap / weight, a source is capped while its cap is below its share."""
    per = sized.groupBy("_key").agg(F.sum("size").alias("source_size"), F.first("_null").alias("_null"))
    order = Window.orderBy("_null", "_key")
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    per = per.withColumn("_weight", weight).withColumn("_cap", cap * F.col("source_size"))
    whole = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_weight"), "_null", "_key")
    before, onward = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn("_total", budget * F.sum("source_size").over(whole))
    left = F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    per = per.withColumn("_capped", F.col("_cap") * F.sum("_weight").over(onward) <= left * F.col("_weight"))
    spent = F.sum(F.when(F.col("_capped"), F.col("_cap")).otherwise(0.0)).over(whole)
    open_weight = F.sum(F.when(F.col("_capped"), 0.0).otherwise(F.col("_weight"))).over(whole)
    share = (F.col("_total") - spent) / open_weight * F.col("_weight")
    return per.select("_key", "source_size", F.when(F.col("_capped"), F.col("_cap")).otherwise(share).alias("target"))


def _identity(docs: DataFrame) -> list[Column]:
    """What rows alike in every column have in common: id, hash of the text, hash
    of the row, source key."""
    plain = [docs[f"`{f.name}`"] for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    row = F.xxhash64(*plain, *[c.isNull() for c in plain])
    return [docs["doc_id"], F.xxhash64(docs["text"]), row, _source_key(docs["source"])]


_IDENTITY = ("_id", "_text_hash", "_row_hash", "_key")


def draw(docs: DataFrame, seed: int = 7, budget: float = 1.5, cap: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """(_id, _text_hash, _row_hash, _key, size, source_size, target, rows, at, offset,
    rate), a row for each set of rows alike, whose places in the layout are at + 1 to
    at + rows; place k is emitted floor(offset + rate k) - floor(offset + rate (k - 1)) times."""
    rows = docs.select(*[c.alias(n) for c, n in zip(_identity(docs), _IDENTITY)], word_count(F.col("text")).alias("size"), F.col("source").isNull().alias("_null"))
    sized = materialise(rows.groupBy(*_IDENTITY, "_null", "size").agg(F.count(F.lit(1)).alias("rows")), "mix-sizes")
    targets = source_targets(sized.select("_key", "_null", (F.col("size") * F.col("rows")).alias("size")), budget, cap, weights)
    digits = F.col("size").cast("string")
    cells = sized.select(
        "*", F.length(digits).alias("_length"), F.substring(digits, 1, 2).alias("_lead"),
        F.substring(F.md5(F.coalesce(F.col("_id").cast("string"), F.concat_ws(",", "_text_hash", "_row_hash")).cast("binary")), 1, 2).alias("_salt"),
    )
    cell = ["_key", "_length", "_lead", "_salt"]
    before = Window.unboundedPreceding, -1
    # where a class of a source begins, and where a cell begins in its class
    classes = cells.groupBy(*cell[:-1]).agg(F.sum("rows").alias("_n"))
    upto = Window.partitionBy("_key").orderBy("_length", "_lead").rowsBetween(*before)
    classes = classes.select(*cell[:-1], F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_first")).join(targets, "_key")
    salted = Window.partitionBy(*cell[:-1]).orderBy("_salt").rowsBetween(*before)
    starts = cells.groupBy(*cell).agg(F.sum("rows").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(salted), F.lit(0)))
    starts = starts.join(classes, cell[:-1]).withColumn("_start", F.col("_first") + F.col("_before")).drop("_n", "_first", "_before")
    inside = Window.partitionBy(*cell).orderBy("size", "_id", "_text_hash", "_row_hash").rowsBetween(*before)
    ranked = cells.withColumn("_rank", F.coalesce(F.sum("rows").over(inside), F.lit(0))).join(starts, cell)
    offset = F.conv(F.substring(F.md5(F.concat(F.col("_key"), F.lit(f"#{seed}")).cast("binary")), 1, 6), 16, 10).cast("double") / 16777216.0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return ranked.select(*_IDENTITY, "size", "source_size", "target", "rows", (F.col("_start") + F.col("_rank")).alias("at"), offset.alias("offset"), rate.alias("rate"))


def _emitted(first: Column, last: Column) -> Column:
    """Copies of the places from first + 1 to last: boundaries crossed."""
    return (F.floor(F.col("offset") + F.col("rate") * last) - F.floor(F.col("offset") + F.col("rate") * first)).cast("long")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The digest of the mix, a row a document: doc_id, size, source_size, target,
    taken, copies."""
    each = draw(docs, **options).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("_j"))
    place = F.col("at") + F.col("_j")
    drawn = each.select(F.col("_id").alias("doc_id"), "size", "source_size", "target", _emitted(place - 1, place).alias("copies"))
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def expand(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every document once for each of its copies, with its
    own columns and ``copy`` (1, 2; rows alike share one series)."""
    docs = docs.drop("copy")
    drawn = draw(docs, **options)
    copies = _emitted(F.col("at"), F.col("at") + F.col("rows"))
    twin = materialise(drawn.select(*_IDENTITY, "rows", copies.alias("_copies")).filter("_copies > 0"), "mix-drawn")

    def alike(rows: DataFrame, marks: DataFrame) -> Column:
        id_, *others = _identity(rows)
        return reduce(lambda p, q: p & q, [id_.eqNullSafe(marks["_id"]), *[c == marks[n] for c, n in zip(others, _IDENTITY[1:])]])

    def copied(rows: DataFrame, marks: DataFrame) -> DataFrame:
        own = [rows[f"`{c}`"] for c in rows.columns]
        return rows.join(shuffled(marks), alike(rows, marks)).select(*own, F.explode(F.sequence(F.lit(1), marks["_copies"].cast("int"))).alias("copy"))

    once, more = twin.filter("rows = 1"), twin.filter("rows > 1")
    out = copied(docs, once)
    if more.isEmpty():
        return out
    # only sets of rows alike move once more, to become one row each
    marks = materialise(more, "mix-alike")
    found = docs.join(shuffled(marks), alike(docs, marks), "left_semi")
    whole = F.struct(*[found[f"`{c}`"] for c in found.columns])
    first = found.groupBy(*[c.alias(n) for c, n in zip(_identity(found), _IDENTITY)]).agg(F.first(whole).alias("_first")).select("_first.*")
    return out.unionByName(copied(first, more))
