"""Hybrid search: BM25 over four text columns, cosine over vectors, notes, and
their fusion by reciprocal rank.

A stored keyword index has one row for each term of each row, with its places, in
files that each cover some rows of the corpus and are sorted by term, so a search
reads the pages of its own terms, and postings are written once, where their rows
were read, without a shuffle.  Without an
index the corpus is read once: each row is reduced to its length and the
frequencies of the asked phrases.  Either way a narrow table of frequencies is
written, from which both the statistics and the scores come.  Every list is cut
to its pool before it is numbered, so no window sees more than 250 rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.functions.ranking import top
from quillgraph.functions.storage import written

K1, B, RRF = 1.2, 0.75, 60.0
INDEXED = ("display_name", "fully_qualified_name", "search_text", "relative_path")


def pool_size(limit: int) -> int:
    return min(max(limit * 20, 50), 250)


def _times(terms: Column, phrase: list[str]) -> Column:
    """Occurrences of a phrase whose last term is a prefix."""
    if len(phrase) == 1:
        return F.size(F.filter(terms, lambda t: t.startswith(phrase[0])))
    n = len(phrase)
    at = F.when(F.size(terms) >= n, F.sequence(F.lit(0), F.size(terms) - n)).otherwise(F.array().cast("array<int>"))

    def here(i: Column) -> Column:
        head = [F.get(terms, i + k) == t for k, t in enumerate(phrase[:-1])]
        return reduce(lambda a, b: a & b, head, F.get(terms, i + n - 1).startswith(phrase[-1]))

    return F.size(F.filter(at, here))


@dataclass
class KeywordIndex:
    """postings: (term, id, canonical_id, size, places); rows and mean size of all."""

    postings: DataFrame
    rows: int
    mean: float


def _bags(corpus: DataFrame, columns) -> tuple[DataFrame, Column]:
    bags = corpus.select("id", "canonical_id", *[X.index_terms(F.col(c)).alias(f"_t{i}") for i, c in enumerate(columns)])
    return bags, reduce(lambda a, b: a + b, [F.size(f"_t{i}") for i in range(len(columns))])


#: Postings that a task holds before it passes them on.
POSTINGS = 100_000


def _placed(batches: Iterator) -> Iterator:
    """Rows (id, canonical_id, size, _terms) -> a posting for each term of each row,
    with its places.  Empty terms are none."""
    import pyarrow as pa

    held: list[tuple[str, int, list[int]]] = []
    for batch in batches:
        own = [batch.column(c) for c in ("id", "canonical_id", "size")]

        def passed():
            at = pa.array([i for _, i, _ in held], pa.int32())
            columns = [pa.array([t for t, _, _ in held], pa.string()), *[c.take(at) for c in own], pa.array([p for _, _, p in held], pa.list_(pa.int32()))]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["term", "id", "canonical_id", "size", "places"])

        for i, terms in enumerate(batch.column("_terms")):
            places: dict[str, list[int]] = {}
            for at, term in enumerate(terms.as_py() or ()):
                if term:
                    places.setdefault(term, []).append(at)
            held.extend((term, i, at) for term, at in places.items())
            if len(held) >= POSTINGS:
                yield passed()
        if held:
            yield passed()


def _postings(corpus: DataFrame, columns) -> DataFrame:
    """(term, id, canonical_id, size, places), without a shuffle."""
    bags, size = _bags(corpus, columns)
    # an empty term between columns keeps phrases from running over
    parts = [F.col("_t0")] + [x for i in range(1, len(columns)) for x in (F.array(F.lit("")), F.col(f"_t{i}"))]
    # a row's places are gathered inside the row, so only finished postings move
    rows = bags.select("id", "canonical_id", size.alias("size"), F.concat(*parts).alias("_terms"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(_placed, f"term string, id {kinds['id']}, canonical_id {kinds['canonical_id']}, size {kinds['size']}, places array<int>")


def _write_postings(corpus: DataFrame, path: str, columns) -> None:
    _postings(corpus, columns).sortWithinPartitions("term", "id").write.parquet(f"{path}/postings")


def _write_rows(corpus: DataFrame, path: str, columns) -> DataFrame:
    """What is indexed: a row's size in terms and a hash of what is read of it."""
    size = reduce(lambda a, b: a + b, [F.size(X.index_terms(F.col(c))) for c in columns])
    mark = F.xxhash64("canonical_id", *columns, *[F.col(c).isNull() for c in columns])
    corpus.select("id", "canonical_id", size.alias("size"), mark.alias("mark")).write.parquet(f"{path}/rows")
    rows = corpus.sparkSession.read.parquet(f"{path}/rows")
    rows.agg(F.count(F.lit(1)).alias("rows"), F.avg("size").alias("mean")).write.parquet(f"{path}/statistics")
    return rows


def write_index(corpus: DataFrame, path: str, columns=INDEXED) -> None:
    """Store the keyword index of a corpus in new folders below ``path``."""
    _write_postings(corpus, path, columns)
    _write_rows(corpus, path, columns)


#: Indexes laid over each other before one is made anew, and the share of rows
#: that may differ.
LAYERS, CHANGED = 8, 0.2


def write_changes(corpus: DataFrame, path: str, below: list[str], columns=INDEXED) -> list[str]:
    """Store below ``path`` what differs between a corpus and the index whose
    folders, oldest first, are ``below``: postings of new and changed rows, and the
    ids whose older postings are void.  Gives the folders to open; where much
    differs, or there are many layers, the whole index is made anew."""
    spark = corpus.sparkSession
    rows = _write_rows(corpus, path, columns)
    before = spark.read.parquet(f"{below[-1]}/rows").select("id", F.col("mark").alias("_before"))
    differs = rows.join(before, "id", "full").filter(~F.col("mark").eqNullSafe(F.col("_before"))).select("id", F.col("_before").isNotNull().alias("void"), F.col("mark").isNotNull().alias("fresh"))
    differs.write.parquet(f"{path}/changes")
    differs = spark.read.parquet(f"{path}/changes")
    if len(below) >= LAYERS or differs.count() > CHANGED * rows.count():
        _write_postings(corpus, path, columns)
        return [path]
    _write_postings(corpus.join(differs.filter("fresh").select("id"), "id", "left_semi"), path, columns)
    return [*below, path]


def open_index(spark: SparkSession, path: str | list[str]) -> KeywordIndex:
    """The index of a folder, or of folders laid over each other: the postings of
    a row count in the last layer that has changed it."""
    layers = [path] if isinstance(path, str) else path
    seen = spark.read.parquet(f"{layers[-1]}/statistics").first()
    postings = [spark.read.parquet(f"{layer}/postings").withColumn("_layer", F.lit(k)) for k, layer in enumerate(layers)]
    held = reduce(DataFrame.unionByName, postings)
    if len(layers) > 1:
        voids = [spark.read.parquet(f"{layer}/changes").filter("void").select(F.col("id").alias("_void"), F.lit(k).alias("_from")) for k, layer in enumerate(layers) if k]
        void = reduce(DataFrame.unionByName, voids).groupBy("_void").agg(F.max("_from").alias("_from"))
        held = held.join(void, (F.col("id") == F.col("_void")) & (F.col("_layer") < F.col("_from")), "left_anti")
    return KeywordIndex(held.drop("_layer"), seen["rows"], seen["mean"] or 1.0)


def _looked_up(index: KeywordIndex, phrases: list[list[str]]) -> DataFrame:
    """(id, canonical_id, size, f0..) of the rows that hold any phrase."""
    found: DataFrame | None = None
    own = ["id", "canonical_id", "size"]
    for k, phrase in enumerate(phrases):
        starts: DataFrame | None = None
        for j, term in enumerate(phrase):
            of = F.col("term").startswith(term) if j == len(phrase) - 1 else F.col("term") == term
            at = index.postings.filter(of).select(*own, F.explode("places").alias("_at")).select(*own, (F.col("_at") - j).alias("_at"))
            starts = at if starts is None else starts.join(at.select("id", "canonical_id", "_at"), ["id", "canonical_id", "_at"], "left_semi")
        hits = starts.groupBy(*own).agg(F.count(F.lit(1)).alias("f")).withColumn("k", F.lit(k))
        found = hits if found is None else found.unionByName(hits)
    return found.groupBy(*own).agg(*[F.coalesce(F.sum(F.when(F.col("k") == k, F.col("f"))), F.lit(0)).alias(f"f{k}") for k in range(len(phrases))])


def keyword_scores(corpus: DataFrame, text: str, columns=INDEXED, index: KeywordIndex | None = None) -> DataFrame:
    """(id, canonical_id, score): BM25 as a positive number, matching rows only.
    With the index of the corpus the corpus itself is not read."""
    phrases = X.match_phrases(text)
    if not phrases:
        return corpus.select("id", "canonical_id", F.lit(0.0).alias("score")).limit(0)
    if index is not None:
        narrow = written(_looked_up(index, phrases), "bm25")
        seen = narrow.agg(*[F.count(F.when(F.col(f"f{k}") > 0, 1)).alias(f"n{k}") for k in range(len(phrases))]).first().asDict() | {"n": index.rows, "mean": index.mean}
        return _scored(narrow, seen, len(phrases))
    bags, size = _bags(corpus, columns)
    hits = [reduce(lambda a, b: a + b, [_times(F.col(f"_t{i}"), p) for i in range(len(columns))]).alias(f"f{k}") for k, p in enumerate(phrases)]
    narrow = written(bags.select("id", "canonical_id", size.alias("size"), *hits), "bm25")
    seen = narrow.agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean"), *[F.count(F.when(F.col(f"f{k}") > 0, 1)).alias(f"n{k}") for k in range(len(phrases))]).first()
    return _scored(narrow, seen.asDict(), len(phrases))


def _scored(narrow: DataFrame, seen: dict, phrases: int) -> DataFrame:
    mean = seen["mean"] or 1.0
    score = F.lit(0.0)
    for k in range(phrases):
        n = seen[f"n{k}"]
        idf = log((seen["n"] - n + 0.5) / (n + 0.5)) if n < seen["n"] + 0.5 else 0.0
        f = F.col(f"f{k}").cast("double")
        score = score + F.lit(max(idf, 1e-6)) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("size") / mean))
    some = reduce(lambda a, b: a | b, [F.col(f"f{k}") > 0 for k in range(phrases)])
    return narrow.filter(some).select("id", "canonical_id", score.alias("score"))


def keyword_ranks(corpus: DataFrame, text: str, pool: int, columns=INDEXED, index: KeywordIndex | None = None) -> DataFrame:
    return top(keyword_scores(corpus, text, columns, index), [F.desc("score"), F.asc("canonical_id")], pool, "rank")


def vector_scores(corpus: DataFrame, query: list[float]) -> DataFrame:
    """(id, canonical_id, similarity) of every row that has a vector."""
    asked = F.array(*[F.lit(float(v)) for v in query])
    present = corpus.filter(F.col("vector_embedding").isNotNull())
    return present.select("id", "canonical_id", X.cosine(F.col("vector_embedding"), asked).alias("similarity"))


def vector_ranks(corpus: DataFrame, query: list[float], pool: int) -> DataFrame:
    return top(vector_scores(corpus, query), [F.desc("similarity"), F.asc("canonical_id")], pool, "rank")


def memory_scores(memories: DataFrame, text: str) -> DataFrame:
    """Notes (memory_id, id, canonical_id, content, owner, tags): 12 if the
    content holds the text, 8 if the owner's name does, 10 if a tag does."""
    needle = F.lit(text.strip().strip('"').lower())

    def holds(c: Column) -> Column:
        return F.instr(X.ascii_fold(c), needle) > 0

    score = F.when(holds(F.col("content")), 12).otherwise(0) + F.when(holds(F.col("owner")), 8).otherwise(0) + F.when(F.exists("tags", holds), 10).otherwise(0)
    return memories.select("memory_id", "id", "canonical_id", score.cast("long").alias("score")).filter("score > 0")


def memory_ranks(memories: DataFrame, text: str, pool: int) -> DataFrame:
    return top(memory_scores(memories, text), [F.desc("score"), F.asc("canonical_id"), F.asc("memory_id")], pool, "rank")


def memory_vector_ranks(memories: DataFrame, query: list[float], pool: int) -> DataFrame:
    asked = F.array(*[F.lit(float(v)) for v in query])
    near = memories.filter(F.col("vector_embedding").isNotNull()).select("memory_id", "id", "canonical_id", X.cosine(F.col("vector_embedding"), asked).alias("similarity"))
    return top(near, [F.desc("similarity"), F.asc("canonical_id"), F.asc("memory_id")], pool, "rank")


def tagged(memories: DataFrame, tags) -> DataFrame:
    """Notes with any of the tags, letter case aside."""
    wanted = F.array(*[F.lit(t.strip().lower()) for t in tags])
    return memories.filter(F.arrays_overlap(F.transform("tags", lambda t: F.lower(t)), wanted))


def fuse(ranked: list[DataFrame], limit: int) -> DataFrame:
    """(id, canonical_id, score, rank): sum of 1 / (60 + rank) over all lists; an
    owner with several notes in one list counts each."""
    both = reduce(lambda a, b: a.unionByName(b), [r.select("id", "canonical_id", "rank") for r in ranked])
    summed = both.groupBy("id", "canonical_id").agg(F.sum(F.lit(1.0) / (F.lit(RRF) + F.col("rank"))).alias("score"))
    return top(summed.withColumn("_s", F.round("score", 12)), [F.desc("_s"), F.asc("canonical_id")], limit, "rank").drop("_s")


def hybrid(corpus: DataFrame, text: str, query: list[float] | None, limit: int = 10, project_id: int | None = None, node_types=None, memories: DataFrame | None = None, tags=None, index: KeywordIndex | None = None) -> DataFrame:
    """(rank, id, canonical_id, score).  Filters apply before every cut."""
    if not text or not text.strip():
        raise ValueError("search text is blank")
    none = corpus.select("id", "canonical_id", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("rank")).limit(0)
    if limit <= 0 or not X.match_phrases(text):
        return none
    pool = pool_size(limit)

    def asked(df: DataFrame) -> DataFrame:
        if project_id is not None:
            df = df.filter(F.col("project_node_id") == project_id)
        return df.filter(F.col("node_type").isin(*node_types)) if node_types else df

    # collection statistics cover the whole corpus, candidates only what is asked
    keyword = keyword_scores(corpus, text, index=index)
    if project_id is not None or node_types:
        keyword = keyword.join(asked(corpus).select("id"), "id", "left_semi")
    lists = [top(keyword, [F.desc("score"), F.asc("canonical_id")], pool, "rank")]
    if query is not None:
        lists.append(vector_ranks(asked(corpus), query, pool))
    if memories is not None:
        notes = asked(memories)
        notes = tagged(notes, tags) if tags else notes
        lists.append(memory_ranks(notes, text, pool))
        if query is not None:
            lists.append(memory_vector_ranks(notes, query, pool))
    return fuse(lists, limit)
