"""Ranked lexical search, a document at a time over sharded postings.

``index`` makes shards of at most ``SHARD`` documents, each from one task's own
rows: the shard's documents are put in order of doc_id, and every wanted term
gets a posting list of delta and variable-byte coded document ordinals and
counts.  ``search`` adds the shards' figures up (documents, terms, documents of a
term), and in each shard merges the lists of an item's terms with a heap, one
document at a time, into a bounded heap keyed by score, then doc_id.  The shards'
best lists are merged by one ranking per item.

A list whose greatest contribution, with those of all lists below it, cannot lift
a document over the worst kept result no longer drives the merge; it is only
asked for documents that other lists bring up.  Kept results are the same.

Scores are whole numbers: a term of weight w = floor(1000 ln((2 N + 2) / (2 df +
1))) that occurs tf times in a document of length factor m = 100 - 25 + 25 n N
div L adds w * (10^9 tf div (1000 tf + 12 m)).

Scale: texts are read once and never shuffled; postings of the items' terms are
(a shard's lists go to one task, which is bounded by SHARD).  Items are the query
set: they are taken in blocks of ``ITEMS``, each one pass over the documents, and
go with the tasks.  What meets for one item is ``k`` rows a shard, and Spark cuts
that to ``k`` a task before it moves.

Defined results: null and empty texts have no terms; a document of equal score
comes after one with a lower doc_id, null ids last; repeated rows are documents of
their own, each in the list; items equal in id and text are one item; an item
without terms, or none of whose terms occur, has no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from heapq import heapify, heappop, heappush, heapreplace
from itertools import repeat

from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.ranking import global_rank
from quillgraph.llm.common import materialise

SHARD = 16_384
ITEMS = 1_000
INDEX = "shard long, term int, n long, total long, base long, nulls int, data binary, counts binary"
DOCUMENTS = -1  # the term of a shard's row of documents

#: A-Z to a-z, everything ASCII that is no letter or digit to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def pack(values) -> bytes:
    """Whole numbers from 0 on, seven bits a byte, the last byte's high bit clear."""
    import numpy as np

    values = np.asarray(values, dtype=np.uint64)
    sizes = np.ones(len(values), dtype=np.int64)
    for k in range(1, 10):
        sizes += values >= np.uint64(1 << 7 * k)
    out = np.zeros(int(sizes.sum()), dtype=np.uint8)
    first = np.cumsum(sizes) - sizes
    for k in range(int(sizes.max(initial=0))):
        own = sizes > k
        part = (values[own] >> np.uint64(7 * k)) & np.uint64(127)
        out[first[own] + k] = part + np.uint64(128) * (sizes[own] > k + 1)
    return out.tobytes()


def unpack(data: bytes):
    import numpy as np

    raw = np.frombuffer(data, dtype=np.uint8)
    ends = np.flatnonzero(raw < 128)
    first = np.append(0, ends[:-1] + 1) if len(ends) else ends
    out, sizes = np.zeros(len(ends), dtype=np.uint64), ends - first + 1
    for k in range(int(sizes.max(initial=0))):
        own = sizes > k
        out[own] |= (raw[first[own] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return out.astype(np.int64)


class Shard:
    """Documents of a task on their way into one shard of the index."""

    def __init__(self, wanted: dict[bytes, int]):
        self.wanted = wanted
        self.ids: list[int | None] = []
        self.lengths, self.of, self.counts, self.terms = array("q"), array("q"), array("q"), array("q")

    def add(self, doc_id: int | None, text: bytes) -> None:
        import numpy as np

        split = terms(text)
        if not split:
            return
        held = np.fromiter(map(self.wanted.get, split, repeat(-1)), dtype=np.int64, count=len(split))
        found, counts = np.unique(held[held >= 0], return_counts=True)
        self.terms.frombytes(found.tobytes())
        self.counts.frombytes(counts.astype(np.int64).tobytes())
        self.of.frombytes(np.full(len(found), len(self.ids)).tobytes())
        self.ids.append(doc_id)
        self.lengths.append(len(split))

    def rows(self, shard: int) -> list[tuple]:
        """A row of documents (ids as steps from ``base``, lengths), and one for
        each term (ordinals as steps, counts)."""
        import numpy as np

        order = sorted(range(len(self.ids)), key=lambda k: (self.ids[k] is None, self.ids[k] or 0))
        known = [self.ids[k] for k in order if self.ids[k] is not None]
        lengths = np.frombuffer(self.lengths, dtype=np.int64)[order]
        steps = np.diff(np.array(known, dtype=np.int64)).astype(np.uint64)
        out = [(shard, DOCUMENTS, len(order), int(lengths.sum()), known[0] if known else 0, len(order) - len(known), pack(steps), pack(lengths))]
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        term, of, counts = (np.frombuffer(x, dtype=np.int64) for x in (self.terms, self.of, self.counts))
        of = place[of]
        by = np.lexsort((of, term))
        term, of, counts = term[by], of[by], counts[by]
        first = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else []
        for lo, hi in zip(first, np.append(first[1:], len(term))):
            out.append((shard, int(term[lo]), int(hi - lo), None, None, None, pack(np.diff(of[lo:hi], prepend=0)), pack(counts[lo:hi])))
        return out


def index(docs: DataFrame, wanted: dict[bytes, int], shard: int = SHARD) -> DataFrame:
    """Shards of postings of the wanted terms (term -> number), of INDEX type."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        names = ["shard", "term", "n", "total", "base", "nulls", "data", "counts"]
        task = TaskContext.get().partitionId() << 32
        made, now = 0, Shard(wanted)

        def batch(rows: list[tuple]):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for texts in batches:
            for doc_id, text in zip(texts.column("doc_id").to_pylist(), texts.column("_text")):
                now.add(doc_id, text.as_py() or b"")
                if len(now.ids) == shard:
                    yield batch(now.rows(task + made))
                    made, now = made + 1, Shard(wanted)
        if now.ids:
            yield batch(now.rows(task + made))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("_text")).mapInArrow(run, INDEX)


def best(lists: list[tuple[array, array, int]], k: int) -> list[tuple[int, int]]:
    """The ``k`` documents of greatest sum above 0, as (sum, -document).  lists:
    (documents in order, what each adds, the greatest of it)."""
    lists = sorted((x for x in lists if x[2] > 0), key=lambda x: x[2])
    limits, total = [], 0
    for x in lists:
        total += x[2]
        limits.append(total)
    heads = [(docs[0], j, 0) for j, (docs, _, _) in enumerate(lists)]
    heapify(heads)
    kept: list[tuple[int, int]] = []
    drives, worst = 0, 0  # lists from ``drives`` on bring documents up
    cursors = [0] * len(lists)
    while heads:
        doc, score = heads[0][0], 0
        while heads and heads[0][0] == doc:
            _, j, at = heads[0]
            docs, adds, _ = lists[j]
            if j < drives:
                cursors[j] = at
                heappop(heads)
                continue
            score += adds[at]
            at += 1
            if at < len(docs):
                heapreplace(heads, (docs[at], j, at))
            else:
                heappop(heads)
        j = drives - 1
        while j >= 0 and score + limits[j] > worst:
            docs, adds, _ = lists[j]
            at = cursors[j] = bisect_left(docs, doc, cursors[j])
            if at < len(docs) and docs[at] == doc:
                score += adds[at]
            j -= 1
        if score > worst:
            if len(kept) < k:
                heappush(kept, (score, -doc))
            else:
                heapreplace(kept, (score, -doc))
            if len(kept) == k:
                worst = kept[0][0]
                while drives < len(lists) and limits[drives] <= worst:
                    drives += 1
                if drives == len(lists):
                    break
    return kept


def search_shard(rows: list[dict], queries: list[tuple[int | None, int, dict[int, int]]], weights: dict[int, int], documents: int, total: int, k: int) -> list[tuple]:
    """(item_id, item number, doc_id, score) of a shard's best documents.  queries:
    (item_id, item number, term -> how often)."""
    import numpy as np

    head = next(r for r in rows if r["term"] == DOCUMENTS)
    ids = (np.cumsum(np.append(np.int64(head["base"]), unpack(head["data"]))).tolist() if head["n"] > head["nulls"] else []) + [None] * head["nulls"]
    factor = 12 * (75 + 25 * unpack(head["counts"]) * documents // total)
    lists = {}
    for r in rows:
        if r["term"] != DOCUMENTS:
            docs, tf = np.cumsum(unpack(r["data"])), unpack(r["counts"])
            adds = weights[r["term"]] * (1_000_000_000 * tf // (1000 * tf + factor[docs]))
            lists[r["term"]] = (array("q", docs.tobytes()), array("q", adds.tobytes()), int(adds.max()))
    out = []
    for item_id, number, wanted in queries:
        own = [(docs, adds if n == 1 else array("q", [n * x for x in adds]), n * most) for t, n in wanted.items() if t in lists for docs, adds, most in (lists[t],)]
        out += [(item_id, number, ids[-doc], score) for score, doc in best(own, k)]
    return out


FOUND = "item_id long, item int, doc_id long, score long"


def _block(docs: DataFrame, items: list[tuple[int | None, bytes]], k: int, shard: int) -> DataFrame:
    counts = [Counter(terms(text)) for _, text in items]
    wanted = {t: i for i, t in enumerate(sorted({t for c in counts for t in c}))}
    queries = [(item_id, number, {wanted[t]: n for t, n in c.items()}) for number, ((item_id, _), c) in enumerate(zip(items, counts))]
    postings = materialise(index(docs, wanted, shard), "postings")
    documents, total = postings.filter(F.col("term") == DOCUMENTS).agg(F.sum("n"), F.sum("total")).first()
    held = postings.filter(F.col("term") != DOCUMENTS).groupBy("term").agg(F.sum("n").alias("n")).collect()
    weights = {r["term"]: math.floor(1000 * math.log((2 * documents + 2) / (2 * r["n"] + 1))) for r in held}

    def run(group):
        import pyarrow as pa

        found = search_shard(group.to_pylist(), queries, weights, documents, total, k)
        columns = list(zip(*found)) or [[]] * 4
        return pa.table({"item_id": pa.array(columns[0], pa.int64()), "item": pa.array(columns[1], pa.int32()), "doc_id": pa.array(columns[2], pa.int64()), "score": pa.array(columns[3], pa.int64())})

    return postings.groupBy("shard").applyInArrow(run, FOUND)


def search(docs: DataFrame, items: DataFrame, k: int = 20, shard: int = SHARD, block: int = ITEMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` best documents of every
    item."""
    asked = items.select(F.col("item_id").cast("long"), F.col("text").cast("binary").alias("text")).distinct()
    numbered = global_rank(asked, [F.col("item_id"), F.col("text")], "number", "items")
    n = numbered.count()
    blocks = []
    for lo in range(0, max(n, 1), block):
        rows = numbered.filter((F.col("number") > lo) & (F.col("number") <= lo + block)).orderBy("number").collect()
        found = _block(docs, [(r["item_id"], bytes(r["text"] or b"")) for r in rows], k, shard)
        blocks.append(found.withColumn("item", F.col("item") + F.lit(lo)))
    found = reduce(DataFrame.unionByName, blocks)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
