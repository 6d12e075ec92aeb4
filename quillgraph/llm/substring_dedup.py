"""Removal of repeated passages with FM-indexes, one a shard.

A window is ``WINDOW`` consecutive words of one document; a word goes if some
window that covers it begins anywhere else too, in the same document or another.

1. ``cut``: each window is filed under its anchor, the least hash of the runs of
   ``grams(WINDOW)[0]`` words in it.  Equal windows have equal anchors.  Windows
   in a row with one anchor make a piece, which holds their words; every window
   lies in just one piece.
2. Anchors that occur once hold no repeated window; their pieces are left out.
   Equal pieces become one with a number of copies.
3. Pieces are dealt by anchor to shards of about ``SHARD`` words.  A shard's
   pieces make a compressed FM-index, and each of them is streamed through it:
   backward search over the wavelet matrix gives matching statistics, and spans of
   ``WINDOW`` words or more that occur twice (copies counted) are reported.
4. Spans go back to their documents, and the words they cover go.

An anchor with more than ``HOT`` different pieces (a phrase common to many
documents, each with other words around it) would fill a shard.  Its pieces are cut
again by longer runs of words, in the end by whole windows, whose equal pieces are
one; the spans found are put together again.  All windows take part, whatever the
anchor.

Scale: two passes over the texts; what moves is a row of hashes for about every
fifteenth word, pre-aggregated, and the words of one copy of each piece whose
anchor occurs twice.  Texts move twice, to cut those words and for the removal,
as joins with keys that grow with the documents; Spark sends keys instead where they
are few.  Joins back to the documents read written tables, so a piece with very many copies
can be split.

Defined results: words are compared exactly; null and empty texts have no words;
texts of fewer than ``WINDOW`` words keep all; rows equal in id and text are two
documents, so all their windows repeat; kept words are joined by one space;
columns named like an output (``n_words``, ``n_removed``, ``kept``) are replaced,
all others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import checked, materialise, shuffled

WINDOW = 35
SHARD = 300_000
HOT = 2_000
#: Distinct words whose hashes a task keeps before it starts over.
NAMES = 500_000

PIECES = "doc_id long, _th long, start int, n int, gram long, whole long"
TEXTS = "gram long, whole long, copies long, words binary"
SPANS = "gram long, whole long, spans array<struct<first:int,last:int>>"


def grams(window: int) -> tuple[int, int, int]:
    """Words of an anchor: at first, for common anchors, and for common ones of those."""
    return max(1, window // 4), max(1, window * 4 // 7), window


class Hashes(dict):
    """64-bit hashes of words, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) > NAMES:
            self.clear()
        self[word] = h = xxh3_64_intdigest(word)
        return h


def _mixed(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def run_hashes(h, size: int):
    """Hashes of all runs of ``size`` words, from two overlapping ones of half."""
    import numpy as np

    span = 1
    while span * 2 <= size:
        h = _mixed(h[: len(h) - span]) * np.uint64(0x9E3779B97F4A7C15) + _mixed(h[span:] + np.uint64(span))
        span *= 2
    gap = size - span
    return _mixed(h[: len(h) - gap] * np.uint64(0xD6E8FEB86659FD93) + h[gap:]) if gap else _mixed(h)


#: An odd number and its inverse, for hashes of pieces by differences of sums.
_STEP = 0xC2B2AE3D27D4EB4F
_BACK = pow(_STEP, -1, 1 << 64)


def cut(h, window: int, gram: int):
    """h: hashes of a text's words -> start, number of windows, anchor and hash of
    each piece."""
    import numpy as np

    if len(h) < window:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    runs = run_hashes(h, gram)
    wide = window - gram + 1
    at = np.lib.stride_tricks.sliding_window_view(runs, wide).argmin(axis=1) + np.arange(len(runs) - wide + 1)
    start = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    n = np.diff(np.append(start, len(at)))
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.append(np.uint64(1), np.full(len(h), _STEP, dtype=np.uint64)))
        back = np.cumprod(np.append(np.uint64(1), np.full(len(h), _BACK, dtype=np.uint64)))
        sums = np.append(np.uint64(0), np.cumsum(h * powers[:-1], dtype=np.uint64))
        whole = _mixed((sums[start + n + window - 1] - sums[start]) * back[start] + n.astype(np.uint64))
    return start, n, runs[at[start]].view(np.int64), whole.view(np.int64)


def _hashed(names: Hashes, split: list[bytes]):
    import numpy as np

    return np.fromiter(map(names.__getitem__, split), dtype=np.uint64, count=len(split))


def pieces(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pieces of all texts, of PIECES type."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names = Hashes()
        for batch in batches:
            made, counts = [cut([], window, 1)], []
            for text in batch.column("_text"):
                split = (text.as_py() or b"").split()
                found = cut(_hashed(names, split) if len(split) >= window else [], window, grams(window)[0])
                counts.append(len(found[0]))
                made.append(found)
            rows = pa.array(np.repeat(np.arange(len(counts)), counts))
            start, n, gram, whole = (np.concatenate([m[k] for m in made]) for k in range(4))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows), batch.column("_th").take(rows), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(gram), pa.array(whole)],
                names=["doc_id", "_th", "start", "n", "gram", "whole"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("_th"), F.col("text").cast("binary").alias("_text")).mapInArrow(run, PIECES)


def _with(docs: DataFrame, keyed: DataFrame, column: str) -> DataFrame:
    """(_row, column): each row of ``docs`` with its array ``column`` of ``keyed``
    (_id, _h, column)."""
    same = docs["doc_id"].eqNullSafe(keyed["_id"]) & (F.xxhash64(docs["text"]) == keyed["_h"])
    return docs.join(shuffled(keyed), same, "left").select(F.struct(*[docs[c].alias(c) for c in docs.columns]).alias("_row"), keyed[column].alias(column))


def _texts(docs: DataFrame, distinct: DataFrame, window: int) -> DataFrame:
    """The words of one copy of each piece, of TEXTS type; of repeated rows, each
    gives them."""
    wanted = distinct.groupBy(F.col("rep.doc_id").alias("_id"), F.col("rep._th").alias("_h")).agg(
        F.collect_list(F.struct(F.col("rep.start").alias("start"), F.col("rep.n").alias("n"), "gram", "whole", "copies")).alias("_qg_pieces")
    )
    held = _with(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), wanted, "_qg_pieces").filter("_qg_pieces is not null")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for text, places in zip(batch.column("_text"), batch.column("_qg_pieces")):
                split = text.as_py().split()
                rows += [(p["gram"], p["whole"], p["copies"], b" ".join(split[p["start"] : p["start"] + p["n"] + window - 1])) for p in places.as_py()]
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[k], pa.int64()) for k in range(3)] + [pa.array(columns[3], pa.binary())], names=["gram", "whole", "copies", "words"])

    return held.select(F.col("_row.text").cast("binary").alias("_text"), "_qg_pieces").mapInArrow(run, TEXTS)


def _search(texts: DataFrame, total: int, window: int, shard: int) -> DataFrame:
    """Spans of pieces of so many words in all, of SPANS type, from one FM-index a
    shard.  The same piece given twice counts once."""
    shards = max(1, -(-total // shard))

    def run(group):
        import numpy as np
        import pyarrow as pa

        from quillgraph.llm.fm_index import FMIndex, repeated_spans

        once = {key: k for k, key in enumerate(zip(group.column("gram").to_pylist(), group.column("whole").to_pylist()))}
        group = group if len(once) == group.num_rows else group.take(list(once.values()))
        names: dict[bytes, int] = {}
        sequences = [np.array([names.setdefault(w, len(names) + 1) for w in words.as_py().split(b" ")], dtype=np.int64) for words in group.column("words")]
        index = FMIndex(sequences, group.column("copies").to_numpy())
        spans = repeated_spans(index, sequences, window)
        kept = pa.array(np.flatnonzero([len(s) > 0 for s in spans]))
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        found = pa.array([[{"first": a, "last": b} for a, b in spans[k.as_py()]] for k in kept], kind)
        return pa.table({"gram": group.column("gram").take(kept), "whole": group.column("whole").take(kept), "spans": found})

    dealt = texts.withColumn("_shard", F.pmod(F.xxhash64("gram"), F.lit(shards)))
    return dealt.groupBy("_shard").applyInArrow(run, SPANS)


def _recut(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """Pieces of pieces by anchors of ``gram`` words, with the piece they lie in."""
    schema = f"_gram long, _whole long, start int, {TEXTS}"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = Hashes()
        for batch in batches:
            rows = []
            for g, w, copies, words in zip(*(batch.column(c).to_pylist() for c in ("gram", "whole", "copies", "words"))):
                split = words.split(b" ")
                found = cut(_hashed(names, split), window, gram)
                rows += [(g, w, s, a, b, copies, b" ".join(split[s : s + n + window - 1])) for s, n, a, b in zip(*(x.tolist() for x in found))]
            columns = list(zip(*rows)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["_gram", "_whole", "start", "gram", "whole", "copies", "words"])

    return texts.mapInArrow(run, schema)


def _resolve(texts: DataFrame, sizes: DataFrame, window: int, level: int, shard: int, hot: int) -> DataFrame:
    """Spans of distinct pieces: through the shards, or, for anchors with more
    than ``hot`` of them, through pieces of them.  sizes: anchor and words of each
    piece."""
    anchors = sizes.groupBy("gram").agg(F.count(F.lit(1)).alias("_kinds"), F.sum("size").alias("_words"))
    common = F.col("_kinds") > (hot if level + 1 < len(grams(window)) else 1 << 62)
    many, few = anchors.agg(F.count_if(common), F.coalesce(F.sum(F.when(~common, F.col("_words"))), F.lit(0))).first()
    if not many:
        return materialise(_search(texts, few, window, shard), "passage-spans")
    texts = materialise(texts, "passage-pieces")
    common = checked(materialise(anchors.filter(common).select("gram"), "passage-anchors"))
    rest = materialise(_search(texts.join(common, "gram", "left_anti"), few, window, shard), "passage-spans")
    apart = texts.join(common, "gram", "left_semi").dropDuplicates(["gram", "whole"])
    again = materialise(_recut(apart, window, grams(window)[level + 1]), "passage-recut")
    distinct = materialise(again.groupBy("gram", "whole").agg(F.sum("copies").alias("copies"), F.min("words").alias("words")), "passage-pieces")
    sized = distinct.select("gram", F.floor(F.length("words") / 6 + 1).alias("size"))
    found = _resolve(distinct, sized, window, level + 1, shard, hot)
    back = again.select("_gram", "_whole", "start", "gram", "whole").join(found, ["gram", "whole"])
    moved = F.transform("spans", lambda s: F.struct((s["first"] + F.col("start")).alias("first"), (s["last"] + F.col("start")).alias("last")))
    parts = back.groupBy(F.col("_gram").alias("gram"), F.col("_whole").alias("whole")).agg(F.array_distinct(F.flatten(F.collect_list(moved))).alias("spans"))
    return rest.unionByName(parts)


def passages(docs: DataFrame, window: int = WINDOW, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """(_id, _h, _qg_spans): spans of words that lie in repeated windows, by document
    (id and text hash).  Spans may overlap; all are ``window`` words or longer."""
    found = materialise(pieces(docs, window), "passage-windows")
    often = materialise(found.groupBy("gram").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("gram"), "passage-repeats")
    live = materialise(found.join(shuffled(often), "gram", "left_semi"), "passage-live")
    distinct = live.groupBy("gram", "whole").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "_th", "start", "n")).alias("rep"))
    distinct = materialise(distinct, "passage-distinct")
    spans = _resolve(_texts(docs, distinct, window), distinct.select("gram", (F.col("rep.n") + window - 1).alias("size")), window, 0, shard, hot)
    back = live.select("doc_id", "_th", "start", "gram", "whole").join(spans, ["gram", "whole"])
    moved = back.select(F.col("doc_id").alias("_id"), F.col("_th").alias("_h"), F.explode("spans").alias("s"), "start")
    own = F.struct((F.col("start") + F.col("s.first")).alias("first"), (F.col("start") + F.col("s.last")).alias("last"))
    return materialise(moved.groupBy("_id", "_h").agg(F.collect_set(own).alias("_qg_spans")), "passage-found")


REMOVED = "struct<n_words:bigint,n_removed:bigint,kept:string>"


def _removed(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    import numpy as np

    def one(text: str | None, firsts, lasts) -> tuple[int, int, str]:
        split = (text or "").encode().split()
        n = len(split)
        if firsts is not None:
            edge = np.zeros(n + 1, dtype=np.int64)
            np.add.at(edge, firsts, 1)
            np.add.at(edge, lasts, -1)
            split = [split[k] for k in np.flatnonzero(np.cumsum(edge[:n]) == 0).tolist()]
        return n, n - len(split), b" ".join(split).decode()

    for texts, firsts, lasts in batches:
        yield pd.DataFrame([one(*r) for r in zip(texts, firsts, lasts)], columns=["n_words", "n_removed", "kept"])


def remove_passages(docs: DataFrame, window: int = WINDOW, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """``docs`` with n_words, n_removed, and kept, the words outside repeated
    windows."""
    docs = docs.drop("n_words", "n_removed", "kept")
    held = _with(docs, passages(docs, window, shard, hot), "_qg_spans")
    done = held.select("_row", F.pandas_udf(_removed, REMOVED)("_row.text", "_qg_spans.first", "_qg_spans.last").alias("_kept"))
    return done.select("_row.*", "_kept.*")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, and a hash of the kept words."""
    return remove_passages(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
