"""Language-model scores by deleted interpolation.

P(w | v) = a(b) * c(v, w) / c(v) + (1 - a(b)) * P1(w), b the frequency bucket
(log2) of the context v, and P1(w) = m * c(w) / N + (1 - m) / (V + 1).  The
weights a and m are learned by expectation-maximisation on held-out counts: the
n-grams of a deleted part of the training documents, against the counts of the
rest.  Each document starts in a context of its own and ends with one end token.

Every word keeps its own bigrams, however rare it is.  Only where ``head`` is
given are the words beyond the ``head`` most frequent ones (whole frequency
grades) one class, within which P1 decides:
P(w | v) = a(b) * c(v, rest) / c(v) * P1(w) / P1(rest) + (1 - a(b)) * P1(w).

Passes: (1) documents are packed into chunks; a chunk's distinct words and
bigrams go, with how often they occur in its training documents, to the bucket
of their hash (62 and 56 bits), where they are counted, and the counts return to
the chunk;
(2) the chunks of the deleted part give sums for each cell of (context bucket,
ratio of the two estimates), from which the driver learns the weights; (3) each
chunk, which now holds c(v), c(w) and c(v, w), scores its documents.

Scale: a worker packs about ``BLOCK`` tokens at a time.  A bucket stands for about
``PER_BUCKET`` tokens while that takes at most ``BUCKETS`` buckets, and for up to
``MOST_PER_BUCKET`` beyond.  Chunks are dealt to groups of about ``BUCKETS`` x
``MOST_PER_BUCKET`` tokens, and each group has its own buckets, so a chunk is cut into
at most ``BUCKETS`` blocks and a bucket holds no more entries than that, of a hot key
one for each chunk of its group, however large the corpus.  With several groups a key's
counts are added up over them by a plain sum and joined back: a hot key is one row a
group there.  Only sums over cells
reach the driver (and the ``head`` words where it is given).

Defined results: null text is empty (one end token); with no training document
all counts are 0 and both scores are uniform; where so few documents train that
none is deleted, the weights stay where EM begins (m 0.9, a 0.2); a null id is a document of its
own hash remainder; repeated rows are scored each; other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import materialise, unit_hash

HEAD, DELETED, BLOCK = None, math.inf, 500_000  # no bound on the head or the deleted part
PER_BUCKET, MOST_PER_BUCKET, BUCKETS = 1_000_000, 4_000_000, 512
SHARE = 0.1  # of the training documents, deleted at every size
_MASK, PAIR_BITS = (1 << 62) - 1, 56  # of a word's hash, and of a bigram's, of which there are more to send
END, START, REST = 1 << 62, (1 << 62) + 1, (1 << 62) + 2  # keys beyond those of words
EXACT, FINE = 64, 32  # cells of a count: each its own, then so many to an octave


class Vocabulary(dict):
    """Word -> its number in the chunk; ``keys`` has the 62-bit hashes."""

    def __init__(self):
        self.keys = [START, END, REST]

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        n = self[word] = len(self.keys)
        self.keys.append(xxh64_intdigest(word, 42) & _MASK)
        return n


def _train_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("_train"), F.col("_deleted"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_text"))


def word_counts(rows: DataFrame) -> DataFrame:
    """(h, n): occurrences of each word in training texts, by hash."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from collections import Counter
        from xxhash import xxh64_intdigest

        def flush(times: Counter):
            h = np.fromiter((xxh64_intdigest(w, 42) & _MASK for w in times), dtype=np.int64, count=len(times))
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(list(times.values()), pa.int64())], names=["h", "n"])

        times: Counter = Counter()
        for batch in batches:
            for text in batch.column("_text"):
                times.update(text.as_py().lower().split())
                if len(times) > 400_000:
                    yield flush(times)
                    times.clear()
        yield flush(times)

    return rows.filter("_train").select("_text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _head_words(rows: DataFrame, head: int) -> dict[int, int]:
    """Hash -> count of the ``head`` most frequent words, whole grades only."""
    counts = word_counts(rows).persist()
    # words by frequency class (eight to an octave): at most some hundred rows
    grade = F.floor(8 * F.log2("n"))
    grades = counts.groupBy(grade.alias("g")).agg(F.count(F.lit(1)).alias("types")).orderBy(F.desc("g")).collect()
    room, least = head, 1 << 30
    for r in grades:
        room -= r["types"]
        if room < 0:
            break
        least = r["g"]
    top = counts.filter(grade >= least).toArrow().to_pydict()
    counts.unpersist()
    return dict(zip(top["h"], top["n"]))


class Model:
    """Totals and mixture weights; bounded in size."""

    def __init__(self, classes: dict[int, int] | None, tokens: int, types: int, documents: int):
        import numpy as np

        self.classes, self.tokens, self.types, self.documents = classes, tokens, types, documents
        self.m, self.a, self.deleted, self.rest = 0.9, np.full(64, 0.2), 0.0, 1.0

    def base(self, c):
        import numpy as np

        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.types + 1)))

    def unigram(self, c, gone: float = 0.0):
        return self.m * c / max(1.0, self.tokens - gone) + (1 - self.m) / (self.types + 1)

    def set_rest(self) -> None:
        """P1 of the class of all that the head and the end leave."""
        if self.classes is not None:
            self.rest = max(1e-12, 1.0 - float(sum(self.unigram(n) for n in self.classes.values())) - (self.unigram(self.documents) if self.documents else 0.0))


def _squeezed(raw: bytes) -> bytes:
    import pyarrow as pa

    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True) if raw else b""


def _loosened(raw: bytes) -> bytes:
    import pyarrow as pa

    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True) if raw else b""


def _narrow(numbers) -> bytes:
    """Whole numbers in 1, 2, 4 or 8 bytes each, whichever is enough."""
    import numpy as np

    most = int(numbers.max(initial=0))
    return _squeezed(numbers.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.int64).tobytes())


def _widened(raw: bytes, n: int):
    import numpy as np

    raw = _loosened(raw)
    return np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[len(raw) // n] if n else np.uint8).astype(np.int64)


def _steps(keys) -> bytes:
    """Ascending keys as steps, byte by byte: the upper bytes are mostly zero."""
    import numpy as np

    return _squeezed(np.diff(keys, prepend=0).view(np.uint8).reshape(-1, 8).T.tobytes())


def _from_steps(raw: bytes, n: int):
    import numpy as np

    if not n:
        return np.empty(0, dtype=np.int64)
    return np.cumsum(np.ascontiguousarray(np.frombuffer(_loosened(raw), np.uint8).reshape(8, n).T).view(np.int64)[:, 0])


def _entries(seq, sizes, keys, own):
    """A chunk's distinct (context, word) entries in the order of their hash.

    seq: word numbers of all documents, ends included; own: whether a number is
    a class of its own.  Returns (context, word, hash) of the entries, and the
    entry of each token."""
    import numpy as np

    kind = np.where(own, np.arange(len(keys)), 2)
    before = np.empty_like(seq)
    before[1:] = kind[seq[:-1]]
    before[np.cumsum(sizes) - sizes] = 0
    found, entry = np.unique(before * len(keys) + seq, return_inverse=True)
    del before
    v, w = found // len(keys), found % len(keys)
    del found
    with np.errstate(over="ignore"):
        x = keys[v].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + keys[kind[w]].astype(np.uint64)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    h = ((x ^ (x >> np.uint64(31))) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
    order = np.argsort(h, kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return v[order], w[order], h[order], place[entry]


BLOCKS = "bucket int, chunk string, deleted boolean, words int, pairs int, word_keys binary, pair_keys binary, times binary, pair_times binary, meta binary"
_ARROW = {"int": "int32", "string": "string", "boolean": "bool_", "binary": "binary", "long": "int64", "double": "float64"}


def _rows(schema: str, rows: list[tuple]):
    import pyarrow as pa

    fields = [x.split() for x in schema.split(", ")]
    return [pa.array([r[j] for r in rows], getattr(pa, _ARROW[kind])()) for j, (_, kind) in enumerate(fields)], [name for name, _ in fields]


def _pack(classes: dict[int, int] | None, buckets: int, groups: int):
    """Documents -> a chunk's keys and their counts by bucket, and one meta block
    a chunk: ids, sizes, word numbers and hashes.  Deleted documents have chunks
    of their own."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        _frugal()
        task = TaskContext.get().partitionId()
        number = 0

        def fresh():
            return {"words": Vocabulary(), "ids": [], "marks": [], "held": [], "size": 0}

        def flush(s, deleted: bool):
            chunk = f"{task}-{number}"
            keys = np.array(s["words"].keys, dtype=np.int64)
            own = np.ones(len(keys), dtype=bool) if classes is None else np.array([k > _MASK or k in classes for k in s["words"].keys])
            sizes = np.array([len(x) for x in s["held"]], dtype=np.int64)
            seq, marks = np.concatenate(s["held"]).astype(np.int64), np.array(s["marks"], dtype=bool)
            v, w, h, entry = _entries(seq, sizes, keys, own)
            train = np.repeat(marks, sizes)
            times = np.bincount(seq[train], minlength=len(keys))
            times[0], times[2] = marks.sum(), times[~own].sum()
            pair_times = np.bincount(entry[train], minlength=len(h))
            order = np.argsort(keys, kind="stable")
            keys_in, times_in = keys[order], times[order]
            cut, pair_cut = ([*np.searchsorted(x, np.array([(b << bits) // buckets for b in range(buckets)], dtype=np.int64)), len(x)] for x, bits in ((keys_in, 62), (h, PAIR_BITS)))
            planes = [(seq >> shift).astype(np.uint8) for shift in (0, 8, 16, 24)]
            meta = b"".join([np.array([len(sizes), len(seq), len(keys)], np.int64).tobytes(), np.array([x is not None for x in s["ids"]], np.uint8).tobytes(), np.array([x or 0 for x in s["ids"]], np.int64).tobytes(), sizes.tobytes(), keys.tobytes(), own.astype(np.uint8).tobytes(), *[x.tobytes() for x in planes]])
            own_first, every = hash_of(chunk) % groups * buckets, groups * buckets
            out = [(every + hash_of(chunk) % every, chunk, deleted, 0, 0, b"", b"", b"", b"", _squeezed(meta))]
            for b in range(buckets):
                x, y = slice(cut[b], cut[b + 1]), slice(pair_cut[b], pair_cut[b + 1])
                n, pairs = x.stop - x.start, y.stop - y.start
                if n or pairs:
                    out.append((own_first + b, chunk, deleted, n, pairs, _steps(keys_in[x]), _steps(h[y]), _narrow(times_in[x]), _narrow(pair_times[y]), b""))
            return pa.RecordBatch.from_arrays(*_rows(BLOCKS, out))

        open_chunks = [fresh(), fresh()]
        for batch in batches:
            for doc_id, train, gone, text in zip(batch.column("doc_id").to_pylist(), batch.column("_train").to_pylist(), batch.column("_deleted").to_pylist(), batch.column("_text")):
                s = open_chunks[bool(gone)]
                w = text.as_py().lower().split()
                codes = np.empty(len(w) + 1, dtype=np.int32)
                codes[:-1] = np.fromiter(map(s["words"].__getitem__, w), dtype=np.int32, count=len(w))
                codes[-1] = 1
                s["ids"].append(doc_id), s["marks"].append(bool(train)), s["held"].append(codes)
                s["size"] += len(codes)
                if s["size"] > BLOCK:
                    yield flush(s, bool(gone))
                    number += 1
                    open_chunks[bool(gone)] = fresh()
        for k, s in enumerate(open_chunks):
            if s["ids"]:
                yield flush(s, k == 1)
                number += 1

    return run


def _frugal() -> None:
    """Arrow memory of this worker goes back to the system once it is freed."""
    import pyarrow as pa

    pa.set_memory_pool(pa.system_memory_pool())


def hash_of(text: str) -> int:
    from zlib import crc32

    return crc32(text.encode())


PARTS = "bucket int, chunk string, deleted boolean, words int, pairs int, word_counts binary, word_rest binary, pair_counts binary, pair_rest binary, pair_times binary, meta binary"
CELLS = "cell long, n double, x double"


def _added(own: list[dict], size: str, raw: str, times: str):
    """Keys of a bucket's blocks, which of them each entry has, and their counts
    over training documents and over the deleted ones."""
    import numpy as np

    n = np.array([r[size] for r in own])
    key = np.concatenate([_from_steps(r[raw], r[size]) for r in own])
    time = np.concatenate([_widened(r[times], r[size]) for r in own]).astype(np.float64)
    found, inverse = np.unique(key, return_inverse=True)
    del key
    of_gone = np.bincount(inverse, weights=time * np.repeat([r["deleted"] for r in own], n), minlength=len(found)).astype(np.int64)
    every = np.bincount(inverse, weights=time, minlength=len(found)).astype(np.int64)
    return n, found, inverse, every, of_gone


_FIELDS = (("words", "word_keys", "times"), ("pairs", "pair_keys", "pair_times"))
KEYS = "bucket int, pair boolean, h long, n long, gone long"


def _keys(table):
    """A bucket's blocks -> its keys with their counts in its group."""
    import numpy as np
    import pyarrow as pa

    rows = [r for r in table.to_pylist() if not r["meta"]]
    parts = []
    for pair, fields in enumerate(_FIELDS) if rows else ():
        _, found, _, every, of_gone = _added(rows, *fields)
        parts.append((np.full(len(found), rows[0]["bucket"], np.int32), np.full(len(found), pair == 1), found, every, of_gone))
    columns = [np.concatenate(x) for x in zip(*parts)] or [[]] * 5
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()))], names=["bucket", "pair", "h", "n", "gone"])


def _count(table):
    return _filled(table, None)


def _filled(table, known):
    """A bucket's blocks -> counts over all training documents (and, for deleted
    chunks, over the rest of them), back in one block a chunk.  One row without
    a chunk has the bucket's totals.  ``known``, if not None, has the counts of the
    bucket's keys over all groups; totals are then made from those."""
    import numpy as np
    import pyarrow as pa

    _frugal()
    rows = table.to_pylist()
    own = [r for r in rows if r["bucket"] is not None and not r["meta"]]
    out = [(r["bucket"], r["chunk"], r["deleted"], 0, 0, b"", b"", b"", b"", b"", r["meta"]) for r in rows if r["meta"]]
    if own:
        counts, stats = [], []
        for pair, fields in enumerate(_FIELDS):
            n, found, inverse, every, of_gone = _added(own, *fields)
            if known is not None:
                # not by pyarrow.compute: a fresh worker has not loaded it
                mine = np.flatnonzero(known.column("pair").to_numpy() == (pair == 1))
                mine = mine[np.argsort(known.column("h").to_numpy()[mine])]
                every, of_gone = (known.column(c).to_numpy()[mine] for c in ("n", "gone"))
            elif not pair:
                stats = _totals(found, every, of_gone)
            counts.append((np.cumsum(n) - n, n, every[inverse], (every - of_gone)[inverse]))
        for k, r in enumerate(own):
            cols = []
            for at, n, every, left in counts:
                x = slice(at[k], at[k] + n[k])
                cols += [_narrow(every[x]), _narrow(left[x]) if r["deleted"] else b""]
            out.append((r["bucket"], r["chunk"], r["deleted"], r["words"], r["pairs"], *cols, r["pair_times"] if r["deleted"] else b"", b""))
        if known is None:
            out.append((own[0]["bucket"], None, False, len(stats), 0, np.array(stats, np.float64).tobytes(), b"", b"", b"", b"", b""))
    return pa.Table.from_arrays(*_rows(PARTS, out))


TOKENS, TYPES, DOCUMENTS, GONE = -1, -2, -3, -4


def _totals(keys, every, gone) -> list[tuple]:
    """(cell, n, n * x) of a bucket's words: totals, and the deleted part's
    tokens by their count x in the rest."""
    import numpy as np

    word = keys <= END
    left = (every - gone)[word]
    n, gone, end = every[word], gone[word], every[keys == END].sum()
    out = [(TOKENS, n.sum(), 0), (TYPES, (n > 0).sum(), 0), (DOCUMENTS, end, 0), (GONE, gone.sum(), 0)]
    cell = np.where(left < EXACT, left, EXACT + np.floor(FINE * np.log2(np.maximum(left, 1) / EXACT)).astype(np.int64))
    sums = np.bincount(cell, weights=gone, minlength=1), np.bincount(cell, weights=gone * left.astype(np.float64), minlength=1)
    return out + [(int(k), sums[0][k], sums[1][k]) for k in np.flatnonzero(sums[0])]


def _cells_of_words(batches: Iterator) -> Iterator:
    """(h, n, gone) of words -> the cells of ``_totals``."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        cells = np.array(_totals(*[batch.column(c).to_numpy() for c in ("h", "n", "gone")]), dtype=np.float64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([pa.array(cells[:, 0].astype(np.int64)), pa.array(cells[:, 1]), pa.array(cells[:, 2])], names=["cell", "n", "x"])


def _unpack(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for raw in batch.column("word_counts").to_pylist():
            cells = np.frombuffer(raw, np.float64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(cells[:, 0].astype(np.int64)), pa.array(cells[:, 1]), pa.array(cells[:, 2])], names=["cell", "n", "x"])


def _opened(table):
    """A chunk's blocks -> its documents, entries and counts."""
    import numpy as np

    _frugal()
    rows = table.to_pylist()
    (meta,) = [_loosened(r["meta"]) for r in rows if r["meta"]]
    docs, tokens, words = (int(x) for x in np.frombuffer(meta, np.int64, 3))
    at, parts = 24, []
    for kind, n in ((np.uint8, docs), (np.int64, docs), (np.int64, docs), (np.int64, words), (np.uint8, words), *[(np.uint8, tokens)] * 4):
        parts.append(np.frombuffer(meta, kind, n, at).copy())
        at += parts[-1].nbytes
    given, ids, sizes, keys, own, *planes = parts
    own = own.astype(bool)
    seq = sum(x.astype(np.int64) << shift for x, shift in zip(planes, (0, 8, 16, 24)))
    v, w, _, entry = _entries(seq, sizes, keys, own)
    blocks = sorted((r for r in rows if not r["meta"]), key=lambda r: r["bucket"])

    def joined(name, size):
        return np.concatenate([_widened(r[name], r[size]) for r in blocks])

    def by_word(name):
        out = np.empty(words, dtype=np.int64)
        out[np.argsort(keys, kind="stable")] = joined(name, "words")
        return out

    return given, ids, sizes, own, v, w, entry, by_word, joined


def _ratios(model: Model):
    """Deleted chunks -> sums (cell, n, n * log2 of the ratio) for the weights:
    the ratio is that of the bigram's estimate to P1, both from the rest."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        *_, own, v, w, _, by_word, joined = _opened(table)
        left, c, n = by_word("word_rest"), joined("pair_rest", "pairs"), joined("pair_times", "pairs").astype(np.float64)
        p1 = np.where(own[w], model.unigram(left[w], model.deleted), model.rest)
        context = left[v]
        at = np.flatnonzero((context > 0) & (n > 0))
        bucket = np.log2(context[at]).astype(np.int64)
        ratio = c[at] / context[at] / p1[at]
        log = np.log2(np.where(ratio > 0, ratio, 1.0))
        cell = bucket << 32 | np.where(ratio > 0, (1 << 20) + np.floor(log * FINE).astype(np.int64), 0)
        found, inverse = np.unique(cell, return_inverse=True)
        cols = [pa.array(found), pa.array(np.bincount(inverse, weights=n[at], minlength=len(found))), pa.array(np.bincount(inverse, weights=n[at] * log, minlength=len(found)))]
        return pa.Table.from_arrays(cols, names=["cell", "n", "x"])

    return run


RESULT = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _score(model: Model):
    """A chunk's blocks -> a row a document."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        given, ids, sizes, own, v, w, entry, by_word, joined = _opened(table)
        count, c = by_word("word_counts"), joined("pair_counts", "pairs")
        context, word = count[v], count[w]
        p1 = model.unigram(word)
        a = np.where(context > 0, model.a[np.log2(np.maximum(context, 1)).astype(int)], 0.0)
        p = a * c / np.maximum(context, 1) * np.where(own[w], 1.0, p1 / model.rest) + (1 - a) * p1
        first = np.cumsum(sizes) - sizes
        known, base, score = (np.add.reduceat(x[entry], first) for x in ((word > 0).astype(np.int64), model.base(word), np.log10(np.maximum(p, 1e-300))))
        cols = [pa.array(ids, mask=given == 0), pa.array(sizes), pa.array(known), pa.array(base), pa.array(score)]
        return pa.Table.from_arrays(cols, names=[x.split()[0] for x in RESULT.split(", ")])

    return run


def _summed(cells: DataFrame):
    found = cells.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).orderBy("cell").toArrow()
    return [found.column(k).to_numpy() for k in ("cell", "n", "x")]


def _learn(model: Model, parts: DataFrame, cells, rounds: int = 40) -> None:
    """EM for the unigram weight and for the bigram weight of each bucket."""
    import numpy as np

    cell, n, x = cells
    plain = cell >= 0
    n, event = n[plain], x[plain] / np.maximum(n[plain], 1.0)
    total = max(1.0, model.tokens - model.deleted)
    if not n.sum():
        return model.set_rest()
    for _ in range(rounds):
        own = model.m * event / total
        share = own / (own + (1 - model.m) / (model.types + 1))
        model.m = float(np.clip((n * share).sum() / n.sum(), 1e-3, 1 - 1e-3))
    model.set_rest()
    gone = parts.filter("deleted and chunk is not null").groupBy("chunk").applyInArrow(_ratios(model), CELLS)
    cell, n, x = _summed(gone)
    bucket = (cell >> 32).astype(int)
    ratio = np.where(cell & 0xFFFFFFFF, np.exp2(x / np.maximum(n, 1.0)), 0.0)
    whole = np.bincount(bucket, weights=n, minlength=64)
    for _ in range(rounds):
        a = model.a[bucket]
        share = a * ratio / np.maximum(a * ratio + 1 - a, 1e-300)
        model.a = np.where(whole > 0, np.bincount(bucket, weights=n * share, minlength=64) / np.maximum(whole, 1.0), model.a)
    model.a = np.clip(model.a, 0.0, 0.999)


def _counted(packed: DataFrame, groups: int) -> tuple[DataFrame, DataFrame]:
    """(blocks of counts, cells of word totals)."""
    if groups == 1:
        parts = materialise(packed.groupBy("bucket").applyInArrow(_count, PARTS), "lm-counts")
        return parts, parts.filter("chunk is null").mapInArrow(_unpack, CELLS)
    packed = materialise(packed, "lm-blocks")
    keys = materialise(packed.groupBy("bucket").applyInArrow(_keys, KEYS), "lm-keys")
    totals = materialise(keys.groupBy("pair", "h").agg(F.sum("n").alias("n"), F.sum("gone").alias("gone")), "lm-totals")
    known = keys.select("bucket", "pair", "h").join(totals, ["pair", "h"]).select("bucket", "pair", "h", "n", "gone")
    parts = materialise(packed.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(_filled, PARTS), "lm-counts")
    return parts, totals.filter("not pair").select("h", "n", "gone").mapInArrow(_cells_of_words, CELLS)


def _dealt_to(size: int) -> tuple[int, int]:
    """(buckets of a group, groups) for a text of so many bytes."""
    tokens = size / 6  # a token has about six bytes
    groups = max(1, math.ceil(tokens / (MOST_PER_BUCKET * BUCKETS)))
    return min(BUCKETS, max(8, math.ceil(tokens / (PER_BUCKET * groups)))), groups


def _fitted(docs: DataFrame, head: int | None, buckets: int | None, groups: int = 1) -> tuple[Model, DataFrame]:
    rows = _train_rows(docs)
    classes = None if head is None else _head_words(rows, head)
    if buckets is None:
        buckets, groups = _dealt_to(int(rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0))
    parts, cells = _counted(rows.mapInArrow(_pack(classes, buckets, groups), BLOCKS), groups)
    cells = _summed(cells)
    total = dict(zip(cells[0].tolist(), cells[1].tolist()))
    model = Model(classes, *(int(total.get(k, 0)) for k in (TOKENS, TYPES, DOCUMENTS)))
    model.deleted = total.get(GONE, 0.0)
    _learn(model, parts, cells)
    return model, parts


def fit(docs: DataFrame, head: int | None = HEAD) -> Model:
    """docs: with _train and _deleted columns."""
    return _fitted(docs, head, None)[0]


def marked(docs: DataFrame, training: Column, deleted: float = DELETED) -> DataFrame:
    """docs with _train and _deleted, which is SHARE of the training documents."""
    rows = docs.select("doc_id", "text", training.alias("_train"))
    share = min(SHARE, deleted / max(1, rows.filter("_train").count()))
    return rows.withColumn("_deleted", F.col("_train") & (unit_hash(F.coalesce(F.col("doc_id"), F.lit(-1)), F.lit("deleted")) < share))


def score(docs: DataFrame, training: Column, head: int | None = HEAD, deleted: float = DELETED, buckets: int | None = None, groups: int = 1) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every
    document, learned from those where ``training`` holds."""
    model, parts = _fitted(marked(docs, training, deleted), head, buckets, groups)
    done = parts.filter("chunk is not null").groupBy("chunk").applyInArrow(_score(model), RESULT)
    return done.withColumn("train_tokens", F.lit(int(model.tokens)).cast("long"))
