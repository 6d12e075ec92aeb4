"""Edit-aware token counts.

``trees`` cuts each text into pre-tokens (the public byte-level BPE pattern;
merges never cross them), encodes each and keeps a segment tree: leaves are runs
of ``LEAF`` pre-tokens with their characters and tokens, inner nodes their sums.
``apply_edits`` takes such trees and edits (start, stop, replacement, in
characters of the text as it then is), descends to the leaf before the edit,
re-encodes from there until a pre-token begins where an old leaf began behind
the edit, and updates the sums above.  Everything else is left alone.

Boundary context: whether a pre-token ends where it does depends on at most two
characters beyond it, so re-encoding begins at a leaf start two characters or
more before the edit; matching only looks forward, so once a new pre-token
begins at an old leaf's start, the rest is unchanged.

Scale: one Arrow pass, no shuffle; a worker caches the token counts of
pre-tokens it has met, up to ``CACHE`` of them, then starts anew.

Defined results: null text counts as empty (0 tokens, no leaf); edits apply in
order, positions beyond the text are clamped, stop < start is an insertion; a
null list of edits is none, a null replacement is a deletion; null edits are
skipped; repeated rows are counted each; other columns pass through ``trees``
and ``apply_edits`` untouched, but for earlier columns of the names they add,
which are replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that belongs to the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF, CONTEXT, CACHE = 64, 2, 500_000

EDITS = "array<struct<start:bigint,stop:bigint,replacement:string>>"


class Counter(dict):
    """Pre-token -> its number of tokens, encoded on first sight."""

    def __init__(self, ranks: bytes):
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(PATTERN)

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        n = self[piece] = len(self.encoding.encode_ordinary(piece))
        return n

    def leaves(self, text: str) -> tuple[list[int], list[int], int]:
        """(characters, tokens) of each leaf, and the number of pre-tokens."""
        import numpy as np

        pieces = self.pattern.findall(text)
        if not pieces:
            return [], [], 0
        at = np.arange(0, len(pieces), LEAF)
        chars = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        tokens = np.fromiter(map(self.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        return np.add.reduceat(chars, at).tolist(), np.add.reduceat(tokens, at).tolist(), len(pieces)


class SegmentTree:
    """Leaves of (characters, tokens) under sums; node k has 2k and 2k + 1."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.size = 1
        while self.size < max(1, len(chars)):
            self.size *= 2
        pad = [0] * (self.size - len(chars))
        self.chars, self.tokens = [0] * self.size + chars + pad, [0] * self.size + tokens + pad
        for k in range(self.size - 1, 0, -1):
            self._sum(k)

    def _sum(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def find(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character, and the leaf's first character; past
        the end, the last slot."""
        k, first = 1, 0
        while k < self.size:
            k *= 2
            if position >= first + self.chars[k]:
                first += self.chars[k]
                k += 1
        return k - self.size, first

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        k = leaf + self.size
        self.chars[k], self.tokens[k] = chars, tokens
        while k > 1:
            k //= 2
            self._sum(k)

    def leaves(self) -> tuple[list[int], list[int]]:
        kept = [(c, t) for c, t in zip(self.chars[self.size :], self.tokens[self.size :]) if c]
        return [c for c, _ in kept], [t for _, t in kept]


def edit(counter: Counter, text: str, tree: SegmentTree, start: int, stop: int, replacement: str) -> tuple[str, SegmentTree, int]:
    """The edited text, its tree, and how many characters were encoded anew."""
    start = max(0, min(start, len(text)))
    stop = max(start, min(stop, len(text)))
    new = text[:start] + replacement + text[stop:]
    shift = len(replacement) - (stop - start)
    first, begin = tree.find(max(0, start - CONTEXT))
    last, at = first, begin
    ends = {}  # old leaf starts behind the edit, by where they are now -> leaf
    while last < tree.size and at < len(text):
        if at >= stop and last > first:
            ends[at + shift] = last
            if len(ends) > 4 and at > stop + 4096:
                break
        at += tree.chars[tree.size + last]
        last += 1
    else:
        ends[len(new)] = last
    edge = max(ends)
    tokens, met, where = 0, None, begin
    for match in counter.pattern.finditer(new, begin):
        where = match.start()
        if where in ends:
            met = ends[where]
            break
        if where > edge:  # no old start was met: look at all that follow
            break
        tokens += counter[match.group()]
    else:
        where, met = len(new), ends.get(len(new), tree.size)
    if met is None:  # rare: start over to the end of the text
        chars, counts, _ = counter.leaves(new[begin:])
        old_chars = tree.chars[tree.size : tree.size + first] + chars
        old_tokens = tree.tokens[tree.size : tree.size + first] + counts
        return new, SegmentTree(old_chars, old_tokens), len(new) - begin
    tree.put(first, where - begin, tokens)
    for leaf in range(first + 1, min(met, tree.size)):
        if tree.chars[tree.size + leaf]:
            tree.put(leaf, 0, 0)
    if where - begin > 64 * 6 * LEAF:  # a long insertion: split its leaf again
        chars, counts, _ = counter.leaves(new[begin:where])
        behind = slice(tree.size + first + 1, None)
        tree = SegmentTree(tree.chars[tree.size : tree.size + first] + chars + tree.chars[behind], tree.tokens[tree.size : tree.size + first] + counts + tree.tokens[behind])
    return new, tree, where - begin


_counters: dict[str, Counter] = {}


def _counter(name: str, ranks: bytes) -> Counter:
    """A worker's own counter, kept between its batches and tasks."""
    if name not in _counters:
        _counters[name] = Counter(ranks)
    return _counters[name]


def rank_file(tokenizer: str = TOKENIZER) -> bytes:
    """The rank file, read where the plan is made: it goes with the tasks (a
    megabyte or two), so executors need no copy of their own."""
    with open(tokenizer, "rb") as f:
        return f.read()


def trees(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``docs`` with n_tokens, n_pretokens, leaf_chars and leaf_tokens."""
    docs = docs.drop("n_tokens", "n_pretokens", "leaf_chars", "leaf_tokens")
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string("n_tokens long, n_pretokens long, leaf_chars array<bigint>, leaf_tokens array<bigint>").fields])
    at, ranks = docs.columns.index("text"), rank_file(tokenizer)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counter = _counter(tokenizer, ranks)
        for batch in batches:
            made = [counter.leaves(x.as_py() or "") for x in batch.column(at)]
            cols = [pa.array([sum(m[1]) for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64()), pa.array([m[0] for m in made], pa.list_(pa.int64())), pa.array([m[1] for m in made], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=schema.names)

    return docs.mapInArrow(run, schema)


def apply_edits(treed: DataFrame, edits: str = "edits", tokenizer: str = TOKENIZER) -> DataFrame:
    """``treed`` (of ``trees``, with a column of EDITS type) with text, leaves
    and n_tokens after the edits, and n_edits, n_reencoded characters."""
    treed = treed.drop("n_edits", "n_reencoded")
    names = treed.columns
    schema = T.StructType([*treed.schema.fields, *T._parse_datatype_string("n_edits long, n_reencoded long").fields])
    ranks = rank_file(tokenizer)
    place = {c: names.index(c) for c in ("text", "leaf_chars", "leaf_tokens", "n_tokens", edits)}

    def one(counter: Counter, text: str, chars: list[int], tokens: list[int], todo: list) -> tuple:
        tree, anew = SegmentTree(chars, tokens), 0
        for e in todo:
            text, tree, n = edit(counter, text, tree, e["start"] or 0, e["stop"] or 0, e["replacement"] or "")
            anew += n
        chars, tokens = tree.leaves()
        return text, chars, tokens, tree.tokens[1], len(todo), anew

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counter = _counter(tokenizer, ranks)
        for batch in batches:
            made = []
            for text, chars, tokens, todo in zip(*[batch.column(place[c]).to_pylist() for c in ("text", "leaf_chars", "leaf_tokens", edits)]):
                made.append(one(counter, text or "", chars or [], tokens or [], [e for e in todo or [] if e is not None]))
            cols = list(batch.columns)
            for k, c in enumerate(("text", "leaf_chars", "leaf_tokens", "n_tokens")):
                cols[place[c]] = pa.array([m[k] for m in made], batch.schema.field(place[c]).type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array([m[4] for m in made], pa.int64()), pa.array([m[5] for m in made], pa.int64())], names=schema.names)

    return treed.mapInArrow(run, schema)


def stamp_and_redact(text: Column, source: Column) -> Column:
    """The edits of the registered query: a provenance line in front, 32
    characters in the middle redacted, a line end appended."""
    n = F.length(F.coalesce(text, F.lit("")))
    head = F.concat(F.lit("source: "), F.coalesce(source, F.lit("unknown")), F.lit("\n"))

    def make(start: Column, stop: Column, replacement: Column) -> Column:
        return F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"), replacement.alias("replacement"))

    middle = F.length(head) + F.floor(n / 2)
    far = F.lit(1 << 40)
    return F.array(make(F.lit(0), F.lit(0), head), make(middle, middle + 32, F.lit("[redacted]")), make(far, far, F.lit("\n")))


def counts(docs: DataFrame, edits: Column, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, counts before and after the edits, and the work they took."""
    treed = trees(docs.select("doc_id", "text", edits.cast(EDITS).alias("edits")), tokenizer).withColumn("tokens_before", F.col("n_tokens"))
    done = apply_edits(treed, "edits", tokenizer)
    return done.select("doc_id", F.col("tokens_before").alias("n_tokens"), "n_pretokens", F.size("leaf_chars").cast("long").alias("n_segments"), "n_edits", F.col("n_tokens").alias("n_tokens_edited"), "n_reencoded")
