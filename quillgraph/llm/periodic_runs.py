"""Periodic runs of words by the linear-time tandem-repeat method.

A run is a stretch of consecutive words with smallest period q, at least
``max(LEAST, TIMES * q)`` words long, that no neighbouring word extends.  Runs
are found for each text in five steps:

1. words are named by whole numbers, and windows of 1, 2, 4, ... words by ranks
   (prefix doubling), which sort the suffixes and answer how far two positions
   agree to the right or left;
2. the text is cut into LZ blocks (longest factors seen before); every square
   whose first occurrence ends its left half in a block touches that block's
   border, so agreements across the borders give squares that cover, up to
   rotation, the first occurrence of every square;
3. their ends are marked in the suffix tree; walks over suffix links, one word
   down a step and stopped at marked places, complete the vocabulary of
   primitively rooted squares;
4. the leaves below each marked place are all occurrences of that square;
5. occurrences of one period at consecutive starts merge into a run.

A run makes some window of ``LEAST * (TIMES - 1) / TIMES`` words occur twice, so
a text without such a window (compared by hashes; equal hashes only send a text
through the five steps) has no run.

Scale: no shuffle; a text is one row of an Arrow batch and needs about 300 bytes
a word while it is worked on, which is freed before the next one.  Text by text,
tasks can be run anywhere again.

Defined results: null text has no words, no run, and collapses to the empty text;
words are compared exactly; rows are worked on by themselves, so repeated rows and
null ids need no rule; columns named like an output (``n_words``, ``runs``,
``collapsed``) are replaced, all others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm.common import let, words

LEAST, TIMES = 24, 3
RUNS = "n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
#: Distinct words that a task keeps names for before it starts over.
NAMES = 500_000


class Names(dict):
    """Whole numbers for words, in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def repeats_window(ids, size: int) -> bool:
    """Whether some window of ``size`` names may occur twice (never a miss)."""
    import numpy as np

    if len(ids) <= size:
        return False
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    span = 1
    while span * 2 <= size:
        h = (h[:-span] ^ (h[:-span] >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + (h[span:] ^ (h[span:] >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        span *= 2
    if span < size:  # two overlapping windows make one of any size
        gap = size - span
        h = h[:-gap] * np.uint64(0xD6E8FEB86659FD93) + (h[gap:] ^ (h[gap:] >> np.uint64(32)))
    h.sort()
    return bool((h[1:] == h[:-1]).any())


class Suffixes:
    """Ranks of windows of 1, 2, 4, ... names; rank 0 is the end of the text."""

    def __init__(self, ids):
        import numpy as np

        self.n = n = len(ids)
        _, first = np.unique(ids, return_inverse=True)
        self.levels = [np.append(first.astype(np.int32) + 1, np.int32(0))]
        span = 1
        while self.levels[-1].max() < n:
            rank = self.levels[-1].astype(np.int64)
            after = np.zeros(n, dtype=np.int64)
            after[: n - span] = rank[span:n]
            _, paired = np.unique(rank[:n] * (n + 1) + after, return_inverse=True)
            self.levels.append(np.append(paired.astype(np.int32) + 1, np.int32(0)))
            span *= 2
        self.rank = self.levels[-1][:n] - 1
        self.order = np.empty(n, dtype=np.int32)
        self.order[self.rank] = np.arange(n, dtype=np.int32)

    def right(self, i, j):
        """Names on which the suffixes at i and j (i <> j) agree."""
        import numpy as np

        i, j = i.astype(np.int64), j.astype(np.int64)
        start = i.copy()
        for level in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[level]
            same = (rank[i] == rank[j]) & (i < self.n) & (j < self.n)
            step = same.astype(np.int64) << level
            i, j = np.minimum(i + step, self.n), np.minimum(j + step, self.n)
        return i - start

    def left(self, i, j):
        """Names on which the prefixes that end before i and j agree."""
        import numpy as np

        i, j = i.astype(np.int64), j.astype(np.int64)
        end = i.copy()
        for level in range(len(self.levels) - 1, -1, -1):
            rank, span = self.levels[level], 1 << level
            fits = (i >= span) & (j >= span)
            same = fits & (rank[np.where(fits, i - span, 0)] == rank[np.where(fits, j - span, 0)])
            step = same.astype(np.int64) << level
            i, j = i - step, j - step
        return end - i


def blocks(suffixes: Suffixes) -> list[int]:
    """Where LZ blocks begin: each is the longest factor that also begins
    earlier (it may overlap itself), or one new name."""
    import numpy as np

    order = suffixes.order.tolist()
    before, after, stack = [0] * len(order), [0] * len(order), [-1]
    for at in order:  # the nearest suffixes in order that begin earlier
        while stack[-1] > at:
            after[stack.pop()] = at
        before[at] = stack[-1]
        stack.append(at)
    while len(stack) > 1:
        after[stack.pop()] = -1
    at = np.arange(suffixes.n)
    longest = np.zeros(suffixes.n, dtype=np.int64)
    for near in (np.array(before), np.array(after)):
        known = near >= 0
        longest[known] = np.maximum(longest[known], suffixes.right(near[known], at[known]))
    longest, starts, h = longest.tolist(), [], 0
    while h < suffixes.n:
        starts.append(h)
        h += max(1, longest[h])
    return starts


def covering_squares(suffixes: Suffixes, starts: list[int], longest: int):
    """(start, period) of squares that cover, up to rotation to the right, the
    first occurrence of every square of period ``longest`` or less."""
    import numpy as np

    n = suffixes.n
    h = np.array(starts, dtype=np.int64)
    h1 = np.append(h[1:], n)
    h2 = np.append(h1[1:], n)
    found = []
    for border, counts, ahead in ((h1, h1 - h, -1), (h, h2 - h, 1)):
        counts = np.minimum(counts, longest)
        at = np.repeat(border, counts)
        period = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts) + 1
        other = at + ahead * period
        fits = (at < n) & (other < n)
        at, period, other = at[fits], period[fits], other[fits]
        meets = suffixes.levels[0][at] == suffixes.levels[0][other]
        at, period, other = at[meets], period[meets], other[meets]
        low = np.minimum(at, other)
        back = suffixes.left(at, other)
        square = back + suffixes.right(at, other) >= period
        found.append(np.stack([np.maximum(low - back, low - period + 1)[square], period[square]]))
    pairs = np.concatenate(found, axis=1)
    return np.unique(pairs[:, primitive(suffixes, *pairs)], axis=1)


def primitive(suffixes: Suffixes, start, period):
    """Whether a square's root is no power of a shorter word: for every prime
    p that divides the period, the square has no period a p-th as long."""
    import numpy as np

    good = np.ones(len(start), dtype=bool)
    rest, prime = period.copy(), 2
    while len(rest) and prime * prime <= rest.max():
        divides = rest % prime == 0
        if divides.any():
            _test(suffixes, start, period, np.flatnonzero(divides), prime, good)
            while (again := rest % prime == 0).any():
                rest[again] //= prime
        prime += 1
    for prime in np.unique(rest[rest > 1]).tolist():
        _test(suffixes, start, period, np.flatnonzero(rest == prime), prime, good)
    return good


def _test(suffixes: Suffixes, start, period, which, prime: int, good) -> None:
    step = period[which] // prime
    agree = suffixes.right(start[which], start[which] + step)
    good[which[agree >= 2 * period[which] - step]] = False


class SuffixTree:
    """The suffix tree over the sorted suffixes: node k < n is the k-th leaf, the
    others are inner nodes; a node knows its first and last leaf, its depth and
    its parent."""

    def __init__(self, suffixes: Suffixes):
        import numpy as np

        n = suffixes.n
        self.ranks = suffixes.rank
        self.names, self.order, self.rank = suffixes.levels[0].tolist(), suffixes.order.tolist(), suffixes.rank.tolist()
        common = suffixes.right(suffixes.order[:-1], suffixes.order[1:]).tolist() + [-1]
        self.first, self.last = list(range(n)), list(range(n))
        self.depth, self.parent = [n - at for at in self.order], [-1] * n
        root = self._node(0, 0)
        stack = [root]
        for k in range(n):
            if self.depth[stack[-1]] < self.depth[k]:
                stack.append(k)
            height, below = max(common[k], 0), -1
            while self.depth[stack[-1]] > height:  # nodes that end with this leaf
                below = stack.pop()
                self.last[below] = k
                self.parent[below] = stack[-1]
                if self.depth[stack[-1]] < height:
                    inner = self._node(self.first[below], height)
                    self.parent[below] = inner
                    stack.append(inner)
        self.last[root] = n - 1
        self.up = [np.array(self.parent, dtype=np.int32)]
        self.up[0][root] = root
        self.parent[root] = root
        self.root, self.links = root, {root: root}
        self.depths = np.array(self.depth, dtype=np.int32)
        while (self.up[-1] != root).any():
            self.up.append(self.up[-1][self.up[-1]])
        begin = np.minimum(suffixes.order[np.array(self.first)] + self.depths[self.up[0]], n)
        keys = self.up[0].astype(np.int64) * (n + 1) + suffixes.levels[0][begin]
        self.width = n + 1
        self.child = {key: node for node, key in enumerate(keys.tolist()) if node != root}

    def _node(self, first: int, depth: int) -> int:
        self.first.append(first), self.last.append(first), self.depth.append(depth), self.parent.append(-1)
        return len(self.first) - 1

    def locate(self, start, size):
        """The highest nodes above the leaves of ``start`` at least ``size`` deep."""
        import numpy as np

        node = self.ranks[start]
        for up in reversed(self.up):
            higher = up[node]
            node = np.where(self.depths[higher] >= size, higher, node)
        return node

    def link(self, node: int) -> int:
        """The suffix link of an inner node: one name less in front."""
        if node not in self.links:
            here = self.rank[self.order[self.first[node]] + 1] if self.depth[node] > 1 else self.root
            for up in reversed(self.up):
                if self.depth[higher := up.item(here)] >= self.depth[node] - 1:
                    here = higher
            self.links[node] = here
        return self.links[node]

    def rotate(self, node: int, size: int) -> int:
        """From the place of a word of ``size`` names above or at ``node``, over
        the suffix link and down by the name at the middle of the word's
        successor: the place of the next rotation of the square, or -1."""
        at = self.order[self.first[node]]
        name, at = self.names[at], at + 1
        here = self.link(self.parent[node])
        while self.depth[here] < size - 1:
            here = self.child[here * self.width + self.names[at + self.depth[here]]]
        if self.depth[here] == size - 1:
            return self.child.get(here * self.width + name, -1)
        return here if self.names[self.order[self.first[here]] + size - 1] == name else -1


def vocabulary(tree: SuffixTree, start, period) -> list[tuple[int, int]]:
    """(node, period) of every place where a primitively rooted square ends."""
    marked: set[tuple[int, int]] = set()
    for node, q in zip(tree.locate(start, 2 * period).tolist(), period.tolist()):
        while node >= 0 and (node, q) not in marked:
            marked.add((node, q))
            node = tree.rotate(node, 2 * q)
    return list(marked)


def find_runs(ids, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of an array of names, by start, then
    period."""
    import numpy as np

    if len(ids) < least or not repeats_window(ids, max(1, -(-least * (times - 1) // times))):
        return []
    suffixes = Suffixes(ids)
    start, period = covering_squares(suffixes, blocks(suffixes), len(ids) // times)
    if not len(start):
        return []
    tree = SuffixTree(suffixes)
    places = np.array(vocabulary(tree, start, period), dtype=np.int64)
    first, last = np.array(tree.first)[places[:, 0]], np.array(tree.last)[places[:, 0]]
    counts = last - first + 1
    leaf = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
    key = np.sort(np.repeat(places[:, 1], counts) * (len(ids) + 1) + suffixes.order[leaf])
    breaks = np.flatnonzero(np.diff(key) != 1) + 1
    lo, hi = key[np.append(0, breaks)], key[np.append(breaks - 1, len(key) - 1)]
    q, begin = lo // (len(ids) + 1), lo % (len(ids) + 1)
    length = hi - lo + 2 * q
    long = length >= np.maximum(least, times * q)
    return sorted(zip(begin[long].tolist(), length[long].tolist(), q[long].tolist()))


def collapse(text: bytes, names: Names, least: int = LEAST, times: int = TIMES) -> tuple[int, list[tuple[int, int, int]], bytes]:
    """Number of words, runs, and the text with one period left of every run:
    a word goes if any run holds it behind that run's first period."""
    import numpy as np

    split = text.split()
    if len(names) > NAMES:
        names.clear()
    runs = find_runs(np.fromiter(map(names.__getitem__, split), dtype=np.int64, count=len(split)), least, times)
    n = len(split)
    if runs:
        edge = np.zeros(n + 1, dtype=np.int64)
        for start, length, period in runs:
            edge[start + period] += 1
            edge[start + length] -= 1
        split = [w for w, over in zip(split, np.cumsum(edge[:n]).tolist()) if not over]
    return n, runs, b" ".join(split)


def collapse_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``docs`` with n_words, runs (start, length, period; by start, then
    period) and collapsed, the text with one period left of every run."""
    docs = docs.drop("n_words", "runs", "collapsed")
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(RUNS).fields])
    at = docs.columns.index("text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        names = Names()
        for batch in batches:
            rows = [collapse((x.as_py() or "").encode(), names, least, times) for x in batch.column(at)]
            runs = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r[1]] for r in rows], kind)
            cols = [pa.array([r[0] for r in rows], pa.int64()), runs, pa.array([r[2].decode() for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=schema.names)

    return docs.mapInArrow(run, schema)


def looped(doc_id: Column, text: Column) -> Column:
    """The registered query's input: one document in ten, by the hash h of its
    id, has its words from g % n on replaced by repeats of the first few of them,
    where g is h / 10."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def loop(split: Column) -> Column:
        n = F.size(split).cast("long")
        a = g % n
        p = F.floor((n - a) / (3 + g % 8)) + 1
        repeat = let(F.struct(a.cast("int").alias("a"), p.cast("int").alias("p")), lambda x: F.transform(split, lambda w, i: F.when(i < x["a"], w).otherwise(F.get(split, x["a"] + (i - x["a"]) % x["p"]))))
        return F.when(n > 0, F.array_join(repeat, " "))

    return F.when(h % 10 == 0, F.coalesce(let(words(text), loop), text)).otherwise(text)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of greatest exponent, and hashes of all runs and
    of the collapsed text."""
    found = collapse_runs(docs.select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text")))

    def ahead(x: Column, y: Column) -> Column:
        """Less than zero where x has the greater length/period, or comes first."""
        by_exponent = y["length"] * x["period"] - x["length"] * y["period"]
        order = [by_exponent, x["start"] - y["start"], x["period"] - y["period"]]
        return F.coalesce(*[F.when(o != 0, F.signum(o).cast("int")) for o in order], F.lit(0))

    top = F.get(F.array_sort("runs", ahead), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("_top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        F.col("_top.start").alias("start"), F.col("_top.length").alias("length"), F.col("_top.period").alias("period"),
        F.floor(F.lit(1000) * F.col("_top.length") / F.col("_top.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
