"""Licence scans with a generalised suffix automaton.

The automaton accepts every run of words of every licence template.  A text is
streamed through it; wherever the matching statistic (the longest run that ends
here and occurs in a template) reaches ``MIN_MATCH`` words, the run is kept on
its diagonal (template, offset).  Runs of one template are chained in order,
with small gaps, and a chain that covers ``COVER`` of the template is a span.
Fixed base phrases are counted besides; their labels always stay.

Templates are whole licence texts and the short notices that stand for them
(``license_texts``).  Ties: of chains of one template with equal cover the one
that begins first is taken; several templates may hold the same words, and each
that is covered gives its label.

Scale: no shuffle; each text is read once in Arrow batches, the automaton is a
few thousand states in the closure.  Words outside all templates reset the
automaton, so only runs of template words are walked in Python.

Defined results: null text is empty; no place gives null first_word and
last_word; a template found twice gives two spans and one label; repeated rows
are scanned each; other columns are ignored by ``scan_digest``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.license_texts import TEMPLATES

MIN_MATCH, COVER, GAP = 3, 0.75, 8

# Phrases and labels of the contract.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: A-Z to a-z, everything ASCII that is no letter or digit to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def tokens(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class SuffixAutomaton:
    """Of several token sequences; a state knows where its runs end in each."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for t, seq in enumerate(sequences):
            last = 0
            for e, token in enumerate(seq):
                last = self._extend(last, token)
                self.ends[last].add((t, e))
        for v in sorted(range(1, len(self.link)), key=lambda v: -self.length[v]):
            self.ends[self.link[v]] |= self.ends[v]
        self.ends[0] = set()

    def _state(self, length: int, link: int, nxt: dict[int, int]) -> int:
        self.next.append(nxt), self.link.append(link), self.length.append(length), self.ends.append(set())
        return len(self.link) - 1

    def _split(self, p: int, q: int, token: int) -> int:
        """A copy of q for the runs no longer than p and the token."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, token: int) -> int:
        q = self.next[last].get(token)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, token)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, token)
        return new

    def diagonals(self, run: list[int], at: int, least: int) -> dict[tuple[int, int], list[list[int]]]:
        """Matches of ``least`` tokens and more of a run that begins at word
        ``at``: (template, template end - word end) -> [first word, last word]."""
        found: dict[tuple[int, int], list[list[int]]] = {}
        state = size = 0
        for i, token in enumerate(run, at):
            while state and token not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if token in self.next[state]:
                state, size = self.next[state][token], size + 1
            v, longest = state, size
            seen: set[tuple[int, int]] = set()
            while v > 0 and longest >= least:
                for t, e in self.ends[v] - seen:
                    runs = found.setdefault((t, e - i), [])
                    if runs and runs[-1][1] == i - 1 and runs[-1][0] <= i - longest + 1:
                        runs[-1][1] = i
                    else:
                        runs.append([i - longest + 1, i])
                seen |= self.ends[v]
                v = self.link[v]
                longest = self.length[v] if v >= 0 else 0
        return found


def chain(pieces: list[tuple[int, int, int]], size: int, gap: int = GAP, cover: float = COVER) -> list[tuple[int, int, float]]:
    """pieces: (first word, last word, first template token) of one template ->
    spans (first word, last word, covered share), best first, not overlapping."""
    pieces = sorted(pieces)
    best: list[tuple[int, int]] = []  # covered tokens, first word of the chain
    for k, (a, b, s) in enumerate(pieces):
        now = (b - a + 1, a)
        for j in range(k - 1, -1, -1):
            pa, pb, ps = pieces[j]
            if a - pa > size + gap * 8:
                break
            if pb < a <= pb + 1 + gap and ps + (pb - pa) < s <= ps + (pb - pa) + 1 + gap:
                now = max(now, (best[j][0] + b - a + 1, best[j][1]))
        best.append(now)
    spans: list[tuple[int, int, float]] = []
    for share, a, b in sorted(((c / size, a, p[1]) for (c, a), p in zip(best, pieces)), key=lambda x: (-x[0], x[1])):
        if share >= cover and all(b < x or y < a for x, y, _ in spans):
            spans.append((a, b, share))
    return spans


class Scanner:
    """Templates, base phrases and vocabulary, made once and sent to tasks."""

    def __init__(self, templates=TEMPLATES, base=None):
        self.base = dict(BASE if base is None else base)
        self.labels = [label for label, _ in templates]
        split = [tokens(text.encode()) for _, text in templates]
        phrases = [tokens(p.encode()) for p in self.base]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for s in split + phrases for w in s}))}
        ids = [[self.vocabulary[w] for w in s] for s in split]
        self.phrases = [([self.vocabulary[w] for w in p], label) for p, label in zip(phrases, self.base.values())]
        self.sizes = [len(s) for s in ids]
        self.automaton = SuffixAutomaton(ids)

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str, float]], float]:
        """Words, base places, spans (first, last, label, share), best share."""
        import numpy as np
        from itertools import repeat

        w = tokens(text)
        if not w:
            return 0, [], [], 0.0
        ids = np.fromiter(map(self.vocabulary.get, w, repeat(-1)), dtype=np.int32, count=len(w))
        known = np.flatnonzero(ids >= 0)
        places: list[tuple[int, str]] = []
        for phrase, label in self.phrases:
            at = known[ids[known] == phrase[0]]
            at = at[at + len(phrase) <= len(w)]
            for k, token in enumerate(phrase[1:], 1):
                at = at[ids[at + k] == token]
            places += [(int(i), label) for i in at]
        spans: list[tuple[int, int, str, float]] = []
        pieces: dict[int, set[tuple[int, int, int]]] = {}
        breaks = np.flatnonzero(np.diff(known) != 1) + 1
        edges = np.concatenate(([0], breaks, [len(known)]))
        for lo, hi in zip(edges[:-1], edges[1:]):
            if hi - lo >= MIN_MATCH:
                first = int(known[lo])
                for (t, shift), runs in self.automaton.diagonals(ids[first : first + hi - lo].tolist(), first, MIN_MATCH).items():
                    pieces.setdefault(t, set()).update((a, b, a + shift) for a, b in runs)
        for t, own in pieces.items():
            spans += [(a, b, self.labels[t], share) for a, b, share in chain(list(own), self.sizes[t])]
        best = 1.0 if places else max([min(1.0, x[3]) for x in spans], default=0.0)
        return len(w), sorted(places), sorted(spans), best


SCHEMA = "doc_id long, n_words long, places array<struct<word:long,label:string>>, spans array<struct<first:long,last:long,label:string,share:double>>, score double"


def scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """Places of base phrases and covered template spans of every text."""
    scanner = scanner or Scanner()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [
            pa.int64(),
            pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())])),
            pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string()), ("share", pa.float64())])),
            pa.float64(),
        ]
        for batch in batches:
            rows = [scanner.scan(x.as_py() or b"") for x in batch.column("_text")]
            cols = [
                [r[0] for r in rows],
                [[{"word": i, "label": label} for i, label in r[1]] for r in rows],
                [[{"first": a, "last": b, "label": label, "share": min(1.0, s)} for a, b, label, s in r[2]] for r in rows],
                [r[3] for r in rows],
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["doc_id", "n_words", "places", "spans", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("_text")).mapInArrow(run, SCHEMA)


def scan_digest(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    starts = F.transform("places", lambda p: p["word"])
    base = F.transform("places", lambda p: p["label"])
    own = F.transform("spans", lambda s: s["label"])
    return scan(docs, scanner).select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.sort_array(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_distinct(F.concat(base, own))), ",").alias("labels"), "score",
    )
