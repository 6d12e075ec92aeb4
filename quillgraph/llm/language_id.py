"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams, trained by FTRL-proximal with elastic net, then calibrated
by one temperature.

Features: 1- to 3-grams of the lower-cased text with everything but letters as
one space, hashed into ``DIMS`` places; frequency over the whole text times the
inverse document frequency, which is counted over all training documents.

Bound: the weights are fitted on at most ``PER_CLASS`` labelled documents of each
language, drawn by a hash of the id, a fifth of them for the temperature (their
count vectors, a few kilobytes each, meet in the driver); the document frequencies and the predictions cover every document and whole texts.

Scale: two passes without a shuffle of texts; the first adds up one count array
a task, the second scores with a table of DIMS x languages sent in the closure.

Defined results: null text, or one without a letter, is ``und`` with score 0;
without training documents every text is ``und``; equal scores go to the first
language in code-point order; repeated rows and other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import bounded

DIMS, ORDERS, PER_CLASS = 1 << 15, 3, 800
SCALE = 20.0  # brings mean n-gram values near one
CHUNK = 1_000_000  # characters whose n-grams a task holds at once


def _letters():
    import numpy as np

    every = np.arange(0x110000, dtype=np.uint32)
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return np.where(letter, every, np.uint32(32))


def _places(texts: list[str], table):
    """Hashed n-grams of texts one after the other: places, owner offsets."""
    import numpy as np

    joined = "\n" + "\n".join(texts) + "\n"
    lowered = joined.lower()
    cp = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.flatnonzero(cp == 10)
    cp = table[cp]
    cp[ends] = 10
    stay = np.ones(len(cp), dtype=bool)
    stay[1:] = ~((cp[1:] == 32) & ((cp[:-1] == 32) | (cp[:-1] == 10)))
    cp = cp[stay]
    ends = np.flatnonzero(cp == 10)
    codes = np.zeros(len(cp), dtype=np.uint32)
    out, owners = [], []
    broken = np.zeros(len(cp), dtype=bool)
    for n in range(1, ORDERS + 1):
        m = len(cp) - n + 1
        codes = codes[:m] * np.uint32(0x9E3779B1) + cp[n - 1 :] + np.uint32(n)
        broken = broken[:m] | (cp[n - 1 :] == 10)
        alone = (codes * np.uint32(0x85EBCA6B)) >> np.uint32(32 - 15)
        good = ~broken if n > 1 else ~broken & (cp != 32)
        at = np.flatnonzero(good)
        out.append(alone[at].astype(np.int32))
        owners.append(np.searchsorted(ends, at).astype(np.int32) - 1)
    return np.concatenate(out), np.concatenate(owners)


def _chunks(batches: Iterator) -> Iterator:
    """(batch, first row, texts) with at most about CHUNK characters."""
    for batch in batches:
        rows, size, lo = [], 0, 0
        for i, x in enumerate(batch.column("_text")):
            text = (x.as_py() or "").replace("\n", " ")
            rows.append(text)
            size += len(text)
            if size >= CHUNK:
                yield batch, lo, rows
                rows, size, lo = [], 0, i + 1
        if rows:
            yield batch, lo, rows


def document_frequencies(docs: DataFrame) -> dict[int, int]:
    """In how many texts each place occurs; DIMS numbers, whatever the input."""

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        table, total, seen = _letters(), np.zeros(DIMS, dtype=np.int64), np.zeros(DIMS, dtype=bool)
        for _, _, texts in _chunks(batches):
            places, owners = _places(texts, table)
            order = np.argsort(owners, kind="stable")
            bounds = np.searchsorted(owners[order], np.arange(len(texts) + 1))
            places = places[order]
            for a, b in zip(bounds[:-1], bounds[1:]):
                seen[:] = False
                seen[places[a:b]] = True
                total += seen
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["place", "n"])

    rows = docs.select(F.col("text").alias("_text")).mapInArrow(count, "place int, n long")
    return {r["place"]: r["n"] for r in rows.groupBy("place").agg(F.sum("n").alias("n")).collect()}


def vectors(docs: DataFrame, label: str) -> DataFrame:
    """(label, places, counts): sparse count vectors of labelled texts."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        table = _letters()
        for batch, lo, texts in _chunks(batches):
            places, owners = _places(texts, table)
            where, times = [], []
            order = np.argsort(owners, kind="stable")
            bounds = np.searchsorted(owners[order], np.arange(len(texts) + 1))
            for a, b in zip(bounds[:-1], bounds[1:]):
                p, c = np.unique(places[order[a:b]], return_counts=True)
                where.append(p.astype(np.int32).tobytes()), times.append(c.astype(np.int32).tobytes())
            cols = [batch.column("_id").slice(lo, len(texts)), batch.column("_label").slice(lo, len(texts)), pa.array(where, pa.binary()), pa.array(times, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "label", "places", "counts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).alias("_label"), F.col("text").alias("_text"))
    return rows.mapInArrow(run, "id long, label string, places binary, counts binary")


class Ftrl:
    """Multinomial logistic regression, one FTRL-proximal state a coordinate."""

    def __init__(self, dims: int, classes: int, alpha=0.5, beta=1.0, l1=0.05, l2=0.5):
        import numpy as np

        self.np, self.alpha, self.beta, self.l1, self.l2 = np, alpha, beta, l1, l2
        self.z, self.n = np.zeros((dims, classes)), np.zeros((dims, classes))

    def weights(self, at=slice(None)):
        np, z, n = self.np, self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0.0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def step(self, at, x, truth: int) -> None:
        np = self.np
        w = self.weights(at)
        p = softmax(x @ w)
        p[truth] -= 1.0
        g = x[:, None] * p[None, :]
        grown = np.sqrt(self.n[at] + g * g)
        self.z[at] += g - (grown - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g


def softmax(x):
    import numpy as np

    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits, truth) -> float:
    """The one divisor of all logits with the least loss, by golden section."""
    import numpy as np

    def loss(log_t: float) -> float:
        return -np.log(np.maximum(softmax(logits / np.exp(log_t))[np.arange(len(truth)), truth], 1e-12)).mean()

    a, b, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(docs: DataFrame, training: Column, label: str = "lang", per_class: int = PER_CLASS, epochs: int = 4) -> tuple[list[str], object]:
    """(languages, table of DIMS + 1 rows): the last row is the bias; the values
    already hold the idf, the scale and the temperature."""
    import numpy as np

    known = docs.filter(training & F.col(label).isNotNull())
    sizes = {r[label]: r["n"] for r in known.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(sizes)
    if not names:
        return [], np.zeros((DIMS + 1, 0))
    frequency, total = np.zeros(DIMS), sum(sizes.values())
    for place, n in document_frequencies(known).items():
        frequency[place] = n
    idf = np.log((1.0 + total) / (1.0 + frequency)) + 1.0
    got = vectors(bounded(known.select("doc_id", "text", label), per_class, label, "language"), label).collect()
    got.sort(key=lambda r: (-1 if r["id"] is None else r["id"], r["places"], r["counts"]))
    rows = []
    for r in got:
        at, c = np.frombuffer(r["places"], np.int32), np.frombuffer(r["counts"], np.int32)
        if len(at):
            rows.append((np.append(at, DIMS), np.append(SCALE * c / c.sum() * idf[at], 1.0), names.index(r["label"])))
    random = np.random.default_rng(11)
    order = random.permutation(len(rows))
    cut = max(1, len(rows) // 5) if len(rows) > 4 else 0
    held, train = order[:cut], order[cut:]
    model = Ftrl(DIMS + 1, len(names))
    for _ in range(epochs):
        for i in random.permutation(train):
            model.step(*rows[i])
    w = model.weights()
    if cut:
        w = w / temperature(np.array([rows[i][1] @ w[rows[i][0]] for i in held]), np.array([rows[i][2] for i in held]))
    w[:DIMS] *= (SCALE * idf)[:, None]
    return names, w.astype(np.float32)


def predictor(names: list[str], weights) -> Callable[[Iterator], Iterator]:
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        table = _letters()
        for batch, lo, texts in _chunks(batches):
            places, owners = _places(texts, table)
            n = len(texts)
            count = np.bincount(owners, minlength=n)
            lettered = np.array([any(map(str.isalpha, t)) for t in texts], dtype=bool) & (count > 0)
            best, score = np.zeros(n, dtype=int), np.zeros(n)
            if names:
                sums = np.stack([np.bincount(owners, weights=weights[places, k], minlength=n) for k in range(len(names))], axis=1)
                p = softmax(sums / np.maximum(count, 1)[:, None] + weights[-1])
                best, score = p.argmax(axis=1), p.max(axis=1)
            else:
                lettered[:] = False
            lang = pa.array([names[k] if ok else "und" for k, ok in zip(best, lettered)], pa.string())
            cols = [batch.column(c).slice(lo, n) for c in ("doc_id", "held_out")]
            yield pa.RecordBatch.from_arrays([*cols, lang, pa.array(np.where(lettered, score, 0.0))], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, held_out: Column, label: str = "lang", **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, learned from
    those that are not held out."""
    names, weights = fit(docs, ~held_out, label, **options)
    rows = docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), F.col("text").alias("_text"))
    return rows.mapInArrow(predictor(names, weights), "doc_id long, held_out boolean, lang_pred string, score double")
