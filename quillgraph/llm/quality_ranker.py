"""Quality classifier: Bradley-Terry pairwise ranking.

A document's worth is linear in features of its whole text; that a good
document is preferred to a bad one has probability sigmoid(worth difference).
The weights minimise that logistic loss over preference pairs.  The threshold is
the quantile of worth at the share of bad labels; scores are shifted so that
this threshold is 0.3.

Fit: on every labelled document.  They are dealt by a hash into packs of about
``PACK``; every good document of a pack is paired with every bad one, documents of
the rarer label being dealt to as many packs as give each ``RARE`` of them.  Mean,
deviation, knots, Newton steps on the loss of all these pairs, the threshold and
the slope are sums over packs.

Scale: one Arrow pass over the texts, no shuffle of texts; features are written once,
those of labelled documents are shuffled, and a pass over packs gives the driver a
fixed number of values for each task.

Defined results: null or empty text has all features 0 and still gets a score;
without labels of both kinds every score is 0.5; contradictory labels of one id
teach nothing; repeated rows score alike; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import bounded, drawn, materialise, shuffled, unit_hash

PACK, RARE, KNOTS, CUT = 1024, 16, 7, 0.3
RIDGE, ROUNDS, EDGES = 1e-3, 40, 512
SYMBOLS, STOPS = "#*$%&|<>", ".!?;:,"
N_FEATURES = 19


def _classes():
    """Class of each ASCII character: 1 symbol, 2 '!', 3 digit, 4 white space,
    5 other punctuation, 6 letter."""
    import numpy as np

    table = np.full(128, 5, dtype=np.uint8)
    for c in range(128):
        x = chr(c)
        table[c] = 1 if x in SYMBOLS else 2 if x == "!" else 3 if x.isdigit() else 4 if x.isspace() else 6 if x.isalpha() else 5
    return table


def features(text: str, table) -> list[float]:
    import numpy as np
    from collections import Counter

    w = text.split()
    if not w:
        return [0.0] * N_FEATURES
    n, chars = len(w), len(text)
    lower = text.lower()
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = np.bincount(table[cp[cp < 128]], minlength=7)
    if len(lower) == chars:
        upper = int(np.count_nonzero(cp != np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)))
    else:
        upper = sum(map(str.isupper, text))
    lines = [x for x in text.split("\n") if x.strip()]
    times = Counter(w)
    top = times.most_common(3)
    sizes = np.fromiter(map(len, w), dtype=np.int32, count=n)
    pairs = set(zip(w, w[1:], w[2:]))
    ends = text.count(".") + text.count("?") + text.count("!")
    return [
        np.log1p(n), sizes.mean(), sizes.std(), float(sizes.max()) ** 0.5, float((sizes <= 2).mean()),
        upper / chars, kinds[1] / chars, kinds[2] / n, kinds[3] / chars, kinds[5] / chars, kinds[6] / chars,
        len(times) / n, len(times) / n**0.75, top[0][1] / n, sum(c for _, c in top) / n,
        len(pairs) / max(1, n - 2), sum(map(str.__eq__, w, w[1:])) / n,
        1.0 - len(set(lines)) / len(lines), n / (ends + 1.0) / 20.0,
    ]


def featurise(docs: DataFrame, keep: list[tuple[str, str]]) -> DataFrame:
    """The columns ``keep`` (name, type) with ``x``: array of features."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = _classes()
        for batch in batches:
            x = pa.array([[float(v) for v in features(t.as_py() or "", table)] for t in batch.column("_text")], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c, _ in keep], x], names=[*[c for c, _ in keep], "x"])

    rows = docs.select(*[F.col(c).cast(kind) for c, kind in keep], F.col("text").alias("_text"))
    return rows.mapInArrow(run, ", ".join([*[f"{c} {kind}" for c, kind in keep], "x array<double>"]))


def _spread(x, knots):
    """Each feature, and its part beyond each knot: piecewise linear worths."""
    import numpy as np

    parts = [x]
    for k in range(knots.shape[1]):
        parts.append(np.maximum(x - knots[:, k], 0.0))
    return np.concatenate(parts, axis=1)


def pairwise(w, good, bad):
    """Of log(1 + exp(-(g - b) . w)), summed over all pairs of rows g and b: value,
    gradient and second derivatives."""
    import numpy as np

    m = np.clip((good @ w)[:, None] - (bad @ w)[None, :], -30, 30)
    p = 1.0 / (1.0 + np.exp(m))
    q = p * (1.0 - p)
    mixed = good.T @ q @ bad
    curved = (good.T * q.sum(axis=1)) @ good + (bad.T * q.sum(axis=0)) @ bad - mixed - mixed.T
    return float(np.log1p(np.exp(-m)).sum()), p.sum(axis=0) @ bad - p.sum(axis=1) @ good, curved


def gradient(w, d, ridge: float):
    """Of the mean of log(1 + exp(-d . w)) over feature differences d, winner
    minus loser, and ridge / 2 times the square of w."""
    import numpy as np

    return pairwise(w, d, np.zeros((1, d.shape[1])))[1] / len(d) + ridge * w


class Model:
    """worth = spread(x) . w;  score = sigmoid(slope * (worth - cut) + logit(0.3)).

    ``Model(x, good, bad_share)`` learns from rows in memory, ``Model.of`` from
    ``passes``: a function that runs a step over every pack (features, good, whether
    a row counts here or is a copy) and returns an array, a row a task: the sums of
    what the step gives, or their least values."""

    def __init__(self, x, good, bad_share: float):
        import numpy as np

        self._learn(lambda step, least=False: np.array([step(x, good, np.ones(len(x), dtype=bool))]), bad_share)

    @classmethod
    def of(cls, passes: Callable, bad_share: float) -> Model:
        model = cls.__new__(cls)
        model._learn(passes, bad_share)
        return model

    def _learn(self, passes: Callable, bad_share: float) -> None:
        import numpy as np

        levels = np.linspace(0.02, 0.98, KNOTS)

        def places(x, good, own):
            x, good = x[own], good[own]
            at = np.quantile(x, levels, axis=0) * len(x) if len(x) else np.zeros((KNOTS, x.shape[1]))
            return np.concatenate([[len(x), good.sum()], x.sum(axis=0), at.ravel()])

        n, n_good, *rest = passes(places).sum(axis=0)
        rest = np.array(rest).reshape(1 + KNOTS, -1) / n
        self.mid = mid = rest[0]
        self.scale = scale = np.sqrt(passes(lambda x, good, own: ((x[own] - mid) ** 2).sum(axis=0)).sum(axis=0) / n) + 1e-9
        self.knots = knots = ((rest[1:] - mid) / scale).T
        self.w = self._minimum(passes, lambda x: _spread((x - mid) / scale, knots))
        self.slope, weights = 1.0, (bad_share / (n - n_good), (1 - bad_share) / n_good)  # of a bad row and of a good one
        self.cut = self._quantile(passes, weights, bad_share)
        slopes = [0.05 * 1.25**k for k in range(30)]

        def losses(x, good, own):
            worth, mark = self.worth(x[own]), good[own]
            return [self._loss(worth, mark, np.where(mark, weights[1], weights[0]), a) for a in slopes]

        self.slope = slopes[int(np.argmin(passes(losses).sum(axis=0)))]

    def _minimum(self, passes: Callable, spread: Callable):
        """Newton steps, halved where the loss would rise."""
        import numpy as np

        def at(w):
            def step(x, good, own):
                s = spread(x)
                value, slope, curved = pairwise(w, s[good], s[~good])
                return np.concatenate([[good.sum() * (~good).sum(), value], slope, curved[np.triu_indices(len(w))]])

            pairs, value, *rest = passes(step).sum(axis=0)
            rest, k = np.array(rest) / pairs, len(w)
            curved = np.zeros((k, k))
            curved[np.triu_indices(k)] = rest[k:]
            curved = curved + np.triu(curved, 1).T + RIDGE * np.eye(k)
            return value / pairs + RIDGE / 2 * (w @ w), rest[:k] + RIDGE * w, curved

        w = np.zeros(len(self.mid) * (1 + KNOTS))
        value, slope, curved = at(w)
        move = -np.linalg.solve(curved, slope)
        for _ in range(ROUNDS):
            if -(slope @ move) < 1e-10:  # twice what a step can still gain
                break
            tried = at(w + move)
            if tried[0] > value:
                move = move / 2
                continue
            w = w + move
            value, slope, curved = tried
            move = -np.linalg.solve(curved, slope)
        return w

    def _quantile(self, passes: Callable, weights, share: float) -> float:
        """Half way between the greatest worth with no more than ``share`` of the
        weight up to it and the next: narrowed between edges, then looked up."""
        import numpy as np

        def ends(x, good, own):
            worth = self.worth(x[own])
            return [worth.min(initial=np.inf), (-worth).min(initial=np.inf)]

        low, high = passes(ends, least=True).min(axis=0) * [1, -1]
        low -= 1e-9 * (1 + abs(low))
        for _ in range(3):
            edges = np.linspace(low, high, EDGES)

            def below(x, good, own, edges=edges):
                worth, mark = self.worth(x[own]), good[own]
                return np.concatenate([np.searchsorted(np.sort(worth[~mark]), edges, side="right"), np.searchsorted(np.sort(worth[mark]), edges, side="right")])

            counts = passes(below).sum(axis=0)
            within = counts[:EDGES] * weights[0] + counts[EDGES:] * weights[1] <= share + 1e-9
            k = max(int(within.sum()) - 1, 0)
            low, high = edges[k], edges[min(k + 1, EDGES - 1)]

        def nearest(x, good, own):
            worth = self.worth(x[own])
            return [(-worth[worth <= low]).min(initial=np.inf), worth[worth > low].min(initial=np.inf)]

        last, following = passes(nearest, least=True).min(axis=0) * [-1, 1]
        return float(following if np.isinf(last) else last if np.isinf(following) else (last + following) / 2)

    def _loss(self, worth, good, weight, slope: float) -> float:
        import numpy as np

        p = np.clip(self._score(worth, slope), 1e-9, 1 - 1e-9)
        return float(-(weight * np.where(good, np.log(p), np.log(1 - p))).sum())

    def _score(self, worth, slope: float):
        import numpy as np

        return 1.0 / (1.0 + np.exp(-np.clip(slope * (worth - self.cut) + np.log(CUT / (1 - CUT)), -30, 30)))

    def worth(self, x):
        return _spread((x - self.mid) / self.scale, self.knots) @ self.w

    def scores(self, x):
        return self._score(self.worth(x), self.slope)


def _matrix(column):
    """A column of arrays of features -> a row each."""
    import numpy as np

    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, N_FEATURES)


def packed(rows: DataFrame, good: int, bad: int) -> DataFrame:
    """(pack, x, good, own) of ``rows`` (doc_id, q, x): a row a pack, as bytes."""
    packs = -(-(good + bad) // PACK)
    copies = min(packs, -(-RARE * packs // min(good, bad)))
    times = F.when(F.col("q") == int(good <= bad), copies).otherwise(1)
    copy = rows.withColumn("_copy", F.explode(F.sequence(F.lit(0), times - 1)))
    dealt = copy.withColumn("pack", F.pmod(F.xxhash64("doc_id", "x") + F.col("_copy"), F.lit(packs)))

    def pack(table):
        import numpy as np
        import pyarrow as pa

        x, ids = _matrix(table.column("x").combine_chunks()), table.column("doc_id").to_numpy()
        at = np.lexsort((*x.T, ids))
        good, own = table.column("q").to_numpy()[at] == 1, table.column("_copy").to_numpy()[at] == 0
        return pa.table({"pack": table.column("pack")[:1], "x": [x[at].tobytes()], "good": [good.tobytes()], "own": [own.tobytes()]})

    return dealt.select("pack", "doc_id", "q", "x", "_copy").groupBy("pack").applyInArrow(pack, "pack long, x binary, good binary, own binary")


def over(packs: DataFrame) -> Callable:
    """``passes`` of a model over a table of packs."""

    def passes(step: Callable, least: bool = False):
        import numpy as np

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            first, total = None, None
            for batch in batches:
                for pack, *data in zip(*(batch.column(c).to_pylist() for c in ("pack", "x", "good", "own"))):
                    x, good, own = np.frombuffer(data[0]).reshape(-1, N_FEATURES), np.frombuffer(data[1], dtype=bool), np.frombuffer(data[2], dtype=bool)
                    got = np.asarray(step(x, good, own), dtype=np.float64)
                    first, total = (pack, got) if total is None else (min(first, pack), np.minimum(total, got) if least else total + got)
            if total is not None:
                yield pa.RecordBatch.from_pydict({"first": [first], "total": [total.tobytes()]})

        got = packs.mapInArrow(run, "first long, total binary").collect()
        return np.array([np.frombuffer(bytes(r["total"])) for r in sorted(got, key=lambda r: r["first"])])

    return passes


def _marks(labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    marks = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("q2")).filter("q = q2 and doc_id is not null and q in (0, 1)")
    counts = {r["q"]: r["n"] for r in marks.groupBy("q").agg(F.count(F.lit(1)).alias("n")).collect()}
    return marks.select(F.col("doc_id").alias("_label_id"), F.col("q").cast("int").alias("q")), counts


def _fitted(rows: DataFrame, counts: dict[int, int]) -> Model | None:
    """From (doc_id, q, x); rows alike in all three teach once."""
    rows = materialise(rows.distinct(), "ranker-labelled")
    got = {r["q"]: r["n"] for r in rows.groupBy("q").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(got) < 2:
        return None
    return Model.of(over(materialise(packed(rows, got[1], got[0]), "ranker-packs")), counts[0] / (counts[0] + counts[1]))


def _known(made: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc_id, q, x) of the labelled among documents with features."""
    one = made.filter("doc_id is not null").select("doc_id", "x").distinct()
    return one.join(shuffled(marks), F.col("doc_id") == F.col("_label_id")).select("doc_id", "q", "x")


def fit(docs: DataFrame, labels: DataFrame, per_class: int | None = None) -> Model | None:
    """From all labelled documents; ``per_class`` asks for at most so many a label."""
    marks, counts = _marks(labels)
    if len(counts) < 2:
        return None
    if per_class is None:
        return _fitted(_known(featurise(docs, [("doc_id", "long")]), marks), counts)
    chosen = drawn(marks, per_class, "q", unit_hash(F.col("_label_id"), F.lit("quality")), F.col("_label_id"), of=F.when(F.col("q") == 1, counts[1]).otherwise(counts[0]))
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_label_id"))
    return _fitted(featurise(bounded(joined.drop("_label_id"), per_class, "q", "quality"), [("doc_id", "long"), ("q", "int")]), counts)


def rank(docs: DataFrame, labels: DataFrame, held_out: Column, per_class: int | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; ``labels`` may
    hold only what may be learned from."""
    made = featurise(docs.select("doc_id", held_out.alias("held_out"), "text"), [("doc_id", "long"), ("held_out", "boolean")])
    made = materialise(made, "ranker-features")
    if per_class is None:
        marks, counts = _marks(labels)
        model = _fitted(_known(made, marks), counts) if len(counts) == 2 else None
    else:
        model = fit(docs, labels, per_class)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x = _matrix(batch.column("x"))
            score = model.scores(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return made.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
