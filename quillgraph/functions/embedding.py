"""Vectors for texts: a pluggable model behind an iterator pandas UDF, and a
deterministic one that needs no model file."""

from collections.abc import Callable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

DIMS, BATCH = 384, 32


def hashing_model(dims: int = DIMS) -> Callable[[list[str]], list[list[float]]]:
    """Signed feature hashing of words, length one."""

    def embed(texts: list[str]) -> list[list[float]]:
        from itertools import chain
        from zlib import crc32

        import numpy as np

        words = [(text or "").lower().split() for text in texts]
        h = np.array([crc32(w.encode()) for w in chain.from_iterable(words)], dtype=np.int64)
        row = np.repeat(np.arange(len(words)), [len(w) for w in words])
        v = np.bincount(row * dims + h % dims, weights=np.where(h >> 31, 1.0, -1.0), minlength=len(words) * dims).reshape(len(words), dims)
        size = np.linalg.norm(v, axis=1, keepdims=True)
        return (v / np.where(size, size, 1.0)).tolist()

    return embed


def embedder(load: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = BATCH) -> Callable[[Column], Column]:
    """A column function; ``load`` runs once a worker and gives the model."""
    import pandas as pd

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            texts, rows = part.tolist(), []
            for i in range(0, len(texts), batch):
                rows.extend(model(texts[i : i + batch]))
            yield pd.Series(rows, index=part.index, dtype=object)

    return run
