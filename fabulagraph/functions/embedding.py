"""Text embeddings behind an interface (SCA-42).

``Embedder`` is what a model would implement; ``HashEmbedder`` is a deterministic stand-in
of hashed character trigrams, of unit length.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Embedder(Protocol):
    def __call__(self, text: str) -> np.ndarray | None: ...


class HashEmbedder:
    def __init__(self, size: int = 64):
        self.size = size

    def __call__(self, text: str) -> np.ndarray | None:
        padded = f"  {text.strip().lower()}  "
        v = np.zeros(self.size, np.float32)
        for i in range(len(padded) - 2):
            h = zlib.crc32(padded[i : i + 3].encode())
            v[h % self.size] += 1 if h >> 31 else -1
        length = float(np.linalg.norm(v))
        return v / length if length else None


def embedded(text: Column, embedder: Callable[[], Embedder] = HashEmbedder) -> Column:
    """Embeddings in Arrow batches; null for null or blank text, and where the embedder has none."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = embedder()
        for texts in batches:
            yield texts.map(lambda t: None if t is None or not t.strip() else model(t))

    return run(text)
