"""Embedders: vectors of texts, by a model of one's own or by hashing tokens."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_py


class Embedder(Protocol):
    """Makes unit vectors of texts; loaded once a Python worker."""

    name: str

    def encode(self, texts: list[str], *, question: bool) -> np.ndarray: ...


class HashingEmbedder:
    """Signed hashing of word tokens: the same vector everywhere, no model file."""

    def __init__(self, length: int = 256):
        self.length, self.name = length, f"hashing-{length}"

    def encode(self, texts: list[str], *, question: bool = False) -> np.ndarray:
        out = np.zeros((len(texts), self.length))
        for row, text in zip(out, texts, strict=True):
            for w, n in Counter(normalize_py(text or "").split()).items():
                h = zlib.crc32(w.encode())
                row[h % self.length] += n if h >> 31 else -n
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n > 0, n, 1)


def embedded(df: DataFrame, embedder: Embedder, *, text: str = "text", question: bool = False) -> DataFrame:
    """df with `embedding`."""

    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(embedder.encode(s.fillna("").tolist(), question=question)))

    return df.withColumn("embedding", vectors(F.col(text)))
