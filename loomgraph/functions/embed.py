"""Embedders: text to unit vectors, in doubles; tables of the store keep them as floats. The hashing one is deterministic and needs no model."""

from __future__ import annotations

import hashlib
from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


class Embedder(ABC):
    kind, model, dimension, enabled = "", "", 0, True

    @abstractmethod
    def embed(self, texts: list[str]) -> np.ndarray:
        """One row of `dimension` floats for each text."""

    def column(self, text: Column) -> Column:
        @F.pandas_udf(ArrayType(DoubleType()))
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for b in batches:
                v = self.embed(["" if x is None else x for x in b])
                if v.shape != (len(b), self.dimension):
                    raise ValueError(f"{len(b)} texts of dimension {self.dimension} asked for, {v.shape} embedded")
                yield pd.Series(list(v.astype(np.float64)), index=b.index)

        return run(text)


class HashEmbedder(Embedder):
    """Digests of the text and a counter, spread over [-1, 1] and scaled to length 1."""

    kind, model = "hash", "sha256-counter"

    def __init__(self, dimension: int = 64):
        if dimension < 8:
            raise ValueError("dimension must be 8 or more")
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        blocks = -(-self.dimension // 8)
        raw = b"".join(hashlib.sha256(f"{k}:{x}".encode("utf-8", "surrogatepass")).digest() for x in texts for k in range(blocks))
        v = np.frombuffer(raw, "<u4").reshape(len(texts), blocks * 8)[:, : self.dimension] / (2**31 - 0.5) - 1
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


class NoEmbedder(Embedder):
    kind, enabled = "none", False

    def embed(self, texts: list[str]) -> np.ndarray:
        raise RuntimeError("embeddings are off")


def embedder(provider: str, dimension: int = 64) -> Embedder:
    made = {"none": NoEmbedder, "hash": lambda: HashEmbedder(dimension)}.get(provider)
    if made is None:
        raise ValueError(f"no embedder named {provider!r}")
    return made()


def embed_chunks(chunks: DataFrame, by: Embedder) -> DataFrame:
    """chunks(parent, ordinal, text) with embedding; null where embeddings are off."""
    return chunks.withColumn("embedding", by.column(F.col("text")) if by.enabled else F.lit(None).cast("array<double>"))
