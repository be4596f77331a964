"""Vectors for texts: a pluggable model in Arrow batches, unit length always."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabbyline.session import ensure_shipped

Model = Callable[[list[str]], np.ndarray]
_WORD = regex.compile(r"\p{L}+|\p{N}+")


def hash_model(dim: int = 384) -> Callable[[], Model]:
    """Feature hashing of words and word pairs: deterministic, no weights needed. The default where no
    trained model is at hand; it serves lexical likeness only."""

    def build() -> Model:
        memo: dict[str, tuple[int, float]] = {}

        def place(feature: str) -> tuple[int, float]:
            known = memo.get(feature)
            if known is None:
                h = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "big")
                known = ((h >> 1) % dim, 1.0 if h & 1 else -1.0)
                if len(memo) < 200_000:
                    memo[feature] = known
            return known

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim), np.float32)
            for row, text in enumerate(texts):
                words = _WORD.findall((text or "").lower())
                for feature in (*words, *map(" ".join, zip(words, words[1:]))):
                    at, sign = place(feature)
                    out[row, at] += sign
            return out

        return encode

    return build


def embedding(df: DataFrame, text: Column, model: Callable[[], Model], batch_size: int = 64) -> Column:
    """Unit vectors of a text; null for texts without any feature. The model is built once a worker."""
    ensure_shipped(df.sparkSession)

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = model()
        for batch in batches:
            texts, out = batch.tolist(), []
            for at in range(0, len(texts), batch_size):
                vectors = np.asarray(run(texts[at : at + batch_size]), np.float64)
                norms = np.linalg.norm(vectors, axis=1)
                out += [(v / n).astype(np.float32) if n > 0 else None for v, n in zip(vectors, norms)]
            yield pd.Series(out, dtype=object)

    return encode(text)


def embed_chunks(chunks: DataFrame, model: Callable[[], Model] | None = None, name: str = "feature-hash", batch_size: int = 64) -> DataFrame:
    """Chunks with their vectors and the model's name."""
    vectors = embedding(chunks, F.col("content"), model or hash_model(), batch_size)
    return chunks.withColumns({"embedding": vectors, "embedding_model": F.lit(name)})
