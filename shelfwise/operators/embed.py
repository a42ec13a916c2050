"""Text to vectors with a caller's encoder, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

DIMENSIONS = 64
BATCH = 32
Encoder = Callable[[list[str]], np.ndarray]


def ngram_encoder(dimensions: int = DIMENSIONS, n: int = 3) -> Encoder:
    """Signed hashed character n-grams of the whole text, with a space at both ends: needs no model, equal on every worker.

    A gram's hash is its code points as digits of base 131; modulo `dimensions` it gives the place, the next bit the sign.
    """
    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions))
        for i, text in enumerate(texts):
            points = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            count = max(len(points) - n + 1, 0)
            hashes = np.zeros(count, np.int64)
            for k in range(n):
                hashes = hashes * 131 + points[k:k + count]
            out[i] = np.bincount(hashes % dimensions, np.where(hashes // dimensions % 2 == 1, 1.0, -1.0), dimensions)
        return out

    return encode


def embed(rows: DataFrame, make_encoder: Callable[[], Encoder] = ngram_encoder, text: str = "text", key: str = "listing_id",
          batch: int = BATCH) -> DataFrame:
    """key, embedding: unit vectors of `text`. make_encoder runs once per task, where a model is loaded."""
    key_type = dict(rows.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make_encoder()
        for frame in frames:
            texts = frame[text].fillna("").tolist()
            parts = [np.asarray(encode(texts[i:i + batch]), dtype="float64") for i in range(0, len(texts), batch)]
            vectors = np.concatenate(parts) if parts else np.zeros((0, 1))
            length = np.linalg.norm(vectors, axis=1, keepdims=True)
            unit = np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0).astype("float32")
            yield pd.DataFrame({key: frame[key], "embedding": list(unit)})

    return rows.select(key, text).mapInPandas(run, f"{key} {key_type}, embedding array<float>")
