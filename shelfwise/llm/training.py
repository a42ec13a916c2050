"""Bounded training samples for the classifiers, and a small optimiser."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo folds; null for a null key."""
    return (F.crc32(key.cast("string").cast("binary")) % folds).cast("int")


def one_label(labels: DataFrame, key: str, label: str) -> DataFrame:
    """(id, label): one 0 or 1 per key; repeated rows vote, a tie is 1; null keys and labels are left out."""
    known = labels.select(F.col(key).cast("long").alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label is not null")
    return known.groupBy("id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))


def sample(frame: DataFrame, key: str, most: int, seed: str) -> DataFrame:
    """About `most` rows (all, if there are fewer), chosen by a seeded hash of the key, so reruns agree."""
    total = frame.count()
    if total <= most:
        return frame.where(F.col(key).isNotNull())
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 40))
    return frame.where(F.col(key).isNotNull() & (place < int((1 << 40) * (most / total))))


def unused(columns: list[str], name: str) -> str:
    """The name, with underscores before it as long as some column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name


class Adam:
    """Adam steps on a dict of arrays."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float, decay: float = 0.0) -> None:
        self.weights, self.rate, self.decay, self.steps = weights, rate, decay, 0
        self.first = {k: np.zeros_like(v) for k, v in weights.items()}
        self.second = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, gradients: dict[str, np.ndarray]) -> None:
        self.steps += 1
        for k, g in gradients.items():
            g = g + self.decay * self.weights[k]
            self.first[k] += 0.1 * (g - self.first[k])
            self.second[k] += 0.001 * (g * g - self.second[k])
            scale = np.sqrt(1 - 0.999 ** self.steps) / (1 - 0.9 ** self.steps)
            self.weights[k] -= self.rate * scale * self.first[k] / (np.sqrt(self.second[k]) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))
