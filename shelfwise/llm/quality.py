"""Quality by positive-unlabelled learning.

A small network on style features of whole texts is trained on trusted positives and unlabelled web text alone: with the class prior p,
the risk of the negative class is the unlabelled risk less p times the positives' risk as negatives, held at zero from below (the
non-negative unbiased risk), plus p times the positives' own risk.
"""

from __future__ import annotations

import dataclasses
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .training import Adam, one_label, sample, sigmoid, unused

#: Texts that a training sample holds at most, about; training is on the driver.
SAMPLE = 24_000
TAILS, HIDDEN, EPOCHS, BATCH, RATE = 96, 16, 60, 1024, 0.01

_KIND = np.zeros(256, np.uint8)  # 0 others: letters beyond ASCII
_KIND[ord("a"):ord("z") + 1] = 1
_KIND[ord("A"):ord("Z") + 1] = 2
_KIND[ord("0"):ord("9") + 1] = 3
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = 4
_KIND[[9, 11, 12, 13, 32]] = 5
_KIND[10] = 6
_PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
DENSE = 20


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _distinct_per_text(keys: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of distinct keys, share of the commonest) of each text."""
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    first = np.ones(len(k), bool)
    first[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(first)
    counts = np.diff(np.append(at, len(k)))
    most = np.zeros(texts)
    np.maximum.at(most, o[at], counts)
    return np.bincount(o[at], minlength=texts), most


def features(texts: pa.Array) -> np.ndarray:
    """Style of every whole text: kinds of characters, shapes and repetition of words and lines, tails of punctuation.

    Nothing depends on which words there are. Null and empty texts are zeros.
    """
    count = len(texts)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    distinct, codes, offsets = words.split(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + count + 1]
    body = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0]:ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    kinds = _KIND[body]
    size = np.maximum(np.diff(ends), 1)
    out = np.zeros((count, DENSE + TAILS), np.float32)
    for k in range(7):
        out[:, k] = _sums(kinds == k, ends - ends[0]) / size
    n = np.diff(offsets)
    some = np.maximum(n, 1)
    owner = np.repeat(np.arange(count), n)
    shape = np.zeros((max(len(distinct), 1), 5), np.float32)
    tails = np.zeros(max(len(distinct), 1), np.int64)
    for i, w in enumerate(distinct):
        bare = w.rstrip(_PUNCTUATION)
        shape[i] = len(w), w.isupper(), not bare, bare.isalpha(), len(w) > 30
        if len(bare) != len(w):
            tails[i] = 1 + zlib.crc32(w[len(bare):].encode()) % (TAILS - 1)
    out[:, 7:12] = _sums(shape[codes], offsets) / some[:, None]
    out[:, 12] = np.log1p(n) / 10
    types, most = _distinct_per_text(codes, owner, count)
    out[:, 13], out[:, 14] = types / some, most / some
    same = np.zeros(len(codes))
    same[1:] = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    out[:, 15] = _sums(same, offsets) / some
    pair = codes[:-1] * len(distinct) + codes[1:]
    inner = owner[1:] == owner[:-1]
    pairs, _ = _distinct_per_text(pair[inner], owner[1:][inner], count)
    out[:, 16] = np.where(n > 1, pairs / np.maximum(n - 1, 1), 0)
    lines = pc.split_pattern(texts, "\n")
    flat = lines.flatten().dictionary_encode()
    line_ends = np.asarray(lines.offsets, np.int64) - lines.offsets[0].as_py()
    line_owner = np.repeat(np.arange(count), np.diff(line_ends))
    kept, _ = _distinct_per_text(np.asarray(flat.indices, np.int64), line_owner, count)
    out[:, 17] = 1 - kept / np.maximum(np.diff(line_ends), 1)
    out[:, 18] = types / np.sqrt(some) / 10
    out[:, 19] = n > 0
    tail_counts = np.bincount(owner * TAILS + tails[codes], minlength=count * TAILS).reshape(count, TAILS) if len(codes) else np.zeros((count, TAILS))
    out[:, DENSE:] = np.sqrt(tail_counts / some[:, None])
    return out


@dataclasses.dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.tanh(z @ self.weights["w"] + self.weights["b"]) @ self.weights["v"] + self.weights["c"]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x).astype(np.float64)[:, 0])


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Minimise the non-negative unbiased risk with logistic loss. Without positives every score is the prior."""
    prior = float(np.clip(prior, 0.01, 0.99))
    both = np.concatenate((positive, unlabelled))
    width = positive.shape[1]
    draw = np.random.default_rng(seed)
    model = Model(both.mean(axis=0) if len(both) else np.zeros(width), (both.std(axis=0) if len(both) else np.zeros(width)) + 1e-3, {
        "w": draw.normal(0, width ** -0.5, (width, HIDDEN)), "b": np.zeros(HIDDEN), "v": draw.normal(0, HIDDEN ** -0.5, (HIDDEN, 1)),
        "c": np.full(1, np.log(prior / (1 - prior)))}, prior)
    if not len(positive) or not len(unlabelled):
        model.weights["v"][:] = 0
        return model
    z = np.clip((both - model.mean) / model.scale, -6, 6)
    p, u = z[:len(positive)], z[len(positive):]
    optimiser = Adam(model.weights, RATE, 1e-4)
    share = BATCH / max(len(p), len(u), BATCH)
    for _ in range(epochs):
        p_order, u_order = draw.permutation(len(p)), draw.permutation(len(u))
        steps = max(1, round(1 / share))
        for k in range(steps):
            xp = p[p_order[k * len(p) // steps:(k + 1) * len(p) // steps]]
            xu = u[u_order[k * len(u) // steps:(k + 1) * len(u) // steps]]
            if not len(xp) or not len(xu):
                continue
            x = np.concatenate((xp, xu))
            hidden = np.tanh(x @ model.weights["w"] + model.weights["b"])
            chance = sigmoid(hidden @ model.weights["v"] + model.weights["c"])
            fp, fu = chance[:len(xp)], chance[len(xp):]
            negative = -np.log1p(-np.minimum(fu, 1 - 1e-9)).mean() + prior * np.log1p(-np.minimum(fp, 1 - 1e-9)).mean()
            slope = np.zeros_like(chance)
            if negative >= 0:
                slope[:len(xp)] = (prior * (fp - 1) - prior * fp) / len(xp)
                slope[len(xp):] = fu / len(xu)
            else:  # the risk of the negatives went below zero: walk back on it alone
                slope[:len(xp)] = prior * fp / len(xp)
                slope[len(xp):] = -fu / len(xu)
            back = slope @ model.weights["v"].T * (1 - hidden ** 2)
            optimiser.step({"w": x.T @ back, "b": back.sum(axis=0), "v": hidden.T @ slope, "c": slope.sum(axis=0)})
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in words.slices(batch, "text"):
            x = features(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "x"])


def train(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality",
          prior: float | None = None, most: int = SAMPLE) -> Model:
    """Fit on the labelled positives and the unlabelled texts among about `most` documents, chosen by a hash of their ids.

    `labels` are the rows that may be learnt from. Labels of 0 serve the class prior alone, the share of 1 among labels, where `prior`
    isn't given. The unlabelled side is all of them, whatever their labels, so the prior is that of the same population. Ids in `labels` without a document, and documents without id, play no part.
    """
    plain = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    known = one_label(labels, id_column, label_column)
    if prior is None:
        seen = known.agg(F.sum("label").alias("ones"), F.count(F.lit(1)).alias("n")).first()
        prior = ((seen["ones"] or 0) + 1) / (seen["n"] + 2)
    chosen = sample(plain, "id", most, "quality").mapInArrow(_features, "id long, x binary")
    rows = chosen.join(known, "id", "left").select((F.coalesce("label", F.lit(0)) == 1).alias("positive"), "id", "x").toPandas().sort_values("id", kind="stable")
    x = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(-1, DENSE + TAILS).astype(np.float64)
    positive = rows["positive"].to_numpy(bool)
    return fit(x[positive], x, prior)


def _score(batches: Iterator[pa.RecordBatch], model: Model, column: str, keep: list[str], name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in words.slices(batch, column):
            yield part.select(keep).append_column(name, pa.array(model.scores(features(part.column(column)))))


def score(documents: DataFrame, model: Model, text_column: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """`documents` (or its columns `keep`) with a score from 0 to 1 of every whole text, empty and null ones included.

    A column named like the result is replaced. One scan without a shuffle; repeated rows are scored each; an empty table stays empty.
    """
    keep = documents.columns if keep is None else keep
    name = unused(keep, out)
    kinds = T.StructType([*(documents.schema[c] for c in keep), T.StructField(name, T.DoubleType())])
    scored = words.small_batches(documents).mapInArrow(lambda b: _score(b, model, text_column, keep, name), kinds)
    return scored if name == out else scored.withColumn(out, F.col(name)).drop(name)
