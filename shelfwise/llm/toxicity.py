"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word comes in twice: as itself (a hashed embedding) and by its characters (means of hashed embeddings of its byte n-grams and of its beginnings).
The network reads windows of words in both directions, attention weighs its states, and a text scores as its worst window. All windows
of a text are scored, each overlapping the next by half, so a single insult in a long text counts as much as in a short one.
"""

from __future__ import annotations

import dataclasses
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from . import words
from .training import Adam, one_label, sample, sigmoid, unused

#: Texts that a training sample holds at most, about, of each label, and their bytes altogether; training is one task.
SAMPLE, SAMPLE_BYTES = 3_000, 64 << 20
WINDOW, STRIDE = 32, 16
DIMENSION, HIDDEN = 4, 8
ROUNDS, BATCH, RATE, EMBEDDING_RATE = 5, 128, 0.01, 0.005
#: Steps of a round at least; few texts are gone through several times.
LEAST_STEPS = 40
#: Share of labels taken as wrong: words of some toxic texts are lost, and the network shouldn't learn such texts by heart.
SMOOTH = 0.05
#: Windows that a task scores at once, and distinct words up to which it computes the inputs of all windows' words beforehand.
TOGETHER, AT_ONCE = 4096, 50_000
#: Words whose rows are looked up at once.
SOME_WORDS = 20_000
#: Weight of the overall share of toxic texts, in texts, against a row's own counts.
SHRINK = 4.0

_PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


@dataclasses.dataclass
class Rows:
    """Embedding rows of words: those of word i at rows[starts[i]:starts[i + 1]], at least one each."""

    rows: np.ndarray
    starts: np.ndarray

    def of(self, which: np.ndarray) -> Rows:
        count = np.diff(self.starts)[which]
        return Rows(self.rows[words.ranges(self.starts[which], count)], np.concatenate(([0], np.cumsum(count))))


#: Each embedding's number of rows; an input is the concatenation of their means.
TABLES = {"word": 1 << 15, "gram": 1 << 16, "front": 1 << 16}
Lexicon = dict[str, Rows]


def lexicon(distinct: list[str]) -> Lexicon:
    """The rows of all words, found for some of them at a time."""
    parts = [_lexicon(distinct[i:i + SOME_WORDS]) for i in range(0, len(distinct), SOME_WORDS)] or [_lexicon([])]
    out = {}
    for name in TABLES:
        ends = np.cumsum([0, *(len(p[name].rows) for p in parts)])
        starts = [p[name].starts[:-1] + end for p, end in zip(parts, ends)]
        out[name] = Rows(np.concatenate([p[name].rows for p in parts]), np.append(np.concatenate(starts), ends[-1]))
    return out


def _lexicon(distinct: list[str]) -> Lexicon:
    """A word's own row, those of its byte 3- and 5-grams, and those of its first 4 to 8 bytes.

    Punctuation around a word is dropped, unless it is all there is; words are marked at both ends.
    """
    bare = [w.strip(_PUNCTUATION) or w for w in distinct]
    encoded = [w.encode() for w in bare]
    flat = np.frombuffer(b"\x01" + b"\x01\x01".join(encoded) + b"\x01", np.uint8).astype(np.uint64)
    size_of = np.fromiter(map(len, encoded), np.int64, len(encoded)) + 2  # with a mark at both ends; words may hold the mark's byte too
    end = np.cumsum(size_of)
    begin = end - size_of
    owner = np.repeat(np.arange(len(bare)), size_of)
    hashes, owners = [], []
    for size in (3, 5):
        n = max(len(flat) - size + 1, 0)
        h = np.full(n, size, np.uint64)
        for k in range(size):
            h = h * np.uint64(0x100000001B3) ^ flat[k:k + n]
        good = owner[:n] == owner[size - 1:size - 1 + n]
        hashes.append(h[good])
        owners.append(owner[:n][good])
    own = np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    grams = Rows(_slots(np.concatenate(hashes)[order], "gram"), np.searchsorted(own[order], np.arange(len(bare) + 1)))
    h = np.full(len(bare), 99, np.uint64)
    front = []
    for k in range(9):
        at = begin + k
        h = np.where(at < end, h * np.uint64(0x100000001B3) ^ flat[np.minimum(at, len(flat) - 1)], h)
        if k >= 4:
            front.append(h)
    fronts = Rows(_slots(np.stack(front, axis=1).ravel(), "front"), np.arange(len(bare) + 1) * len(front))
    return {"word": Rows(_slots(words.word_hashes(bare), "word"), np.arange(len(bare) + 1)), "gram": grams, "front": fronts}


def _slots(hashes: np.ndarray, table: str) -> np.ndarray:
    return (words.mix(hashes) % np.uint64(TABLES[table])).astype(np.int32)


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, length) of all windows; a text without words has none, its last window ends with it."""
    n = np.diff(offsets)
    count = np.where(n == 0, 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)))
    owner = np.repeat(np.arange(len(n)), count)
    first = words.ranges(np.zeros(len(n), np.int64), count) * STRIDE
    return owner, offsets[owner] + first, np.minimum(WINDOW, n[owner] - first)


def _mean_rows(table: np.ndarray, own: Rows) -> np.ndarray:
    out = np.empty((len(own.starts) - 1, table.shape[1]), np.float32)
    for i in range(0, len(out), SOME_WORDS):
        starts = own.starts[i:i + SOME_WORDS + 1]
        sums = np.add.reduceat(table[own.rows[starts[0]:starts[-1]]], starts[:-1] - starts[0], axis=0)
        out[i:i + SOME_WORDS] = sums / np.diff(starts)[:, None]
    return out


class Network:
    """Weights by name: word, gram, front (embeddings); per direction u (input), r (recurrent), z (bias); attention a, q; output o, c."""

    def __init__(self, seed: int = 11) -> None:
        draw = np.random.default_rng(seed)
        normal = lambda *shape, by: draw.normal(0, by, shape).astype(np.float32)
        width = len(TABLES) * DIMENSION
        self.weights = {name: normal(rows, DIMENSION, by=0.05) for name, rows in TABLES.items()}
        self.weights |= {"a": normal(2 * HIDDEN, HIDDEN, by=0.3), "q": normal(HIDDEN, 1, by=0.3), "o": normal(2 * HIDDEN, 1, by=0.3),
                        "c": np.zeros(1, np.float32), "fit": np.array([1.0, 0.0], np.float32)}
        for way in "fb":
            self.weights |= {f"u{way}": normal(width, 3 * HIDDEN, by=width ** -0.5), f"r{way}": normal(HIDDEN, 3 * HIDDEN, by=HIDDEN ** -0.5),
                             f"z{way}": np.zeros(3 * HIDDEN, np.float32)}

    def inputs(self, lex: Lexicon) -> np.ndarray:
        return np.concatenate([_mean_rows(self.weights[name], lex[name]) for name in TABLES], axis=1)

    def _run(self, way: str, projected: np.ndarray, index: np.ndarray, length: np.ndarray, keep: list | None) -> np.ndarray:
        """States (step, window, hidden) of one direction; windows are sorted by length, longest first, so live ones are a prefix."""
        r, h = self.weights[f"r{way}"], HIDDEN
        states = np.zeros((index.shape[0], index.shape[1], h), np.float32)
        state = np.zeros((index.shape[1], h), np.float32)
        steps = range(index.shape[0]) if way == "f" else range(index.shape[0] - 1, -1, -1)
        for t in steps:
            live = int(np.searchsorted(-length, -t, side="left"))
            before = state[:live]
            x = projected[index[t, :live]]
            linear = before @ r
            gates = sigmoid(x[:, :2 * h] + linear[:, :2 * h])
            new = np.tanh(x[:, 2 * h:] + gates[:, :h] * linear[:, 2 * h:])
            after = new + gates[:, h:] * (before - new)
            if keep is not None:
                keep.append((t, live, before.copy(), gates, new, linear[:, 2 * h:]))
            state[:live] = after
            states[t, :live] = after
        return states

    def forward(self, x: np.ndarray, index: np.ndarray, length: np.ndarray, projected: dict[str, np.ndarray] | None = None,
                keep: dict | None = None) -> np.ndarray:
        """Logits of windows: index (step, window) into words, of which only the first length[i] of window i count."""
        w = self.weights
        projected = projected or self.project(x)
        both = []
        for way in "fb":
            trace = None if keep is None else keep.setdefault(way, [])
            both.append(self._run(way, projected[way], index, length, trace))
        states = np.concatenate(both, axis=2)
        energy = np.tanh(states @ w["a"])
        weight = (energy @ w["q"])[:, :, 0]
        weight[np.arange(index.shape[0])[:, None] >= length[None, :]] = -1e9
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", weight, states)
        if keep is not None:
            keep |= {"states": states, "energy": energy, "weight": weight, "pooled": pooled}
        return (pooled @ w["o"] + w["c"])[:, 0]

    def project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {way: x @ self.weights[f"u{way}"] + self.weights[f"z{way}"] for way in "fb"}

    def backward(self, x: np.ndarray, index: np.ndarray, length: np.ndarray, keep: dict, slope: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the dense weights, and of the inputs of every word."""
        w, h, out = self.weights, HIDDEN, {}
        states, energy, weight, pooled = keep["states"], keep["energy"], keep["weight"], keep["pooled"]
        out["o"], out["c"] = pooled.T @ slope[:, None], slope.sum(keepdims=True)
        to_pooled = slope[:, None] * w["o"][:, 0]
        to_weight = np.einsum("bh,tbh->tb", to_pooled, states)
        to_score = weight * (to_weight - (weight * to_weight).sum(axis=0))
        to_energy = to_score[:, :, None] * w["q"][:, 0] * (1 - energy ** 2)
        out["q"] = np.einsum("tbh,tb->h", energy, to_score)[:, None]
        out["a"] = np.einsum("tbi,tbj->ij", states, to_energy)
        to_states = weight[:, :, None] * to_pooled + to_energy @ w["a"].T
        to_x = np.zeros_like(x)
        for way, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            r, u = w[f"r{way}"], w[f"u{way}"]
            to_r, to_u, to_z = np.zeros_like(r), np.zeros_like(u), np.zeros_like(w[f"z{way}"])
            carry = np.zeros((index.shape[1], h), np.float32)
            for t, live, before, gates, new, linear in reversed(keep[way]):
                total = carry[:live] + to_states[t, :live, part]
                reset, update = gates[:, :h], gates[:, h:]
                to_new = total * (1 - update) * (1 - new ** 2)
                to_update = total * (before - new) * update * (1 - update)
                to_reset = to_new * linear * reset * (1 - reset)
                gate = np.concatenate((to_reset, to_update, to_new), axis=1)
                recurrent = np.concatenate((to_reset, to_update, to_new * reset), axis=1)
                to_r += before.T @ recurrent
                to_z += gate.sum(axis=0)
                own = index[t, :live]
                to_u += x[own].T @ gate
                np.add.at(to_x, own, gate @ u.T)
                carry[:live] = total * update + recurrent @ r.T
            out |= {f"r{way}": to_r, f"u{way}": to_u, f"z{way}": to_z}
        return out, to_x

    def window_logits(self, lex: Lexicon, codes: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        few = len(lex["word"].starts) <= AT_ONCE
        x = self.inputs(lex) if few else None
        projected = self.project(x) if few else None
        order = np.argsort(-length, kind="stable")
        out = np.zeros(len(first), np.float32)
        for k in range(0, len(order), TOGETHER):
            own = order[k:k + TOGETHER]
            index = _index(codes, first[own], length[own])
            if few:
                out[own] = self.forward(x, index, length[own], projected)
                continue
            used, index_flat = np.unique(index, return_inverse=True)
            out[own] = self.forward(self.inputs({name: rows.of(used) for name, rows in lex.items()}), index_flat.reshape(index.shape), length[own])
        return out

    def text_logits(self, texts: pa.Array) -> np.ndarray:
        """Each text's worst window; minus infinity without words."""
        distinct, codes, offsets = words.split(texts, lower=True)
        out = np.full(len(texts), -np.inf)
        if distinct:
            owner, first, length = windows(offsets)
            np.maximum.at(out, owner, self.window_logits(lexicon(distinct), codes, first, length))
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        logits = self.text_logits(texts)
        slope, shift = self.weights["fit"].astype(np.float64)
        return np.where(np.isfinite(logits), sigmoid(slope * np.where(np.isfinite(logits), logits, 0) + shift), 0.0)


def _index(codes: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """(step, window) word numbers; steps past a window's end repeat its first word and aren't read."""
    step = np.arange(int(length.max()))[:, None]
    return codes[np.where(step < length, first + step, first)]


def _odds(own: Rows, codes: np.ndarray, offsets: np.ndarray, toxic: np.ndarray, size: int) -> np.ndarray:
    """Log odds of toxicity of the texts that have a row, less the overall ones; rare rows are drawn to zero. Texts go in a few at a time."""
    ones, both = np.zeros(size), np.zeros(size)
    words_known = len(own.starts) - 1
    for start in range(0, len(toxic), 64):
        ends = offsets[start:start + 65]
        text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        seen = np.unique(text * words_known + codes[ends[0]:ends[-1]])
        rows = own.of(seen % words_known)
        pairs = np.unique(np.repeat(seen // words_known, np.diff(rows.starts)) * size + rows.rows.astype(np.int64))
        both += np.bincount(pairs % size, minlength=size)
        ones += np.bincount(pairs[toxic[start:start + 64][pairs // size]] % size, minlength=size)
    share = toxic.mean()
    chance = (ones + SHRINK * share) / (both + SHRINK)
    return np.log(chance / (1 - chance)) - np.log(share / (1 - share))


class Encoded:
    """Texts as codes of words, encoded some at a time; their strings aren't kept, but for those of distinct words."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.codes: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def add(self, texts: pa.Array) -> None:
        distinct, codes, offsets = words.split(texts, lower=True)
        place = np.fromiter((self.known.setdefault(w, len(self.known)) for w in distinct), np.int32, len(distinct))
        self.codes.append(place[codes])
        self.sizes.append(np.diff(offsets))

    def in_order(self, order: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(distinct words by code, codes, offsets of texts), the texts in the order given; what was added is let go."""
        sizes, codes = np.concatenate(self.sizes), np.concatenate(self.codes)
        starts = np.cumsum(sizes) - sizes
        codes = codes[words.ranges(starts[order], sizes[order])]
        distinct = list(self.known)
        self.__init__()
        return distinct, codes, np.concatenate(([0], np.cumsum(sizes[order])))


def fit(texts: list[str], toxic: np.ndarray, rounds: int = ROUNDS, seed: int = 11) -> Network:
    """Train on whole texts whose labels say only that some window is toxic."""
    encoded = Encoded()
    encoded.add(pa.array(texts, pa.large_string()))
    return fit_encoded(encoded, np.arange(len(texts)), toxic, rounds, seed)


def fit_encoded(encoded: Encoded, order: np.ndarray, toxic: np.ndarray, rounds: int = ROUNDS, seed: int = 11) -> Network:
    """Each round takes every text's worst window so far (by its words' odds at first), and a random one of texts that aren't toxic.

    Without texts of both labels every score is near the share of toxic ones. Texts are taken in `order`, toxic is in that order.
    """
    net = Network(seed)
    distinct, codes, offsets = encoded.in_order(order)
    owner, first, length = windows(offsets)
    if not toxic.any() or toxic.all() or not len(first):
        share = (toxic.sum() + 0.5) / (len(toxic) + 1)
        net.weights["fit"][:] = 0, np.log(share / (1 - share))
        return net
    lex = lexicon(distinct)
    del distinct
    for name, size in TABLES.items():  # the first dimension of each embedding starts from the odds of its rows
        net.weights[name][:, 0] = _odds(lex[name], codes, offsets, toxic, size)
    by_word = net.inputs(lex)[:, ::DIMENSION].sum(axis=1)
    draw = np.random.default_rng(seed)
    logits = np.full(len(first), -1e9, np.float32)
    for t in range(int(length.max())):
        live = length > t
        logits[live] = np.maximum(logits[live], by_word[codes[first[live] + t]])
    optimiser = Adam({k: v for k, v in net.weights.items() if k not in TABLES}, RATE, 1e-3)
    moment = {name: np.zeros((rows, 1), np.float32) for name, rows in TABLES.items()}
    for _ in range(rounds):
        worst = np.lexsort((logits, owner))
        worst = worst[np.append(owner[worst][1:] != owner[worst][:-1], True)]
        other = draw.integers(0, len(first), len(worst))
        chosen = np.concatenate((worst, other[~toxic[owner[other]]]))
        passes = -(-LEAST_STEPS * BATCH // max(len(chosen), BATCH))
        order = np.concatenate([draw.permutation(chosen) for _ in range(passes)])
        for part in np.array_split(order, max(1, len(order) // BATCH)):
            part = part[np.argsort(-length[part], kind="stable")]
            index = _index(codes, first[part], length[part])
            used, index_flat = np.unique(index, return_inverse=True)
            small = {name: lex[name].of(used) for name in TABLES}
            keep: dict = {}
            x, index = net.inputs(small), index_flat.reshape(index.shape)
            chance = sigmoid(net.forward(x, index, length[part], None, keep))
            target = SMOOTH + (1 - 2 * SMOOTH) * toxic[owner[part]]
            slope = ((chance - target) / len(part)).astype(np.float32)
            gradients, to_x = net.backward(x, index, length[part], keep, slope)
            optimiser.step(gradients)
            for i, (name, rows) in enumerate(small.items()):
                count = np.diff(rows.starts)
                change = np.repeat(to_x[:, i * DIMENSION:(i + 1) * DIMENSION] / count[:, None], count, axis=0)
                where, back = np.unique(rows.rows, return_inverse=True)
                sums = np.zeros((len(where), DIMENSION), np.float32)
                np.add.at(sums, back, change)
                moment[name][where] += (sums ** 2).mean(axis=1, keepdims=True)
                net.weights[name][where] -= EMBEDDING_RATE * sums / (np.sqrt(moment[name][where]) + 1e-6)
        logits = net.window_logits(lex, codes, first, length)
    most = np.full(len(toxic), -np.inf)
    np.maximum.at(most, owner, logits)
    _calibrate(net, most, toxic)
    return net


def _calibrate(net: Network, most: np.ndarray, toxic: np.ndarray) -> None:
    """A slope and shift that turn a text's worst logit into a chance, labels weighed alike."""
    known = np.isfinite(most)
    y, x = toxic[known].astype(float), most[known]
    if not 0 < y.sum() < len(y):
        return
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, optimiser = {"fit": np.array([1.0, 0.0])}, None
    optimiser = Adam(w, 0.05)
    for _ in range(400):
        gap = (sigmoid(w["fit"][0] * x + w["fit"][1]) - y) * weight
        optimiser.step({"fit": np.array([(gap * x).sum() + 1e-4 * w["fit"][0], gap.sum()])})
    net.weights["fit"][:] = max(w["fit"][0], 0.05), w["fit"][1]


def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weights of a network fitted on all rows of the task, whatever order they come in."""
    encoded, ids, labels, hashes = Encoded(), [], [], []
    for batch in batches:
        texts = batch.column("text").cast(pa.large_string())
        encoded.add(texts)
        ids.append(batch.column("id").to_numpy())
        labels.append(batch.column("label").to_numpy())
        hashes.append(words.word_hashes(["" if t is None else t for t in texts.to_pylist()]))
    if not ids:
        encoded.add(pa.array([], pa.large_string()))
        ids, labels, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)]
    label = np.concatenate(labels)
    order = np.lexsort((label, np.concatenate(hashes), np.concatenate(ids)))
    net = fit_encoded(encoded, order, label[order] == 1)
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net.weights)], pa.binary())], ["weights"])


def train(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic",
          most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Network:
    """Fit on about `most` labelled whole texts of each label, about `most_bytes` of them, chosen by a hash of their ids.

    `labels` are the rows that may be learnt from; ids without a document and documents without id play no part. One task fits on the
    sample, so that a lost executor repeats it, and only the weights come to the driver.
    """
    known = one_label(labels, id_column, label_column)
    plain = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))

    def drawn(share: float) -> DataFrame:
        parts = [sample(known.where(F.col("label") == label), "id", int(most * share), "toxicity") for label in (0, 1)]
        return cut(words.small_batches(plain.join(F.broadcast(parts[0].unionByName(parts[1])), "id")))

    rows = drawn(1.0)
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    if size > most_bytes:
        rows = drawn(most_bytes / size)
    weights = rows.repartition(1).mapInArrow(_fit_task, "weights binary").first()["weights"]
    net = Network()
    net.weights = pickle.loads(weights)
    return net


def _score(batches: Iterator[pa.RecordBatch], net: Network, column: str, keep: list[str], name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in words.slices(batch, column):
            yield part.select(keep).append_column(name, pa.array(net.scores(part.column(column)), pa.float64()))


def score(documents: DataFrame, net: Network, text_column: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """`documents` (or its columns `keep`) with a score from 0 to 1 of every whole text; texts without words, and null ones, have 0.

    A column named like the result is replaced. One scan without a shuffle; repeated rows are scored each; an empty table stays empty.
    """
    keep = documents.columns if keep is None else keep
    name = unused(keep, out)
    kinds = T.StructType([*(documents.schema[c] for c in keep), T.StructField(name, T.DoubleType())])
    scored = words.small_batches(documents).mapInArrow(lambda b: _score(b, net, text_column, keep, name), kinds)
    return scored if name == out else scored.withColumn(out, F.col(name)).drop(name)
