"""Near-duplicate vectors through an inverted multi-index.

Unit vectors are cut in halves, each half has a codebook of its own, and a vector lives in one cell of the product grid. From there a
vector also visits the cells nearest to it, in the order of the multi-sequence traversal (least sum of both halves' distances first), as
far as vectors at the threshold of similarity were found when the grid was fitted. Members and visitors of a cell are then compared exactly.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..session import cut
from . import vectors

#: Vectors that the codebooks are fitted on at most, and those that the traversal's reach is set with.
SAMPLE, PROBED = 20_000, 400
#: Members that a cell should have on average, and most centres of a half.
MEMBERS, MOST_CENTRES = 48, 1024
#: Share of pairs at the threshold that are found, that is, reached by either side's traversal.
RECALL = 0.99
#: Rows of a cell compared at once in a task.
TILE = 2048
#: Crowded cells that are broadcast; with more, cells are joined with their sizes by a shuffle.
BROADCAST_CELLS = 200_000
ROUNDS = 12


def _far(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, each computed alike whatever else is in the batch."""
    out = np.empty((len(x), len(centres)))
    for k, centre in enumerate(centres):
        out[:, k] = ((x - centre) ** 2).sum(axis=1)
    return out


def _centres(x: np.ndarray, count: int, draw: np.random.Generator) -> np.ndarray:
    centres = x[draw.choice(len(x), count, replace=len(x) < count)]
    for _ in range(ROUNDS):
        near = (x @ centres.T - 0.5 * (centres ** 2).sum(axis=1)).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        size = np.bincount(near, minlength=count)[:, None]
        centres = np.where(size > 0, sums / np.maximum(size, 1), centres)
    return centres


@dataclasses.dataclass
class Grid:
    """Two codebooks, the split point, and how far beyond its nearest cell a vector's traversal goes."""

    left: np.ndarray
    right: np.ndarray
    half: int
    reach: float

    def excess(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances to the centres of both halves, beyond the nearest's."""
        a, b = _far(x[:, :self.half], self.left), _far(x[:, self.half:], self.right)
        return a - a.min(axis=1, keepdims=True), b - b.min(axis=1, keepdims=True)

    def home(self, x: np.ndarray) -> np.ndarray:
        a, b = self.excess(x)
        return a.argmin(axis=1) * len(self.right) + b.argmin(axis=1)

    def traverse(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Cells of one vector whose summed excess is within reach, nearest first."""
        rows, columns = np.flatnonzero(a <= self.reach), np.flatnonzero(b <= self.reach)
        total = a[rows][:, None] + b[columns]
        inside = total <= self.reach
        cells = (rows[:, None] * len(self.right) + columns)[inside]
        return cells[np.argsort(total[inside], kind="stable")]


def _from(grid: Grid, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How far x's traversal must go to reach y's cell."""
    (a, b), home = grid.excess(x), grid.home(y)
    return a[np.arange(len(x)), home // len(grid.right)] + b[np.arange(len(x)), home % len(grid.right)]


def fit(sample: np.ndarray, rows: int, threshold: float, recall: float = RECALL, seed: int = 5) -> Grid:
    """Codebooks by k-means; the reach covers `recall` of pairs made at the threshold, from one side or the other.

    Pairs are made to differ in both halves and in either alone, and the hardest kind counts."""
    draw = np.random.default_rng(seed)
    half = max(sample.shape[1] // 2, 1)
    count = int(np.clip(round((rows / MEMBERS) ** 0.5), 1, min(MOST_CENTRES, max(len(sample) // 8, 1))))
    right = sample[:, half:] if sample.shape[1] > 1 else np.zeros((len(sample), 1))
    grid = Grid(_centres(sample[:, :half], count, draw), _centres(right, count, draw), half, 0.0)
    if sample.shape[1] == 1:
        grid.reach = float("inf")
        return grid
    at = sample[draw.permutation(len(sample))[:PROBED]]
    needed = [0.0]
    for part in (slice(None), slice(0, half), slice(half, None)):
        noise = np.zeros_like(at)
        noise[:, part] = draw.normal(size=at[:, part].shape)
        noise -= (noise * at).sum(axis=1, keepdims=True) * at
        size = np.sqrt((noise ** 2).sum(axis=1, keepdims=True))
        near = threshold * at + (1 - threshold ** 2) ** 0.5 * noise / np.maximum(size, 1e-12)
        needed.append(np.quantile(np.minimum(_from(grid, at, near), _from(grid, near, at)), recall))
    grid.reach = float(max(needed)) + 1e-9
    return grid


def _spread(batches: Iterator[pa.RecordBatch], grid: Grid, length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            a, b = grid.excess(vectors.unit(vectors.matrix(part.column("vector"), length)))
            home = a.argmin(axis=1) * len(grid.right) + b.argmin(axis=1)
            visits = [grid.traverse(x, y) for x, y in zip(a, b)]
            size = np.fromiter(map(len, visits), np.int64, len(visits))
            cells, own = np.concatenate(visits), np.repeat(np.arange(len(visits)), size)
            taken = part.take(pa.array(own))
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(cells == home[own]), taken.column("node"), taken.column("weight"), taken.column("vector")],
                                             ["cell", "member", "node", "weight", "vector"])


def _union(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest labels after joining rows a[i] and b[i]; a label is the number of a row of its class."""
    while True:
        one, two = labels[a], labels[b]
        if (one == two).all():
            return labels
        low = np.minimum(one, two)
        np.minimum.at(labels, one, low)
        np.minimum.at(labels, two, low)
        while (labels[labels] != labels).any():
            labels = labels[labels]


def _compare(table: pa.Table, grid: Grid, length: int, threshold: float) -> pa.Table:
    """Links of one tile: each row's linked weight, and the smallest row its links in the tile lead to.

    A pair met in both rows' home cells counts in the smaller of the two.
    """
    table = table.combine_chunks().sort_by("node")
    ids, weight, block, member = (table.column(c).to_numpy() for c in ("node", "weight", "block", "member"))
    i, j, cell = (table.column(c)[0].as_py() for c in ("i", "j", "cell"))
    x = vectors.unit(vectors.matrix(table.column("vector"), length))
    a, b = grid.excess(x)
    home = a.argmin(axis=1) * len(grid.right) + b.argmin(axis=1)
    count, labels = np.zeros(len(ids), np.int64), np.arange(len(ids))
    inside = np.flatnonzero(member)
    for start in range(0, len(inside), 256):
        rows = inside[start:start + 256]
        one, two = np.nonzero(x[rows] @ x.T >= threshold)
        one = rows[one]
        good = np.where(member[two], one < two, True) & (one != two)
        if i != j:
            good &= block[one] != block[two]
        one, two = one[good], two[good]
        away = home[two]
        back = ~member[two] & (a[one, away // len(grid.right)] + b[one, away % len(grid.right)] <= grid.reach)
        good = ~(back & (away < cell))
        one, two = one[good], two[good]
        np.add.at(count, one, weight[two])
        np.add.at(count, two, weight[one])
        labels = _union(labels, one, two)
    some = np.flatnonzero(count)
    return pa.table([pa.array(ids[some]), pa.array(count[some]), pa.array(ids[labels[some]])], ["node", "n", "root"])


def near_vectors(frame: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", threshold: float = 0.9,
                 recall: float = RECALL, tile: int = TILE) -> DataFrame:
    """(id, n_links, component_id, kept) of every row: links are pairs of vectors found with at least `threshold` cosine similarity.

    Cosines are computed in double precision. Null and empty vectors, zeros, and vectors with null or non-finite components link with
    nothing; vectors of different lengths don't link, each length that occurs has an index of its own. Equal vectors are compared once and
    count as often as there are; rows of one id and vector are so many links of each other. A row with a null id has null results but still
    counts for others. An empty table gives no rows. Cells hold `MEMBERS` vectors on average up to `MEMBERS * MOST_CENTRES ** 2` of
    them, and more beyond; large cells are compared in tiles, and no pair leaves its task.
    """
    rows = frame.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    good = vectors.usable(F.col("vector")) & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("vector", F.when(good, F.col("vector")))
    distinct = rows.where("vector is not null").groupBy("vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"))
    distinct = cut(distinct.withColumn("node", F.monotonically_increasing_id()))
    classes = None
    for length in vectors.lengths(distinct, "vector"):
        own = _classes(distinct.where(F.size("vector") == length), length, threshold, recall, tile)
        classes = own if classes is None else classes.unionByName(own)
    if classes is None:
        return rows.select(F.col("id").alias(id_column), *_results(F.lit(0), F.lit(None)))
    out = rows.select("id", F.when(F.col("vector").isNotNull(), _hashes("vector")).alias("hashes")).join(classes, "hashes", "left")
    return out.select(F.col("id").alias(id_column), *_results(F.col("n"), F.col("c")))


def _classes(distinct: DataFrame, length: int, threshold: float, recall: float, tile: int) -> DataFrame:
    """(hashes, n, c): links and component of every distinct vector of one length."""
    total = distinct.count()
    place = F.pmod(F.xxhash64("vector"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, SAMPLE / total))
    chosen = distinct.where(place).select("vector").sort("vector").collect() or distinct.select("vector").limit(1).collect()
    grid = fit(vectors.unit(np.array([r["vector"] for r in chosen])), total, threshold, recall)

    spread = distinct.select("node", "weight", "vector").mapInArrow(
        lambda b: _spread(b, grid, length), "cell long, member boolean, node long, weight long, vector array<double>")
    crowded = cut(spread.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > tile))
    crowded = F.broadcast(crowded) if crowded.count() <= BROADCAST_CELLS else crowded
    parts = F.coalesce(F.ceil(F.col("size") / tile), F.lit(1)).cast("int")
    tiled = (spread.join(crowded, "cell", "left").withColumn("block", F.pmod(F.xxhash64("node"), parts).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
             .select("cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "member", "node", "weight", "vector"))
    found = cut(tiled.groupBy("cell", "i", "j").applyInArrow(
        lambda t: _compare(t, grid, length, threshold), "node long, n long, root long"))
    settled = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = distinct.select("node", "id").join(settled, "node").groupBy("component").agg(F.min("id").alias("component_id"))
    named = settled.join(named, "component").select("node", "component_id")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    return distinct.join(counts, "node", "left").join(named, "node", "left").select(
        _hashes("vector").alias("hashes"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component_id", "id").alias("c"))


def _hashes(vector: str) -> Column:
    return F.struct(F.xxhash64(vector).alias("one"), F.xxhash64(F.lit("two"), vector).alias("two"))


def _results(links: Column, component: Column) -> list[Column]:
    known, own = F.col("id").isNotNull(), F.coalesce(component, F.col("id"))
    return [F.when(known, F.coalesce(links, F.lit(0))).cast("long").alias("n_links"), F.when(known, own).cast("long").alias("component_id"),
            F.when(known, F.col("id") == own).alias("kept")]
