"""Periodic runs of words: stretches that repeat with some period and can't be extended.

Every run has a Lyndon root: for one of the two orders of the words (as numbered, or the other way round), the longest Lyndon word that
begins at some place of the run is as long as the period. So the longest Lyndon words at all places, in both orders, are candidates, and each
is extended in both directions by longest common extensions. These are the depths of lowest common ancestors in two suffix trees
(Ukkonen), of the words and of their reversal, found in constant time as range minima over the trees' Euler tours.

A word of a run whose length is k periods or more stands in it k times at least. So words that occur less often in a stretch are in no run
of it; they cut it into shorter stretches, of which the same holds. What is left of ordinary text is next to nothing; trees are built on that.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words

#: A run's least length in words, and in periods.
LEAST_LENGTH, LEAST_EXPONENT = 6, 4
#: Entries of an Euler tour that share a block of the range minima.
BLOCK = 16


def stretches(codes: np.ndarray, offsets: np.ndarray, length: int, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, end) of the stretches that may hold runs, for all texts of a batch: text i is codes[offsets[i]:offsets[i + 1]]."""
    texts = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.arange(len(codes))
    size = int(codes.max()) + 1 if len(codes) else 1
    while len(at):
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | (np.diff(texts[at]) > 0)
        part = np.cumsum(new) - 1
        long = np.bincount(part)[part] >= length
        _, which, count = np.unique(part * size + codes[at], return_inverse=True, return_counts=True)
        good = long & (count[which] >= exponent)
        lost = len(at) - int(good.sum())
        if not lost:
            break
        at = at[good]
        if lost * 8 < len(good) and long.all():  # more rounds would find little; what is kept in vain only costs time
            break
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    first = np.flatnonzero(np.append(True, (np.diff(at) > 1) | (np.diff(texts[at]) > 0)))
    return texts[at[first]], at[first], at[np.append(first[1:], len(at)) - 1] + 1


class RangeMin:
    """Minima of ranges in constant time: of whole blocks by a sparse table, of their ends by running minima."""

    def __init__(self, values: np.ndarray) -> None:
        blocks = np.full(-(-len(values) // BLOCK) * BLOCK, np.iinfo(np.int32).max, np.int32)
        blocks[:len(values)] = values
        self.values = blocks
        blocks = blocks.reshape(-1, BLOCK)
        self.up_to = np.minimum.accumulate(blocks, axis=1).ravel()
        self.onward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [blocks.min(axis=1)]
        while (1 << len(self.table)) <= len(blocks):
            half = 1 << len(self.table) - 1
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minima from low to high, both included."""
        first, last = low // BLOCK, high // BLOCK
        out = np.minimum(self.onward[low], self.up_to[high])
        same = np.flatnonzero(first == last)
        inside = self.values[low[same]]
        for k in range(1, BLOCK):
            inside = np.minimum(inside, self.values[np.minimum(low[same] + k, high[same])])
        out[same] = inside
        between = np.flatnonzero(last - first > 1)
        width = last[between] - first[between] - 1
        level = np.frexp(width.astype(np.float64))[1] - 1
        for k in np.unique(level):
            own = between[level == k]
            table = self.table[k]
            out[own] = np.minimum(out[own], np.minimum(table[first[own] + 1], table[last[own] - (1 << int(k))]))
        return out


class SuffixTree:
    """Ukkonen's suffix tree of a list of numbers whose negative ones occur once each; the last is negative, so suffixes end in leaves."""

    def __init__(self, symbols: list[int]) -> None:
        self.symbols, size = symbols, len(symbols)
        begin, end, link, children = [0], [0], [0], [{}]  # an edge is named after the node below it
        node, edge, depth, open_suffixes = 0, 0, 0, 0
        for i, symbol in enumerate(symbols):
            unlinked = 0
            open_suffixes += 1
            while open_suffixes:
                if not depth:
                    edge = i
                below = children[node].get(symbols[edge])
                if below is None:
                    children[node][symbols[edge]] = len(begin)
                    begin.append(i)
                    end.append(size)
                    link.append(0)
                    children.append({})
                    link[unlinked] = node if unlinked else 0
                    unlinked = 0
                else:
                    long = end[below] - begin[below]
                    if depth >= long:
                        edge, depth, node = edge + long, depth - long, below
                        continue
                    other = symbols[begin[below] + depth]
                    if other == symbol:
                        link[unlinked] = node if unlinked else 0
                        depth += 1
                        break
                    middle = len(begin)
                    children[node][symbols[edge]] = middle
                    begin += (begin[below], i)
                    end += (begin[below] + depth, size)
                    link += (0, 0)
                    children += ({other: below, symbol: middle + 1}, {})
                    begin[below] += depth
                    link[unlinked] = middle if unlinked else 0
                    unlinked = middle
                open_suffixes -= 1
                if node:
                    node = link[node]
                elif depth:
                    depth -= 1
                    edge = i - open_suffixes + 1
        self.begin, self.end, self.children = begin, end, children

    def tour(self, descending: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(depths along the Euler tour, place in it of each suffix): children in the order of their symbols, negative symbols first."""
        begin, end, children, size = self.begin, self.end, self.children, len(self.symbols)
        key = (lambda s: s if s < 0 else size - s) if descending else None
        depths, place, above, todo = [0], [0] * size, [0], []
        todo.append(iter(self._ordered(0, key)))
        while todo:
            below = next(todo[-1], None)
            if below is None:
                todo.pop()
                above.pop()
                if above:
                    depths.append(above[-1])
                continue
            depth = above[-1] + end[below] - begin[below]
            if children[below]:
                depths.append(depth)
                above.append(depth)
                todo.append(iter(self._ordered(below, key)))
            else:
                place[size - depth] = len(depths)
                depths += (depth, above[-1])
        return np.array(depths, np.int32), np.array(place, np.int64)

    def _ordered(self, node: int, key) -> list[int]:
        own = self.children[node]
        return [own[s] for s in sorted(own, key=key)]


class Extensions:
    """How far the suffixes at two places agree."""

    def __init__(self, depths: np.ndarray, place: np.ndarray) -> None:
        self.minima, self.place = RangeMin(depths), place

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.place[i], self.place[j]
        return self.minima.of(np.minimum(a, b), np.maximum(a, b)).astype(np.int64)


def next_smaller(rank: list[int]) -> list[int]:
    """For each place the next one of smaller rank: where the longest Lyndon word that begins there ends."""
    size = len(rank)
    out = [size] * size
    for i in range(size - 2, -1, -1):
        j, own = i + 1, rank[i]
        while j < size and rank[j] > own:
            j = out[j]
        out[i] = j
    return out


def find_runs(parts: list[np.ndarray], length: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> list[np.ndarray]:
    """The runs of each stretch of a text, as rows (start within the stretch, length, smallest period) by start and period."""
    numbers = np.unique(np.concatenate(parts), return_inverse=True)[1]
    sizes = np.array([len(p) for p in parts])
    begins = np.cumsum(sizes + 1) - sizes - 1
    symbols = np.empty(int(sizes.sum()) + len(parts), np.int64)
    ends = begins + sizes
    inside = np.ones(len(symbols), bool)
    inside[ends] = False
    symbols[inside], symbols[ends] = numbers, -1 - np.arange(len(parts))  # a number of its own ends each stretch
    tree = SuffixTree(symbols.tolist())
    depths, place = tree.tour()
    forward = Extensions(depths, place)
    # the reversal's own last symbol lies below all others, so that the place after the first word exists there too
    backward = Extensions(*SuffixTree([*symbols[::-1].tolist(), -1 - len(parts)]).tour())
    found = []
    for order in (place, tree.tour(descending=True)[1]):
        i = np.flatnonzero(inside)
        j = np.array(next_smaller(order.tolist()), np.int64)[i]
        period = j - i
        left = backward.of(len(symbols) - i, len(symbols) - j)
        size = left + period + forward.of(i, j)
        good = size >= np.maximum(length, exponent * period)
        found.append(np.stack((i - left, size, period), axis=1)[good])
    runs = np.unique(np.concatenate(found), axis=0)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    owner = np.searchsorted(begins, runs[:, 0], side="right") - 1
    runs[:, 0] -= begins[owner]
    return [runs[owner == k] for k in range(len(parts))]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the most periods, compared as fractions; of equal ones the first, then that of the smaller period."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def _runs(batches: Iterator[pa.RecordBatch], length: int, exponent: int) -> Iterator[pa.RecordBatch]:
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    names = ("start", "length", "period")
    for whole in batches:
        for batch in words.slices(whole, "text"):
            distinct, codes, offsets = words.split(batch.column("text"))
            owner, begin, end = stretches(codes, offsets, length, exponent)
            by_text: dict[int, list[tuple[int, int]]] = {}
            for text, a, b in zip(owner.tolist(), begin.tolist(), end.tolist()):
                by_text.setdefault(text, []).append((a, b))
            runs: list[list[tuple[int, int, int]]] = [[] for _ in range(len(batch))]
            kept = np.ones(len(codes), bool)
            for text, places in by_text.items():
                for (a, _), rows in zip(places, find_runs([codes[a:b] for a, b in places], length, exponent)):
                    for start, size, period in rows.tolist():
                        runs[text].append((a - int(offsets[text]) + start, size, period))
                        kept[a + start + period:a + start + size] = False
            collapsed = [" ".join([distinct[c] for c in codes[a:b][kept[a:b]].tolist()]) for a, b in zip(offsets[:-1], offsets[1:])]
            best = [strongest(r) for r in runs]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.diff(offsets), pa.int64()), pa.array([[dict(zip(names, r)) for r in own] for own in runs], pa.list_(run)),
                 pa.array([b and dict(zip(names, b)) for b in best], run), pa.array(collapsed, pa.string())],
                names=["id", "n_words", "runs", "strongest", "collapsed"])


def periodic_runs(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LEAST_LENGTH,
                  exponent: int = LEAST_EXPONENT) -> DataFrame:
    """One row per row of `documents`: the id, n_words, runs, strongest, collapsed.

    runs lists (start, length, period) by start and period: stretches of words whose smallest period is `period`, at least `length` words and
    `exponent` (a whole number, 2 at least) periods long, which no word beside them extends. strongest is the one with the greatest length /
    period (then the first, then that of the smaller period), null without runs. collapsed is the text's words joined by spaces, without
    those that some run holds after its first period. A null or empty text has no words, no runs and an empty collapsed text;
    null ids stay null; repeated rows are read each; other columns are ignored; an empty table gives no rows.

    One scan without a shuffle. A task holds a slice of a batch, and trees of one text at a time, of its stretches that may hold runs.
    """
    if exponent < 2:
        raise ValueError("exponent must be 2 at least")
    run = "struct<start: bigint, length: bigint, period: bigint>"
    plain = words.small_batches(documents).select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    kinds = f"id {plain.schema['id'].dataType.simpleString()}, n_words long, runs array<{run}>, strongest {run}, collapsed string"
    return plain.mapInArrow(lambda b: _runs(b, length, exponent), kinds).withColumnRenamed("id", id_column)
