"""Mixing overlapping sources to target weights: a min-cost flow over membership patterns, then seeded selection.

Documents with the same set of sources are interchangeable to the flow, so only one row per set leaves the
cluster. The flow routes words from sets to the sources' quotas; each further repetition of a set costs more
than the one before. What a set gives is then turned into copies of documents chosen by a seeded hash.
"""

from __future__ import annotations

import dataclasses
import math
from collections import deque
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import cut

#: No document is taken more often than this; a repetition costs more than all before it.
MAX_COPIES = 3
#: Sets of sources that the driver solves for; more are refused, since they are meant to be metadata.
MAX_PATTERNS = 10_000
#: Documents of one set among which the last words of its share are chosen, on average, and most bins of one pass.
FINE, MOST_BINS = 128, 4096
#: Chosen documents up to which they are broadcast; beyond, they are joined by a shuffle.
BROADCAST_PICKS = 200_000


def in_order(sources: Iterable[str | None]) -> list[str | None]:
    """Sources by code point, null last."""
    return sorted(set(sources), key=lambda s: (s is None, s or ""))


def capped_targets(sizes: Sequence[int], weights: Sequence[float], cap: float) -> list[float]:
    """Shares of the total by weight, none above cap times its size; what a cap cuts off is shared again by weight."""
    out, open_, rest = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in sorted(open_) if rest * weights[i] / weight > cap * sizes[i]]
        for i in over or open_:
            out[i] = float(cap * sizes[i]) if over else rest * weights[i] / weight
        rest -= sum(out[i] for i in over)
        open_ = open_ - set(over) if over else set()
    return out


class _Network:
    """Augmenting paths over levels of a residual network."""

    def __init__(self, nodes: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.head: list[int] = []
        self.room: list[int] = []

    def arc(self, a: int, b: int, room: int) -> int:
        for start, end, free in ((a, b, room), (b, a, 0)):
            self.out[start].append(len(self.head))
            self.head.append(end)
            self.room.append(free)
        return len(self.head) - 2

    def saturate(self, start: int, end: int) -> None:
        """Send as much as fits, along shortest paths first."""
        while True:
            level = [-1] * len(self.out)
            level[start] = 0
            queue = deque([start])
            while queue:
                at = queue.popleft()
                for e in self.out[at]:
                    if self.room[e] and level[self.head[e]] < 0:
                        level[self.head[e]] = level[at] + 1
                        queue.append(self.head[e])
            if level[end] < 0:
                return
            turn = [0] * len(self.out)
            path: list[int] = []
            at = start
            while True:
                if at == end:
                    sent = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= sent
                        self.room[e ^ 1] += sent
                    path, at = [], start
                    continue
                while turn[at] < len(self.out[at]):
                    e = self.out[at][turn[at]]
                    if self.room[e] and level[self.head[e]] == level[at] + 1:
                        break
                    turn[at] += 1
                if turn[at] < len(self.out[at]):
                    path.append(self.out[at][turn[at]])
                    at = self.head[path[-1]]
                elif path:
                    at = self.head[path.pop() ^ 1]
                    turn[at] += 1
                else:
                    break


def route(patterns: Sequence[tuple[Sequence[int], int]], quotas: Sequence[int], max_copies: int = MAX_COPIES) -> list[int]:
    """Words that each pattern (source numbers, size) gives, so that quotas are met at least cost of repetition.

    Cost is paid per word by repetition alone and rises with it, the same for all patterns: paths through first
    copies are cheaper than any through second ones, so saturating the network repetition by repetition is the
    successive-shortest-path algorithm of min-cost flow.
    """
    start, end = len(patterns) + len(quotas), len(patterns) + len(quotas) + 1
    net = _Network(end + 1)
    for i, quota in enumerate(quotas):
        net.arc(len(patterns) + i, end, quota)
    for p, (members, size) in enumerate(patterns):
        for s in members:
            net.arc(p, len(patterns) + s, size * max_copies)
    used = [0] * len(patterns)
    for _ in range(max_copies):
        arcs = [net.arc(start, p, size) for p, (_, size) in enumerate(patterns)]
        net.saturate(start, end)
        for p, arc in enumerate(arcs):
            used[p] += net.room[arc ^ 1]
            net.room[arc] = net.room[arc ^ 1] = 0  # a longer repetition never takes words back from a shorter one
    return used


def word_count(text: Column) -> Column:
    """Words of a text, runs of other than space and U+0009 to U+000D; null has 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


@dataclasses.dataclass
class Mix:
    """What to take: per source its size and target, per pattern its copies, and the documents that get one more."""

    sources: DataFrame
    patterns: DataFrame
    picks: DataFrame
    few_picks: bool

    def decide(self, frame: DataFrame, key: str, size: str, sources: str, out: str = "copies") -> DataFrame:
        """`frame` with a column of the copies to take of each row; names of other columns don't matter."""
        pattern = frame.withColumn("__pattern", _pattern(F.col(sources))).withColumn("__key", F.col(key))
        picks = self.picks.select(F.col("pattern").alias("__p"), F.col("key").alias("__k"), F.col("size").alias("__s"))
        known = self.patterns.select(F.col("pattern").alias("__q"), "base", "bins", "edge")
        known = known.select("__q", *(F.col(c).alias(f"__{c}") for c in ("base", "bins", "edge")))
        joined = pattern.join(F.broadcast(known), F.col("__pattern").eqNullSafe(F.col("__q")), "left")
        joined = joined.join(F.broadcast(picks) if self.few_picks else picks,
                             F.col("__pattern").eqNullSafe(F.col("__p")) & F.col("__key").eqNullSafe(F.col("__k"))
                             & F.col(size).eqNullSafe(F.col("__s")), "left")
        below = _place(F.col("__key"), F.col(size)) < F.col("__edge")
        copies = F.coalesce(F.col("__base"), F.lit(0)) + (F.coalesce(below, F.lit(False)) | F.col("__p").isNotNull()).cast("int")
        return joined.select(*frame.columns, F.when(F.col(size) > 0, copies).otherwise(F.lit(0)).cast("int").alias(out))


def _pattern(sources: Column) -> Column:
    return F.coalesce(F.array_sort(F.array_distinct(sources)), F.array().cast("array<string>"))


def _place(key: Column, size: Column) -> Column:
    """A seeded place in [0, 1): rows with one key and size are taken alike."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("mix"), key, size), 11).cast("double") / F.lit(float(1 << 53))


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows of a pattern's last bin in seeded order; each that still fits is taken."""
    rows = rows.sort_values(["place", "key", "size"], kind="stable")
    left, taken = int(rows["left"].iloc[0]), []
    for total in rows["total"].tolist():
        taken.append(total <= left)
        left -= total if taken[-1] else 0
    rows = rows[taken]
    return rows[["p", "key", "size"]]


def plan_mix(frame: DataFrame, key: str, size: str, sources: str, weight_cycle: Sequence[float] = (5.0, 2.0, 1.0),
             max_copies: int = MAX_COPIES, fine: int = FINE) -> Mix:
    """Plan the mix of a table of (key, size, array of source names).

    Sources in order of code points, null last, weigh by the repeated cycle and share all words by weight, none
    above max_copies times its own; a document with several sources may serve any of them. Zero-sized rows are
    never taken; rows without sources neither; rows of one key, size and sources are taken alike; an empty table
    gives an empty mix. Selection depends on keys and sizes alone, so reruns agree whatever the partitions.
    """
    spark = frame.sparkSession
    narrow = cut(frame.select(F.col(key).cast("long").alias("key"), F.col(size).cast("long").alias("size"),
                              _pattern(F.col(sources)).alias("pattern")))
    sums = narrow.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).take(MAX_PATTERNS + 1)
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} sets of sources")
    names = in_order(s for row in sums for s in row["pattern"])
    number = {s: i for i, s in enumerate(names)}
    sums.sort(key=lambda row: [number[s] for s in row["pattern"]])
    members = [[number[s] for s in row["pattern"]] for row in sums]
    sizes = [0] * len(names)
    for own, row in zip(members, sums):
        for s in own:
            sizes[s] += row["size"]
    weights = [weight_cycle[i % len(weight_cycle)] for i in range(len(names))]
    total = sum(row["size"] for own, row in zip(members, sums) if own)
    targets = capped_targets(sizes, weights, max_copies) if sum(sizes) == total else _overlapping(sizes, weights, max_copies, total)
    used = route([(own, row["size"]) for own, row in zip(members, sums)], [math.floor(t + 0.5) for t in targets], max_copies)

    kind = T.StructType([T.StructField("p", T.IntegerType()), T.StructField("pattern", T.ArrayType(T.StringType())),
                         T.StructField("base", T.IntegerType()), T.StructField("left", T.LongType()), T.StructField("bins", T.IntegerType())])
    rows = [(p, row["pattern"], used[p] // max(row["size"], 1), used[p] % max(row["size"], 1), min(MOST_BINS, row["n"] // fine + 1))
            for p, row in enumerate(sums)]
    plan = spark.createDataFrame(rows, kind)
    open_ = (narrow.where("size > 0").withColumn("place", _place(F.col("key"), F.col("size")))
             .join(F.broadcast(plan.where("left > 0")), "pattern").select("p", "key", "size", "place", "bins", "left")
             .withColumn("low", F.lit(0.0)).withColumn("high", F.lit(1.0)))
    edges = plan.select("p", F.lit(0.0).alias("edge"))
    while True:
        bin_of = F.least(F.floor((F.col("place") - F.col("low")) / (F.col("high") - F.col("low")) * F.col("bins")), F.col("bins") - 1)
        binned = open_.withColumn("bin", bin_of.cast("int"))
        each = binned.groupBy("p", "bin").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"), F.first("left").alias("left"),
                                              F.first("bins").alias("bins"), F.first("low").alias("low"), F.first("high").alias("high"))
        order = Window.partitionBy("p").orderBy("bin")
        upto = F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        width = (F.col("high") - F.col("low")) / F.col("bins")
        last = (each.withColumn("upto", upto).where("upto > left and upto - words <= left")
                .select("p", "bin", "n", (F.col("left") - F.col("upto") + F.col("words")).alias("left"),
                        (F.col("low") + F.col("bin") * width).alias("low"), (F.col("low") + (F.col("bin") + 1) * width).alias("high")))
        last = cut(last)
        edges = edges.join(F.broadcast(last.select("p", F.col("low").alias("to"))), "p", "left").select(
            "p", F.coalesce("to", "edge").alias("edge"))
        here = F.broadcast(last.select("p", "bin", F.col("left").alias("l"), F.col("low").alias("a"), F.col("high").alias("b"),
                                       F.least(F.lit(MOST_BINS), F.floor(F.col("n") / fine) + 1).cast("int").alias("c")))
        open_ = binned.join(here, ["p", "bin"]).select(
            "p", "key", "size", "place", F.col("c").alias("bins"), F.col("l").alias("left"), F.col("a").alias("low"), F.col("b").alias("high"))
        crowded = last.where((F.col("n") > 8 * fine) & (F.col("high") - F.col("low") > 1e-12)).limit(1).count()
        if not crowded:
            break
        open_ = cut(open_)
    units = open_.groupBy("p", "key", "size", "place", "left").agg(F.sum("size").alias("total"))
    picked = units.groupBy("p").applyInPandas(_fill, "p int, key long, size long")
    picks = cut(picked.join(F.broadcast(plan.select("p", "pattern")), "p").select("pattern", "key", "size"))
    return Mix(
        spark.createDataFrame(list(zip(names, sizes, targets)), "source string, source_size long, target double"),
        cut(plan.join(F.broadcast(edges), "p").select("pattern", "base", "bins", "edge")), picks, picks.count() <= BROADCAST_PICKS)


def _overlapping(sizes: Sequence[int], weights: Sequence[float], cap: float, total: int) -> list[float]:
    """Targets where sources share documents: shares of the words there are, capped by each source's own."""
    scale = total / max(sum(sizes), 1)
    return [min(t * scale, cap * s) for t, s in zip(capped_targets(sizes, weights, cap / max(scale, 1e-12)), sizes)]


def with_targets(frame: DataFrame, mix: Mix, source: str) -> DataFrame:
    """`frame` with its source's size and target."""
    known = mix.sources.select(F.col("source").alias("__source"), "source_size", "target")
    return frame.join(F.broadcast(known), F.col(source).eqNullSafe(F.col("__source")), "left").drop("__source")


def mix_documents(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
                  **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of `documents`."""
    sized = documents.withColumn("__size", word_count(F.col(text_column))).withColumn("__sources", F.array(F.col(source_column)))
    sized = sized.withColumn("__id", F.col(id_column).cast("long"))
    plan = plan_mix(sized, "__id", "__size", "__sources", **options)
    taken = plan.decide(sized, "__id", "__size", "__sources", "__copies")
    return taken.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__copies")))).select(*documents.columns)
