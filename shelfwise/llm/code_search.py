"""Exact nearest binary codes by incremental multi-index hashing.

A code is cut in segments, and each segment is an index of its own. Codes within distance d of a query differ from it by at most
floor(d / segments) bits in some segment, so a query searches all segments within radius 0, 1, 2 and so on, until its k-th verified
distance is below what the radius reached is sure to cover: segments * (radius + 1) - 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut, is_empty
from . import vectors

#: Bits of a segment, of which the upper half is the key that rows are dealt by.
SEGMENT_BITS, KEY_BITS = 16, 8
#: Rows of a key compared with each other in one task, and parts in which equal codes are first reduced.
TILE, SALTS = 8192, 16
_POPULATION = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def sign_words(vector: Column, length: int) -> Column:
    """Segments of a vector's sign code as integers: bit i of the code is 1 where component i is positive."""
    segments = -(-length // SEGMENT_BITS)
    return F.array(*(sum((F.when(F.get(vector, F.lit(s * SEGMENT_BITS + b)) > 0, F.lit(1 << b)).otherwise(F.lit(0))
                          for b in range(min(SEGMENT_BITS, length - s * SEGMENT_BITS))), F.lit(0)) for s in range(segments)))


def _bits(x: np.ndarray) -> np.ndarray:
    return _POPULATION[x]


def _search(table: pa.Table, radius: int, k: int, segments: int) -> pa.Table:
    """Codes of one key whose segment is exactly `radius` bits from the query's: each query's k nearest among them, of ties the lowest numbers.

    Rows are codes (query null) or queries; `away` is the distance of a query's key from the group's.
    """
    table = table.combine_chunks()
    codes = np.asarray(table.column("code").combine_chunks().flatten(), np.int64).reshape(-1, segments)
    low = codes[np.arange(len(codes)), table.column("segment").to_numpy()] & ((1 << KEY_BITS) - 1)
    asks = table.column("asks").to_numpy(zero_copy_only=False)
    away, kth, ids = table.column("away").to_numpy(), table.column("kth").to_numpy(), table.column("id").to_numpy()
    q, rows = np.flatnonzero(asks), np.flatnonzero(~asks)
    rows = rows[np.argsort(ids[rows], kind="stable")]
    out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3]
    for start in range(0, len(q), 256):
        own = q[start:start + 256]
        near, at = np.nonzero(_bits(low[own][:, None] ^ low[rows]) == (radius - away[own])[:, None])
        distance = np.zeros(len(near), np.int64)
        for s in range(segments):
            distance += _bits(codes[own[near], s] ^ codes[rows[at], s])
        good = distance <= kth[own[near]]
        near, at, distance = near[good], at[good], distance[good]
        order = np.lexsort((ids[rows[at]], distance, near))
        near, at, distance = near[order], at[order], distance[order]
        rank = np.arange(len(near)) - np.searchsorted(near, near)
        first = rank < k
        out.append((ids[own[near[first]]], ids[rows[at[first]]], distance[first]))
    query, code, distance = (np.concatenate(c) for c in zip(*out))
    return pa.table([pa.array(query), pa.array(code), pa.array(distance)], ["query", "code", "distance"])


def _searcher(radius: int, k: int, segments: int) -> Callable[[pa.Table], pa.Table]:
    return lambda table: _search(table, radius, k, segments)


def _reached(batches: Iterator[pa.RecordBatch], radius: int, segments: int) -> Iterator[pa.RecordBatch]:
    """Keys of every segment at which a segment exactly `radius` bits away can be: all at distance of at most radius, and no nearer than the rest allows."""
    keys = np.arange(1 << KEY_BITS)
    for batch in batches:
        codes = np.asarray(batch.column("code").flatten(), np.int64).reshape(-1, segments)
        for s in range(segments):
            away = _bits((codes[:, s] >> KEY_BITS)[:, None] ^ keys)
            row, key = np.nonzero((away <= radius) & (radius - away <= KEY_BITS))
            taken = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), s, np.int32)), pa.array(key.astype(np.int32)), pa.array(away[row, key].astype(np.int32)),
                                              taken.column("id"), taken.column("code"), taken.column("kth")],
                                             ["segment", "key", "away", "id", "code", "kth"])


def _lowest(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy("id")
    return rows.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).drop("__n")


def nearest_codes(frame: DataFrame, asks: Column, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 10,
                  tile: int = TILE) -> DataFrame:
    """(query_id, rank, neighbour_id, distance): the k rows nearest to each row where `asks` holds, by Hamming distance of sign codes, then id.

    A row isn't its own neighbour. Rows with a null id, or with a null, empty or non-finite vector, neither ask nor are found; a query is
    compared with the vectors of its own length, each length that occurs has an index of its own; where fewer than k + 1 rows have it, there are
    fewer neighbours. Rows of one id are one row if their codes agree, else several. Equal codes are searched once; of each, the k + 1
    smallest ids can matter and are kept. All rows are dealt by segment and key, queries to the keys within the radius that is searched:
    a key's rows are compared in tiles. An empty table, or one without queries, gives no rows.
    """
    rows = frame.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"),
                        F.coalesce(asks, F.lit(False)).alias("asks")).where("id is not null")
    rows = rows.where(vectors.usable(F.col("vector")))
    found = None
    for length in vectors.lengths(rows.where("asks"), "vector"):
        coded = cut(rows.where(F.size("vector") == length).select("id", "asks", sign_words(F.col("vector"), length).alias("code")).distinct())
        own = _nearest_of_length(coded, length, k, tile)
        found = own if found is None else found.unionByName(own)
    return found if found is not None else rows.sparkSession.createDataFrame([], "query_id long, rank int, neighbour_id long, distance int")


def _nearest_of_length(coded: DataFrame, length: int, k: int, tile: int) -> DataFrame:
    """The k nearest among the codes (id, asks, code) of one length."""
    segments = max(1, -(-length // SEGMENT_BITS))
    salted = _lowest(coded.select("id", "code").distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))), ["code", "salt"], k + 1)
    holders = cut(_lowest(salted.drop("salt"), ["code"], k + 1))
    lists = holders.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    # numbered in the order of their smallest ids: of codes equally far, a search keeps those that the result's ties go to
    index = cut(lists.orderBy(F.col("ids")[0], "code").withColumn("id", F.monotonically_increasing_id()))
    asking = coded.where("asks").select("code").distinct()
    open_ = cut(asking.withColumn("id", F.monotonically_increasing_id()).withColumn("kth", F.lit(length).cast("long")))
    queries, found = open_, None
    counts = index.select("id", F.size("ids").alias("copies"))

    dealt = index.select("id", "code", F.posexplode("code").alias("segment", "word")).select(
        "segment", F.shiftright("word", KEY_BITS).cast("int").alias("key"), F.lit(0).alias("away"), "id", "code", F.lit(0).cast("long").alias("kth"),
        F.lit(False).alias("asks"))
    crowded = cut(dealt.groupBy("segment", "key").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("parts")).where("parts > 1"))
    dealt = dealt.join(F.broadcast(crowded), ["segment", "key"], "left").withColumn(
        "part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    for radius in range(SEGMENT_BITS + 1):
        keys = open_.select("id", "code", "kth").mapInArrow(lambda b, r=radius: _reached(b, r, segments),
                                                 "segment int, key int, away int, id long, code array<int>, kth long")
        keys = keys.withColumn("asks", F.lit(True)).join(F.broadcast(crowded), ["segment", "key"], "left").withColumn(
            "part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        step = dealt.unionByName(keys).groupBy("segment", "key", "part").applyInArrow(
            _searcher(radius, k + 1, segments), "query long, code long, distance long")
        step = step.distinct().join(counts.withColumnRenamed("id", "code"), "code")
        found = cut(_nearest(step if found is None else found.unionByName(step), k + 1))
        covered = segments * (radius + 1) - 1
        kth = found.groupBy("query").agg(F.max("distance").alias("kth"), F.sum("copies").alias("n")).where(F.col("n") > k)
        state = queries.select("id", "code").join(kth.select(F.col("query").alias("id"), "kth"), "id", "left")
        open_ = cut(state.select("id", "code", F.coalesce("kth", F.lit(length)).cast("long").alias("kth")).where(F.col("kth") > covered))
        if covered >= length or is_empty(open_):
            break
    if found is None:
        raise AssertionError("no radius was searched")
    pairs = found.join(index.select(F.col("id").alias("code"), F.explode("ids").alias("neighbour_id")), "code")
    askers = coded.where("asks").select(F.col("id").alias("query_id"), "code").join(queries.select(F.col("id").alias("query"), "code"), "code").select("query_id", "query")
    pairs = askers.join(pairs.select("query", "neighbour_id", "distance"), "query").where("query_id <> neighbour_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbour_id"))
    return pairs.select("query_id", rank.cast("int").alias("rank"), "neighbour_id", F.col("distance").cast("int").alias("distance")).where(F.col("rank") <= k)


def _nearest(found: DataFrame, most: int) -> DataFrame:
    """Of each query, the nearest codes that together hold `most` rows, with all codes as far as the last of them."""
    before = F.sum("copies").over(Window.partitionBy("query").orderBy("distance").rangeBetween(Window.unboundedPreceding, -1))
    distinct = found.dropDuplicates(["query", "code"])
    return distinct.withColumn("__n", F.coalesce(before, F.lit(0))).where(F.col("__n") < most).drop("__n")
