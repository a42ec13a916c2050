"""Near duplicates by MinHash bands and sequential Bayesian verification.

Texts with one set of shingles become one class at once. Classes that share a band of their signatures are candidates: first each with
the smallest of its bucket, then, where a bucket still spans several components, those in different components with each other, tile by
tile inside tasks. A candidate's signatures are compared batch by batch and given up as soon as the posterior chance that the similarity
reaches the threshold is below the chosen miss probability; survivors are verified on their full sets.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..session import cut, is_empty
from . import words

#: A pair at the threshold shares no band with at most this chance; a signature has at most so many hashes.
BAND_MISS, MOST_HASHES = 2e-5, 160
#: Hashes compared at a time, and the chance given up at most by each look at a pair.
BATCH, MISS = 24, 1e-6
#: Rows of a bucket compared in one task.
TILE = 512
#: Candidates whose ids are broadcast to find their texts; with more, texts are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def banding(threshold: float, miss: float = BAND_MISS, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the longest bands for which enough of them fit; pairs share no band with chance (1 - s ** rows) ** bands."""
    best = (most, 1)
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(miss) / math.log1p(-threshold ** rows)) if threshold < 1 else 1
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


@functools.lru_cache(maxsize=4)
def _family(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and shifts of the hash functions, from a fixed seed."""
    draw = np.random.default_rng(20240229)
    return draw.integers(0, 1 << 32, size, np.uint64).astype(np.uint32) | np.uint32(1), draw.integers(0, 1 << 32, size, np.uint64).astype(np.uint32)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text; fewer words than `width` are one shingle, no words none."""
    distinct, codes, offsets = words.split(texts, lower=True)
    hashed = words.word_hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    wide = hashed[: max(len(hashed) - width + 1, 0)] * _ODD[0]
    for k in range(1, width):
        wide = (wide ^ (wide >> np.uint64(29))) * _ODD[1] + hashed[k:len(hashed) - width + 1 + k] * _ODD[2]
    wide = words.mix(wide)
    out = []
    for first, last in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if last - first >= width:
            out.append(np.unique(wide[first:last - width + 1]))
        elif last > first:
            short = np.uint64(last - first)
            for h in hashed[first:last]:
                short = (short ^ (short >> np.uint64(29))) * _ODD[3] + h * _ODD[4]
            out.append(words.mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    multiply, add = _family(size)
    small = (shingles >> np.uint64(32)).astype(np.uint32)
    lowest = np.full(size, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(small), 2048):
        np.minimum(lowest, (small[i:i + 2048, None] * multiply + add).min(axis=0), out=lowest)
    return lowest


def _sign(batches: Iterator[pa.RecordBatch], width: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    number = (np.arange(bands, dtype=np.uint64) + np.uint64(1)) * _ODD[0]
    for batch in batches:
        for part in words.slices(batch, "text"):
            with np.errstate(over="ignore"):
                counts, one, two, signatures, keys = [], [], [], [], []
                for own in shingle_sets(part.column("text"), width):
                    counts.append(len(own))
                    one.append(int(own.sum(dtype=np.uint64)))
                    two.append(int(words.mix(own ^ _ODD[3]).sum(dtype=np.uint64)))
                    drawn = signature(own, bands * rows)
                    signatures.append(drawn.tobytes())
                    band = number.copy()
                    for column in drawn.reshape(bands, rows).T.astype(np.uint64):
                        band = words.mix(band ^ (column * _ODD[1]))
                    keys.append(band)
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([
                part.column("id"), pa.array(counts, pa.int64()), pa.array(np.array(one, np.uint64).view(np.int64)),
                pa.array(np.array(two, np.uint64).view(np.int64)), pa.array(signatures, pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * bands), pa.array(flat))],
                ["id", "n_shingles", "one", "two", "signature", "bands"])


@functools.lru_cache(maxsize=16)
def least_matches(threshold: float, size: int, batch: int, miss: float) -> tuple[tuple[int, int], ...]:
    """(hashes seen, matches below which a pair is given up), for each look.

    With a uniform prior, after m matches of n the similarity's posterior is Beta(m + 1, n - m + 1); its chance to reach the threshold
    is the chance of at most m successes in n + 1 trials at the threshold.
    """
    out = []
    for n in [*range(batch, size, batch), size]:
        chance, m = 0.0, -1
        while chance < miss:
            m += 1
            chance += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return tuple(out)


def surviving(left: np.ndarray, right: np.ndarray, threshold: float, batch: int, miss: float) -> np.ndarray:
    """Row numbers of the pairs (left[i], right[i]) of signatures that no look gives up."""
    alive, matches, start = np.arange(len(left)), np.zeros(len(left), np.int64), 0
    for seen, least in least_matches(threshold, left.shape[1], batch, miss):
        matches += (left[alive, start:seen] == right[alive, start:seen]).sum(axis=1)
        keep = matches >= least
        alive, matches, start = alive[keep], matches[keep], seen
    return alive


def _signatures(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, size)


def _look(batches: Iterator[pa.RecordBatch], size: int, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = surviving(_signatures(batch.column("sign_a"), size), _signatures(batch.column("sign_b"), size), threshold, BATCH, MISS)
        yield batch.select(["a", "b"]).take(pa.array(kept))


TILE_KEY = ["key", "i", "j"]


def _whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows come sorted by tile; each table given holds all rows of one tile."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in TILE_KEY])
        edges = (np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist()
        for first, last in zip([0, *edges], [*edges, batch.num_rows]):
            part = batch.slice(first, last - first)
            if not part.num_rows:
                continue
            if held and any(held[0].column(c)[0] != part.column(c)[0] for c in TILE_KEY):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _apart(tile: pa.Table, size: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of a tile, of different blocks (or one, on the diagonal) and components, whose signatures survive.

    The smallest row of a bucket has met all others before.
    """
    signs = _signatures(tile.column("signature").combine_chunks(), size)
    component, block, lowest = (tile.column(c).to_numpy() for c in ("component", "block", "lowest"))
    i, j = tile.column("i")[0].as_py(), tile.column("j")[0].as_py()
    for row in np.flatnonzero((block == i) & ~lowest).tolist():
        others = (component != component[row]) & ~lowest & (block == j)
        if i == j:
            others[:row + 1] = False
        two = np.flatnonzero(others)
        if len(two):
            kept = surviving(np.broadcast_to(signs[row], (len(two), size)), signs[two], threshold, BATCH, MISS)
            if len(kept):
                yield np.full(len(kept), row), two[kept]


def _with_survivors(batches: Iterator[pa.RecordBatch], size: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """The rows of each tile that are in a surviving pair."""
    for tile in _whole_tiles(batches):
        alive = np.zeros(tile.num_rows, bool)
        for one, two in _apart(tile, size, threshold):
            alive[one] = alive[two] = True
        yield from tile.filter(pa.array(alive)).to_batches()


def _joined(batches: Iterator[pa.RecordBatch], size: int, threshold: float, percent: int) -> Iterator[pa.RecordBatch]:
    """Links of each tile verified on full sets, as many as join its components: no pair is looked up that is joined already."""
    for tile in _whole_tiles(batches):
        ids, labels = tile.column("id").to_numpy(), tile.column("component").to_numpy().copy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in tile.column("shingles").combine_chunks()]
        found = []
        for one, two in _apart(tile, size, threshold):
            for a, b in zip(one.tolist(), two.tolist()):
                if labels[a] != labels[b] and similar(sets[a], sets[b], percent):
                    labels[labels == labels[b]] = labels[a]
                    found.append((ids[a], ids[b]))
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets, neither empty, have a Jaccard similarity of at least `percent`."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    common = int((b[at] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _set_rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in words.slices(batch, "text"):
            with np.errstate(over="ignore"):
                sets = [s.tobytes() for s in shingle_sets(part.column("text"), width)]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, pa.binary())], ["id", "shingles"])


def _exact(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column("set_a"), batch.column("set_b"))
        kept = [k for k, (a, b) in enumerate(pairs)
                if similar(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), percent)]
        yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))


def near_duplicates(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5, percent: int = 80,
                    tile: int = TILE, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row: the smallest id reachable by links of at least `percent` Jaccard similarity.

    Words are lower-cased by A-Z; a text's set holds its distinct shingles of `width` words, or its whole sequence if it has fewer.
    Null and empty texts have no shingles and link with nothing. Rows of one id are one document. A null id is never smallest: such a
    row has the component of its copies, else a null one, and is kept only then. Other columns are ignored, an empty table gives no rows.
    """
    threshold = percent / 100
    bands, rows = banding(threshold)
    size = bands * rows
    plain = words.small_batches(documents).select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    signed = cut(plain.mapInArrow(lambda b: _sign(b, width, bands, rows),
                                  "id long, n_shingles long, one long, two long, signature binary, bands array<long>"))
    same = ["one", "two", "n_shingles"]
    classes = signed.where("n_shingles > 0 and id is not null").groupBy(*same).agg(F.min("id").alias("id"))
    chosen = cut(signed.join(classes, [*same, "id"], "left_semi").select("id", "signature", "bands", *same).dropDuplicates(["id"]))
    signs = chosen.select("id", "signature")

    banded = chosen.select("id", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = cut(banded.join(buckets, "key"))
    stars = members.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    links = cut(_verified(_looked(stars, signs, size, threshold), plain, width, percent, broadcast_ids))
    settled = components(links)

    known = members.join(settled.withColumnRenamed("node", "id"), "id", "left").select(
        "key", "id", "n", (F.col("id") == F.col("first")).alias("lowest"), F.coalesce("component", "id").alias("component"))
    known = cut(known)
    # buckets of the same members are one; those within one component are done
    open_ = known.groupBy("key", "n").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.bit_xor(F.xxhash64("id")).alias("x"),
                                          F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("s")).where("low < high and n > 2")
    open_ = open_.groupBy("n", "low", "high", "x", "s").agg(F.min("key").alias("key")).select("key")
    parts = F.ceil(F.col("n") / tile).cast("int")
    rest = (known.join(open_, "key").withColumn("block", F.pmod(F.xxhash64("id"), parts).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
            .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "component", "lowest", "block"))
    schema = "key long, i int, j int, id long, component long, lowest boolean, block int, signature binary"
    alive = cut(_by_tile(rest.join(signs, "id").select(*(f.split()[0] for f in schema.split(", ")))).mapInArrow(
        lambda b: _with_survivors(b, size, threshold), schema))
    if not is_empty(alive):
        sets = _sets(plain, alive.select("id").distinct(), width, broadcast_ids)
        more = cut(_by_tile(alive.join(sets, "id")).mapInArrow(lambda b: _joined(b, size, threshold, percent), "a long, b long"))
        if not is_empty(more):
            settled = components(settled.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more))

    named = classes.join(settled.withColumnRenamed("node", "id"), "id", "left").select(*same, F.coalesce("component", "id").alias("component"))
    out = signed.select("id", *same).join(named, same, "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_column), "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("id") == component, component.isNull()).alias("kept"))


def _looked(pairs: DataFrame, signs: DataFrame, size: int, threshold: float) -> DataFrame:
    both = (pairs.join(signs.select(F.col("id").alias("a"), F.col("signature").alias("sign_a")), "a")
            .join(signs.select(F.col("id").alias("b"), F.col("signature").alias("sign_b")), "b"))
    return both.select("a", "b", "sign_a", "sign_b").mapInArrow(lambda b: _look(b, size, threshold), "a long, b long")


def _by_tile(rows: DataFrame) -> DataFrame:
    return rows.repartition(*TILE_KEY).sortWithinPartitions(*TILE_KEY)


def _sets(plain: DataFrame, ids: DataFrame, width: int, broadcast_ids: int) -> DataFrame:
    """(id, shingles) of some documents; only their texts are read into sets."""
    ids = cut(ids)
    wanted = F.broadcast(ids) if ids.count() <= broadcast_ids else ids
    return cut(plain.join(wanted, "id", "left_semi").mapInArrow(lambda b: _set_rows(b, width), "id long, shingles binary").dropDuplicates(["id"]))


def _verified(pairs: DataFrame, plain: DataFrame, width: int, percent: int, broadcast_ids: int) -> DataFrame:
    """Pairs whose full sets are similar enough."""
    pairs = cut(pairs)
    sets = _sets(plain, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), width, broadcast_ids)
    both = (pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b")), "b"))
    return both.select("a", "b", "set_a", "set_b").mapInArrow(lambda b: _exact(b, percent), "a long, b long")
