"""Catalog names mentioned in texts.

Names and texts are normalised (no asterisks, single spaces, lower case). A mention is a name's
first position in a text; where mentions overlap the earlier one stays, and of two starting together the
longer one.

Names up to NAMES_BYTES go to every task as one automaton (a trie with failure links), which finds all of them in one pass over a text.
A larger catalog meets the texts in joins on anchors, with the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import squeeze
from ..session import cut

GRAM = 5
NAMES_BYTES = 16 << 20    # of all names that one automaton holds, with NAME_COST each; it takes some ten times as much of a worker's memory
NAME_COST = 32


def normalized(text: Column) -> Column:
    return F.lower(squeeze(F.replace(text, F.lit("*"), F.lit(""))))


def name_anchors(names: DataFrame, gram: int = GRAM) -> DataFrame:
    """product_id, key, size, anchor: what a text must hold to mention the name.

    A name of three words or more is anchored on an inner word (size 0), which a text can only hold as a
    whole word; a shorter one on a character gram. The anchor rarest among all names is taken, so
    frequent words do not join every text.
    """
    rows = names.select("product_id", normalized(F.col("name")).alias("key")).where("key <> ''").withColumn("words", F.split("key", " "))
    inner = rows.where(F.size("words") >= 3).select(
        "product_id", "key", F.lit(0).alias("size"), F.explode(F.array_distinct(F.slice("words", 2, F.size("words") - 2))).alias("anchor"))
    short = rows.where(F.size("words") < 3).withColumn("size", F.least(F.length("key"), F.lit(gram)))
    grams = short.select("product_id", "key", "size", F.explode(_grams(F.col("key"), F.col("size"))).alias("anchor"))
    offered = inner.unionByName(grams)
    uses = offered.groupBy("size", "anchor").agg(F.count(F.lit(1)).alias("uses"))
    best = offered.join(uses, ["size", "anchor"]).groupBy("product_id", "key").agg(F.min(F.struct("uses", "size", "anchor")).alias("b"))
    return best.select("product_id", "key", F.col("b.size").alias("size"), F.col("b.anchor").alias("anchor"))


def _grams(text: Column, size: Column) -> Column:
    pattern = F.concat(F.lit("(?s)(?=(.{"), size.cast("string"), F.lit("}))"))
    return F.array_distinct(F.regexp_extract_all(text, pattern, F.lit(1)))


def _named(names: DataFrame) -> DataFrame:
    return names.select("product_id", normalized(F.col("name")).alias("key")).where("key <> ''")


_LATEST: dict[str, tuple[ahocorasick.Automaton, pa.Array, list]] = {}


def _known(token: str, names: Broadcast) -> tuple[ahocorasick.Automaton, pa.Array, list]:
    """The automaton of all distinct names, each with the rows that have it, and the rows' product ids; built once per worker."""
    if token not in _LATEST:
        rows: dict[str, list[int]] = {}
        for i, key in enumerate(names.value["key"].to_pylist()):
            rows.setdefault(key, []).append(i)
        automaton = ahocorasick.Automaton()
        for key, own in rows.items():
            automaton.add_word(key, (len(key), own))
        automaton.make_automaton()
        products = names.value["product_id"].combine_chunks()
        _LATEST.clear()
        _LATEST[token] = automaton, products, products.to_pylist()
    return _LATEST[token]


def _first_places(automaton: ahocorasick.Automaton, body: str) -> list[tuple[int, int, int]]:
    """(start from 1, size, row of the name) of each name's first place in a text."""
    first: dict[int, tuple[int, int]] = {}
    for end, (size, own) in automaton.iter(body):
        for row in own:
            if row not in first:
                first[row] = (end - size + 2, size)
    return [(start, size, row) for row, (start, size) in first.items()]


def _without_overlaps(hits: list[tuple[int, int, int]], ids: list) -> list[tuple[int, int, int]]:
    kept, end = [], 0
    for hit in sorted(hits, key=lambda h: (h[0], -h[1], ids[h[2]])):
        if hit[0] >= end:
            kept.append(hit)
            end = hit[0] + hit[1]
    return kept


def _scan(batches: Iterator[pa.RecordBatch], names: Broadcast, token: str, apart: bool) -> Iterator[pa.RecordBatch]:
    automaton, products, ids = _known(token, names)
    for batch in batches:
        texts, starts, sizes, rows = [], [], [], []
        for i, body in enumerate(batch.column(1).to_pylist()):
            hits = _first_places(automaton, body) if body and len(automaton) else []
            for start, size, row in _without_overlaps(hits, ids) if apart else hits:
                texts.append(i)
                starts.append(start)
                sizes.append(size)
                rows.append(row)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(texts, pa.int64())), products.take(pa.array(rows, pa.int64())), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32())],
            [batch.schema.names[0], "product_id", "start", "size"])


def _by_automaton(texts: DataFrame, names: DataFrame, key: str, apart: bool) -> DataFrame:
    shared, token = texts.sparkSession.sparkContext.broadcast(names.toArrow()), uuid.uuid4().hex
    rows = texts.select(F.col(key), normalized(F.col("text")).alias("body"))
    spec = f"{key} {dict(rows.dtypes)[key]}, product_id {dict(names.dtypes)['product_id']}, start int, size int"
    return rows.mapInArrow(lambda batches: _scan(batches, shared, token, apart), spec)


def _by_anchors(texts: DataFrame, names: DataFrame, key: str, gram: int) -> DataFrame:
    """An equi-join of a text's distinct words (and, only when names of one or two words exist, its distinct
    grams) with the names' anchors; `instr` then settles the few pairs left.
    """
    anchors = cut(name_anchors(names, gram))
    rows = texts.select(key, normalized(F.col("text")).alias("body"))
    grams = rows.select(key, F.lit(0).alias("size"), F.explode(F.array_distinct(F.split("body", " "))).alias("anchor"))
    sizes = [r["size"] for r in anchors.where("size > 0").select("size").distinct().collect()]    # at most `gram` values
    for size in sizes:
        grams = grams.unionByName(rows.select(key, F.lit(size).alias("size"), F.explode(_grams(F.col("body"), F.lit(size))).alias("anchor")))
    hits = grams.join(anchors, ["size", "anchor"]).select(key, "product_id", F.col("key").alias("name_key"))
    placed = hits.join(rows, key).withColumn("start", F.expr("instr(body, name_key)"))
    return placed.where("start > 0").select(key, "product_id", "start", F.length("name_key").alias("size"))


def _is_small(named: DataFrame, names_bytes: int) -> bool:
    size = named.agg(F.sum(F.octet_length("key") + NAME_COST).alias("n")).first()["n"] or 0
    return size <= names_bytes


def found_names(texts: DataFrame, names: DataFrame, key: str = "text_id", gram: int = GRAM, names_bytes: int = NAMES_BYTES) -> DataFrame:
    """key, product_id, start, size of every name contained in a text, whole texts read; null texts and names, and empty ones, have none."""
    named = _named(names)
    if _is_small(named, names_bytes):
        return _by_automaton(texts, named, key, False)
    return _by_anchors(texts, names, key, gram)


def mentions(texts: DataFrame, names: DataFrame, key: str = "text_id", gram: int = GRAM, names_bytes: int = NAMES_BYTES) -> DataFrame:
    """Mentions with overlaps removed, in text order: key, product_id, start.

    The automaton's pass settles them text by text. Beyond its bound, a text's hits (start and size, bounded by the names it
    can hold) are folded in order.
    """
    named = _named(names)
    if _is_small(named, names_bytes):
        return _by_automaton(texts, named, key, True).drop("size")
    hits = _by_anchors(texts, names, key, gram)
    listed = hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(
        "start", (-F.col("size")).alias("less"), "product_id", "size"))).alias("hits"))
    kind = dict(listed.dtypes)["hits"]
    zero = F.struct(F.lit(0).alias("end"), F.array().cast(kind).alias("kept"))

    def step(state: Column, hit: Column) -> Column:
        taken = F.struct((hit["start"] + hit["size"]).alias("end"), F.concat(state["kept"], F.array(hit)).alias("kept"))
        return F.when(hit["start"] >= state["end"], taken).otherwise(state)

    kept = listed.select(key, F.explode(F.aggregate("hits", zero, step)["kept"]).alias("hit"))
    return kept.select(key, "hit.product_id", "hit.start")
