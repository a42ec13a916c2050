"""Words of a batch of texts as dictionary codes, computed column-wise inside Arrow tasks.

A word is a run of characters other than space and U+0009 to U+000D. A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

#: Bytes of text handled at once in a task; bounds a task's memory, results do not depend on it.
SLICE_BYTES = 4 << 20


#: Rows that Spark hands to a task's Python at a time.
BATCH_ROWS = 1000


def small_batches(frame: DataFrame) -> DataFrame:
    """The frame, with its session set to hand texts to Python in batches of few rows: they bound the memory of both sides."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", frame.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, BATCH_ROWS)
    return frame


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about `limit` bytes of one text column, one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    part = np.cumsum(sizes) // limit
    start = 0
    for end in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]:
        if end > start:
            yield batch.slice(start, end - start)
        start = end


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(texts: pa.Array) -> pa.Array:
    """A to Z lower-cased, all other bytes as they are; no nulls."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if not len(texts) or ends[-1] == ends[0]:
        return texts
    body = _LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[ends[0]:ends[-1]]]
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(body))


def split(texts: pa.Array, lower: bool = False) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, code of every word, offsets of texts): text i holds codes[offsets[i]:offsets[i + 1]]."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = lower_ascii(texts)
    lists = pc.ascii_split_whitespace(texts)
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten()
    ends = np.asarray(lists.offsets, np.int64)
    ends = ends - ends[0]
    full = np.asarray(pc.greater(pc.binary_length(flat), 0)) if len(flat) else np.zeros(0, bool)
    offsets = np.concatenate(([0], np.cumsum(full)))[ends].astype(np.int64)
    coded = flat.filter(pa.array(full)).dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.dictionary.to_pylist(), np.asarray(coded.indices, np.int64), offsets


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums of hashes spread over all bits."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated index runs start, start + 1, ... of the given lengths."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)
