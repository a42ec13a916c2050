"""Packing by power-of-two decomposition: no sequence crosses documents, and none needs padding."""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words

#: The id that ends a document, and the longest sequence.
END_ID, MAX_LENGTH = 1, 2048
#: Distinct words whose ids a worker remembers before it starts anew, and words encoded in one call; only speed depends on them.
REMEMBERED, TOGETHER = 200_000, 200

PIECES = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                    ("doc_tokens", pa.int64())])


class WordIds:
    """Token ids of words, each encoded once per worker.

    The tokenizer drops white space and never joins what white space separates, so the ids of a text
    are the ids of its words in order.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)

    def encode(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word); words go in joined by spaces, an id belongs to the word where it starts."""
        groups = [new[i:i + TOGETHER] for i in range(0, len(new), TOGETHER)]
        ids, lengths = [], []
        for group, encoded in zip(groups, self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)):
            starts = np.cumsum([0, *(len(w) + 1 for w in group)])
            owner = np.searchsorted(starts, np.array([a for a, _ in encoded.offsets], np.int64), side="right") - 1
            ids.append(np.array(encoded.ids, np.uint32))
            lengths.append(np.bincount(owner, minlength=len(group)))
        return np.concatenate(ids), np.concatenate(lengths)

    def codes(self, distinct: list[str]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.clear()
        new = [w for w in distinct if w not in self.known]
        if new:
            ids, lengths = self.encode(new)
            self.known.update(zip(new, range(len(self.start), len(self.start) + len(new))))
            self.start = np.concatenate((self.start, len(self.ids) + np.cumsum(lengths) - lengths))
            self.length = np.concatenate((self.length, lengths))
            self.ids = np.concatenate((self.ids, ids))
        return np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of texts). The tokenizer lower-cases, but its special tokens are written in lower case."""
        special = pc.any(pc.match_substring(texts, "<|")).as_py()
        distinct, codes, offsets = words.split(texts, lower=not special)
        codes = self.codes(distinct)[codes]
        lengths = self.length[codes]
        ids = self.ids[words.ranges(self.start[codes], lengths)]
        return ids, np.concatenate(([0], np.cumsum(lengths)))[offsets]


@functools.lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def binary_lengths(total: int, longest: int) -> list[int]:
    """Full pieces first, then one piece for each bit of the rest, longest first."""
    rest = total % longest
    return [longest] * (total // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int, longest: int) -> Iterator[pa.RecordBatch]:
    encoder = word_ids(path)
    for batch in batches:
        for part in words.slices(batch, "text", 16 << 20):
            ids, offsets = encoder.of(part.column("text"))
            rows: list[tuple] = []
            for key, first, last in zip(part.column("id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                own = np.append(ids[first:last], np.uint32(end_id)).astype("<u4")
                at = 0
                for length in binary_lengths(len(own), longest):
                    rows.append((key, at, length, own[at:at + length].tobytes(), len(own)))
                    at += length
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), PIECES.types)]
            yield pa.RecordBatch.from_arrays(columns, schema=PIECES)


def pack(documents: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text",
         end_id: int = END_ID, longest: int = MAX_LENGTH) -> DataFrame:
    """Cut every document into pieces whose lengths are powers of two; a piece is a sequence of its own.

    Returns one row per piece: the id column, start, length, ids (the piece's ids as little-endian unsigned
    32-bit integers), doc_tokens, bucket (log2 of the length: batches are formed within a bucket, so rows of
    a batch have equal lengths), sequence_id and offset (always 0). `longest` must be a power of two.

    A document is the ids of its text followed by `end_id`; a null or empty text is `end_id` alone. Repeated
    rows are packed once per row; a null id stays null; other columns are ignored, whatever their names; an
    empty table gives no rows. The work is one scan without a shuffle; a task holds a slice of a batch of rows.
    sequence_id is unique within a run, and the same again when a lost task is repeated.
    """
    if longest < 1 or longest & longest - 1:
        raise ValueError("longest must be a power of two")
    plain = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    pieces = plain.mapInArrow(lambda b: _pieces(b, tokenizer_path, end_id, longest),
                              "id long, start long, length long, ids binary, doc_tokens long")
    return pieces.select(
        F.col("id").alias(id_column), "start", "length", "ids", "doc_tokens",
        F.round(F.log2("length")).cast("int").alias("bucket"),
        F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
