"""Fill-in-the-middle: cut a text into prefix, middle and suffix at drawn code points and put the middle last.

Where code point k of a text ends is found on whole batches at once. The UTF-8 bytes of a batch are viewed as 64-bit words; arithmetic
marks every byte that ends a code point; population counts of the words, summed up, say in which word the wanted mark is; and the mark's
place inside that word follows from byte-wise running counts (one multiplication) and a byte-wise comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words

#: Marks of the parts in an output; a text that holds one of them stays as it is.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, how many are rearranged, and how many of these begin with the suffix.
REARRANGED, SUFFIX_FIRST = 90, 20

_ONES = np.uint64(0x0101010101010101)
_HIGH = np.uint64(0x8080808080808080)
_BYTE, _SIX, _SEVEN, _TOP = (np.uint64(n) for n in (8, 6, 7, 56))


class UnitEnds:
    """The bytes of a run of UTF-8 that end a code point, and the way from a code point's number to its end and back."""

    def __init__(self, body: np.ndarray) -> None:
        padded = np.zeros(len(body) // 8 * 8 + 16, np.uint8)  # zeros after the text are no continuation bytes: they end its last code point
        padded[:len(body)] = body
        view = padded.view("<u8")
        continues = view >> _SEVEN & ~(view >> _SIX) & _ONES
        begins = continues ^ _ONES
        self.ends = begins[:-1] >> _BYTE | begins[1:] << _TOP  # a byte ends a code point where the next one begins another
        self.before = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.bitwise_count(self.ends), dtype=np.int64)))

    def rank(self, offsets: np.ndarray) -> np.ndarray:
        """How many code points end before each byte offset."""
        word = offsets // 8
        below = (np.uint64(1) << (offsets % 8 * 8).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.ends[word] & below)

    def select(self, count: np.ndarray) -> np.ndarray:
        """The byte offset after which `count` code points (one at least) have ended."""
        word = np.searchsorted(self.before, count, side="left") - 1
        wanted = (count - self.before[word]).astype(np.uint64)
        running = self.ends[word] * _ONES  # byte k: marks in bytes 0 to k
        reached = (running | _HIGH) - wanted * _ONES & _HIGH  # high bits of bytes whose running count is the wanted one or more
        return word * 8 + 9 - np.bitwise_count(reached)


def unit_cuts(texts: pa.Array, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
    """(n, small, large, byte of small, byte of large) of each text: code points, and the cuts draw % (n + 1) in order; bytes count from the text's begin."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    body = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    starts = ends - ends[0]
    marks = UnitEnds(body)
    before = marks.rank(starts)
    n = np.diff(before)
    a, b = first % (n + 1), second % (n + 1)
    small, large = np.minimum(a, b), np.maximum(a, b)

    def offset(units: np.ndarray) -> np.ndarray:
        at = before[:-1] + units
        return np.where(units > 0, marks.select(np.maximum(at, 1)), starts[:-1]) - starts[:-1]

    return n, small, large, offset(small), offset(large)


def _rearrange(batches: Iterator[pa.RecordBatch], keep: list[str], names: list[str]) -> Iterator[pa.RecordBatch]:
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    for whole in batches:
        for batch in words.slices(whole, "_text"):
            texts = pc.fill_null(batch.column("_text").cast(pa.large_string()), "")
            draws = [np.asarray(batch.column(f"_h{i}"), np.int64) for i in range(1, 5)]
            n, small, large, at, to = unit_cuts(texts, draws[0], draws[1])
            marked = np.zeros(len(texts), bool)
            for mark in (PREFIX, SUFFIX, MIDDLE):
                marked |= np.asarray(pc.match_substring(texts, mark))
            plain = marked | (n == 0) | (draws[2] % 100 >= REARRANGED)
            form = np.where(plain, "plain", np.where(draws[3] % 100 < SUFFIX_FIRST, "spm", "psm"))
            out = []
            for text, kind, i, j in zip(texts.cast(pa.large_binary()).to_pylist(), form.tolist(), at.tolist(), to.tolist()):
                if kind == "psm":
                    text = b"".join((p, text[:i], s, text[j:], m, text[i:j]))
                elif kind == "spm":
                    text = b"".join((s, text[j:], p, text[:i], m, text[i:j]))
                out.append(text)
            new = [pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), pa.array(small, pa.int64(), mask=plain),
                   pa.array(large - small, pa.int64(), mask=plain), pa.array(out, pa.large_binary()).cast(pa.large_string()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *new], names=[*keep, *names])


def draws(key: Column, seed: str = "1") -> list[Column]:
    """Four 32-bit numbers from the hex sha256 of `seed:key`; a null key counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_middle(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: str = "1",
                keep: list[str] | None = None) -> DataFrame:
    """`documents` (or its columns `keep`) with n, form, prefix_chars, middle_chars and output, which replace columns of these names.

    n counts code points. The cuts are two numbers drawn from 0 to n by the id, so reruns and repeated rows agree; prefix, middle or
    suffix may be empty. form is psm (prefix, suffix, middle), spm (suffix, prefix, middle) or plain: null and empty texts, texts that
    hold one of the marks, and the share that isn't rearranged; their prefix_chars and middle_chars are null. A null text has the output
    '', a null id draws as the empty key. One scan without a shuffle, a task holds a slice of a batch; an empty table stays empty.
    """
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]
    keep = [c for c in (documents.columns if keep is None else keep) if c.lower() not in names]
    inner = {c: f"_{i}" for i, c in enumerate(keep)}  # names of their own, whatever the columns are called
    hidden = words.small_batches(documents).select(
        *(F.col(f"`{c}`").alias(i) for c, i in inner.items()), F.col(text_column).alias("_text"),
        *(h.alias(f"_h{i}") for i, h in enumerate(draws(F.col(id_column), seed), 1)))
    kinds = T.StructType([*(hidden.schema[i] for i in inner.values()), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
                          T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])
    done = hidden.mapInArrow(lambda b: _rearrange(b, list(inner.values()), names), kinds)
    return done.select(*(F.col(i).alias(c) for c, i in inner.items()), *names)


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of. No part holds a mark, and marks can't overlap one, so splitting at them is exact."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
            .when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output))
