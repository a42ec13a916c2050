"""Greedy word-piece lengths by a linear longest-match automaton, without building pieces.

Words are walked byte by byte through a trie of the vocabulary. Where a byte does not continue the match, the
state's failure link leads to the state that remains after the longest pieces are taken from its front, and a
precomputed count says how many pieces that were; so every byte is read once and no piece is ever made.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words

#: Words of more bytes are walked one by one, others side by side.
SIDE_BY_SIDE = 64
#: Runs that a worker remembers before it starts anew, and runs counted in one call; only speed depends on them.
REMEMBERED, TOGETHER = 1_000_000, 20_000
END = 256


class LongestMatch:
    """Automaton over symbols 0 to 255 (bytes) and END (end of word).

    `first` are the pieces that may start a word, `later` those that may follow (a word-piece vocabulary marks
    them with ##); a vocabulary with word ends instead has the same pieces at both places, some with END last.
    """

    def __init__(self, first: list[tuple[int, ...]], later: list[tuple[int, ...]]) -> None:
        self.next: list[dict[int, int]] = [{}, {}]
        self.piece = [False, False]
        for start, pieces in ((0, first), (1, later)):
            for symbols in pieces:
                at = start
                for symbol in symbols:
                    to = self.next[at].get(symbol)
                    if to is None:
                        to = len(self.next)
                        self.next[at][symbol] = to
                        self.next.append({})
                        self.piece.append(False)
                    at = to
                self.piece[at] = at > 1
        self._link()
        self._table()

    def _link(self) -> None:
        """fail[v]: state left after greedy pieces are taken from v's string, -1 where none can be; popped[v]: how many."""
        size = len(self.next)
        self.fail = [-1] * size
        self.popped = [0] * size
        queue = [0, 1]
        for at in queue:
            for symbol, to in self.next[at].items():
                if self.piece[to]:
                    self.fail[to], self.popped[to] = 1, 1
                else:
                    back, count = self.fail[at], self.popped[at]
                    while back >= 0 and symbol not in self.next[back]:
                        count += self.popped[back]
                        back = self.fail[back]
                    if back >= 0:
                        self.fail[to], self.popped[to] = self.next[back][symbol], count
                queue.append(to)

    def _table(self) -> None:
        """Transitions as a sorted array of state * 512 + symbol, for walks of many words at once."""
        pairs = sorted((v * 512 + s, to) for v, out in enumerate(self.next) for s, to in out.items())
        self.keys = np.array([k for k, _ in pairs], np.int64)
        self.to = np.array([t for _, t in pairs], np.int64)
        self.fail_of = np.array(self.fail, np.int64)
        self.popped_of = np.array(self.popped, np.int64)

    def count(self, symbols: bytes, end: bool) -> int:
        """Pieces of one word, 0 where the vocabulary can't spell it."""
        at, total = 0, 0
        for symbol in (*symbols, END) if end else symbols:
            while symbol not in self.next[at]:
                total += self.popped[at]
                at = self.fail[at]
                if at < 0:
                    return 0
            at = self.next[at][symbol]
        return self._finish(at, total)

    def _finish(self, at: int, total: int) -> int:
        while at > 1:
            total += self.popped[at]
            at = self.fail[at]
        return total if at == 1 else 0

    def _step(self, state: np.ndarray, symbol: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Next states; -1 where a word can't be spelt."""
        todo = np.flatnonzero(state >= 0)
        out = state.copy()
        while len(todo):
            keys = out[todo] * 512 + symbol[todo]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[at] == keys
            out[todo[hit]] = self.to[at[hit]]
            todo = todo[~hit]
            total[todo] += self.popped_of[out[todo]]
            out[todo] = self.fail_of[out[todo]]
            todo = todo[out[todo] >= 0]
        return out

    def counts(self, spelt: list[bytes], end: bool) -> np.ndarray:
        """Pieces of many words: short ones side by side, longer ones singly; 0 where a word can't be spelt."""
        lengths = np.fromiter(map(len, spelt), np.int64, len(spelt))
        out = np.zeros(len(spelt), np.int64)
        short = np.flatnonzero((lengths <= SIDE_BY_SIDE) & (lengths > 0))
        short = short[np.argsort(-lengths[short], kind="stable")]
        if len(short) and len(self.keys):
            width = int(lengths[short[0]]) + end
            grid = np.zeros((len(short), width), np.int64)
            own = lengths[short]
            grid[np.repeat(np.arange(len(short)), own), words.ranges(np.zeros(len(short), np.int64), own)] = np.frombuffer(
                b"".join([spelt[i] for i in short.tolist()]), np.uint8)
            if end:
                grid[np.arange(len(short)), own] = END
                own = own + 1
            state, total = np.zeros(len(short), np.int64), np.zeros(len(short), np.int64)
            for k in range(width):
                live = int(np.searchsorted(-own, -k, side="left"))
                part = total[:live]
                state[:live] = self._step(state[:live], grid[:live, k], part)
            while (open_ := state > 1).any():
                total[open_] += self.popped_of[state[open_]]
                state[open_] = self.fail_of[state[open_]]
            out[short] = np.where(state == 1, total, 0)
        for i in np.flatnonzero(lengths > SIDE_BY_SIDE).tolist():
            out[i] = self.count(spelt[i], end)
        return out


def _byte_letters() -> dict[str, int]:
    """The printable letter by which byte-level vocabularies write each byte: itself if printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordPieces:
    """The words of a tokenizer file (its own normaliser and word splitter), counted by longest match over its vocabulary."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        suffix = model.get("end_of_word_suffix") or ""
        letters = _byte_letters()
        self.letters = str.maketrans({letter: chr(byte) for letter, byte in letters.items()})
        pieces = []
        for token in model["vocab"]:
            end = bool(suffix) and token.endswith(suffix) and len(token) > len(suffix)
            body = token[: len(token) - len(suffix)] if end else token
            if all(c in letters for c in body):
                pieces.append((*(letters[c] for c in body), *((END,) if end else ())))
        self.end = bool(suffix)
        self.automaton = LongestMatch(pieces, pieces)
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, tuple[int, int]] = {}

    def spell(self, chunks: list[str]) -> tuple[list[bytes], np.ndarray]:
        """(words of all runs as bytes, the run of each): runs go through the normaliser and splitter joined by spaces."""
        normal = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else str
        joined = " ".join(chunks)
        plain = normal(joined).split(" ")
        if joined.split() != chunks or len(plain) != len(chunks):  # a run holds white space of another kind
            plain = [normal(c) for c in chunks]
        found = self.tokenizer.pre_tokenizer.pre_tokenize_str(" ".join(plain))
        starts = np.cumsum([0, *(len(p) + 1 for p in plain)])
        owner = np.searchsorted(starts, np.array([a for _, (a, _) in found], np.int64), side="right") - 1
        return [w.translate(self.letters).encode("latin-1") for w, _ in found], owner

    def counts(self, distinct: list[str]) -> np.ndarray:
        """(pieces, words) of each run; a word that can't be spelt counts as one unknown piece."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [c for c in distinct if c not in self.known]
        for i in range(0, len(new), TOGETHER):
            part = new[i:i + TOGETHER]
            spelt, owner = self.spell(part)
            sizes = np.maximum(self.automaton.counts(spelt, self.end), 1)
            pieces = np.bincount(owner, sizes, len(part)).astype(np.int64).tolist()
            self.known.update(zip(part, zip(pieces, np.bincount(owner, minlength=len(part)).tolist())))
        return np.array([self.known[c] for c in distinct], np.int64).reshape(-1, 2)


@functools.lru_cache(maxsize=1)
def word_pieces(path: str) -> WordPieces:
    return WordPieces(path)


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    pieces = word_pieces(path)
    for batch in batches:
        for part in words.slices(batch, "text", 16 << 20):
            distinct, codes, offsets = words.split(part.column("text"))
            each = pieces.counts(distinct)[codes]
            sums = np.concatenate((np.zeros((1, 2), np.int64), np.cumsum(each, axis=0)))
            own = sums[offsets[1:]] - sums[offsets[:-1]]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(own[:, 0]), pa.array(own[:, 1])], ["id", "n_tokens", "n_words"])


def count_tokens(documents: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id column, n_tokens, n_words) of every row: greedy longest-match pieces and words of its whole text.

    Words are those of the tokenizer file's normaliser and splitter. A null or empty text has 0 of both; a word
    the vocabulary can't spell is one piece. Repeated rows are counted each; other columns are ignored; an empty
    table gives no rows. One scan, no shuffle; each distinct word is walked once per task.
    """
    plain = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return plain.mapInArrow(lambda b: _count(b, tokenizer_path), "id long, n_tokens long, n_words long").withColumnRenamed("id", id_column)
