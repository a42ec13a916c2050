"""Packing and token counts against the tokenizer itself and greedy matching spelt out."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shelfwise.llm import packing, token_counts
from tests.llm import ugly

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def check_pieces(rows, tokenizer, texts, longest):
    """Pieces joined in order are the ids of the text and the end id; every sequence is one power of two."""
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    for r in rows:
        assert r["offset"] == 0 and r["length"] & (r["length"] - 1) == 0 and r["length"] <= longest and 1 << r["bucket"] == r["length"]
    wanted = {}
    for key, text in texts:
        wanted.setdefault(key, []).append([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1])
    assert set(by_id) == set(wanted)
    for key, docs in wanted.items():
        assert sum(r["length"] for r in by_id[key]) == sum(map(len, docs))
        if len(docs) == 1:
            pieces = sorted(by_id[key], key=lambda r: r["start"])
            assert [i for r in pieces for i in np.frombuffer(bytes(r["ids"]), "<u4").tolist()] == docs[0]
            assert all(r["doc_tokens"] == len(docs[0]) for r in pieces)


def test_packing_round_trip(spark, tokenizer):
    for longest in (2048, 8):
        check_pieces(packing.pack(ugly.documents(spark), PATH, longest=longest).collect(), tokenizer, ugly.TEXTS, longest)
    assert packing.pack(ugly.nothing(spark), PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pack(ugly.documents(spark), PATH, longest=100)


def test_packing_of_real_texts(spark, tokenizer):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    check_pieces(packing.pack(documents, PATH).collect(), tokenizer, texts, 2048)


def test_binary_lengths():
    for total in range(1, 300):
        pieces = packing.binary_lengths(total, 64)
        assert sum(pieces) == total and pieces == sorted(pieces, reverse=True) and len([p for p in pieces if p < 64]) == bin(total % 64).count("1")


def test_crc_of_pieces(spark):
    from pyspark.sql import functions as F

    for r in packing.pack(ugly.documents(spark), PATH).select("ids", F.crc32("ids").alias("crc")).collect():
        assert r["crc"] == zlib.crc32(bytes(r["ids"]))


def greedy(word, vocabulary):
    rest, count = [*word, "</w>"], 0
    while rest:
        size = next((n for n in range(len(rest), 0, -1) if "".join(rest[:n]) in vocabulary and rest[:n] != ["</w>"]), 0)
        if not size:
            return 1
        rest, count = rest[size:], count + 1
    return count


def test_token_counts_are_greedy(spark, tokenizer):
    documents = ugly.documents(spark).unionByName(
        spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source"), allowMissingColumns=True)
    vocabulary, known = set(tokenizer.get_vocab()), {}
    want = []
    for key, text in documents.select("doc_id", "text").collect():
        found = [w for w, _ in tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(text or ""))]
        for w in found:
            known[w] = known.get(w) or greedy(w, vocabulary)
        want.append((key or 0, sum(known[w] for w in found), len(found)))
    got = [(r["doc_id"] or 0, r["n_tokens"], r["n_words"]) for r in token_counts.count_tokens(documents, PATH).collect()]
    assert sorted(got) == sorted(want)
    assert token_counts.count_tokens(ugly.nothing(spark), PATH).count() == 0


def test_word_piece_vocabulary_with_unknown_words():
    first = [tuple(w.encode()) for w in ("un", "a", "ab", "abc", "x")]
    later = [tuple(w.encode()) for w in ("aff", "able", "b", "cd", "d", "bcde")]
    automaton = token_counts.LongestMatch(first, later)

    def plain(word):
        at, pieces, count = 0, first, 0
        while at < len(word):
            fit = [p for p in pieces if tuple(word[at:at + len(p)]) == p]
            if not fit:
                return 0
            at, pieces, count = at + len(max(fit, key=len)), later, count + 1
        return count

    draw = np.random.default_rng(3)
    spelt = [bytes(draw.choice(list(b"abcdeunflx"), draw.integers(1, 9))) for _ in range(3000)] + [b"unaffable", b"abcd" + b"d" * 100, b"unaffaffx"]
    assert automaton.counts(spelt, False).tolist() == [plain(w) for w in spelt]
    assert [automaton.count(w, False) for w in spelt] == [plain(w) for w in spelt]
