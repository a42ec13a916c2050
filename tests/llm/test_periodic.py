"""Periodic runs against every period tried at every place."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from shelfwise.llm import periodic, queries
from tests.llm import ugly


def plain_runs(w, length=6, exponent=4):
    """Maximal stretches for each period; those that a smaller period explains are left out."""
    n, found = len(w), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if size >= max(length, exponent * q) and not any(p < q and s <= i and i + size <= s + n_ for s, n_, p in found):
                found[i, size, q] = True
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def digests(key, text, planted):
    w = re.findall("[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(key).encode())
    if planted and key is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    kept = set(range(n)) - {i for s, size, q in runs for i in range(s + q, s + size)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    milli = None if not runs else 1000 * best[1] // best[2]
    return (key, len(runs), *best, milli, hashlib.sha256("".join(f"{s},{z},{q}\n" for s, z, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(w[i] for i in sorted(kept)).encode()).hexdigest())


def random_words(draw):
    """Words of a small alphabet with repeats of repeats put in."""
    w = draw.integers(0, draw.integers(1, 6), draw.integers(0, 30)).tolist()
    for _ in range(draw.integers(0, 4)):
        a = int(draw.integers(0, len(w) + 1))
        b = int(draw.integers(a, min(len(w), a + 7) + 1))
        w[a:b] = w[a:b] * int(draw.integers(1, 7)) + w[a:b][: int(draw.integers(0, 3))]
    return w


@pytest.mark.parametrize("length,exponent", [(6, 4), (1, 2), (4, 3)])
def test_runs_of_random_words(length, exponent):
    draw = np.random.default_rng(length)
    for _ in range(500):
        texts = [np.array(random_words(draw), np.int64) for _ in range(3)]
        offsets = np.cumsum([0, *map(len, texts)])
        codes = np.concatenate(texts)
        owner, begin, end = periodic.stretches(codes, offsets, length, exponent)
        got = {i: [] for i in range(3)}
        for i in range(3):
            places = [(a, b) for t, a, b in zip(owner, begin, end) if t == i]
            if places:
                for (a, _), rows in zip(places, periodic.find_runs([codes[a:b] for a, b in places], length, exponent)):
                    got[i] += [(a - offsets[i] + s, size, q) for s, size, q in rows.tolist()]
        assert [got[i] for i in range(3)] == [plain_runs(t.tolist(), length, exponent) for t in texts]


def test_extensions_are_those_of_the_suffixes():
    draw = np.random.default_rng(2)
    for _ in range(60):
        s = [*random_words(draw), -1]
        extend = periodic.Extensions(*periodic.SuffixTree(s).tour())
        for i in range(len(s)):
            j = np.arange(len(s))
            want = [next((k for k in range(len(s)) if i + k >= len(s) or b + k >= len(s) or s[i + k] != s[b + k]), len(s)) for b in j]
            assert extend.of(np.full(len(s), i), j).tolist() == [w if b != i else len(s) - i for w, b in zip(want, j)]


def test_range_minima():
    draw = np.random.default_rng(4)
    for size in (1, 15, 16, 17, 300, 2000):
        values = draw.integers(0, 50, size)
        low, high = np.sort(draw.integers(0, size, (2, 400)), axis=0)
        assert periodic.RangeMin(values).of(low, high).tolist() == [values[a:b + 1].min() for a, b in zip(low, high)]


REPEATS = [(50, "a " * 40), (51, "x y " * 30 + "x"), (52, " ".join(["a b c"] * 9 + ["d"] + ["c b"] * 5 + ["b"] * 9)), (53, "a a a a a"), (54, "a a a a a a"),
           (55, "é 😀 " * 6), (56, ("a a a a b " * 5) * 2), (57, " ".join(f"w{i % 700}" for i in range(4000)))]


def rows_of(frame):
    return sorted(tuple(r) for r in frame.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").na.fill(-9, ["doc_id"]).collect())


def test_query_on_ugly_and_given_texts(spark, tmp_path):
    rows = [*ugly.TEXTS, *REPEATS, *((k, f"w{k} the end of it all " * (k % 9)) for k in range(100, 300))]
    rows = [(k, t if t is None or len(t) < 100_000 else t[:20_000]) for k, t in rows]  # the plain way is quadratic
    ugly.documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    for folder, texts in ((str(tmp_path), rows), ("/root/testdata/sf0.001", None)):
        if texts is None:
            texts = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
        want = sorted((-9 if d[0] is None else d[0], *d[1:]) for d in (digests(k, t, True) for k, t in texts))
        assert sorted(map(repr, rows_of(queries.op13_periodic_runs(spark, folder)))) == sorted(map(repr, want))
    assert periodic.periodic_runs(ugly.nothing(spark)).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(ugly.nothing(spark), exponent=1)


def test_long_text_and_operator_columns(spark):
    got = {r["doc_id"]: r for r in periodic.periodic_runs(ugly.documents(spark, [*ugly.TEXTS, *REPEATS])).collect()}
    assert got[7]["n_words"] == 30000 and got[57]["runs"] == [(0, 4000, 700)] and len(got[57]["collapsed"].split()) == 700
    assert got[50]["strongest"] == (0, 40, 1) and got[50]["collapsed"] == "a" and got[53]["strongest"] is None and got[2]["collapsed"] == ""
