"""Fill-in-the-middle against slices of Python strings, which count code points."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from shelfwise.llm import fill_middle
from tests.llm import ugly

MARKED = [(20, "a <P> mark"), (21, "<S>"), (22, "x<M>"), (23, "<P"), (24, "M> S> <"), (25, "ÿ€😀" * 700), (26, "😀"), (27, "é"), (28, "<<P"), (29, "\x00")]


def plain(key, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return key, len(text), "plain", None, None, text, text
    p, m, s = text[:a], text[a:b], text[b:]
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return key, len(text), form, a, b - a, out, text


def test_fill_middle(spark):
    many = [(k, "é€😀a b"[: k % 7] * (k % 5)) for k in range(100, 400)]
    rows = ugly.TEXTS + MARKED + many
    clash = (*ugly.CLASH, "form", "output", "_text", "_h1")
    done = fill_middle.fill_middle(ugly.documents(spark, rows, clash))
    got = done.withColumn("back", fill_middle.restore(F.col("output"), F.col("form")))
    wanted = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "back"]
    assert sorted(map(repr, got.select(wanted).collect())) == sorted(repr(r) for r in spark.createDataFrame(
        [plain(k, t) for k, t in rows], "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, back string").collect())
    assert {"_text", "_h1", "source", "score"} <= set(done.columns) and done.columns.count("form") == 1
    assert {r["form"] for r in done.collect()} == {"plain", "psm", "spm"}
    assert fill_middle.fill_middle(ugly.nothing(spark)).count() == 0


def test_unit_ends_at_every_cut():
    draw = np.random.default_rng(5)
    for _ in range(200):
        texts = ["".join(draw.choice(list("aé€😀\x7f\x80߿ࠀ￿"), draw.integers(0, 20))) for _ in range(draw.integers(1, 6))]
        array = pa.array(["skipped ", *texts], pa.large_string()).slice(1)
        cuts = [draw.integers(0, 1 << 32, len(texts)) for _ in range(2)]
        n, small, large, at, to = fill_middle.unit_cuts(array, *cuts)
        for i, text in enumerate(texts):
            a, b = sorted((int(cuts[0][i]) % (len(text) + 1), int(cuts[1][i]) % (len(text) + 1)))
            assert (n[i], small[i], large[i]) == (len(text), a, b)
            assert (at[i], to[i]) == (len(text[:a].encode()), len(text[:b].encode()))
