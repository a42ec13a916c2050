"""Near-duplicate texts and vectors, and code search, against comparing everything with everything."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import code_search, near_duplicates, vector_links
from tests.llm import ugly


def classes(nodes, links):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def shingles(text, width):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(rows, width, percent):
    sets = [(k, shingles(t, width)) for k, t in rows]
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if x and y and 100 * len(x & y) >= percent * len(x | y)]
    label = classes([k for k, _ in sets], links)
    return sorted((k, len(s), label[k], label[k] == k) for k, s in sets)


def edited(draw, words, share):
    return [w if draw.random() > share else f"e{draw.integers(1e9)}" for w in words]


@pytest.mark.parametrize("tile", [4, 256])
def test_near_duplicates_equal_brute_force(spark, tile):
    """Chains of copies of copies, a group around one text, pairs on both sides of the threshold, exact copies; a tile of 4 splits all groups."""
    draw = np.random.default_rng(8)
    rows = [(k, t) for k, t in ugly.TEXTS if k is not None and k != 8]
    for g in range(4):
        base = [f"g{g}w{i}" for i in range(120)]
        text = base
        for _ in range(12):
            text = edited(draw, text, 0.015)
            rows.append((1000 + len(rows), " ".join(text)))
        rows += [(1000 + len(rows) + i, " ".join(edited(draw, base, 0.03))) for i in range(25)]
    rows += [(5000 + i, t) for i, (_, t) in enumerate(rows[-30:])]
    order = draw.permutation(len(rows))
    rows = [(rows[i][0] * 7919 % 100003, rows[i][1]) for i in order]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for width, percent in ((3, 85), (5, 80)):
        got = sorted(tuple(r) for r in near_duplicates.near_duplicates(frame, width=width, percent=percent, tile=tile).collect())
        assert got == brute(rows, width, percent)


def test_near_duplicates_of_ugly_rows(spark):
    got = near_duplicates.near_duplicates(ugly.documents(spark), broadcast_ids=0).collect()
    assert len(got) == len(ugly.TEXTS)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[8]["component_id"] == 1 and not by_id[8]["kept"]
    assert [by_id[k]["n_shingles"] for k in (2, 3, 4, 5, 6)] == [0, 0, 0, 1, 1] and all(by_id[k]["kept"] for k in (2, 3, 4, 5, 6))
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)] * 2
    assert near_duplicates.near_duplicates(ugly.nothing(spark)).count() == 0


def test_near_duplicates_with_a_group_of_a_third(spark):
    base = " ".join(f"w{i}" for i in range(50))
    rows = [(i, base) for i in range(300)] + [(i, f"{base} tail{i}") for i in range(300, 500)] + [(i, f"only text {i} of its own kind here") for i in range(500, 1000)]
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).where("kept").count()
    assert got == 501


def test_looks_keep_pairs_at_the_threshold():
    """A pair just at the threshold is given up about as seldom as chosen, dissimilar pairs mostly at the first look."""
    draw = np.random.default_rng(1)
    same = lambda s: (draw.random((4000, 138)) < s).astype(np.uint32)
    ones = np.ones((4000, 138), np.uint32)
    kept = lambda s: len(near_duplicates.surviving(ones, same(s), 0.85, near_duplicates.BATCH, near_duplicates.MISS))
    assert kept(0.85) == 4000 and kept(0.3) == 0 and kept(0.5) < 10


def vector_rows(draw):
    base = draw.normal(size=(60, 16))
    rows = [b + s * draw.normal(size=16) for b in base[:20] for s in (0.05, 0.1, 0.12)] + list(base)
    rows += [np.concatenate((b[:8] + 0.5 * draw.normal(size=8), b[8:])) for b in base[:20]]
    return [(i, [float(x) for x in r]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("tile", [8, 1024])
def test_vector_links_equal_brute_force(spark, tile):
    rows = vector_rows(np.random.default_rng(4))
    rows += [(900 + i, v) for i, (_, v) in enumerate(rows[:5])] + [(2000, [1e200 * x for x in rows[3][1]])]
    bad = [(950, None), (951, []), (952, [0.0] * 16), (953, [float("nan")] + [1.0] * 15), (954, [None] + [1.0] * 15), (955, [1.0] * 3), (956, [float("inf")] + [1.0] * 15)]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("n", "weight", "node", "cell")})
    x = np.array([np.asarray(v) / np.abs(v).max() for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    close = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    label = classes([k for k, _ in rows], [(rows[a][0], rows[b][0]) for a, b in zip(*np.nonzero(close))])
    want = sorted((k, int(close[i].sum()), label[k], label[k] == k) for i, (k, _) in enumerate(rows))
    want += sorted((k, 0, k, True) for k, _ in bad)
    got = sorted(tuple(r) for r in vector_links.near_vectors(frame, tile=tile).collect())
    assert got == sorted(want)


def test_vector_links_recall_and_empty(spark):
    from shelfwise.llm.queries import QUERIES

    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vector_links.near_vectors(empty).count() == 0
    only = spark.createDataFrame([(1, None), (None, [1.0, 2.0]), (2, [2.0, 4.0])], "vec_id long, embedding array<float>")
    assert sorted(map(str, (tuple(r) for r in vector_links.near_vectors(only).collect()))) == sorted(
        ["(1, 0, 1, True)", "(None, None, None, None)", "(2, 1, 2, True)"])
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    x = np.array([r["embedding"] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = {r["vec_id"]: int(n) - 1 for r, n in zip(rows, (x @ x.T >= 0.9).sum(axis=1))}
    got = {r["vec_id"]: r["n_links"] for r in QUERIES["op4_near_vectors"](spark, folder).collect()}
    assert all(got[k] <= want[k] for k in want) and sum(got.values()) >= 0.9 * sum(want.values())


@pytest.mark.parametrize(("bits", "tile"), [(24, 8192), (40, 16), (5, 8192)])
def test_code_search_equals_brute_force(spark, bits, tile):
    draw = np.random.default_rng(bits)
    x = draw.normal(size=(400, bits))
    x[50:200] = x[7]
    x[200:260] = x[8] * np.where(draw.random((60, bits)) < 0.1, -1, 1)
    rows = [(int(i * 31 % 1009), [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(5000, None), (5050, []), (5100, [float("nan")] * bits), (None, [1.0] * bits), (5150, [1.0] * (bits + 1))]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "code", "query", "rank")})
    code = {k: np.array(v) > 0 for k, v in rows}
    want = []
    for q in code:
        if q % 50 == 0:
            near = sorted((int((code[q] != c).sum()), k) for k, c in code.items() if k != q)[:7]
            want += [(q, i + 1, k, d) for i, (d, k) in enumerate(near)]
    got = code_search.nearest_codes(frame, F.col("vec_id") % 50 == 0, k=7, tile=tile)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_code_search_of_few_rows(spark):
    one = spark.createDataFrame([(0, [1.0, -1.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in code_search.nearest_codes(one, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 1)]
    assert code_search.nearest_codes(one, F.lit(False)).count() == 0
    assert code_search.nearest_codes(one.where("false"), F.lit(True)).count() == 0


@pytest.mark.parametrize("tile", [16, 8192])
def test_code_search_of_near_copies(spark, tile):
    """Many distinct codes as far as the kth one, in one key of most segments: the smallest ids win."""
    draw = np.random.default_rng(5)
    signs = -np.ones((1 + 64 + 200, 64))
    signs[np.arange(1, 65), np.arange(64)] = 1
    for row in signs[65:]:
        row[draw.choice(64, 2, replace=False)] = 1
    ids = [0, *(int(i) for i in draw.permutation(np.arange(1, len(signs))))]
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, signs)], "vec_id long, embedding array<double>").repartition(7)
    got = code_search.nearest_codes(frame, F.col("vec_id") % 40 == 0, k=10, tile=tile)
    rows = [tuple(r) for r in got.orderBy("query_id", "rank").collect()]
    for q in range(0, len(ids), 40):
        far = (signs != signs[ids.index(q)]).sum(axis=1)
        want = sorted((int(d), i) for d, i in zip(far, ids) if i != q)[:10]
        assert [(d, i) for asker, _, i, d in rows if asker == q] == want


def test_vectors_of_two_lengths(spark):
    """Each length is an index of its own: equal and near vectors of the rarer one are linked and found too."""
    rows = [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 1.0, 0.01]), (10, [1.0, 2.0]), (11, [1.0, 2.0]), (12, [-1.0, 2.0]), (13, [5.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    links = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_links.near_vectors(frame).collect()}
    assert links == {1: (0, 1), 2: (1, 2), 3: (1, 2), 10: (1, 10), 11: (1, 10), 12: (0, 12), 13: (0, 13)}
    got = sorted(tuple(r) for r in code_search.nearest_codes(frame, F.lit(True), k=2).collect())
    assert got == [(1, 1, 2, 2), (1, 2, 3, 3), (2, 1, 3, 1), (2, 2, 1, 2), (3, 1, 2, 1), (3, 2, 1, 3), (10, 1, 11, 0), (10, 2, 12, 1),
                   (11, 1, 10, 0), (11, 2, 12, 1), (12, 1, 10, 1), (12, 2, 11, 1)]
