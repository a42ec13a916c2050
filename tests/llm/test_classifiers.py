import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import quality, toxicity, training
from shelfwise.llm.queries import QUERIES
from tests.llm import ugly

FOLDER = "/root/testdata/sf0.1"


def held_out(spark, name, label):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = QUERIES[name](spark, FOLDER).join(labels, "doc_id", "left").toPandas()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count() and rows["score"].between(0, 1).all()
    own = rows[rows["held_out"] & rows[label].notna()]
    return own[own[label] == 1], own[own[label] == 0]


def test_quality_of_held_out_texts(spark):
    good, bad = held_out(spark, "op1_quality", "quality")
    assert good["predicted"].mean() > 0.99 and bad["predicted"].mean() < 0.02


def test_toxicity_of_held_out_texts(spark):
    """A tenth of the toxic texts of these tables have lost their toxic words to other damage."""
    toxic, clean = held_out(spark, "op3_toxicity", "toxic")
    assert toxic["predicted"].mean() > 0.75 and clean["predicted"].mean() < 0.03


def test_risk_is_non_negative_and_unbiased():
    """Two clouds; with the right prior the classes are told apart though no negative is labelled."""
    draw = np.random.default_rng(2)
    positive, negative = draw.normal(1.5, 1, (3000, 4)), draw.normal(-1.5, 1, (3000, 4))
    mixture = np.concatenate((positive[1000:2400], negative[:600]))
    model = quality.fit(positive[:1000], mixture, 0.7)
    assert (model.scores(positive[2400:]) > 0.5).mean() > 0.97 and (model.scores(negative[600:]) < 0.5).mean() > 0.9
    assert quality.fit(positive[:0], mixture, 0.3).scores(mixture) == pytest.approx(0.3)


def test_gradients_of_the_network():
    draw = np.random.default_rng(0)
    net = toxicity.Network(1)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    x, index, length = draw.normal(size=(9, len(toxicity.TABLES) * toxicity.DIMENSION)).astype(np.float64), draw.integers(0, 9, (6, 4)), np.array([6, 5, 3, 1])
    slope = draw.normal(size=4)
    loss = lambda: float((net.forward(x, index, length) * slope).sum())
    keep = {}
    net.forward(x, index, length, None, keep)
    gradients, to_x = net.backward(x, index, length, keep, slope)
    for array, change in [(net.weights[k], g) for k, g in gradients.items()] + [(x, to_x)]:
        for at in draw.integers(0, array.size, 5):
            array.flat[at] += 1e-2
            up = loss()
            array.flat[at] -= 2e-2
            down = loss()
            array.flat[at] += 1e-2
            assert change.flat[at] == pytest.approx((up - down) / 2e-2, abs=2e-3)


def test_one_word_in_a_long_text():
    """Every window counts, the last as well; words and windows are those of the whole text."""
    draw = np.random.default_rng(5)
    plain = [" ".join(f"w{k}" for k in draw.integers(0, 300, n)) for n in draw.integers(5, 200, 300)]
    toxic = [f"{t} {'insult' + 'aeiou'[i % 5]}!! {plain[-i] if i % 3 else ''}" for i, t in enumerate(plain[:80])]
    net = toxicity.fit([*toxic, *plain[80:]], np.arange(300) < 80)
    long = " ".join(f"w{k}" for k in draw.integers(0, 300, 20000))
    scores = net.scores(pa.array([long, f"{long} insulto", f"INSULTI {long}", f"{long[:3000]} insultu, {long}", None, "", " \n"]))
    assert scores[0] < scores[1:4].min() - 0.2 and (scores[1:4] > 0.5).all() and (scores[4:] == 0).all()
    offsets = np.array([0, 0, 1, 33, 100])
    owner, first, length = toxicity.windows(offsets)
    for text in range(4):
        seen = {w for f, n in zip(first[owner == text], length[owner == text]) for w in range(f, f + n)}
        assert seen == set(range(offsets[text], offsets[text + 1]))


@pytest.mark.parametrize("one", [quality, toxicity])
def test_ugly_rows(spark, one):
    documents = ugly.documents(spark)
    column = "quality" if one is quality else "toxic"
    for rows in ([(1, 1), (7, 0), (8, 1), (8, 0), (5, None), (None, 1), (99, 0), (10, 0)], [(1, 1)], []):
        labels = spark.createDataFrame(rows, f"doc_id long, {column} int")
        scored = one.score(documents, one.train(documents, labels))
        assert scored.columns == documents.columns and scored.count() == len(ugly.TEXTS)
        assert all(0 <= r["score"] <= 1 for r in scored.collect())
        assert one.score(ugly.nothing(spark), one.train(ugly.nothing(spark), labels)).count() == 0
    assert one.score(documents, one.train(documents, labels), out="other", keep=["doc_id"]).columns == ["doc_id", "other"]


def test_folds_and_labels(spark):
    import zlib
    frame = spark.createDataFrame([(i,) for i in (-3, 0, 1, 10**12)] + [(None,)], "doc_id long").withColumn("f", training.fold(F.col("doc_id"), 5))
    assert [r["f"] for r in frame.collect()] == [zlib.crc32(str(i).encode()) % 5 for i in (-3, 0, 1, 10**12)] + [None]
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (2, 0), (3, None)], "k long, y int")
    assert sorted(tuple(r) for r in training.one_label(labels, "k", "y").collect()) == [(1, 1), (2, 0)]


def test_words_that_hold_the_mark(spark):
    """U+0001 isn't white space: words may hold it, at their ends or alone, and don't change other words' rows."""
    odd = ["\x01", "a\x01b", "\x01\x01\x01", "ç\x01", "\x01x"]
    plain = ["insult", "!!", "naïve", "of"]
    mixed, alone = toxicity.lexicon([w for pair in zip(odd, [*plain, "z"]) for w in pair]), toxicity.lexicon(plain)
    for name in toxicity.TABLES:
        ours = mixed[name].of(np.arange(len(plain)) * 2 + 1)
        assert (ours.rows == alone[name].rows).all() and (ours.starts == alone[name].starts).all() and (np.diff(mixed[name].starts) > 0).all()
    texts = [(i, f"some words \x01 and od\x01d {i} {'insult' * (i % 2)}\x01") for i in range(20)]
    documents = spark.createDataFrame(texts, "doc_id long, text string")
    net = toxicity.train(documents, documents.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")))
    assert toxicity.score(documents, net).where("score between 0 and 1").count() == 20
