"""Each stage of the corpus pipeline against a plain version on its own input, and the whole."""

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from shelfwise.llm import mixing, quality, queries, toxicity
from tests.llm import ugly
from tests.llm.test_links import brute
from tests.llm.test_texts import check_pieces

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "toxicity", "near_duplicates", "mixing", "packing"]
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select(columns).collect()]
        got = stage(spark, docs, FOLDER)
        if name == "quality":
            scored = quality.score(docs, queries.quality_model(docs, labels), out="q")
            want = [tuple(r) for r in scored.where("q >= 0.7").select(columns).collect()]
        elif name == "toxicity":
            scored = toxicity.score(docs, queries.toxicity_model(docs, labels), out="q")
            want = [tuple(r) for r in scored.where("q < 0.5").select(columns).collect()]
        elif name == "near_duplicates":
            kept = {k for k, _, _, first in brute([r[:2] for r in before], 5, 80) if first}
            want = [r for r in before if r[0] in kept]
        elif name == "mixing":
            want = [tuple(r) for r in mixing.mix_documents(docs).collect()]
            assert set(want) <= set(before) and max(want.count(r) for r in set(want)) <= 3
        else:
            tokenizer = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
            once = got.join(docs.groupBy("doc_id").count().where("count = 1"), "doc_id", "left_semi").collect()
            check_pieces(once, tokenizer, [r[:2] for r in before if before.count(r) == 1], 2048)
            assert got.agg(F.sum("length")).first()[0] == sum(len(tokenizer.encode(r[1], add_special_tokens=False).ids) + 1 for r in before)
            break
        assert got.columns == columns
        assert sorted(tuple(r) for r in got.collect()) == sorted(want), name
        out[name] = got.count()
        docs = got
    assert out["quality"] > out["toxicity"] > out["near_duplicates"] > 0


def test_run_and_ugly_documents(spark, tmp_path):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
    folder = str(tmp_path)
    ugly.documents(spark).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (7, 0, 1), (10, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        got, none = stage(spark, docs, folder), stage(spark, docs.where("false"), folder)
        assert none.count() == 0
        assert name == "packing" or got.columns == docs.columns
        got.collect()
    texts = [r["text"] for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, folder).collect()]
    assert sum((t or "").startswith("The quick") for t in texts) == 1 and len(texts) == len(ugly.TEXTS) - 2
