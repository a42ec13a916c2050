"""The corpus pipeline: good, clean and distinct documents, mixed by source and packed into sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next stage's docs. All but the
last return the columns of docs, whatever else these are called; rows with null or repeated ids, null and empty texts pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from shelfwise.llm import mixing, near_duplicates, packing, quality, queries, toxicity
from shelfwise.llm.training import unused
from shelfwise.session import work_folder

#: Ids of dropped documents up to which they are broadcast.
BROADCAST_IDS = 1_000_000


def good(spark, docs, sf_dir):
    """Documents that the quality classifier accepts, fitted on the training folds of labels."""
    model = queries.quality_model(docs, queries.table(spark, sf_dir, "labels"))
    name = unused(docs.columns, "score")
    return quality.score(docs, model, out=name).where(F.col(name) >= queries.GOOD).drop(name)


def clean(spark, docs, sf_dir):
    """Documents that the toxicity classifier doesn't reject, fitted on the training folds of labels."""
    net = queries.toxicity_model(docs, queries.table(spark, sf_dir, "labels"))
    name = unused(docs.columns, "score")
    return toxicity.score(docs, net, out=name).where(F.col(name) < queries.TOXIC).drop(name)


def distinct(spark, docs, sf_dir):
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the smallest id, or row where ids are null or repeat."""
    key = unused(docs.columns, "key")
    named = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count() == 0
    keyed = docs.withColumn(key, F.col("doc_id") if named else F.monotonically_increasing_id())
    found = near_duplicates.near_duplicates(keyed, id_column=key)
    dropped = found.where(~F.col("kept")).select(key).persist()
    few = dropped.count() <= BROADCAST_IDS
    return keyed.join(F.broadcast(dropped) if few else dropped, key, "left_anti").drop(key)


def mixed(spark, docs, sf_dir):
    """Documents as often as the mix takes them."""
    return mixing.mix_documents(docs)


def packed(spark, docs, sf_dir):
    """Pieces of documents, each a sequence of a power-of-two length."""
    return packing.pack(docs, public_tokenizers.path(queries.TOKENIZER))


STAGES = [("quality", good), ("toxicity", clean), ("near_duplicates", distinct), ("mixing", mixed), ("packing", packed)]

#: Trained models and tokenizers have no SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents, each written to the shared folder."""
    docs, folder = queries.table(spark, sf_dir, "documents"), work_folder(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
