"""What matching leaves on disk must not be many times its input."""

import os
import time

from pyspark.sql import functions as F

from shelfwise.operators import blocking, graph, rules
from shelfwise.session import cut, remove, store, work_folder

from .test_large_catalog import listings


def shuffles(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle")}


def folder_of(table):
    return table.inputFiles()[0].removeprefix("file:").replace("///", "/").rsplit("/", 1)[0]


def size(table):
    return sum(os.path.getsize(os.path.join(folder_of(table), f)) for f in os.listdir(folder_of(table)))


def test_what_is_cut_or_stored_leaves_no_shuffles(spark):
    made = spark.range(20_000).groupBy(F.pmod("id", F.lit(7_001)).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    key, known = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", shuffles(spark)
    before = spark.conf.get(key)
    kept = [cut(made), store(made), store(made.where("k % 2 = 0"), made.where("k % 2 = 1"), packed=True)]
    for _ in range(50):
        if not (left := shuffles(spark) - known):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(key) == before
    assert [t.agg(F.sum("n")).first()[0] for t in kept] == [20_000] * 3


def test_packed_tables_are_small_and_go_when_removed(spark):
    pairs = spark.range(100_000).select(F.expr("id DIV 25 AS a"), "id", F.lit(0.5).alias("similarity"), F.lit("concentration").alias("reason"))
    packed, plain = store(pairs, packed=True), store(pairs)
    assert size(packed) * 4 < size(plain) and packed.count() == 100_000
    remove(packed)
    assert not os.path.exists(folder_of(plain).rsplit("/", 1)[0] + "/" + folder_of(packed).rsplit("/", 1)[1]) and plain.count() == 100_000


def test_rounds_of_components_leave_one_table(spark):
    root = work_folder(spark, "x").rsplit("/", 1)[0].removeprefix("file:")
    before = set(os.listdir(root))
    found = graph.components(spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert {r["component"] for r in found.collect()} == {0} and found.count() == 41
    assert len([n for n in set(os.listdir(root)) - before if n.startswith("table-")]) == 1


def test_sliced_decisions_are_the_same(spark):
    rows = rules.with_split_flags(store(rules.T.tokenize_listings(listings(
        spark, [(i, f"s{i % 3}", "Norte", f"{('Lago Azul', 'Lago', 'Rio Verde')[i % 3]} 50 ml", 50 + i % 2, None) for i in range(60)]))))
    pairs = store(spark.range(60).toDF("a").crossJoin(spark.range(60).toDF("b")).where("a < b").withColumn("similarity", F.lit(0.5)))
    whole, sliced = rules.classify(pairs, rows), rules.classify(pairs, rows, slice_rows=300)
    assert sorted(whole.collect()) == sorted(sliced.collect()) and sliced.count() == pairs.count()


def test_candidates_meet_labels_where_they_are_made(spark):
    vectors = [[1.0, 0.0], [0.6, 0.8], [0.0, 1.0]]
    rows = store(spark.createDataFrame([(i, f"s{i % 3}", "norte" if i < 9 else "sur", f"u{i}", vectors[i % 3]) for i in range(12)],
                                       "listing_id long, store string, brand_key string, listing_url string, embedding array<float>"))
    labels = spark.createDataFrame([("u0", "u1", "same"), ("u0", "u10", "different")], "url_a string, url_b string, label string")
    fresh = blocking.candidates(rows)
    joined = blocking.labelled_candidates(fresh, rows, labels)
    want = {(r["a"], r["b"]): r["similarity"] for r in fresh.collect()}
    got = {(r["a"], r["b"]): r for r in joined.collect()}
    assert {k: r["similarity"] for k, r in got.items() if r["candidate"]} == want and (0, 10) not in want
    assert {k: r["label"] for k, r in got.items() if r["label"]} == {(0, 1): "same", (0, 10): "different"}
    assert got[0, 10]["similarity"] == 0.6 and len(got) == len(want) + 1


def test_shelves_leave_the_vectors_to_the_classes(spark):
    rows = store(spark.createDataFrame([(i, f"s{i % 2}", "norte", [float(i % 4), 1.0]) for i in range(40)],
                                       "listing_id long, store string, brand_key string, embedding array<float>"))
    members, kept = blocking.shelves(rows, 3)
    assert members.columns == ["listing_id", "store", "class"] and members.count() == 40 and kept.count() == 4


def test_match_rows_hold_no_vectors(spark):
    from workloads import match_queries

    assert "embedding" not in match_queries.match_rows(spark, "/root/testdata/sf0.001").columns
