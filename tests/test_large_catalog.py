"""Steps of matching that must not grow faster than the catalog: text read once per written form, pairs shipped as numbers, nothing walked twice."""

from pyspark.sql import functions as F

from shelfwise.operators import blocking, products, rules
from shelfwise.operators import tokens as T
from shelfwise.session import store


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def listings(spark, rows):
    frame = spark.createDataFrame(rows, "listing_id long, store string, brand string, name string, volume_ml int, concentration string")
    return frame.withColumn("listing_url", F.concat(F.lit("u"), "listing_id"))


def test_listings_of_one_form_are_tokenised_once(spark):
    rows = [(1, "s", "Norte", "Rio 50 ml (M)", 50, None), (2, "t", "Norte", "Rio 50 ml (M)", 50, None), (3, "dperfumes", "Norte", "Rio 50 ml (M)", 50, None),
            (4, "s", None, "Rio 50 ml (M)", 50, None), (5, "t", None, "Rio 50 ml (M)", 50, None), (6, "s", "Norte", "Rio 50 ml (M)", None, None)]
    got = {r["listing_id"]: r for r in T.tokenize_listings(listings(spark, rows)).collect()}
    assert {i: r["form"] for i, r in got.items()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6}
    assert {i: r["store"] for i, r in got.items()} == {i: s for i, s, *_ in rows}
    assert got[3]["coded_gender"] and not got[1]["coded_gender"] and got[1]["listing_key"] and got[6]["listing_key"] is None


def test_splitting_keys_leaves_nothing_to_walk_again(spark):
    rows = T.tokenize_listings(listings(spark, [(i, "s", "Norte", "Rio Cologne 50 ml" if i % 2 else "Rio 50 ml", 50, None) for i in range(12)]))
    members = products.grouped_listings(rows, spark.createDataFrame([], "a long, b long, similarity double, group_id long")).localCheckpoint()
    parts = products.split_keys(members, products.group_keys(members))
    assert "Pandas" not in plan(parts)
    assert {r["group_id"]: r["part"] for r in parts.collect()} == {i: i % 2 for i in range(12)}


def test_reference_names_cut_a_name_once_per_form(spark):
    rows = T.tokenize_listings(listings(spark, [(i, "s" if i % 2 else "t", "Norte" if i % 3 else None, "Norte Rio 50 ml", 50, None) for i in range(12)]))
    members = products.grouped_listings(rows, spark.createDataFrame([], "a long, b long, similarity double, group_id long")).localCheckpoint()
    groups = products.group_keys(members)
    assigned = products.assign_products(members, groups, products.split_keys(members, groups))
    names = products.reference_names(members, assigned, products.brand_spelling(rows))
    assert "levenshtein" not in plan(names)
    assert {(r["brand"], r["name"], r["listings"], r["reference_listing"]) for r in names.collect()} == {("Norte", "Rio", 8, 1), ("", "Norte Rio", 4, 0)}


def test_pairs_are_shipped_without_words(spark):
    names = [" ".join(f"{w}{i % 7}" for w in ("magnolia", "bergamota", "sandalo", "vainilla", "pachuli", "jazmin")) + f" {50 + 50 * (i % 2)} ml" for i in range(14)]
    rows = rules.with_split_flags(T.tokenize_listings(listings(
        spark, [(i, "s" if i % 2 else "t", "Norte", names[i % 14], 50 + 50 * (i % 2), None) for i in range(400)]))).localCheckpoint()
    pairs = spark.range(400).toDF("a").crossJoin(spark.range(400).toDF("b")).where("a < b").withColumn("similarity", F.lit(0.5)).localCheckpoint()
    judged = rules.classify(pairs, rows)
    assert not any("words_a" in line and "similarity" in line for line in plan(judged).splitlines())
    got = {(r["a"], r["b"]): r["reason"] for r in judged.collect()}
    assert len(got) == 400 * 399 // 2
    assert all(reason == ("volume" if (a - b) % 2 else "variant" if (a - b) % 14 else "same_name") for (a, b), reason in got.items())


def test_pairs_are_settled_by_scalars_and_wordings_compared_once(spark, monkeypatch):
    rows = rules.with_split_flags(T.tokenize_listings(listings(
        spark, [(i, f"s{i % 2}", "Norte", f"{('Lago Azul', 'Lago', 'Rio Verde')[i % 3]} {50 + i} ml" if i < 60 else None, 50 + i if i % 2 else None, None)
                for i in range(62)]))).localCheckpoint()
    pairs = spark.range(62).toDF("a").crossJoin(spark.range(62).toDF("b")).where("a < b").withColumn("similarity", F.lit(0.5)).localCheckpoint()
    tables = []
    monkeypatch.setattr(rules, "cut", lambda df: tables.append(df.localCheckpoint()) or tables[-1])
    judged = rules.classify(pairs, rows)
    got = {(r["a"], r["b"]): r["reason"] for r in judged.collect()}
    worded = [t for t in tables if "other_name" in t.columns]
    assert [t.count() for t in worded] == [13]  # of three names and none
    assert len(got) == 62 * 61 // 2
    for (a, b), reason in got.items():
        if b < 60:
            want = "volume" if a % 2 and b % 2 else "name" if (a % 3 == 2) != (b % 3 == 2) else "extra_words" if a % 3 != b % 3 else "unknown_volume"
            assert reason == want, (a, b, reason)


def test_labels_and_candidates_meet_in_one_join(spark):
    rows = spark.createDataFrame([(i, f"s{i}", f"u{i}", [float(i == 1), float(i != 1)]) for i in range(5)],
                                 "listing_id long, store string, listing_url string, embedding array<float>")
    pairs = spark.createDataFrame([(0, 1, 0.25), (0, 2, 0.5), (0, 3, 0.75)], "a long, b long, similarity double")
    labels = spark.createDataFrame([("u0", "u1", "same"), ("u0", "u3", None), ("u1", "u2", "different"), ("u2", "u4", None), ("u3", "gone", "same")],
                                   "url_a string, url_b string, label string")
    keyed = blocking.label_pairs(pairs, rows, labels)
    assert "Join" not in plan(keyed)
    assert sorted(keyed.collect(), key=str) == sorted(
        [(0, 1, 0.25, "same"), (0, 2, 0.5, None), (0, 3, 0.75, None), (1, 2, 0.0, "different"), (2, 4, 1.0, None)], key=str)
    old = blocking.add_labelled(pairs, rows, labels)
    assert sorted(map(tuple, old.collect())) == sorted((r["a"], r["b"], r["similarity"]) for r in keyed.collect())


def test_shared_tables_are_read_by_column(spark):
    frame = spark.createDataFrame([(1, "a", [0.5] * 64), (2, None, None)] + [(3, "b", [0.25] * 64)] * 998, "listing_id long, store string, embedding array<float>")
    kept = store(frame)
    assert sorted(kept.collect(), key=str) == sorted(frame.collect(), key=str) and kept.dtypes == frame.dtypes
    assert "ReadSchema: struct<listing_id:bigint>" in kept.select("listing_id")._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert int(str(kept._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > 998 * 64 * 4  # equal rows too count as such


def test_store_duplicates_resolves_no_products(spark, monkeypatch):
    from workloads import id_queries, match_queries

    def refuse(*_):
        raise AssertionError("products are not needed")

    monkeypatch.setattr(match_queries, "resolved_products", refuse)
    assert id_queries.store_duplicates(spark, "/root/testdata/sf0.001").columns == ["group_id", "listings", "inconsistent"]
    _, members = match_queries.grouped_members(spark, "/root/testdata/sf0.001")
    assert "embedding" not in members.columns and members.count() == members.select("listing_id").distinct().count()
