"""The listing state against plain loops, and how often the readings are scanned for it."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import mentions as H
from shelfwise.operators import prices as P
from shelfwise.operators import state as S
from workloads import price_queries, stages
from workloads import views as V

SCHEMA = "listing_id int, scraped_at timestamp_ntz, price long, list_price long, is_available boolean"
START = datetime.datetime(2024, 1, 1)


def rows_of(rng, n, hot=False):
    """Readings of listings, several of an instant among them; of a hot one, a third of all."""
    rows = []
    for i in range(n):
        listing = 0 if hot and i % 3 == 0 else rng.randrange(1, 30)
        price = rng.randrange(10, 40)
        rows.append((listing, START + datetime.timedelta(hours=rng.randrange(0, 2000)), price, rng.choice([None, price, price + 5]), rng.random() < 0.8))
    return rows


def plain_state(rows, days):
    out = {}
    for listing in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == listing]
        key = lambda r: (r[1], r[2], r[3] if r[3] is not None else -1, r[4])
        now = max(own, key=key)
        window = [r for r in own if r[1] >= now[1] - datetime.timedelta(days=days)]
        usable = [r for r in window if r[4] and not (r[3] is not None and r[3] > r[2])]
        top = max(((r[2], r[1]) for r in usable), default=(None, None))
        out[listing] = (now[1], now[2], now[3], now[4], *top, min(r[1] for r in window), len(window), len(usable))
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_state_equals_loops(spark, hot):
    rows = rows_of(random.Random(3), 3000, hot)
    frame = spark.createDataFrame(rows, SCHEMA)
    parts = [S.instants(frame.where(F.col("price") % 3 == k)) for k in range(3)]
    for merged in (S.instants(frame), S.merge_instants(*parts)):
        got = {r["listing_id"]: tuple(r)[1:] for r in S.listing_state(merged, 20).select(
            "listing_id", "scraped_at", "price", "list_price", "is_available", "reference", "reference_at", "observed_from", "points_in_window", "undiscounted_points").collect()}
        assert got == plain_state(rows, 20)
    assert S.listing_state(S.instants(frame.where("false"))).count() == 0


def test_a_hot_listing_is_spread_over_its_instants(spark):
    """A listing with a third of all readings: no partition of the first shuffle holds much more than its share."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        merged = S.instants(spark.createDataFrame(rows_of(random.Random(4), 6000, True), SCHEMA))
        sizes = [r["count"] for r in merged.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) > 1 and max(sizes) < 1.3 * sum(sizes) / len(sizes)


def scans(df):
    text = df._jdf.queryExecution().optimizedPlan().toString()
    return sum(line.strip(" +-:").startswith("Relation [") and "l_partkey" in line for line in text.splitlines())


def test_the_readings_are_scanned_twice_at_most(spark):
    folder = "/root/testdata/sf0.001"
    stages.forget()
    state = S.listing_state(S.instants(V.readings(spark, folder), V.READING_ORDER, ("product_id", "store")), V.WINDOW_DAYS)
    assert scans(state) == 2 and scans(P.latest_readings(V.readings(spark, folder))) == 1
    from __spark_entry__ import queries

    for name in ("verified_discounts", "catalog_sort_relevance", "product_summary", "cheapest_offer", "history_check"):
        assert scans(queries()[name](spark, folder)) == 0  # they read the published state
    assert price_queries.offers(spark, folder).count() > 0


def test_published_state_is_joined_without_a_shuffle(spark):
    frame = spark.createDataFrame(rows_of(random.Random(5), 500), SCHEMA)
    S.publish(S.current_state(S.instants(frame)), "listing_states_test", 4)
    try:
        table = spark.table("listing_states_test")
        other = table.withColumnRenamed("price", "again").select("listing_id", "again")
        plan = table.hint("merge").join(other, "listing_id")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.sql("DROP TABLE listing_states_test")


def test_names_by_automaton_equal_names_by_anchors(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 3)))
    texts = [(i, " ".join(word() for _ in range(rng.randint(0, 40)))) for i in range(120)] + [(900, None), (901, ""), (902, "*A*  b")]
    names = [(i, " ".join(word() for _ in range(rng.randint(1, 4)))) for i in range(60)] + [(100, None), (101, " * "), (102, "ab a"), (103, "ab a")]
    t = spark.createDataFrame(texts, "text_id int, text string")
    n = spark.createDataFrame(names, "product_id int, name string")
    for find in (H.found_names, H.mentions):
        got, want = (sorted(map(tuple, find(t, n, names_bytes=size).collect())) for size in (1 << 20, 0))
        assert got == want and got
    assert H.found_names(t, n.where("false")).count() == 0 and H.mentions(t.where("false"), n).count() == 0
