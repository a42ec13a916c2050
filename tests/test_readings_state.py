"""The state straight from the readings: the same as by way of instants, with two shuffles of rows instead of four."""

import random

import pytest

from shelfwise.operators import state as S
from tests.test_state import SCHEMA, rows_of


@pytest.mark.parametrize("limit", [1_000_000, 600, 50])
def test_readings_state_equals_the_state_of_instants(spark, limit):
    rows = rows_of(random.Random(8), 3000, True) + [(500, None, 5, None, True), (None, rows_of(random.Random(8), 1)[0][1], 5, None, True),
                                                    (501, rows_of(random.Random(8), 1)[0][1], None, 3, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(tuple, S.listing_state(S.instants(frame), 20).collect()))
    got = S.readings_state(frame, 20, limit=limit)
    assert got.columns == S.listing_state(S.instants(frame), 20).columns and sorted(map(tuple, got.collect())) == want and len(want) == 31
    assert S.readings_state(frame.where("false"), 20, limit=limit).count() == 0


def test_much_read_listings_are_found(spark):
    frame = spark.createDataFrame(rows_of(random.Random(9), 3000, True), SCHEMA)
    for buckets in (1, 10_000):
        assert [r["listing_id"] for r in S.much_read(frame, 600, buckets).collect()] == [0]
    assert S.much_read(frame, 3000) is None


def test_readings_are_shuffled_twice(spark):
    frame = spark.range(1000).selectExpr("id % 40 AS listing_id", "timestamp_ntz '2024-01-01' AS scraped_at", "id AS price", "id AS list_price", "true AS is_available")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = S.readings_state(frame, 20)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2
