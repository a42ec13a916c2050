"""Streaming jobs at the level of their operators."""

import datetime as dt
import json
import random

import pandas as pd

from shelfwise.schemas import LISTINGS, PRICES
from shelfwise.sources.snapshots import read_snapshots
from shelfwise.sources.tables import VersionedTable
from shelfwise.streaming import jobs as J

UTC = dt.timezone.utc


def test_stale_midnights_that_a_clock_change_skips_or_repeats():
    read = pd.Series([int(dt.datetime(2024, 9, 5, 12, tzinfo=UTC).timestamp()) * 1_000_000, int(dt.datetime(2024, 10, 31, 12, tzinfo=UTC).timestamp()) * 1_000_000])
    ends = [dt.datetime.fromtimestamp(ms / 1000, UTC) for ms in (J.stale_at(read[:1], 2, "America/Santiago")[0], J.stale_at(read[1:], 2, "America/Havana")[1])]
    assert ends == [dt.datetime(2024, 9, 8, 4, tzinfo=UTC), dt.datetime(2024, 11, 3, 4, tzinfo=UTC)]


def test_latest_price_keeps_a_state_per_bucket_and_reports_each_stale_listing_once(spark, tmp_path):
    rng, start = random.Random(3), dt.datetime(2024, 5, 1)
    schema = "listing_id string, scraped_at timestamp, price long"
    batches = [[(f"l{rng.randrange(300)}", start + dt.timedelta(days=4 * n, seconds=rng.randrange(86400)), rng.randrange(1, 50)) for _ in range(200)] for n in range(4)]
    batches[1] += [("late", start + dt.timedelta(days=3), 7), ("none", None, 1), ("none", start + dt.timedelta(days=4), None)]
    batches[2] += batches[1][:20]  # read again
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = []
    query = (J.latest_price(files, buckets=8).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True)
             .foreachBatch(lambda batch, n: out.extend((n, *row) for row in batch.collect())).start())
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 8
    newest = {}
    for rows in batches:
        for key, at, price in rows:
            if at is not None and price is not None:
                newest[key] = max(newest.get(key, (at, price)), (at, price))
    mark = max(at for at, _ in newest.values()) - dt.timedelta(days=2)
    midnight = {key: dt.datetime.combine(at.date(), dt.time()) + dt.timedelta(days=3) for key, (at, _) in newest.items()}
    last = {row[1]: row[2:] for row in sorted(out)}
    assert last == {key: (at, price, midnight[key] <= mark) for key, (at, price) in newest.items()}
    assert len({row[1:4] for row in out if row[4]}) == sum(row[4] for row in out) > 30


def test_the_cards_of_one_snapshot_are_parsed_by_all_tasks_and_tables_are_not_copied(spark, tmp_path, monkeypatch):
    products = [{"name": f"part {i}", "current_price": f"${i}", "url": f"https://store0.example/p/{i}"} for i in range(1, 201)]
    for day in (1, 2):
        head = {"store": "store0", "scraped_at": f"2024-05-0{day}T00:00:00", "price_extraction_version": 2, "progress": {"step": "done"},
                "pagination": {"stop_reason": "all_pages", "catalog_exhausted": True}, "products": products}
        (tmp_path / f"snapshot{day}.json").write_text(json.dumps(head))
    table = VersionedTable(spark, f"{tmp_path}/table")
    wanted = [f for f in LISTINGS if f.name in ("listing_id", "store", "listing_url", "raw_name", "raw_brand", "image_url", "first_seen_at", "last_seen_at", "is_active")]
    table.commit({"listings": spark.createDataFrame([], type(LISTINGS)(wanted)), "prices": spark.createDataFrame([], PRICES)}, "start")
    seen, cuts, load = [], [], J.load
    monkeypatch.setattr(J, "load", lambda heads, cards, *rest, **options: seen.append(cards.rdd.getNumPartitions()) or load(heads, cards, *rest, **options))
    cut = J.cut
    monkeypatch.setattr(J, "cut", lambda df: cuts.append(df.columns) or cut(df))
    J.snapshot_loader(table, ["store0"], stop_rules={}, total_rules={}, max_share=1.0)(read_snapshots(spark, f"{tmp_path}/*.json"), 0)
    assert len(seen) == 2 and min(seen) >= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(cuts) == 2 and not any("products" in columns for columns in cuts)  # heads and cards alone, whatever the turns
    assert table.read("listings").count() == 200 and table.read("prices").groupBy("scraped_at").count().count() == 2
    assert table.read("prices").count() == 400


def test_a_snapshot_in_parts_is_loaded_once_all_have_come(spark, tmp_path):
    def write(folder, store, part, parts, cards):
        (tmp_path / folder).mkdir(exist_ok=True)
        products = [{"name": f"part {i}", "current_price": f"${price}", "url": f"https://{store}.example/p/{i}"} for i, price in cards]
        head = {"store": store, "scraped_at": "2024-05-01T00:00:00", "price_extraction_version": 2, "progress": {"step": "done"}, "products": products,
                "pagination": {"stop_reason": "all_pages", "catalog_exhausted": True}} | ({"part": part, "parts": parts} if parts else {})
        (tmp_path / folder / f"{store}-{part}.json").write_text(json.dumps(head))

    write("0", "store0", 1, 3, [(i, 1000 + i) for i in range(1, 41)])
    write("0", "store1", 0, 0, [(i, 2000 + i) for i in range(1, 11)])
    write("1", "store0", 3, 3, [(5, 9000), *((i, 1000 + i) for i in range(61, 81))])
    write("1", "store0", 9, 3, [])
    (tmp_path / "1" / "store0-9.json").write_text((tmp_path / "0" / "store0-1.json").read_text())  # part 1 once more
    write("2", "store0", 2, 3, [(i, 1000 + i) for i in range(41, 61)])
    table = VersionedTable(spark, f"{tmp_path}/table")
    wanted = [f for f in LISTINGS if f.name in ("listing_id", "store", "listing_url", "raw_name", "raw_brand", "image_url", "first_seen_at", "last_seen_at", "is_active")]
    table.commit({"listings": spark.createDataFrame([], type(LISTINGS)(wanted)), "prices": spark.createDataFrame([], PRICES)}, "start")
    handle = J.snapshot_loader(table, ["store0", "store1"], stop_rules={}, total_rules={}, max_share=1.0)
    seen = []
    for n in range(3):
        handle(read_snapshots(spark, f"{tmp_path}/{n}/*.json"), n)
        seen.append(({r["store"]: r["count"] for r in table.read("listings").groupBy("store").count().collect()}, table.holds("waiting")))
    assert seen == [({"store1": 10}, True), ({"store1": 10}, True), ({"store0": 80, "store1": 10}, False)]
    prices = [r["price"] for r in table.read("prices").collect()]
    assert len(prices) == 90 and 9000 in prices and 1005 not in prices  # of a card in two parts the later one
