"""Streaming jobs drained over the events file, checked against batch SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfwise.operators import prices as P
from shelfwise.session import cut, work_folder
from shelfwise.sources import snapshots as S
from shelfwise.sources.tables import VersionedTable
from shelfwise.streaming import jobs as J

from . import views as V
from .ingest_queries import DROP_SQL, LOAD_SQL, load_tables, store_totals
from .registry import query


def drain(spark, stream, purpose, mode="append"):
    """Drain a job. In a local session its state gets one partition per core instead of the cluster default."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    if spark.sparkContext.master.startswith("local"):
        spark.conf.set(key, str(min(int(before), spark.sparkContext.defaultParallelism)))
    try:
        return J.drain(stream, work_folder(spark, purpose), mode)
    finally:
        spark.conf.set(key, before)


def event_stream(spark, folder):
    schema = V.table(spark, folder, "events").schema
    rows = J.file_stream(spark, schema, folder, "parquet", "events.parquet")
    return rows.select(F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("listing_id"),
                       F.col("ts").cast("timestamp").alias("scraped_at"), F.round(F.col("value") * 100).cast("bigint").alias("price"))


STREAM_SQL = """
WITH e AS (SELECT CAST(user_id AS VARCHAR) || '-' || event_type AS listing_id, ts, CAST(round(value * 100) AS BIGINT) AS price FROM events)"""


@query("stream_files", STREAM_SQL + " SELECT listing_id, count(*) AS readings, min(price) AS low, max(price) AS high FROM e GROUP BY 1")
def stream_files(spark, folder):
    rows = drain(spark, event_stream(spark, folder), "files")
    return rows.groupBy("listing_id").agg(F.count(F.lit(1)).alias("readings"), F.min("price").alias("low"), F.max("price").alias("high"))


@query("stream_first_of_day", STREAM_SQL + " SELECT listing_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, 1 AS readings FROM e GROUP BY 1, 2")
def stream_first_of_day(spark, folder):
    rows = drain(spark, J.first_of_day(event_stream(spark, folder)), "first")
    return rows.groupBy("listing_id", F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("readings"))


@query("stream_daily", STREAM_SQL + """
SELECT listing_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, min(price) AS low, max(price) AS high, arg_max(price, (ts, price)) AS last FROM e GROUP BY 1, 2""")
def stream_daily(spark, folder):
    rows = drain(spark, J.daily_band(event_stream(spark, folder)), "daily", "update")
    return J.newest_update(rows, ["listing_id", "day"]).withColumn("day", F.to_date("day").cast("string"))


ZONE = "America/Santiago"
FILE_ROWS = 500_000


@query("stream_latest", STREAM_SQL + f""",
newest AS (SELECT listing_id, arg_max(price, (ts, price)) AS price, max(ts) AS seen FROM e GROUP BY 1),
watermark AS (SELECT max(ts) - INTERVAL 2 DAY AS mark FROM e)
SELECT listing_id, price, strftime(seen, '%Y-%m-%d %H:%M:%S') AS scraped_at,
  timezone('UTC', timezone('{ZONE}', date_trunc('day', timezone('{ZONE}', timezone('UTC', seen))) + INTERVAL 3 DAY)) <= mark AS is_stale FROM newest CROSS JOIN watermark""")
def stream_latest(spark, folder):
    """Three batches of files, a third of the time each, some readings a day late and some twice; a listing unread for two local days ends as stale."""
    source = work_folder(spark, "readings")
    rows = V.table(spark, folder, "events").select(
        F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("listing_id"), F.col("ts").cast("timestamp").alias("scraped_at"),
        F.round(F.col("value") * 100).cast("bigint").alias("price"), "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    first, last = rows.agg(F.min("at")).scalar(), rows.agg(F.max("at")).scalar()
    third = F.floor((last - first + 1) / 3)
    part = F.least(F.lit(2), F.floor((F.col("at") - first) / third)).cast("int")
    late = (part < 2) & (first + (part + 1) * third - F.col("at") < 86400)
    rows = rows.select("listing_id", "scraped_at", "price", F.when(late & (F.col("event_id") % 5 == 0), F.array(part + 1))
                       .when(late & (F.col("event_id") % 7 == 0), F.array(part, part + 1)).otherwise(F.array(part)).alias("parts"))
    counts = rows.select(F.explode("parts").alias("part")).groupBy("part").count().collect()
    parts = max(1, min(r["count"] for r in counts) // FILE_ROWS) if len(counts) == 3 else 1  # so many rows leave no file of a batch out as empty
    for n in range(3):
        rows.where(F.array_contains("parts", n)).drop("parts").repartition(parts).write.mode("append").parquet(source)
    files = spark.readStream.schema("listing_id string, scraped_at timestamp, price long").option("maxFilesPerTrigger", parts).parquet(source)
    drained = drain(spark, J.latest_price(files, watermark="2 days", zone=ZONE), "latest", "update")
    return J.newest_update(drained, ["listing_id"]).select("listing_id", "price", V.stamp("scraped_at").alias("scraped_at"), "is_stale")


@query("stream_drop_alerts", DROP_SQL)
def stream_drop_alerts(spark, folder):
    """The daily totals arrive file by file and are judged as a stream; equals the batch review."""
    source = work_folder(spark, "totals")
    store_totals(spark, folder).withColumn("scraped_at", F.col("scraped_at").cast("timestamp")).repartition(4).write.parquet(source)
    totals = spark.readStream.schema("store string, scraped_at timestamp, key string, total long").option("maxFilesPerTrigger", 2).parquet(source)
    return J.newest_review(drain(spark, J.drop_alerts(totals), "drops", "update")).withColumn("scraped_at", V.stamp("scraped_at"))


FILE_CARDS = 50_000   # cards of a snapshot's file, about


PERIOD = "least(datediff(scraped_at, DATE '2000-01-01') DIV 150, 4)"


@query("stream_load", f"WITH {LOAD_SQL}" + """,
periods AS (
  SELECT listing_id, store, period, CASE WHEN is_available THEN price END AS price FROM (
    SELECT *, row_number() OVER (PARTITION BY listing_id, period ORDER BY scraped_at DESC, tie1 DESC, tie2 DESC, price DESC, list_price DESC NULLS LAST, is_available DESC) AS rn
    FROM (SELECT *, least(date_diff('day', DATE '2000-01-01', CAST(scraped_at AS DATE)) // 150, 4) AS period FROM readings WHERE scraped_at >= TIMESTAMP '2000-01-01')) WHERE rn = 1),
last_seen AS (SELECT listing_id, any_value(store) AS store, arg_max(price IS NOT NULL, period) AS is_active FROM periods GROUP BY 1),
listed AS (SELECT coalesce(n.store, o.store) AS store, count(*) AS listings, count(*) FILTER (WHERE coalesce(n.is_active, o.is_active)) AS active
           FROM old_listings o FULL JOIN last_seen n USING (listing_id) GROUP BY 1),
priced AS (SELECT store, count(*) AS prices, CAST(sum(price) AS BIGINT) AS total FROM (
             SELECT store, price FROM periods WHERE price IS NOT NULL UNION ALL SELECT store, price FROM old_prices JOIN old_listings USING (listing_id)) GROUP BY 1)
SELECT store, listings, active, prices, total FROM listed JOIN priced USING (store)""")
def stream_load(spark, folder):
    """Five snapshots of every store arrive as files, large ones in parts, and are loaded batch by batch, one batch twice: as if loaded one after the other."""
    r = V.readings(spark, folder)
    old, prices, _ = load_tables(spark, folder)
    stamp, text = (lambda c: F.col(c).cast("timestamp")), (lambda c: F.col(c).cast("string"))
    listings = old.select(text("listing_id").alias("listing_id"), "store", "listing_url", "raw_name", "raw_brand", "image_url", stamp("first_seen_at").alias("first_seen_at"),
                          stamp("last_seen_at").alias("last_seen_at"), "is_active", F.lit(None).cast("string").alias("declared_gender"))
    known = prices.select(text("listing_id").alias("listing_id"), "price", F.lit(None).cast("bigint").alias("list_price"), F.lit("CLP").alias("currency"),
                          F.lit(True).alias("is_available"), stamp("scraped_at").alias("scraped_at"))
    table = VersionedTable(spark, work_folder(spark, "load"))
    table.commit({"listings": listings, "prices": known}, "history")

    recent = r.where("scraped_at >= timestamp_ntz '2000-01-01'").withColumn("period", F.expr(PERIOD))
    newest = P.pick(recent, ["listing_id", "product_id", "store", "period"], V.READING_ORDER, largest=True)
    price = F.when(F.col("is_available"), F.concat(F.lit("$"), F.translate(F.format_number("price", 0), ",", ".")))
    url = F.concat(F.lit("https://"), "store", F.lit(".example/p/"), F.col("product_id").cast("string"))
    card = F.struct(F.concat(F.lit("part "), F.col("product_id").cast("string")).alias("name"), price.alias("current_price"), url.alias("url"))
    day = F.date_format(F.date_add(F.lit("2002-01-01").cast("date"), F.col("period").cast("int")), "yyyy-MM-dd'T'HH:mm:ss")
    cards = cut(newest.select("store", "period", day.alias("scraped_at"), card.alias("card")))
    most = cards.groupBy("store", "period").count().agg(F.max("count").alias("n")).first()["n"] or 0
    files = most // FILE_CARDS + 1
    cards = cards.withColumn("deal", F.pmod(F.xxhash64("card.url"), F.lit(files)))
    numbered = F.row_number().over(Window.partitionBy("store", "period").orderBy("deal")).alias("part")
    several = cards.select("store", "period", "deal").distinct().select(
        "*", numbered, F.count(F.lit(1)).over(Window.partitionBy("store", "period")).cast("int").alias("parts"))
    source = work_folder(spark, "snapshots")
    for period in range(5):
        own = cards.where(F.col("period") == period).repartition(6 * files, "store", "period", "scraped_at", "deal")  # a task gathers a few files' cards
        documents = own.groupBy("store", "period", "scraped_at", "deal").agg(F.collect_list("card").alias("products"))
        own = documents.join(F.broadcast(several), ["store", "period", "deal"]).select(
            "part", "parts", "store", "scraped_at", F.lit(2).alias("price_extraction_version"), F.struct(F.lit("done").alias("step")).alias("progress"),
            F.struct(F.lit("all_pages").alias("stop_reason"), F.lit(True).alias("catalog_exhausted")).alias("pagination"), "products", F.col("store").alias("shop"), F.col("part").alias("piece"))
        own.write.mode("append").partitionBy("shop", "piece").json(f"{source}/{period}")
    stores = [f"store{i}" for i in range(6)]
    handle = J.snapshot_loader(table, stores, stop_rules={}, total_rules={}, max_share=1.0)
    J.run_batches(J.snapshot_stream(spark, source, per_batch=12 * files), handle, f"{work_folder(spark, 'checkpoint')}")
    handle(S.read_snapshots(spark, f"{source}/0/*/*/*.json"), 0)  # a replay of the first batch loads nothing
    listed = table.read("listings").groupBy("store").agg(F.count(F.lit(1)).alias("listings"), F.count_if("is_active").alias("active"))
    owners = table.read("listings").select("listing_id", "store")
    priced = table.read("prices").join(owners, "listing_id").groupBy("store").agg(F.count(F.lit(1)).alias("prices"), F.sum("price").alias("total"))
    return listed.join(priced, "store")
