"""The driver's tables seen as the library's tables, in Spark and in the oracle's SQL.

lineitem is a price history: a listing is a (part, supplier mod 6) pair, a line is one
reading of it. part is the product table. Prices are whole cents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.operators import prices as P
from shelfwise.operators import state as S
from shelfwise.session import cut

from .stages import built, stage

STALE_DAYS = 365    # readings are years apart here: widen the two-day default
WINDOW_DAYS = 1460


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def readings(spark: SparkSession, folder: str) -> DataFrame:
    base = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    percent = F.round(F.abs("l_discount") * 100).cast("int")
    return (
        table(spark, folder, "lineitem")
        .select("*", base.alias("base"), percent.alias("pct"))
        .select(
            (F.col("l_partkey") * 6 + F.col("l_suppkey") % 6).alias("listing_id"),
            F.col("l_partkey").alias("product_id"),
            F.concat(F.lit("store"), (F.col("l_suppkey") % 6).cast("string")).alias("store"),
            F.col("l_shipdate").alias("scraped_at"),
            F.col("l_orderkey").alias("tie1"),
            F.col("l_linenumber").cast("int").alias("tie2"),
            F.expr("CASE WHEN pct >= 5 THEN base - (base * pct) DIV 100 ELSE base END").alias("price"),
            F.expr("CASE WHEN pct >= 5 THEN base END").alias("list_price"),
            (F.col("l_returnflag") != "R").alias("is_available"),
        )
    )


READING_ORDER = ("scraped_at", "tie1", "tie2", "price", "list_price", "is_available")

READINGS_SQL = """
readings AS (
  SELECT l_partkey * 6 + l_suppkey % 6 AS listing_id, l_partkey AS product_id,
         'store' || CAST(l_suppkey % 6 AS VARCHAR) AS store, l_shipdate AS scraped_at,
         l_orderkey AS tie1, l_linenumber AS tie2,
         CASE WHEN pct >= 5 THEN base - (base * pct) // 100 ELSE base END AS price,
         CASE WHEN pct >= 5 THEN base END AS list_price,
         l_returnflag <> 'R' AS is_available
  FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS base,
               CAST(round(abs(l_discount) * 100) AS INTEGER) AS pct FROM lineitem)
),
latest AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY scraped_at DESC, tie1 DESC, tie2 DESC,
           price DESC, list_price DESC NULLS LAST, is_available DESC) AS rn FROM readings) WHERE rn = 1
),
bound AS (
  SELECT date_trunc('day', max(scraped_at)) - INTERVAL 365 DAY AS fresh_since, max(scraped_at) AS as_of FROM readings
)
"""


def listings_from(source: DataFrame) -> DataFrame:
    """Listing attributes, functions of the (product, store) pair."""
    listing = F.col("listing_id")
    return source.select(
        "listing_id", "product_id", "store",
        F.concat(F.lit("https://"), F.col("store"), F.lit(".example/p/"), F.col("product_id").cast("string"))
        .alias("listing_url"),
        F.when(listing % 11 == 0, "pending").otherwise("matched").alias("matching_status"),
        (listing % 7 != 0).alias("is_active"),
        F.when(listing % 3 != 0, F.concat(F.lit("https://img.example/"), listing.cast("string"))).alias("image_url"),
    )


def state(spark: SparkSession, folder: str) -> DataFrame:
    """Every listing's latest reading and the window before it, published once and read by all queries of a job."""
    return stage(spark, folder, "state", lambda: cut(S.readings_state(
        readings(spark, folder), WINDOW_DAYS, READING_ORDER, ("product_id", "store"))))


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """Every listing's latest reading, in one scan; of the state, where that was published."""
    if built(spark, folder, "state"):
        return state(spark, folder).drop(*S.HISTORY)
    return stage(spark, folder, "latest", lambda: cut(P.latest_readings(readings(spark, folder), order=READING_ORDER)))


def listings(spark: SparkSession, folder: str) -> DataFrame:
    """A listing is a product in a store, so its latest reading names it."""
    return listings_from(latest(spark, folder).select("listing_id", "product_id", "store"))


LISTINGS_SQL = """
listings AS (
  SELECT listing_id, product_id, store,
         'https://' || store || '.example/p/' || CAST(product_id AS VARCHAR) AS listing_url,
         CASE WHEN listing_id % 11 = 0 THEN 'pending' ELSE 'matched' END AS matching_status,
         listing_id % 7 <> 0 AS is_active,
         CASE WHEN listing_id % 3 <> 0 THEN 'https://img.example/' || CAST(listing_id AS VARCHAR) END AS image_url
  FROM (SELECT DISTINCT listing_id, product_id, store FROM readings)
)
"""


def products(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, folder, "part").select(
        key.alias("product_id"),
        F.concat_ws("|", "p_brand", "p_name").alias("fragrance_id"),
        F.concat(F.col("p_brand"), F.lit(" "), F.col("p_name"), F.lit(" "), F.col("p_size").cast("string"),
                 F.lit(" ml")).alias("canonical_name"),
        F.col("p_brand").alias("brand"),
        F.col("p_name").alias("name"),
        F.lower("p_type").alias("concentration"),
        F.col("p_size").cast("int").alias("volume_ml"),
        F.when(key % 10 == 0, "travel_set").otherwise("full_bottle").alias("presentation"),
        F.when(key % 3 == 0, "male").when(key % 3 == 1, "female").otherwise("unisex").alias("gender"),
    )


PRODUCTS_SQL = """
products AS (
  SELECT p_partkey AS product_id, p_brand || '|' || p_name AS fragrance_id,
         p_brand || ' ' || p_name || ' ' || CAST(p_size AS VARCHAR) || ' ml' AS canonical_name,
         p_brand AS brand, p_name AS name, lower(p_type) AS concentration, CAST(p_size AS INTEGER) AS volume_ml,
         CASE WHEN p_partkey % 10 = 0 THEN 'travel_set' ELSE 'full_bottle' END AS presentation,
         CASE p_partkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE 'unisex' END AS gender
  FROM part
)
"""

OFFERS_SQL = """
offers AS (
  SELECT r.*, l.listing_url, l.image_url, r.scraped_at < b.fresh_since AS is_stale
  FROM latest r JOIN listings l USING (listing_id, product_id, store) CROSS JOIN bound b
  WHERE l.is_active AND l.matching_status IN ('matched', 'new_product')
),
lowest AS (
  SELECT product_id, price AS lowest_price, store AS lowest_price_store FROM (
    SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY price, store) AS rn
    FROM offers WHERE is_available AND NOT is_stale) WHERE rn = 1
),
stats AS (
  SELECT product_id, max(scraped_at) AS last_updated,
         max(CASE WHEN is_available AND NOT is_stale AND list_price > price
                  THEN ((2000 * (list_price - price) + list_price) // (2 * list_price)) / 10.0 END) AS best_discount_percent,
         string_agg(DISTINCT CASE WHEN is_available AND NOT is_stale THEN store END, ',' ORDER BY
                    CASE WHEN is_available AND NOT is_stale THEN store END) AS stores,
         count(DISTINCT CASE WHEN is_available AND NOT is_stale THEN store END) AS store_count,
         max(CASE WHEN is_available AND NOT is_stale THEN price END) AS highest_price
  FROM offers GROUP BY product_id
),
last_known AS (
  SELECT product_id, price AS last_known_price, store AS last_known_price_store, scraped_at AS last_known_price_at FROM (
    SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY price, store, scraped_at DESC) AS rn
    FROM offers WHERE is_available AND is_stale) WHERE rn = 1
),
image AS (
  SELECT product_id, image_url FROM (
    SELECT l.product_id, l.image_url, row_number() OVER (PARTITION BY l.product_id ORDER BY
           c.is_available IS NOT TRUE, c.price NULLS LAST, l.store, l.listing_url) AS rn
    FROM listings l LEFT JOIN latest c USING (listing_id)
    WHERE l.is_active AND l.image_url IS NOT NULL AND l.matching_status IN ('matched', 'new_product')) WHERE rn = 1
)
"""

SUMMARY_SQL = """
summary AS (
  SELECT p.product_id, p.fragrance_id, p.canonical_name, p.brand, p.name, p.concentration, p.volume_ml,
         p.presentation, p.gender, lowest.lowest_price, lowest.lowest_price_store, image.image_url,
         CASE WHEN p.presentation <> 'travel_set' AND lowest.lowest_price IS NOT NULL
              THEN ((20 * lowest.lowest_price + p.volume_ml) // (2 * p.volume_ml)) / 10.0 END AS price_per_ml,
         stats.best_discount_percent, stats.last_updated, coalesce(stats.store_count, 0) AS store_count,
         stats.stores, stats.highest_price,
         CASE WHEN lowest.lowest_price IS NULL THEN last_known.last_known_price END AS last_known_price,
         CASE WHEN lowest.lowest_price IS NULL THEN last_known.last_known_price_store END AS last_known_price_store,
         CASE WHEN lowest.lowest_price IS NULL THEN last_known.last_known_price_at END AS last_known_price_at
  FROM products p LEFT JOIN lowest USING (product_id) LEFT JOIN stats USING (product_id)
       LEFT JOIN image USING (product_id) LEFT JOIN last_known USING (product_id)
)
"""

PRICES = f"WITH {READINGS_SQL}"
OFFERS = f"WITH {READINGS_SQL}, {LISTINGS_SQL}, {OFFERS_SQL}"
SUMMARY = f"WITH {READINGS_SQL}, {LISTINGS_SQL}, {PRODUCTS_SQL}, {OFFERS_SQL}, {SUMMARY_SQL}"


def stamp(column: str):
    """A timestamp as text, the same in both engines."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def stamp_sql(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"
