"""Price history queries over lineitem and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators import prices as P
from shelfwise.operators import state as S

from . import views as V
from .registry import query



def since(r: DataFrame):
    return P.fresh_since(P.newest_instant(r), V.STALE_DAYS)


def offers(spark, folder) -> DataFrame:
    latest = V.latest(spark, folder)
    return S.offers_of(latest, V.listings(spark, folder), since(latest))


@query("latest_reading", V.PRICES + f"""
SELECT listing_id, product_id, store, {V.stamp_sql('scraped_at')} AS scraped_at, price, list_price, is_available FROM latest""")
def latest_reading(spark, folder):
    return V.latest(spark, folder).select(
        "listing_id", "product_id", "store", V.stamp("scraped_at").alias("scraped_at"), "price", "list_price", "is_available")


@query("latest_reading_stale", V.OFFERS + f"""
SELECT listing_id, product_id, store, price, {V.stamp_sql('scraped_at')} AS scraped_at, is_stale FROM offers""")
def latest_reading_stale(spark, folder):
    return offers(spark, folder).select("listing_id", "product_id", "store", "price",
                                        V.stamp("scraped_at").alias("scraped_at"), "is_stale")


@query("cheapest_offer", V.OFFERS + """
SELECT product_id, lowest_price, lowest_price_store, best_discount_percent, store_count
FROM lowest JOIN stats USING (product_id)""")
def cheapest_offer(spark, folder):
    return P.offer_rollup(offers(spark, folder)).where("lowest_price IS NOT NULL").select(
        "product_id", "lowest_price", "lowest_price_store", "best_discount_percent",
        F.col("store_count").cast("bigint").alias("store_count"))


@query("offer_stats", V.OFFERS + f"""
SELECT product_id, {V.stamp_sql('last_updated')} AS last_updated, best_discount_percent, coalesce(stores, '') AS stores, store_count,
       highest_price FROM stats""")
def offer_stats(spark, folder):
    return P.offer_stats(offers(spark, folder)).select(
        "product_id", V.stamp("last_updated").alias("last_updated"), "best_discount_percent",
        F.array_join("stores", ",").alias("stores"), F.col("store_count").cast("bigint").alias("store_count"),
        "highest_price")


@query("last_known_price", V.OFFERS + f"""
SELECT product_id, last_known_price, last_known_price_store, {V.stamp_sql('last_known_price_at')} AS last_known_price_at
FROM last_known""")
def last_known_price(spark, folder):
    return P.last_known_price(offers(spark, folder)).withColumn("last_known_price_at", V.stamp("last_known_price_at"))


@query("lowest_price", V.OFFERS + "SELECT product_id, lowest_price, lowest_price_store FROM lowest")
def lowest_price(spark, folder):
    return P.cheapest_offer(offers(spark, folder))


@query("product_image", V.OFFERS + "SELECT product_id, image_url FROM image")
def product_image(spark, folder):
    return P.product_image(V.latest(spark, folder), V.listings(spark, folder))


HISTORY_SQL = f"""
windowed AS (
  SELECT c.listing_id, c.scraped_at AS current_at, c.price AS current_price, c.list_price AS current_list_price,
         r.scraped_at, r.price, (r.list_price IS NULL OR r.list_price <= r.price) AND r.is_available AS usable
  FROM latest c JOIN readings r ON r.listing_id = c.listing_id
   AND r.scraped_at BETWEEN c.scraped_at - INTERVAL {V.WINDOW_DAYS} DAY AND c.scraped_at
),
agg AS (
  SELECT listing_id, current_at, current_price, current_list_price, min(scraped_at) AS observed_from,
         count(*) AS points_in_window, count(*) FILTER (WHERE usable) AS undiscounted_points,
         max(price) FILTER (WHERE usable) AS ref
  FROM windowed GROUP BY ALL
),
history AS (
  SELECT a.*, CASE WHEN current_list_price IS NULL OR current_list_price <= current_price THEN 'no_list_price'
                   WHEN undiscounted_points = 0 THEN 'insufficient_data'
                   WHEN current_list_price > ref THEN 'above_history' ELSE 'consistent' END AS history_status,
         CASE WHEN current_list_price > current_price THEN ref END AS history_reference,
         CASE WHEN current_list_price > current_price THEN
           (SELECT max(w.scraped_at) FROM windowed w WHERE w.listing_id = a.listing_id AND w.usable AND w.price = a.ref)
         END AS history_reference_at
  FROM agg a
)
"""


@query("history_check", f"{V.PRICES}, {HISTORY_SQL}" + f"""
SELECT listing_id, history_status, history_reference, {V.stamp_sql('history_reference_at')} AS history_reference_at,
       {V.stamp_sql('observed_from')} AS observed_from, points_in_window, undiscounted_points FROM history""")
def history_check(spark, folder):
    return P.history_verdicts(V.state(spark, folder)).select(
        "listing_id", "history_status", "history_reference", V.stamp("history_reference_at").alias("history_reference_at"),
        V.stamp("observed_from").alias("observed_from"), "points_in_window", "undiscounted_points")


def market_sql(references: str) -> str:
    return f"""
market_floor AS (
  SELECT product_id, store, min(price) AS price FROM offers
  WHERE is_available AND (list_price IS NULL OR list_price <= price) AND {references} GROUP BY 1, 2
),
market_raw AS (
  SELECT o.listing_id, o.product_id, o.store, o.price, o.list_price,
         o.list_price IS NOT NULL AND o.list_price > o.price AS on_sale,
         list(f.price ORDER BY f.price) FILTER (WHERE f.price IS NOT NULL) AS prices,
         string_agg(f.store, ',' ORDER BY f.store) AS stores
  FROM offers o LEFT JOIN market_floor f ON f.product_id = o.product_id AND f.store <> o.store
  GROUP BY ALL
),
market_ref AS (
  SELECT *, on_sale AND coalesce(len(prices), 0) > 0 AS enough,
         prices[(len(prices) + 1) // 2] + prices[len(prices) // 2 + 1] AS twice FROM market_raw
),
market_val AS (
  SELECT *, CASE WHEN enough THEN twice // 2 + CASE WHEN twice % 2 = 1 THEN (twice // 2) % 2 ELSE 0 END END AS ref FROM market_ref
),
market_tenths AS (
  SELECT *, 1000 * (list_price - ref) AS n, (((1000 * (list_price - ref)) % ref) + ref) % ref AS rem FROM market_val
),
market AS (
  SELECT listing_id, product_id, store,
         CASE WHEN NOT on_sale THEN 'no_list_price' WHEN NOT enough THEN 'insufficient_data'
              WHEN list_price * 100 > ref * 120 THEN 'above_market' ELSE 'within_market' END AS market_status,
         ref AS market_reference, CASE WHEN enough THEN coalesce(stores, '') ELSE '' END AS market_stores,
         ((n - rem) // ref + CASE WHEN 2 * rem > ref THEN 1 WHEN 2 * rem < ref THEN 0
                                  ELSE abs(((n - rem) // ref) % 2) END) / 10.0 AS percent_above
  FROM market_tenths
)
"""


@query("market_check", f"{V.OFFERS}, {market_sql('true')} SELECT * FROM market")
def market_check(spark, folder):
    return P.market_check(offers(spark, folder)).select(
        "listing_id", "product_id", "store", "market_status", "market_reference",
        F.array_join("market_stores", ",").alias("market_stores"), "percent_above")


@query("both_checks", f"{V.OFFERS}, {HISTORY_SQL}, {market_sql('NOT is_stale')}" + """
SELECT m.listing_id, m.product_id, market_status, market_reference, percent_above, history_status, history_reference
FROM market m JOIN history h USING (listing_id)""")
def both_checks(spark, folder):
    return P.both_checks(V.state(spark, folder), offers(spark, folder)).select(
        "listing_id", "product_id", "market_status", "market_reference", "percent_above", "history_status",
        "history_reference")


@query("verified_discounts", f"{V.OFFERS}, {V.PRODUCTS_SQL}, {HISTORY_SQL}, {market_sql('NOT is_stale')}" + """
SELECT o.listing_id, o.product_id, p.canonical_name, p.brand, o.store, o.price, o.list_price,
       o.list_price - o.price AS discount_amount,
       CAST(((n - n % o.list_price) // o.list_price + CASE WHEN 2 * (n % o.list_price) > o.list_price THEN 1
             WHEN 2 * (n % o.list_price) < o.list_price THEN 0 ELSE ((n - n % o.list_price) // o.list_price) % 2 END) AS DOUBLE) / 10.0
         AS discount_percent, h.history_reference, m.market_status
FROM (SELECT *, 1000 * (list_price - price) AS n FROM offers) o JOIN history h USING (listing_id)
     JOIN market m USING (listing_id) JOIN products p ON p.product_id = o.product_id
WHERE o.is_available AND NOT o.is_stale AND o.list_price > o.price AND h.history_status = 'consistent'""")
def verified_discounts(spark, folder):
    rows = P.verified_discounts(V.state(spark, folder), offers(spark, folder), V.products(spark, folder))
    return rows.select("listing_id", "product_id", "canonical_name", "brand", "store", "price", "list_price",
                       "discount_amount", "discount_percent", "history_reference", "market_status")


@query("price_series", f"WITH {V.READINGS_SQL}, {V.LISTINGS_SQL}" + f"""
SELECT r.product_id, r.store, r.listing_id, l.listing_url, {V.stamp_sql('r.scraped_at')} AS scraped_at, r.price, r.list_price,
       r.is_available FROM readings r JOIN listings l USING (listing_id) WHERE l.matching_status IN ('matched', 'new_product')""")
def price_series(spark, folder):
    return P.price_points(V.readings(spark, folder), V.listings(spark, folder)).select(
        "product_id", "store", "listing_id", "listing_url", V.stamp("scraped_at").alias("scraped_at"), "price",
        "list_price", "is_available")


@query("series_points", f"WITH {V.READINGS_SQL}, {V.LISTINGS_SQL}" + f"""
SELECT r.product_id, r.listing_id, l.listing_url, count(*) AS points, string_agg({V.stamp_sql('r.scraped_at')} || '=' || CAST(r.price AS VARCHAR), ';'
  ORDER BY r.scraped_at, r.price, r.list_price NULLS FIRST, r.is_available) AS series
FROM readings r JOIN listings l USING (listing_id) WHERE l.matching_status IN ('matched', 'new_product') GROUP BY ALL""")
def series_points(spark, folder):
    nested = P.nest_series(P.price_points(V.readings(spark, folder), V.listings(spark, folder)))
    text = F.array_join(F.transform("points", lambda p: F.concat(V.stamp(p["scraped_at"]), F.lit("="), p["price"].cast("string"))), ";")
    return nested.select("product_id", "listing_id", "listing_url", F.size("points").cast("bigint").alias("points"), text.alias("series"))


@query("price_ladder", V.OFFERS + """,
scale AS (SELECT product_id, min(CASE WHEN is_available AND NOT is_stale THEN price END) AS low,
                 max(coalesce(list_price, price)) AS top FROM offers GROUP BY 1)
SELECT listing_id, product_id, is_available AND NOT is_stale AND price = low AS is_lowest,
       CASE WHEN is_available AND NOT is_stale THEN price - low END AS over_lowest,
       greatest(6.0, ((2000 * price + top) // (2 * top)) / 10.0) AS share_percent
FROM offers JOIN scale USING (product_id)""")
def price_ladder(spark, folder):
    return P.price_ladder(offers(spark, folder)).select("listing_id", "product_id", "is_lowest", "over_lowest", "share_percent")


@query("range_30d", V.OFFERS + """,
recent AS (SELECT product_id, min(price) AS range_low, max(price) AS range_high FROM readings CROSS JOIN bound
           WHERE is_available AND scraped_at >= as_of - INTERVAL 365 DAY GROUP BY 1),
live AS (SELECT product_id, count(DISTINCT CASE WHEN is_available AND NOT is_stale THEN store END) AS stores_in_stock,
                count(DISTINCT store) AS stores, min(CASE WHEN is_available AND NOT is_stale THEN price END) AS low,
                max(CASE WHEN is_available AND NOT is_stale THEN price END) AS high FROM offers GROUP BY 1)
SELECT product_id, stores_in_stock, stores, range_low, range_high, CASE WHEN high > low THEN high - low END AS saving
FROM live LEFT JOIN recent USING (product_id)""")
def range_30d(spark, folder):
    r = V.readings(spark, folder)
    return P.product_facts(r, offers(spark, folder), P.newest_instant(V.latest(spark, folder)), 365).select(
        "product_id", F.col("stores_in_stock").cast("bigint").alias("stores_in_stock"),
        F.col("stores").cast("bigint").alias("stores"), "range_low", "range_high", "saving")


RANKS = ("store3", "store0", "store5")


@query("best_image", V.OFFERS + """
SELECT product_id, image_url FROM (
  SELECT product_id, image_url, row_number() OVER (PARTITION BY product_id ORDER BY
    CASE store WHEN 'store3' THEN 0 WHEN 'store0' THEN 1 WHEN 'store5' THEN 2 ELSE 3 END, is_stale, price, store, listing_url) AS rn
  FROM offers WHERE image_url IS NOT NULL) WHERE rn = 1""")
def best_image(spark, folder):
    return P.best_image(offers(spark, folder), RANKS)


@query("series_order", V.OFFERS + """,
cheap AS (SELECT product_id, listing_url AS cheapest_url FROM (SELECT *, row_number() OVER (PARTITION BY product_id
          ORDER BY price, store, listing_url) AS rn FROM offers WHERE is_available AND NOT is_stale) WHERE rn = 1),
rows AS (
  SELECT l.product_id, l.listing_id, l.store, coalesce(o.is_stale, true) AS stale,
         coalesce(l.listing_url = c.cheapest_url, false) AS cheapest, t.price AS last_price,
         row_number() OVER (PARTITION BY l.product_id ORDER BY l.store, l.listing_url) AS place,
         count(*) OVER (PARTITION BY l.product_id, l.store) AS repeats
  FROM listings l JOIN latest t USING (listing_id) LEFT JOIN offers o USING (listing_id)
       LEFT JOIN cheap c ON c.product_id = l.product_id
  WHERE l.matching_status IN ('matched', 'new_product'))
SELECT product_id, listing_id, CASE WHEN repeats > 1 THEN store || ' (' || place || ')' ELSE store END AS label, cheapest, stale,
       last_price, row_number() OVER (PARTITION BY product_id ORDER BY cheapest DESC, stale, last_price, place) AS position
FROM rows""")
def series_order(spark, folder):
    return P.series_order(V.latest(spark, folder), offers(spark, folder), V.listings(spark, folder)).withColumn(
        "position", F.col("position").cast("bigint"))


def event_readings(spark, folder):
    """events as readings: a listing is a (user, event type), value its price; errors are out of stock."""
    return V.table(spark, folder, "events").select(
        F.col("user_id").alias("product_id"), F.col("event_type").alias("store"),
        F.col("ts").alias("scraped_at"), F.col("event_id"),
        F.round(F.col("value") * 100).cast("bigint").alias("price"), (F.col("event_id") % 9 != 0).alias("is_available"))


EVENTS_SQL = """
event_readings AS (
  SELECT user_id AS product_id, event_type AS store, ts AS scraped_at, event_id,
         CAST(round(value * 100) AS BIGINT) AS price, event_id % 9 <> 0 AS is_available FROM events
),
daily AS (
  SELECT product_id, store, day, value FROM (
    SELECT product_id, store, CAST(scraped_at AS DATE) AS day, CASE WHEN is_available THEN price END AS value,
           row_number() OVER (PARTITION BY product_id, store, CAST(scraped_at AS DATE) ORDER BY scraped_at DESC, event_id DESC) AS rn
    FROM event_readings) WHERE rn = 1
)"""
GRID_SQL = EVENTS_SQL + """,
grid AS (
  SELECT product_id, store, day, value, read_day <> day AS carried FROM (
    SELECT d.product_id, d.store, g.day, d.value, d.day AS read_day,
           row_number() OVER (PARTITION BY d.product_id, d.store, g.day ORDER BY d.day DESC) AS rn
    FROM daily d JOIN (SELECT product_id, store, max(day) AS last_day FROM daily GROUP BY 1, 2) m USING (product_id, store)
         JOIN (SELECT DISTINCT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM daily) g
           ON g.day BETWEEN d.day AND least(d.day + 2, m.last_day)) WHERE rn = 1
)"""
KEYS = ("product_id", "store")


def event_daily(spark, folder):
    return P.daily_values(event_readings(spark, folder), KEYS, order=("scraped_at", "event_id"))


@query("daily_values", f"WITH {EVENTS_SQL} SELECT product_id, store, CAST(day AS VARCHAR) AS day, value FROM daily")
def daily_values(spark, folder):
    return event_daily(spark, folder).withColumn("day", F.col("day").cast("string"))


@query("daily_grid_carry", f"WITH {GRID_SQL} SELECT product_id, store, CAST(day AS VARCHAR) AS day, value, carried FROM grid")
def daily_grid_carry(spark, folder):
    return P.daily_grid(event_daily(spark, folder), KEYS).withColumn("day", F.col("day").cast("string"))


@query("daily_band", f"WITH {GRID_SQL}" + """,
calendar AS (SELECT product_id, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM grid GROUP BY 1),
band AS (SELECT product_id, day, min(value) AS low, max(value) AS high FROM grid GROUP BY 1, 2)
SELECT product_id, CAST(day AS VARCHAR) AS day, low, high FROM calendar LEFT JOIN band USING (product_id, day)""")
def daily_band(spark, folder):
    return P.daily_band(P.daily_grid(event_daily(spark, folder), KEYS)).withColumn("day", F.col("day").cast("string"))


@query("band_change", f"WITH {GRID_SQL}" + """,
band AS (SELECT product_id, day, min(value) AS low FROM grid GROUP BY 1, 2 HAVING min(value) IS NOT NULL)
SELECT product_id, first_low, last_low, last_low - first_low AS change FROM (
  SELECT product_id, arg_min(low, day) AS first_low, arg_max(low, day) AS last_low FROM band GROUP BY 1)""")
def band_change(spark, folder):
    return P.band_change(P.daily_band(P.daily_grid(event_daily(spark, folder), KEYS)))
