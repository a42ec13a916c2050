"""Ingest queries. events by type and day are snapshots of five stores; lineitem split by date is a load."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfwise.operators import completeness as C
from shelfwise.operators import ingest as I
from shelfwise.operators import prices as P
from shelfwise.operators import runs as R
from shelfwise.sources import snapshots as S

from . import views as V
from .registry import query

CARDS_SQL = """
cards AS (
  SELECT event_type AS store, CAST(ts AS DATE) AS day, event_type || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS file, event_id, ts,
         'https://' || event_type || '.example/u/' || CAST(user_id AS VARCHAR) AS url,
         CASE WHEN event_id % 9 <> 0 THEN CAST(round(value * 100) AS BIGINT) END AS price,
         row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS position
  FROM events
),
heads AS (
  SELECT store, file, day, CAST(day AS TIMESTAMP) AS scraped_at, count(*) AS n_products, count(DISTINCT url) AS n_urls,
         CASE WHEN day(day) % 7 = 0 THEN 'listing' ELSE 'done' END AS step, CASE WHEN day(day) % 11 = 0 THEN 1 ELSE 2 END AS version,
         CASE WHEN day(day) % 10 <> 3 THEN count(DISTINCT CASE WHEN price IS NOT NULL THEN url END) + CASE WHEN day(day) % 5 = 0 THEN 1 ELSE 0 END END AS site_total,
         count(DISTINCT CASE WHEN price IS NOT NULL THEN url END) AS n_read
  FROM cards GROUP BY store, file, day
)"""


def cards(spark, folder):
    """One row per card. The rank runs inside one store's day, the size of one snapshot document."""
    e = V.table(spark, folder, "events")
    day = F.to_date("ts")
    w = Window.partitionBy("event_type", day).orderBy("ts", "event_id")
    return e.select(
        F.col("event_type").alias("store"), day.alias("day"), F.concat_ws("-", "event_type", day.cast("string")).alias("file"), "event_id", "ts",
        F.concat(F.lit("https://"), "event_type", F.lit(".example/u/"), F.col("user_id").cast("string")).alias("url"),
        F.when(F.col("event_id") % 9 != 0, F.round(F.col("value") * 100).cast("bigint")).alias("price"),
        (F.row_number().over(w) - 1).alias("position"))


def heads(spark, folder, source=None):
    n = F.dayofmonth("day")
    priced = F.count_distinct(F.when(F.col("price").isNotNull(), F.col("url")))
    return (source if source is not None else cards(spark, folder)).groupBy("store", "file", "day").agg(
        F.count(F.lit(1)).alias("n_products"), F.count_distinct("url").alias("n_urls"), priced.alias("n_read")).select(
        "store", "file", "day", F.col("day").cast("timestamp_ntz").alias("scraped_at"), "n_products", "n_urls", "n_read",
        F.when(n % 7 == 0, "listing").otherwise("done").alias("step"), F.when(n % 11 == 0, 1).otherwise(2).alias("version"),
        F.when(n % 10 != 3, F.col("n_read") + F.when(n % 5 == 0, 1).otherwise(0)).alias("site_total"))


KNOWN = ("click", "view", "error", "purchase")


@query("snapshot_gate", f"WITH {CARDS_SQL}" + """
SELECT file, CASE WHEN store NOT IN ('click', 'view', 'error', 'purchase') THEN 'unknown_store' WHEN step <> 'done' THEN 'unfinished'
  WHEN version < 2 THEN 'old_price_version' END AS rejected FROM heads""")
def snapshot_gate(spark, folder):
    return S.gate(heads(spark, folder), KNOWN).select("file", "rejected")


@query("latest_snapshot", f"WITH {CARDS_SQL} SELECT store, max(file) AS file FROM heads WHERE step = 'done' GROUP BY 1")
def latest_snapshot(spark, folder):
    return S.latest_finished(heads(spark, folder)).select("store", "file")


@query("pending_snapshots", f"WITH {CARDS_SQL}" + """,
last AS (SELECT store, max(scraped_at) AS last_at FROM heads WHERE day(day) <= 12 GROUP BY 1)
SELECT store, file FROM heads LEFT JOIN last USING (store) WHERE scraped_at > last_at AND step <> 'listing'""")
def pending_snapshots(spark, folder):
    h = heads(spark, folder)
    last = h.where(F.dayofmonth("day") <= 12).groupBy("store").agg(F.max("scraped_at").alias("last_price_at"))
    return S.pending(h, h.where("step = 'listing'"), last).select("store", "file")


@query("last_wins_dedupe", f"WITH {CARDS_SQL} SELECT file, url, arg_max(coalesce(price, -1), position) AS price, max(position) AS position FROM cards GROUP BY 1, 2")
def last_wins_dedupe(spark, folder):
    c = cards(spark, folder).groupBy("file", "url").agg(F.max(F.struct("position", F.coalesce("price", F.lit(-1)).alias("price"))).alias("r"))
    return c.select("file", "url", "r.price", F.col("r.position").cast("bigint").alias("position"))


RULES = {"click": "total", "view": "total_or_coverage", "error": "coverage", "purchase": "seen"}


@query("completeness_rules", f"WITH {CARDS_SQL}" + """,
active AS (SELECT store, count(DISTINCT url) AS active_before FROM cards GROUP BY 1)
SELECT file, n_read, step = 'done' AND CASE store
    WHEN 'click' THEN coalesce(n_read = site_total, false)
    WHEN 'view' THEN CASE WHEN site_total IS NULL THEN n_read / active_before >= 0.8 ELSE n_read = site_total END
    WHEN 'purchase' THEN coalesce(n_urls = site_total, false) ELSE n_read / active_before >= 0.8 END AS complete,
  CASE WHEN step = 'done' THEN 'all_pages' ELSE 'unfinished:listing' END AS stop_label
FROM heads JOIN active USING (store)""")
def completeness_rules(spark, folder):
    c = cards(spark, folder)
    active = c.groupBy("store").agg(F.count_distinct("url").alias("active_before"))
    h = heads(spark, folder, c).join(active, "store").select(
        "*", F.lit("all_pages").alias("stop_reason"), F.lit(True).alias("catalog_exhausted"), F.col("n_urls").alias("products_seen"),
        F.lit(None).cast("int").alias("final_products"), F.lit(None).cast("int").alias("page_size"), F.lit(None).cast("int").alias("pages_fetched"),
        F.lit(None).cast("int").alias("site_total_reported"), F.lit(None).cast("int").alias("unparsed_cards"),
        F.lit(None).cast("boolean").alias("listing_complete"), F.lit(None).cast("int").alias("urls_distinct"),
        F.lit(None).cast("array<struct<category_url:string,site_total:int,listing_complete:boolean,urls_distinct:int,error:string>>").alias("categories"))
    return C.completeness(C.clean_stop(h, {}), RULES).select("file", "n_read", "complete", "stop_label")


@query("category_completeness", f"WITH {CARDS_SQL}" + """,
cats AS (SELECT file, url, price, 'c' || CAST(event_id % 3 AS VARCHAR) AS category FROM cards),
per AS (SELECT file, category, count(DISTINCT url) AS n, count(*) AS total FROM cats GROUP BY 1, 2)
SELECT file, bool_and(n = total) AS complete, count(*) FILTER (WHERE n <> total) AS bad FROM per GROUP BY 1""")
def category_completeness(spark, folder):
    cats = cards(spark, folder).withColumn("category", F.concat(F.lit("https://s.example/c"), (F.col("event_id") % 3).cast("string")))
    per = cats.groupBy("file", "category").agg(F.count_distinct("url").cast("int").alias("n"), F.count(F.lit(1)).cast("int").alias("total"))
    entry = F.struct(F.col("category").alias("category_url"), F.col("total").alias("site_total"), (F.col("n") == F.col("total")).alias("listing_complete"),
                     F.col("n").alias("urls_distinct"), F.lit(None).cast("string").alias("error"))
    docs = per.groupBy("file").agg(F.collect_list(entry).alias("categories"))
    return C.category_report(docs).select("file", F.col("categories_good").alias("complete"), F.size("category_notes").cast("bigint").alias("bad"))


@query("category_union", f"WITH {CARDS_SQL}" + """,
cats AS (SELECT file, url, coalesce(price, -1) AS price, event_id % 3 AS category, position FROM cards),
firsts AS (SELECT file, url, arg_min(category, (category, position)) AS category, arg_min(price, (category, position)) AS price,
                  count(DISTINCT category) AS categories FROM cats GROUP BY 1, 2)
SELECT file, url, category, price, categories FROM firsts""")
def category_union(spark, folder):
    from shelfwise.sources.payloads import combine_categories

    c = cards(spark, folder).select("file", "url", F.coalesce("price", F.lit(-1)).alias("price"), (F.col("event_id") % 3).alias("category"), "position")
    return combine_categories(c).select("file", "url", "category", "price", "categories")


def passes(spark, folder):
    c = cards(spark, folder).withColumn("pass", F.when(F.col("event_id") % 2 == 0, 1).otherwise(2))
    w = Window.partitionBy("file", "pass").orderBy("ts", "event_id")
    c = c.withColumn("position", F.row_number().over(w) - 1)
    n = c.groupBy("file", "pass").agg(F.count(F.lit(1)).cast("int").alias("n"), F.count_distinct("url").alias("distinct"))
    both = c.groupBy("file").agg(F.count_distinct("url").alias("u"))
    ends = F.transform(F.sequence(F.lit(1), F.ceil(F.col("n") / 24).cast("int")), lambda i: F.least(i * 24, F.col("n")))
    day = F.substring("file", -2, 2).cast("int")
    total = F.when(day % 3 == 0, F.col("distinct")).when((day % 3 == 1) | (F.col("pass") == 1), F.col("u")).otherwise(F.col("u") + 1)
    return c, n.join(both, "file").select("file", "pass", total.cast("int").alias("site_total"), ends.alias("batch_ends"))


@query("two_pass_union", f"WITH {CARDS_SQL}" + """,
p AS (SELECT file, url, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END AS pass, row_number() OVER (PARTITION BY file, event_id % 2 ORDER BY ts, event_id) - 1 AS position FROM cards),
n AS (SELECT file, pass, count(*) AS n, count(DISTINCT url) AS d FROM p GROUP BY 1, 2),
u AS (SELECT file, count(DISTINCT url) AS u FROM p GROUP BY 1),
tot AS (SELECT file, pass, n, d, u, CASE WHEN CAST(right(file, 2) AS INT) % 3 = 0 THEN d WHEN CAST(right(file, 2) AS INT) % 3 = 1 OR pass = 1 THEN u ELSE u + 1 END AS total FROM n JOIN u USING (file)),
near AS (SELECT p.file, p.url, p.pass, bool_and((p.position + 2) % 24 <= 3 AND p.position + 2 >= 24 AND 24 * ((p.position + 2) // 24) < t.n) AS near FROM p JOIN tot t ON t.file = p.file AND t.pass = p.pass GROUP BY 1, 2, 3),
away AS (SELECT file, count(*) AS away FROM (SELECT file, url, count(*) AS c, bool_and(near) AS near FROM near GROUP BY 1, 2) WHERE c = 1 AND NOT near GROUP BY 1),
w AS (SELECT file, max(u) AS u, max(CASE WHEN pass = 1 THEN d END) AS d1, max(CASE WHEN pass = 2 THEN d END) AS d2,
        max(CASE WHEN pass = 1 THEN total END) AS t1, max(CASE WHEN pass = 2 THEN total END) AS t2 FROM tot GROUP BY 1),
s AS (SELECT w.*, coalesce(away, 0) AS away, CASE WHEN coalesce(d1 = t1, false) OR d2 IS NULL THEN 'first_pass' WHEN coalesce(d2 = t2, false) THEN 'second_pass' ELSE 'union' END AS source
      FROM w LEFT JOIN away USING (file)),
r AS (SELECT *, CASE WHEN source = 'union' THEN CASE WHEN t1 IS NULL OR t1 IS DISTINCT FROM t2 THEN 'same_page_total' WHEN u <> t1 THEN 'union_matches_total'
      WHEN away > 0 THEN 'differences_at_batch_boundaries' END END AS rejected FROM s)
SELECT file, source, CASE WHEN source = 'first_pass' THEN coalesce(d1 = t1, false) ELSE rejected IS NULL END AS complete, rejected, u AS n_union,
  CASE WHEN source = 'union' THEN u - coalesce(d1, 0) ELSE 0 END AS n_recovered FROM r""")
def two_pass_union(spark, folder):
    c, p = passes(spark, folder)
    return C.choose_listing(c, p)


@query("page_coverage", f"WITH {CARDS_SQL}" + """,
g AS (SELECT file, count(DISTINCT position // 24) AS pages, count(DISTINCT url) AS products, count(DISTINCT (position // 240)) AS totals_seen, max(position // 24) AS last_page FROM cards GROUP BY 1)
SELECT file, pages, products, totals_seen, pages = last_page + 1 + CASE WHEN day(day) % 6 = 0 THEN 1 ELSE 0 END AND products = n_urls AS whole
FROM heads JOIN g USING (file)""")
def page_coverage(spark, folder):
    c = cards(spark, folder)
    pages = c.select("file", F.floor(F.col("position") / 24).alias("page"), F.col("url").alias("product_id"), F.floor(F.col("position") / 240).alias("total"))
    announced = pages.groupBy("file").agg((F.max("page") + 1).alias("n")).join(heads(spark, folder, c), "file").select(
        "file", (F.col("n") + F.when(F.dayofmonth("day") % 6 == 0, 1).otherwise(0)).alias("n_pages"), F.col("n_urls").alias("site_total"))
    return C.page_coverage(pages, announced)


def store_totals(spark, folder):
    c = cards(spark, folder).withColumn("at", F.col("day").cast("timestamp_ntz"))
    store = c.groupBy("store", "at").agg(F.count(F.lit(1)).alias("total")).select("store", F.col("at").alias("scraped_at"), F.lit("store").alias("key"), "total")
    part = c.groupBy("store", "at", (F.col("event_id") % 2).alias("k")).agg(F.count(F.lit(1)).alias("total")).select(
        "store", F.col("at").alias("scraped_at"), F.concat(F.lit("c"), F.col("k").cast("string")).alias("key"), "total")
    return store.unionByName(part)


@query("totals_history", f"WITH {CARDS_SQL}" + """,
t AS (SELECT store, day, 'store' AS key, count(*) AS total FROM cards GROUP BY 1, 2 UNION ALL SELECT store, day, 'c' || CAST(event_id % 2 AS VARCHAR), count(*) FROM cards GROUP BY 1, 2, 3),
d AS (SELECT store, day, row_number() OVER (PARTITION BY store ORDER BY day DESC) AS age FROM (SELECT DISTINCT store, day FROM cards))
SELECT t.store, CAST(t.day AS VARCHAR) AS day, key, total FROM t JOIN d ON d.store = t.store AND d.day = t.day WHERE age <= 20""")
def totals_history(spark, folder):
    return C.totals_history(store_totals(spark, folder), 20).select("store", F.to_date("scraped_at").cast("string").alias("day"), "key", "total")


# The fold over a store's newest 60 snapshots: first the store's own total, then its categories, which the store's total can excuse.
FOLD = """, {state} AS (
  SELECT {ids}, 0 AS n, CAST(NULL AS BIGINT) AS total, CAST(NULL AS BIGINT) AS prior, CAST(NULL AS BIGINT) AS base, CAST(NULL AS DOUBLE) AS level, 0 AS streak,
    0 AS run, CAST(NULL AS VARCHAR) AS verdict FROM {start}
  UNION ALL
  SELECT {ids}, n + 1, t, base, CASE WHEN t IS NULL OR verdict_now = 'alert' THEN base ELSE t END, CASE WHEN t IS NULL THEN level WHEN verdict_now = 'alert' THEN near_level END,
    CASE WHEN t IS NULL THEN streak WHEN verdict_now = 'alert' THEN run_now ELSE 0 END, run_now, verdict_now
  FROM (SELECT *, CASE WHEN moved THEN 'reorganized' WHEN counted AND run_now >= 3 THEN 'accepted' WHEN counted THEN 'alert' ELSE 'ok' END AS verdict_now
    FROM (SELECT *, CASE WHEN near THEN streak + 1 WHEN counted THEN 1 ELSE 0 END AS run_now, CASE WHEN near THEN level ELSE t END AS near_level
      FROM (SELECT *, counted AND level IS NOT NULL AND abs(t - level) <= level * 0.03 AS near
        FROM (SELECT *, low AND NOT moved AS counted
          FROM (SELECT {source}, x.total AS t, coalesce(x.total < s.base * (1 - 0.10), false) AS low, {moved} AS moved
            FROM {state} s JOIN {snapshots})))))) """
DROP_SQL = f"WITH RECURSIVE {CARDS_SQL}" + """,
totals AS (SELECT store, day AS seen, 'store' AS key, count(*) AS total FROM cards GROUP BY 1, 2
           UNION ALL SELECT store, day, 'c' || CAST(event_id % 2 AS VARCHAR), count(*) FROM cards GROUP BY 1, 2, event_id % 2),
times AS (SELECT store, seen, row_number() OVER (PARTITION BY store ORDER BY seen) AS n FROM (
  SELECT store, seen, row_number() OVER (PARTITION BY store ORDER BY seen DESC) AS age FROM (SELECT DISTINCT store, seen FROM totals)) WHERE age <= 60),
whole AS (SELECT store, n, total FROM times LEFT JOIN totals USING (store, seen) WHERE key = 'store'),
keys AS (SELECT DISTINCT store, key FROM totals WHERE key <> 'store'),
parts AS (SELECT k.store, k.key, t.n, x.total FROM keys k JOIN times t ON t.store = k.store LEFT JOIN totals x ON x.store = t.store AND x.seen = t.seen AND x.key = k.key)""" + FOLD.format(
    state="store_state", ids="store", start="(SELECT DISTINCT store FROM times)", source="s.store, s.n, s.base, s.level, s.streak", moved="false",
    snapshots="whole x ON x.store = s.store AND x.n = s.n + 1") + FOLD.format(
    state="key_state", ids="store, key", start="keys", source="s.store, s.key, s.n, s.base, s.level, s.streak",
    moved="coalesce(x.total < s.base * (1 - 0.10), false) AND (w.prior IS NULL OR w.total >= w.prior * (1 - 0.10))",
    snapshots="parts x ON x.store = s.store AND x.key = s.key AND x.n = s.n + 1 JOIN store_state w ON w.store = s.store AND w.n = s.n + 1") + """,
raised AS (
  SELECT store, 0 AS n, CAST(NULL AS DOUBLE) AS share, CAST(NULL AS BIGINT) AS anchor, 0 AS age FROM (SELECT DISTINCT store FROM times)
  UNION ALL
  SELECT r.store, r.n + 1, CASE WHEN s.verdict = 'accepted' THEN (s.prior - s.total) / s.prior WHEN r.age < 2 AND abs(s.total - r.anchor) <= r.anchor * 0.03 THEN r.share END,
    CASE WHEN s.verdict = 'accepted' THEN s.total ELSE r.anchor END, CASE WHEN s.verdict = 'accepted' THEN 0 ELSE r.age + 1 END
  FROM raised r JOIN store_state s ON s.store = r.store AND s.n = r.n + 1),
judged AS (SELECT store, n, 'store' AS key, total, prior, verdict, run, share + 0.03 AS "limit" FROM store_state JOIN raised USING (store, n)
           UNION ALL SELECT store, n, key, total, prior, verdict, run, NULL FROM key_state WHERE total IS NOT NULL)
SELECT store, strftime(CAST(seen AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS scraped_at, key, total, prior AS base, verdict, run, "limit" FROM judged JOIN times USING (store, n) WHERE n > 0"""


@query("drop_alerts", DROP_SQL)
def drop_alerts(spark, folder):
    return C.drop_review(store_totals(spark, folder)).withColumn("scraped_at", V.stamp("scraped_at"))


@query("new_share_alert", f"WITH {CARDS_SQL}" + """,
known AS (SELECT DISTINCT store, url FROM cards WHERE day(day) <= 3),
latest AS (SELECT DISTINCT store, url FROM cards WHERE day(day) = 20)
SELECT store, count(*) AS n_read, count(*) FILTER (WHERE k.url IS NULL) AS n_new, count(*) FILTER (WHERE k.url IS NULL) / count(*) > 0.10 AS alert
FROM latest l LEFT JOIN known k USING (store, url) GROUP BY 1""")
def new_share_alert(spark, folder):
    c = cards(spark, folder).withColumnRenamed("url", "listing_url")
    return I.new_share_alert(c.where(F.dayofmonth("day") == 20), c.where(F.dayofmonth("day") <= 3))


# ---------------------------------------------------------------- lineitem split by date: before and the new snapshot
#
# Readings up to 1999 are history; each store's snapshot is every later reading, one card per listing (the last read).

LOAD_SQL = V.READINGS_SQL + """,
old_prices AS (SELECT listing_id, scraped_at, max(price) AS price FROM readings WHERE scraped_at < TIMESTAMP '2000-01-01' GROUP BY 1, 2),
old_listings AS (
  SELECT listing_id, any_value(product_id) AS product_id, any_value(store) AS store, 'https://' || any_value(store) || '.example/p/' || CAST(any_value(product_id) AS VARCHAR) AS listing_url,
         'part ' || CAST(any_value(product_id) AS VARCHAR) AS raw_name, min(scraped_at) AS first_seen_at, max(scraped_at) AS last_seen_at, listing_id % 7 <> 0 AS is_active,
         'img' AS image_url FROM readings WHERE scraped_at < TIMESTAMP '2000-01-01' GROUP BY listing_id),
snap AS (
  SELECT listing_id, product_id, store, 'https://' || store || '.example/p/' || CAST(product_id AS VARCHAR) AS listing_url, scraped_at,
         CASE WHEN is_available THEN price END AS price,
         'part ' || CAST(product_id AS VARCHAR) || CASE WHEN listing_id % 13 = 0 THEN ' new' ELSE '' END AS raw_name
  FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY scraped_at DESC, tie1 DESC, tie2 DESC, price DESC, list_price DESC NULLS LAST, is_available DESC) AS rn
        FROM readings WHERE scraped_at >= TIMESTAMP '2000-01-01') WHERE rn = 1)
"""


def load_tables(spark, folder):
    r = V.readings(spark, folder)
    split = F.lit("2000-01-01").cast("timestamp_ntz")
    url = F.concat(F.lit("https://"), "store", F.lit(".example/p/"), F.col("product_id").cast("string"))
    old = r.where(F.col("scraped_at") < split)
    prices = old.groupBy("listing_id", "scraped_at").agg(F.max("price").alias("price"))
    listings = old.groupBy("listing_id", "product_id", "store").agg(
        F.min("scraped_at").alias("first_seen_at"), F.max("scraped_at").alias("last_seen_at")).select(
        "listing_id", "product_id", "store", url.alias("listing_url"), F.concat(F.lit("part "), F.col("product_id").cast("string")).alias("raw_name"),
        F.lit(None).cast("string").alias("raw_brand"), "first_seen_at", "last_seen_at", (F.col("listing_id") % 7 != 0).alias("is_active"), F.lit("img").alias("image_url"))
    new = P.latest_readings(r.where(F.col("scraped_at") >= split), order=V.READING_ORDER)
    name = F.concat(F.lit("part "), F.col("product_id").cast("string"), F.when(F.col("listing_id") % 13 == 0, " new").otherwise(""))
    snap = new.select("listing_id", "product_id", "store", url.alias("listing_url"), "scraped_at", F.when(F.col("is_available"), F.col("price")).alias("price"),
                      name.alias("raw_name"), F.lit(None).cast("string").alias("raw_brand"), F.lit(None).cast("string").alias("store_sku"),
                      F.lit(None).cast("string").alias("parsed_concentration"), F.lit(None).cast("int").alias("parsed_volume_ml"),
                      F.lit(None).cast("string").alias("declared_gender"), F.lit(None).cast("string").alias("image_url"))
    return listings, prices, snap


@query("upsert_listings", f"WITH {LOAD_SQL}" + f"""
SELECT coalesce(s.listing_url, o.listing_url) AS listing_url, coalesce(s.raw_name, o.raw_name) AS raw_name, o.image_url,
  {V.stamp_sql('least(o.first_seen_at, s.scraped_at)')} AS first_seen_at, {V.stamp_sql('greatest(o.last_seen_at, s.scraped_at)')} AS last_seen_at,
  CASE WHEN s.listing_id IS NOT NULL THEN s.price IS NOT NULL ELSE o.is_active END AS is_active,
  CASE WHEN o.listing_id IS NULL THEN 'inserted' WHEN s.listing_id IS NOT NULL THEN 'updated' END AS change
FROM old_listings o FULL JOIN snap s ON s.listing_id = o.listing_id""")
def upsert_listings(spark, folder):
    listings, _, snap = load_tables(spark, folder)
    rows = I.upsert_listings(listings, snap.withColumn("action", F.lit("upsert")))
    return rows.select("listing_url", "raw_name", "image_url", V.stamp("first_seen_at").alias("first_seen_at"), V.stamp("last_seen_at").alias("last_seen_at"), "is_active", "change")


@query("touch_listings", f"WITH {LOAD_SQL}" + f"""
SELECT o.listing_url, o.raw_name, {V.stamp_sql('greatest(o.last_seen_at, s.scraped_at)')} AS last_seen_at,
  CASE WHEN s.listing_id IS NOT NULL AND s.listing_id % 2 = 0 THEN s.price IS NOT NULL ELSE o.is_active END AS is_active
FROM old_listings o LEFT JOIN snap s ON s.listing_id = o.listing_id""")
def touch_listings(spark, folder):
    """Unfinished snapshots touch known listings; prices not read are only seen. Nothing is inserted."""
    listings, _, snap = load_tables(spark, folder)
    rows = I.upsert_listings(listings, snap.withColumn("action", F.when(F.col("listing_id") % 2 == 0, "touch").otherwise("seen")))
    return rows.select("listing_url", "raw_name", V.stamp("last_seen_at").alias("last_seen_at"), "is_active")


@query("idempotent_append", f"WITH {V.READINGS_SQL}" + f"""
SELECT listing_id, {V.stamp_sql('scraped_at')} AS scraped_at, max(price) AS price FROM readings GROUP BY listing_id, scraped_at""")
def idempotent_append(spark, folder):
    """The second half of the history arrives twice, overlapping the first half."""
    r = V.readings(spark, folder).groupBy("listing_id", "scraped_at").agg(F.max("price").alias("price"))
    first = r.where("scraped_at < timestamp_ntz '2000-01-01'")
    again = r.where("scraped_at >= timestamp_ntz '1999-01-01'")
    once = I.append_prices(first, again)
    return I.append_prices(once, again).withColumn("scraped_at", V.stamp("scraped_at"))


def snapshot_days(snap):
    return snap.groupBy("store").agg(F.max("scraped_at").alias("scraped_at"))


@query("keep_priced_today", f"WITH {V.READINGS_SQL}" + """,
day AS (SELECT store, CAST(max(scraped_at) AS DATE) AS day FROM readings GROUP BY 1),
priced AS (SELECT DISTINCT r.listing_id FROM readings r JOIN day d ON d.store = r.store AND d.day = CAST(r.scraped_at AS DATE))
SELECT DISTINCT listing_id FROM readings WHERE listing_id NOT IN (SELECT listing_id FROM priced)""")
def keep_priced_today(spark, folder):
    r = V.readings(spark, folder)
    listings = V.listings(spark, folder)
    already = I.priced_today(r.select("listing_id", "scraped_at"), listings, snapshot_days(r))
    return I.keep_priced_today(listings, already).select("listing_id")


@query("replace_today", f"WITH {V.READINGS_SQL}" + f""",
fresh AS (SELECT listing_id, scraped_at, price + 1 AS price FROM (SELECT listing_id, scraped_at, max(price) AS price,
          row_number() OVER (PARTITION BY listing_id ORDER BY scraped_at DESC) AS rn FROM readings GROUP BY listing_id, scraped_at) WHERE rn = 1)
SELECT listing_id, {V.stamp_sql('scraped_at')} AS scraped_at, price FROM (
  SELECT r.listing_id, r.scraped_at, max(r.price) AS price FROM readings r
  WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.listing_id = r.listing_id AND CAST(f.scraped_at AS DATE) = CAST(r.scraped_at AS DATE)) GROUP BY 1, 2
  UNION ALL SELECT * FROM fresh)""")
def replace_today(spark, folder):
    prices = V.readings(spark, folder).groupBy("listing_id", "scraped_at").agg(F.max("price").alias("price"))
    fresh = P.latest_readings(prices).withColumn("price", F.col("price") + 1)
    return I.replace_today(prices, fresh).withColumn("scraped_at", V.stamp("scraped_at"))


@query("deactivate_missing", f"WITH {LOAD_SQL} SELECT store, listing_url FROM old_listings WHERE is_active AND listing_url NOT IN (SELECT listing_url FROM snap)")
def deactivate_missing(spark, folder):
    listings, _, snap = load_tables(spark, folder)
    return I.deactivate(listings, snap, snap.select("store").distinct())


@query("deactivation_guard", f"WITH {LOAD_SQL}" + """,
c AS (SELECT o.store, count(*) AS active_before, count(*) FILTER (WHERE s.listing_id IS NULL) AS missing,
        count(*) FILTER (WHERE s.listing_id IS NOT NULL AND s.price IS NULL) AS going FROM old_listings o LEFT JOIN snap s USING (listing_id) WHERE o.is_active GROUP BY 1)
SELECT store, active_before, missing, going, (missing + going) / active_before > 0.6 AS blocked FROM c""")
def deactivation_guard(spark, folder):
    listings, _, snap = load_tables(spark, folder)
    going = listings.where("is_active").select("store", "listing_url").join(snap.where("price IS NULL").select("store", "listing_url"), ["store", "listing_url"]).groupBy(
        "store").agg(F.count(F.lit(1)).alias("going"))
    state = I.missing_counts(listings, snap).join(going, "store", "left").fillna(0, ["going"]).withColumn("complete", F.lit(True))
    return I.deactivation_guard(state, 0.6).select("store", "active_before", "missing", "going", "blocked")


@query("unpriced_kinds", f"WITH {LOAD_SQL}" + """,
bare AS (SELECT * FROM snap WHERE price IS NULL),
last AS (SELECT listing_id, max(scraped_at) AS last_at FROM old_prices GROUP BY 1),
times AS (SELECT DISTINCT o.store, p.scraped_at FROM old_prices p JOIN old_listings o USING (listing_id)),
ranked AS (SELECT store, scraped_at, row_number() OVER (PARTITION BY store ORDER BY scraped_at) AS place, count(*) OVER (PARTITION BY store) AS n FROM times)
SELECT b.store, b.listing_url, CASE WHEN b.store IN ('store0', 'store1', 'store2') THEN 'no_price' WHEN l.last_at IS NULL THEN 'never_priced'
  WHEN k.n - k.place + 1 >= 100 THEN 'too_long' ELSE 'not_read' END AS kind, coalesce(o.is_active, false) AS active
FROM bare b LEFT JOIN old_listings o USING (listing_id) LEFT JOIN last l USING (listing_id) LEFT JOIN ranked k ON k.store = b.store AND k.scraped_at = l.last_at""")
def unpriced_kinds(spark, folder):
    listings, prices, snap = load_tables(spark, folder)
    at = snap.agg(F.max("scraped_at")).scalar()
    return I.unpriced_kinds(snap.withColumn("scraped_at", at), listings, prices, patient_stores=("store3", "store4", "store5"), limit=100)


@query("load_stats", f"WITH {LOAD_SQL}" + """
SELECT coalesce(s.store, o.store) AS store, count(*) FILTER (WHERE o.listing_id IS NULL) AS inserted,
  count(*) FILTER (WHERE o.listing_id IS NOT NULL AND s.listing_id IS NOT NULL) AS updated, count(s.price) AS prices_added,
  count(s.listing_id) AS products, count(s.listing_id) - count(s.price) AS unpriced, 0 AS skipped, 0 AS kept_today, 0 AS replaced_today, 'full' AS mode, 'all_pages' AS stop_reason
FROM old_listings o FULL JOIN snap s ON s.listing_id = o.listing_id GROUP BY 1""")
def load_stats(spark, folder):
    """The whole load: raw cards of every store through parsing, gates, upsert and append."""
    from shelfwise.plans.load import load

    listings, prices, snap = load_tables(spark, folder)
    at = F.lit("2002-01-01").cast("timestamp_ntz")
    text = F.concat(F.lit("$"), F.translate(F.format_number("price", 0), ",", "."))
    raw = snap.select("store", F.concat("store", F.lit("-1")).alias("file"), at.alias("scraped_at"), F.monotonically_increasing_id().alias("position"),
                      F.col("raw_name").alias("name"), F.lit(None).cast("string").alias("brand"), text.alias("current_price"),
                      *[F.lit(None).cast("string").alias(c) for c in ("previous_price", "volume", "concentration", "availability", "image_url", "volume_note")],
                      F.col("listing_url").alias("url"), F.lit(None).cast("array<string>").alias("declared_gender"))
    cats = "array<struct<category_url:string,site_total:int,listing_complete:boolean,urls_distinct:int,error:string>>"
    h = raw.groupBy("store", "file", "scraped_at").agg(F.count(F.lit(1)).alias("n_products")).select(
        "*", F.lit("done").alias("step"), F.lit("all_pages").alias("stop_reason"), F.lit(True).alias("catalog_exhausted"),
        *[F.lit(None).cast("int").alias(c) for c in ("site_total", "products_seen", "final_products", "page_size", "pages_fetched", "site_total_reported", "unparsed_cards", "urls_distinct")],
        F.lit(None).cast("boolean").alias("listing_complete"), F.lit(None).cast(cats).alias("categories"))
    wide = listings.select("listing_id", "store", "listing_url", "raw_name", "raw_brand", "image_url", "first_seen_at", "last_seen_at", "is_active",
                           F.lit(None).cast("string").alias("declared_gender")).withColumn("listing_id", F.col("listing_id").cast("string"))
    old = prices.select(F.col("listing_id").cast("string").alias("listing_id"), "price", F.lit(None).cast("bigint").alias("list_price"),
                        F.lit("CLP").alias("currency"), F.lit(True).alias("is_available"), "scraped_at")
    done = load(h, raw, wide, old, stop_rules={}, total_rules={}, max_share=1.0)
    return done.stats.select("store", "inserted", "updated", "prices_added", "products", "unpriced", "skipped", "kept_today", "replaced_today", "mode", "stop_reason")


# ---------------------------------------------------------------- runs

RUNS_SQL = CARDS_SQL + """,
store_rows AS (
  SELECT day(day) AS run_id, store, file, scraped_at, store = 'view' AND day(day) % 4 = 0 AS is_backfill, n_read AS prices,
    CASE WHEN step <> 'done' THEN 'failed' WHEN n_read = site_total THEN 'ok' ELSE 'partial' END AS status,
    CASE WHEN step <> 'done' THEN 'rate_limited' ELSE 'all_pages' END AS stop_reason,
    CASE WHEN step <> 'done' THEN 0 ELSE n_read END AS prices_added FROM heads)"""


def store_rows(spark, folder):
    h = heads(spark, folder)
    done = F.col("step") == "done"
    return h.select(
        F.dayofmonth("day").alias("run_id"), "store", "file", "scraped_at", ((F.col("store") == "view") & (F.dayofmonth("day") % 4 == 0)).alias("is_backfill"),
        R.store_status(F.coalesce(done & (F.col("n_read") == F.col("site_total")), F.lit(False)), F.when(done, F.col("n_read")).otherwise(0),
                       F.lit(None).cast("string")).alias("status"),
        F.when(done, "all_pages").otherwise("rate_limited").alias("stop_reason"), F.when(done, F.col("n_read")).otherwise(F.lit(0)).alias("prices_added"))


def run_rows(rows):
    return rows.groupBy("run_id").agg(F.min("scraped_at").alias("started_at")).select(
        "run_id", "started_at", F.when(F.col("run_id") % 8 != 0, F.col("started_at") + F.expr("INTERVAL 45 MINUTES")).alias("finished_at"),
        F.when(F.col("run_id") % 8 != 0, "ok").otherwise("running").alias("status"), F.array().cast("array<string>").alias("errors"))


@query("run_status", f"WITH {RUNS_SQL}" + """
SELECT run_id, CASE WHEN bool_and(status = 'ok') THEN 'ok' WHEN bool_or(prices_added > 0) THEN 'partial' ELSE 'failed' END AS status FROM store_rows GROUP BY 1""")
def run_status(spark, folder):
    rows = store_rows(spark, folder)
    return R.run_status(run_rows(rows), rows)


@query("retry_candidates", f"WITH {RUNS_SQL}" + """
SELECT store FROM store_rows WHERE run_id = 14 AND NOT is_backfill GROUP BY 1 HAVING count(*) = 1 AND min(status) IN ('failed', 'partial') AND min(stop_reason) = 'rate_limited'""")
def retry_candidates(spark, folder):
    rows = store_rows(spark, folder)
    return R.retry_candidates(rows, run_rows(rows), F.lit("2024-01-14").cast("date"))


@query("close_abandoned", f"WITH {RUNS_SQL} SELECT run_id, CASE WHEN run_id % 8 <> 0 THEN 'ok' ELSE 'failed' END AS status, CASE WHEN run_id % 8 = 0 THEN 1 ELSE 0 END AS errors FROM store_rows GROUP BY 1")
def close_abandoned(spark, folder):
    rows = store_rows(spark, folder)
    closed = R.close_abandoned(run_rows(rows), F.lit("2024-02-01").cast("timestamp_ntz"))
    return closed.select("run_id", "status", F.size("errors").alias("errors"))


@query("run_report", f"WITH {RUNS_SQL}" + """
SELECT strftime(min(scraped_at), '%Y-%m-%d %H:%M') || '  ' || CASE WHEN run_id % 8 <> 0 THEN 'OK' ELSE 'RUNNING' END || ' ' ||
  string_agg(store || ' ' || status || ' +' || CAST(prices_added AS VARCHAR), ' | ' ORDER BY store) || ' | errors 0' AS line, run_id
FROM store_rows GROUP BY run_id ORDER BY run_id DESC LIMIT 12""")
def run_report(spark, folder):
    rows = store_rows(spark, folder)
    return R.summary_line(R.run_report(run_rows(rows), rows, 12))


@query("backfill_flags", f"WITH {RUNS_SQL} SELECT file, scraped_at <> max(scraped_at) OVER (PARTITION BY store) AS is_backfill, scraped_at = max(scraped_at) OVER (PARTITION BY store) AS may_deactivate FROM store_rows")
def backfill_flags(spark, folder):
    rows = store_rows(spark, folder)
    own = rows.groupBy("store").agg(F.max("file").alias("file"))
    return R.backfill_flags(rows.drop("is_backfill"), own).select("file", "is_backfill", "may_deactivate")


PART_COLUMNS = ("p_partkey", "p_name", "p_brand", "p_type", "p_size")


@query("fingerprint_table", """
WITH hashed AS (SELECT md5(concat_ws('|', 'p_partkey=' || coalesce(CAST(p_partkey AS VARCHAR), '∅'), 'p_name=' || coalesce(p_name, '∅'), 'p_brand=' || coalesce(p_brand, '∅'),
  'p_type=' || coalesce(p_type, '∅'), 'p_size=' || coalesce(CAST(p_size AS VARCHAR), '∅'))) AS h FROM part)
SELECT count(*) AS n, md5(concat_ws('-', CAST(coalesce(sum(CAST('0x' || h[1:12] AS BIGINT)), 0) AS VARCHAR), CAST(coalesce(sum(CAST('0x' || h[13:24] AS BIGINT)), 0) AS VARCHAR))) AS fingerprint
FROM hashed""")
def fingerprint_table(spark, folder):
    return I.fingerprint(V.table(spark, folder, "part"), PART_COLUMNS)


@query("skip_unchanged", "SELECT false AS same_rows, true AS renamed_rows")
def skip_unchanged(spark, folder):
    """Shuffled rows are unchanged; renaming one product is a change."""
    part = V.table(spark, folder, "part")
    same = I.changed(part, part.repartition(7, "p_name"), PART_COLUMNS).select(F.col("changed").alias("same_rows"))
    renamed = part.withColumn("p_name", F.when(F.col("p_partkey") == 1, "renamed").otherwise(F.col("p_name")))
    return same.select("same_rows", I.changed(part, renamed, PART_COLUMNS).scalar().alias("renamed_rows"))
