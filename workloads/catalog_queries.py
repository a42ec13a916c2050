"""Catalog queries over part and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.operators import catalog as C
from shelfwise.operators import prices as P

from . import views as V
from .price_queries import HISTORY_SQL, offers, since
from .registry import query


def summary(spark, folder):
    latest = V.latest(spark, folder)
    return C.product_summary(V.products(spark, folder), latest, V.listings(spark, folder), since(latest))


SHOWN = "product_id, canonical_name, lowest_price, lowest_price_store, store_count"
ON_SALE_SQL = """EXISTS (SELECT 1 FROM listings l WHERE l.product_id = s.product_id AND l.is_active
                AND l.matching_status IN ('matched', 'new_product'))"""


def shown(df, *extra):
    return df.select("product_id", "canonical_name", "lowest_price", "lowest_price_store",
                     F.col("store_count").cast("bigint").alias("store_count"), *extra)


@query("product_summary", V.SUMMARY + f"""
SELECT product_id, canonical_name, brand, concentration, volume_ml, presentation, lowest_price, lowest_price_store, image_url,
       price_per_ml, best_discount_percent, {V.stamp_sql('last_updated')} AS last_updated, store_count, highest_price,
       last_known_price, last_known_price_store, {V.stamp_sql('last_known_price_at')} AS last_known_price_at FROM summary""")
def product_summary(spark, folder):
    return summary(spark, folder).select(
        "product_id", "canonical_name", "brand", "concentration", "volume_ml", "presentation", "lowest_price",
        "lowest_price_store", "image_url", "price_per_ml", "best_discount_percent",
        V.stamp("last_updated").alias("last_updated"), F.col("store_count").cast("bigint").alias("store_count"),
        "highest_price", "last_known_price", "last_known_price_store",
        V.stamp("last_known_price_at").alias("last_known_price_at"))


@query("on_sale", V.SUMMARY + f"SELECT product_id, canonical_name FROM products s WHERE {ON_SALE_SQL}")
def on_sale(spark, folder):
    return C.on_sale(V.products(spark, folder), V.listings(spark, folder)).select("product_id", "canonical_name")


@query("catalog_filter", V.SUMMARY + f"""
SELECT {SHOWN} FROM summary s WHERE {ON_SALE_SQL} AND lowest_price >= 1000000 AND lowest_price <= 6000000
  AND concentration IN ('economy', 'promo', 'standard') AND volume_ml BETWEEN 5 AND 40 AND gender IN ('male', 'unisex')
  AND list_has_any(string_split(stores, ','), ['store1', 'store4'])""")
def catalog_filter(spark, folder):
    wanted = C.Filters(min_price=1000000, max_price=6000000, concentrations=("economy", "promo", "standard"),
                       min_volume=5, max_volume=40, genders=("male", "unisex"), stores=("store1", "store4")).checked()
    return shown(C.on_sale(C.filtered(summary(spark, folder), wanted), V.listings(spark, folder)))


FOLD_SQL = "lower({})"


@query("catalog_search_rank", V.SUMMARY + f"""
SELECT {SHOWN}, CASE WHEN lower(canonical_name) = 'red bolt' THEN 0
     WHEN starts_with(lower(canonical_name), 'red bolt') OR starts_with(lower(canonical_name), lower(brand) || ' red bolt') THEN 1
     ELSE 2 END AS text_rank
FROM summary s WHERE {ON_SALE_SQL} AND contains(lower(canonical_name) || ' ' || lower(brand), 'red')
  AND contains(lower(canonical_name) || ' ' || lower(brand), 'bolt')""")
def catalog_search_rank(spark, folder):
    rows = C.text_search(C.on_sale(summary(spark, folder), V.listings(spark, folder)), C.search_words("Red bolt"))
    return shown(rows, "text_rank")


SORT_SQL = {
    "name": "",
    "price_asc": "lowest_price ASC NULLS LAST, ",
    "price_desc": "lowest_price DESC NULLS LAST, ",
    "discount": "best_discount_percent DESC NULLS LAST, ",
    "price_per_ml": "price_per_ml ASC NULLS LAST, ",
}


def _register_sort(name: str, head: str) -> None:
    @query(f"catalog_sort_{name}", V.SUMMARY + f"""
SELECT {SHOWN}, best_discount_percent, price_per_ml FROM summary s WHERE {ON_SALE_SQL}
ORDER BY {head} canonical_name, product_id LIMIT 50 OFFSET 20""")
    def run(spark, folder):
        rows = C.on_sale(summary(spark, folder), V.listings(spark, folder))
        return shown(C.page(rows, C.sort_columns(name, collation=None), limit=50, offset=20),
                     "best_discount_percent", "price_per_ml")


for _name, _head in SORT_SQL.items():
    _register_sort(_name, _head)


@query("catalog_sort_relevance", f"{V.SUMMARY}, {HISTORY_SQL}" + f""",
verified AS (SELECT DISTINCT o.product_id FROM offers o JOIN history h USING (listing_id)
             WHERE o.is_available AND NOT o.is_stale AND o.list_price > o.price AND h.history_status = 'consistent')
SELECT {SHOWN}, product_id IN (SELECT product_id FROM verified) AS is_verified FROM summary s
WHERE {ON_SALE_SQL} AND contains(lower(canonical_name) || ' ' || lower(brand), 'gear')
ORDER BY CASE WHEN lower(canonical_name) = 'gear' THEN 0 WHEN starts_with(lower(canonical_name), 'gear')
           OR starts_with(lower(canonical_name), lower(brand) || ' gear') THEN 1 ELSE 2 END,
         lowest_price IS NULL, store_count DESC, is_verified DESC, image_url IS NULL, canonical_name, product_id LIMIT 40""")
def catalog_sort_relevance(spark, folder):
    verified = P.verified_discounts(V.state(spark, folder), offers(spark, folder), V.products(spark, folder))
    rows = C.text_search(C.on_sale(summary(spark, folder), V.listings(spark, folder)), ["gear"])
    rows = C.with_verified(rows, verified)
    return shown(C.page(rows, C.sort_columns("relevance", searched=True, collation=None), limit=40), "is_verified")


@query("catalog_total", V.SUMMARY + f"SELECT count(*) AS total FROM summary s WHERE {ON_SALE_SQL} AND volume_ml >= 10")
def catalog_total(spark, folder):
    rows = C.filtered(V.products(spark, folder), C.Filters(min_volume=10))
    return C.total(C.on_sale(rows, V.listings(spark, folder)))


@query("brand_facet", V.SUMMARY + f"SELECT brand, count(*) AS products FROM products s WHERE {ON_SALE_SQL} GROUP BY brand")
def brand_facet(spark, folder):
    return C.brand_facet(V.products(spark, folder), V.listings(spark, folder))


@query("product_detail", V.SUMMARY + f"""
SELECT o.product_id, o.listing_id, p.canonical_name, o.price, o.is_stale,
       CASE WHEN p.presentation <> 'travel_set' THEN ((20 * o.price + p.volume_ml) // (2 * p.volume_ml)) / 10.0 END AS price_per_ml,
       row_number() OVER (PARTITION BY o.product_id ORDER BY o.is_stale, o.price, o.store, o.listing_url) AS place,
       {V.stamp_sql('s.last_updated')} AS last_updated
FROM offers o JOIN products p ON p.product_id = o.product_id JOIN stats s ON s.product_id = o.product_id""")
def product_detail(spark, folder):
    """The pages of all products, their price rows numbered as shown."""
    products = V.products(spark, folder)
    pages = C.product_detail(offers(spark, folder), products, products)
    rows = pages.select("product_id", "canonical_name", "last_updated", F.posexplode("prices").alias("place", "p"))
    return rows.select("product_id", "p.listing_id", "canonical_name", "p.price", "p.is_stale", "p.price_per_ml",
                       (F.col("place") + 1).cast("bigint").alias("place"), V.stamp("last_updated").alias("last_updated"))


@query("variants", V.SUMMARY + f"""
SELECT {SHOWN}, presentation, volume_ml FROM summary s WHERE {ON_SALE_SQL} AND product_id <> 13
  AND fragrance_id = (SELECT fragrance_id FROM products WHERE product_id = 13)""")
def variants(spark, folder):
    return shown(C.on_sale(C.variants(summary(spark, folder), 13), V.listings(spark, folder)), "presentation", "volume_ml")


@query("variant_counts", f"WITH {V.PRODUCTS_SQL} SELECT product_id, count(*) OVER (PARTITION BY fragrance_id) - 1 AS variants FROM products")
def variant_counts(spark, folder):
    return C.variant_counts(V.products(spark, folder))


@query("featured", V.SUMMARY + """
SELECT c.product_id, c.stores, c.spread FROM (
  SELECT product_id, count(DISTINCT store) AS stores, max(price) - min(price) AS spread FROM offers
  WHERE is_available AND NOT is_stale GROUP BY 1 HAVING count(DISTINCT store) >= 2) c JOIN products p USING (product_id)
WHERE p.presentation = 'full_bottle' AND EXISTS (SELECT 1 FROM listings l WHERE l.product_id = c.product_id AND l.is_active
   AND l.image_url IS NOT NULL AND l.store IN ('store1', 'store2', 'store4') AND l.matching_status IN ('matched', 'new_product'))""")
def featured(spark, folder):
    rows = C.featured_candidates(offers(spark, folder), V.products(spark, folder), V.listings(spark, folder),
                                 ("store1", "store2", "store4"), min_stores=2)
    return rows.select("product_id", F.col("stores").cast("bigint").alias("stores"), "spread")


@query("featured_pick", V.SUMMARY + """
SELECT c.product_id, c.stores, c.spread FROM (
  SELECT product_id, count(DISTINCT store) AS stores, max(price) - min(price) AS spread FROM offers
  WHERE is_available AND NOT is_stale GROUP BY 1 HAVING count(DISTINCT store) >= 2) c JOIN products p USING (product_id)
WHERE p.presentation = 'full_bottle' AND EXISTS (SELECT 1 FROM listings l WHERE l.product_id = c.product_id AND l.is_active
   AND l.image_url IS NOT NULL AND l.store IN ('store1', 'store2', 'store4') AND l.matching_status IN ('matched', 'new_product'))
ORDER BY c.stores DESC, c.spread DESC, c.product_id LIMIT 1""")
def featured_pick(spark, folder):
    rows = C.featured_candidates(offers(spark, folder), V.products(spark, folder), V.listings(spark, folder),
                                 ("store1", "store2", "store4"), min_stores=2)
    return C.featured(rows, preferred=-1).select("product_id", F.col("stores").cast("bigint").alias("stores"), "spread")


ACCENTED_SQL = """
SELECT p_partkey AS product_id, concat(CASE p_partkey % 8 WHEN 0 THEN 'Ébano ' WHEN 1 THEN 'ñandú ' WHEN 2 THEN 'Al ' WHEN 3 THEN 'al-' WHEN 4 THEN 'Nube '
  WHEN 5 THEN 'lattafa ' WHEN 6 THEN 'Eau ' ELSE 'Lacoste ' END, p_name) AS canonical_name FROM part"""


@query("catalog_sort_collated", f"WITH named AS ({ACCENTED_SQL}) SELECT product_id, canonical_name FROM named ORDER BY canonical_name COLLATE es, product_id LIMIT 100 OFFSET 50")
def catalog_sort_collated(spark, folder):
    """A page of names with accents, capitals and punctuation in Spanish order."""
    V.table(spark, folder, "part").createOrReplaceTempView("part")
    return C.page(spark.sql(ACCENTED_SQL), C.sort_columns("name"), limit=100, offset=50)


@query("variants_order", f"WITH {V.PRODUCTS_SQL}" + """
SELECT product_id, fragrance_id, row_number() OVER (PARTITION BY fragrance_id ORDER BY CASE presentation WHEN 'full_bottle' THEN 0 ELSE 4 END, volume_ml,
  canonical_name COLLATE es, product_id) AS place FROM products""")
def variants_order(spark, folder):
    return C.variant_places(V.products(spark, folder)).select("product_id", "fragrance_id", F.col("place").cast("bigint").alias("place"))


SEARCHES_SQL = """
searches AS (
  SELECT DISTINCT p_name || ' ' || substr(p_brand, 7) AS text FROM part UNION SELECT DISTINCT substr(p_name, 2, 5) || ' ' || CAST(p_size AS VARCHAR) FROM part
  UNION SELECT DISTINCT upper(p_name) FROM part UNION SELECT DISTINCT p_brand || ' ' || p_name FROM part)"""


@query("search_many", V.SUMMARY + f", {SEARCHES_SQL}" + r""",
shown AS (SELECT product_id, lower(canonical_name) AS name, lower(brand) AS brand FROM products s WHERE EXISTS (
  SELECT 1 FROM listings l WHERE l.product_id = s.product_id AND l.is_active AND l.matching_status IN ('matched', 'new_product'))),
folded AS (SELECT text, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS phrase FROM searches)
SELECT text, product_id, CASE WHEN name = phrase THEN 0 WHEN starts_with(name, phrase) OR starts_with(name, brand || ' ' || phrase) THEN 1 ELSE 2 END AS text_rank
FROM folded JOIN shown ON len(list_filter(string_split(phrase, ' '), lambda w: NOT contains(name || ' ' || brand, w))) = 0""")
def search_many(spark, folder):
    """Some thousand searches at once, among the products on sale."""
    part = V.table(spark, folder, "part")
    part.createOrReplaceTempView("part")
    searches = spark.sql(f"WITH {SEARCHES_SQL.replace('VARCHAR', 'STRING')} SELECT text FROM searches")
    rows = C.on_sale(V.products(spark, folder), V.listings(spark, folder))
    return C.search_many(rows, searches, "text").select("text", "product_id", "text_rank")


@query("semantic_many", V.SUMMARY + """,
e AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM embeddings),
shown AS (SELECT DISTINCT s.product_id, s.product_id % (SELECT count(*) FROM embeddings) AS vec_id FROM products s WHERE EXISTS (
  SELECT 1 FROM listings l WHERE l.product_id = s.product_id AND l.is_active AND l.matching_status IN ('matched', 'new_product'))),
scored AS (SELECT q.vec_id AS query_id, f.vec_id AS fragrance_id, round(list_dot_product(q.v, f.v), 6) AS similarity
           FROM e q JOIN e f ON q.vec_id % 50 = 0 AND f.vec_id IN (SELECT vec_id FROM shown))
SELECT query_id, fragrance_id, similarity, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, fragrance_id) AS rank FROM scored) WHERE rank <= 200""")
def semantic_many(spark, folder):
    """The 200 fragrances on sale nearest to each of a table of query vectors: those whose id is divisible by 50."""
    vectors = V.table(spark, folder, "embeddings").select("vec_id", "embedding")
    count = vectors.agg(F.count(F.lit(1))).scalar()
    shown = C.on_sale(V.products(spark, folder), V.listings(spark, folder)).select(F.pmod("product_id", count).alias("vec_id"))
    fragrances = vectors.join(shown, "vec_id", "left_semi").select(F.col("vec_id").alias("fragrance_id"), "embedding")
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return C.nearest_many(queries, fragrances).select("query_id", "fragrance_id", "similarity", F.col("rank").cast("bigint").alias("rank"))
