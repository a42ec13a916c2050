"""Catalog queries: one row per product, filtered, ranked, paged."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import per_unit
from ..functions.text import plain
from ..session import cut
from . import prices as P
from .blocking import SIMILARITY_DECIMALS, best_products, unit_rows
from .state import offers_of

PRESENTATIONS = ("full_bottle", "travel_size", "tester", "refill", "travel_set")
MAX_WORDS, MAX_QUERY_LENGTH, MAX_PAGE, DEFAULT_PAGE = 10, 100, 100, 20
SEMANTIC_CANDIDATES, SEMANTIC_PAGE = 200, 10
FEATURED_MIN_STORES = 3


def price_per_unit(price: Column, volume: Column, presentation: Column) -> Column:
    """Null for sets: their price pays for more than the main item."""
    return F.when((presentation != "travel_set") & price.isNotNull(), per_unit(price, volume))


def product_summary(products: DataFrame, latest: DataFrame, listings: DataFrame, since: Column) -> DataFrame:
    """The catalog table: every product with its lowest price, offer statistics, image and last known price.

    latest: the newest reading of every listing (operators.state.current_state or listing_state); the readings themselves aren't read here.
    """
    rows = products.join(P.offer_rollup(offers_of(latest, listings, since)), "product_id", "left").join(
        P.product_image(latest, listings), "product_id", "left")
    hidden = F.col("lowest_price").isNull()
    for column in ("last_known_price", "last_known_price_store", "last_known_price_at"):
        rows = rows.withColumn(column, F.when(hidden, F.col(column)))
    return rows.withColumn("store_count", F.coalesce("store_count", F.lit(0))).withColumn(
        "price_per_ml", price_per_unit(F.col("lowest_price"), F.col("volume_ml"), F.col("presentation")))


def on_sale(products: DataFrame, listings: DataFrame) -> DataFrame:
    """Products with an active, resolved listing."""
    shown = P.resolved(listings).where("is_active").select("product_id")
    return products.join(shown, "product_id", "left_semi")


@dataclass(frozen=True)
class Filters:
    """Optional filters, combined with AND; empty means no filter."""

    brand: str | None = None
    min_price: int | None = None
    max_price: int | None = None
    concentrations: tuple[str, ...] = ()
    min_volume: int | None = None
    max_volume: int | None = None
    genders: tuple[str, ...] = ()
    stores: tuple[str, ...] = ()

    def checked(self, known_stores: Sequence[str] = ()) -> Filters:
        for low, high in ((self.min_price, self.max_price), (self.min_volume, self.max_volume)):
            if low is not None and high is not None and low > high:
                raise ValueError(f"empty range {low}..{high}")
        unknown = sorted(set(self.stores) - set(known_stores)) if known_stores else []
        if unknown:
            raise ValueError(f"unknown stores {unknown}")
        return self

    def conditions(self) -> list[Column]:
        found: list[Column] = []
        if self.brand is not None:
            found.append(F.lower("brand") == self.brand.lower())
        if self.min_price is not None:
            found.append(F.col("lowest_price") >= self.min_price)
        if self.max_price is not None:
            found.append(F.col("lowest_price") <= self.max_price)
        if self.concentrations:
            found.append(F.col("concentration").isin(*self.concentrations))
        if self.min_volume is not None:
            found.append(F.col("volume_ml") >= self.min_volume)
        if self.max_volume is not None:
            found.append(F.col("volume_ml") <= self.max_volume)
        if self.genders:
            found.append(F.col("gender").isin(*self.genders))
        if self.stores:
            found.append(F.arrays_overlap("stores", F.array(*[F.lit(s) for s in self.stores])))
        return found


def filtered(summary: DataFrame, filters: Filters) -> DataFrame:
    for condition in filters.conditions():
        summary = summary.where(condition)
    return summary


def search_words(text: str) -> tuple[str, ...]:
    words = tuple(text[:MAX_QUERY_LENGTH + 1].split())
    if len(text) > MAX_QUERY_LENGTH or len(words) > MAX_WORDS:
        raise ValueError("search text too long")
    return words


def text_search(summary: DataFrame, words: Sequence[str]) -> DataFrame:
    """Rows whose folded name or brand holds every word, with text_rank 0 equal, 1 prefix, 2 other."""
    name, brand = plain(F.col("canonical_name")), plain(F.col("brand"))
    haystack = F.concat(name, F.lit(" "), brand)
    for word in words:
        summary = summary.where(F.contains(haystack, plain(F.lit(word))))
    return summary.withColumn("text_rank", _text_rank(name, brand, plain(F.lit(" ".join(words)))))


SEARCH_GRAM = 3


def _grams(text: Column, size: Column | int) -> Column:
    size = F.lit(size) if isinstance(size, int) else size
    starts = F.when(F.char_length(text) >= size, F.sequence(F.lit(1), F.char_length(text) - size + 1))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, size)))


def search_many(summary: DataFrame, queries: DataFrame, key: str = "query_id", text: str = "text") -> DataFrame:
    """text_search for a table of queries: the key, text_rank and the columns of summary, one row per query and product found.

    An inverted index of character grams of the folded names, of those grams alone that some query holds. A query reads the postings
    of its rarest gram and verifies all its words on what they name. Products of one folded name and brand are indexed and verified as
    one and only joined to what was found. Queries without words, and too long ones, find nothing.

    The joins that grow with the names are never broadcast: Spark takes an exploded index for as small as the file it comes from.
    """
    folded = [plain(F.col("canonical_name")).alias("_name"), plain(F.col("brand")).alias("_brand")]
    texts = cut(summary.select(*folded).where("_name IS NOT NULL AND _brand IS NOT NULL").distinct().withColumn(
        "haystack", F.concat("_name", F.lit(" "), "_brand")))
    words = F.filter(F.split(plain(F.trim(F.col(text))), r"\s+"), lambda w: w != "")
    asked = queries.where((F.char_length(text) <= MAX_QUERY_LENGTH) & (F.size(words) <= MAX_WORDS)).select(F.col(key).alias("_query"), words.alias("_words"))
    asked = cut(asked)
    offered = cut(asked.select("_query", F.explode("_words").alias("word")).select(
        "_query", F.explode(_grams(F.col("word"), F.least(F.char_length("word"), F.lit(SEARCH_GRAM)))).alias("gram")))
    wanted = offered.select("gram").distinct()
    all_grams = F.flatten(F.array(*[F.coalesce(_grams(F.col("haystack"), n), F.array().cast("array<string>")) for n in range(1, SEARCH_GRAM + 1)]))
    index = cut(texts.select("_name", "_brand", F.explode(all_grams).alias("gram")).hint("merge").join(wanted, "gram", "left_semi"))
    uses = index.groupBy("gram").agg(F.count(F.lit(1)).alias("uses"))
    rarest = offered.hint("merge").join(uses, "gram", "left").groupBy("_query").agg(F.min(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "gram")).alias("r"))
    sought = rarest.where("r.uses > 0").select("_query", F.col("r.gram").alias("gram")).hint("merge").join(asked, "_query")
    held = F.concat("_name", F.lit(" "), "_brand")
    found = cut(index.hint("merge").join(sought, "gram").where(F.forall("_words", lambda w: F.contains(held, w))).select(
        "_query", "_name", "_brand", _text_rank(F.col("_name"), F.col("_brand"), F.array_join("_words", " ")).alias("text_rank")))
    rows = summary.select("*", *folded).hint("merge").join(found, ["_name", "_brand"]).drop("_name", "_brand")
    return rows.select(F.col("_query").alias(key), *summary.columns, "text_rank")


def _text_rank(name: Column, brand: Column, phrase: Column) -> Column:
    after_brand = F.startswith(name, F.concat(brand, F.lit(" "), phrase))
    return F.when(name == phrase, 0).when(F.startswith(name, phrase) | after_brand, 1).otherwise(2)


def name_key(collation: str | None = "es") -> Column:
    return F.col("canonical_name") if collation is None else F.collate(F.col("canonical_name"), collation)


def sort_columns(sort: str, *, searched: bool = False, collation: str | None = "es") -> list[Column]:
    """Order of a product list; every order ends with the name and the id so pages are stable.

    relevance reads text_rank (when searched) and is_verified.
    """
    quality = [F.col("lowest_price").isNull().asc(), F.col("store_count").desc(),
               F.col("is_verified").desc(), F.col("image_url").isNull().asc()]
    heads = {
        "relevance": ([F.col("text_rank").asc()] if searched else []) + quality,
        "name": [],
        "price_asc": [F.col("lowest_price").asc_nulls_last()],
        "price_desc": [F.col("lowest_price").desc_nulls_last()],
        "discount": [F.col("best_discount_percent").desc_nulls_last()],
        "price_per_ml": [F.col("price_per_ml").asc_nulls_last()],
    }
    return [*heads[sort], name_key(collation).asc(), F.col("product_id").asc()]


def with_verified(summary: DataFrame, verified: DataFrame) -> DataFrame:
    """Mark products with at least one verified discount."""
    marks = verified.select("product_id").distinct().withColumn("is_verified", F.lit(True))
    return summary.join(marks, "product_id", "left").withColumn("is_verified", F.coalesce("is_verified", F.lit(False)))


def page(rows: DataFrame, order: Sequence[Column], limit: int = DEFAULT_PAGE, offset: int = 0) -> DataFrame:
    """One page of an ordered list: a top-k, not a full sort."""
    if not 1 <= limit <= MAX_PAGE or offset < 0:
        raise ValueError("page out of range")
    return rows.orderBy(*order).offset(offset).limit(limit)


def total(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"))


def brand_facet(products: DataFrame, listings: DataFrame) -> DataFrame:
    return on_sale(products, listings).groupBy("brand").agg(F.count(F.lit(1)).alias("products"))


def presentation_place(column: str = "presentation") -> Column:
    place = F.lit(len(PRESENTATIONS))
    for position, name in enumerate(PRESENTATIONS):
        place = F.when(F.col(column) == name, position).otherwise(place)
    return place


def product_detail(offers: DataFrame, products: DataFrame, wanted: DataFrame) -> DataFrame:
    """Pages of the products in `wanted` (product_id): attributes, last update, price rows as an array, fresh first, cheapest first.

    The array holds one product's current offers, one per listing.
    """
    asked = wanted.select("product_id")
    shown = products.join(asked, "product_id", "left_semi")
    rows = offers.join(shown.select("product_id", "volume_ml", "presentation"), "product_id").withColumn(
        "price_per_ml", price_per_unit(F.col("price"), F.col("volume_ml"), F.col("presentation")))
    entry = F.struct("is_stale", "price", "store", "listing_url", "listing_id", "list_price", "is_available", "scraped_at", "image_url", "price_per_ml")
    priced = rows.groupBy("product_id").agg(
        F.max("scraped_at").alias("last_updated"), F.array_sort(F.collect_list(entry)).alias("prices"))
    return shown.join(priced, "product_id", "left")


def variants(summary: DataFrame, product_id: int | str) -> DataFrame:
    """Other products of one product's fragrance. Order by presentation_place(), volume_ml, name, id."""
    target = summary.where(F.col("product_id") == product_id).select("fragrance_id")
    return summary.where(F.col("product_id") != product_id).join(target, "fragrance_id", "left_semi")


def variant_places(products: DataFrame, collation: str | None = "es") -> DataFrame:
    """Each product's place among those of its fragrance, as a page of variants lists them; a window over one fragrance's products."""
    order = [presentation_place().asc(), F.col("volume_ml").asc_nulls_last(), name_key(collation).asc(), F.col("product_id").asc()]
    return products.withColumn("place", F.row_number().over(Window.partitionBy("fragrance_id").orderBy(*order)))


def variant_counts(products: DataFrame) -> DataFrame:
    """How many other products share each product's fragrance, for a whole catalog."""
    counts = products.groupBy("fragrance_id").agg(F.count(F.lit(1)).alias("n"))
    return products.join(counts, "fragrance_id").select("product_id", (F.col("n") - 1).alias("variants"))


def featured_candidates(offers: DataFrame, products: DataFrame, listings: DataFrame, photo_stores: Sequence[str],
                        min_stores: int = FEATURED_MIN_STORES) -> DataFrame:
    """Full bottles live in enough stores with a photo from a good one."""
    live = offers.where(F.col("is_available") & ~F.col("is_stale"))
    counted = live.groupBy("product_id").agg(
        F.size(F.collect_set("store")).alias("stores"), (F.max("price") - F.min("price")).alias("spread"))
    pictured = P.resolved(listings).where(
        F.col("is_active") & F.col("image_url").isNotNull() & F.col("store").isin(*photo_stores))
    return (
        counted.where(F.col("stores") >= min_stores)
        .join(products.where("presentation = 'full_bottle'").select("product_id"), "product_id", "left_semi")
        .join(pictured.select("product_id"), "product_id", "left_semi")
    )


def featured(candidates: DataFrame, preferred: int | str | None = None) -> DataFrame:
    first = F.col("product_id") == F.lit(preferred) if preferred is not None else F.lit(False)
    return candidates.orderBy(first.desc(), F.desc("stores"), F.desc("spread"), "product_id").limit(1)


def semantic_search(query_vector: Sequence[float], fragrances: DataFrame, summary: DataFrame,
                    candidates: int = SEMANTIC_CANDIDATES, limit: int = SEMANTIC_PAGE) -> DataFrame:
    """Products of the fragrances nearest to one vector: exact scan, top-k, join. Similarity has 4 decimals.

    fragrances: fragrance_id, embedding. The scan keeps a top-k per task, the join broadcasts
    at most `candidates` rows.
    """
    from ..functions.vectors import cosine, literal_vector

    nearest = (
        fragrances.where(F.col("embedding").isNotNull())
        .select("fragrance_id", cosine(F.col("embedding"), literal_vector(query_vector)).alias("cosine"))
        .orderBy(F.desc("cosine"), "fragrance_id").limit(candidates)
    )
    ranked = summary.join(F.broadcast(nearest), "fragrance_id").withColumn("similarity", F.bround("cosine", 4)).drop("cosine")
    return ranked.orderBy(F.desc("similarity"), "canonical_name", "product_id").limit(limit)


NEAREST_ROWS = 4096    # of queries, and of fragrances, that meet in one task
MERGED = 16            # partial lists that one task merges


def nearest_many(queries: DataFrame, fragrances: DataFrame, candidates: int = SEMANTIC_CANDIDATES, rows: int = NEAREST_ROWS) -> DataFrame:
    """(query_id, fragrance_id, similarity, rank): the fragrances nearest to each of a table of query vectors, exact.

    queries: query_id, vector; fragrances: fragrance_id, embedding; filter them first to what is shown. Both are dealt to a grid of parts; a task
    multiplies two parts and keeps a list per query, and the lists of a query are merged some at a time. Null and zero vectors are near nothing.
    Similarities are cosines in double precision, rounded to 6 decimals before ranking; the first id wins a tie.
    """
    def parted(frame: DataFrame, key: str, vector: str, part: str) -> tuple[DataFrame, int]:
        known = frame.where(F.exists(vector, lambda v: v != 0)).select(key, F.col(vector).alias(vector))
        parts = -(-known.count() // rows) or 1
        return known.withColumn(part, F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")), parts

    left, across = parted(queries, "query_id", "vector", "q")
    right, down = parted(fragrances, "fragrance_id", "embedding", "f")
    left = left.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    right = right.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    kinds = {**dict(queries.dtypes), **dict(fragrances.dtypes)}
    spec = f"query_id {kinds['query_id']}, fragrance_id {kinds['fragrance_id']}, similarity double, part int"

    def multiply(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("fragrance_id").combine_chunks()
        none = not len(a) or not len(b)
        row, column, score = (np.zeros(0, np.int64),) * 3 if none else best_products(
            np.concatenate((unit_rows(a["vector"]), unit_rows(b["embedding"]))), np.arange(len(a)), np.arange(len(a), len(a) + len(b)), candidates)
        return pa.table({"query_id": a["query_id"].take(row), "fragrance_id": b["fragrance_id"].take(column - len(a)),
                         "similarity": pa.array(score / 10 ** SIMILARITY_DECIMALS, pa.float64()),
                         "part": pa.array(np.full(len(row), b["f"][0].as_py() if len(b) else 0), pa.int32())})

    found = left.groupBy("q", "f").cogroup(right.groupBy("q", "f")).applyInArrow(multiply, spec)
    order = (F.desc("similarity"), "fragrance_id")
    while down > 1:
        down = -(-down // MERGED)
        found = found.withColumn("part", (F.col("part") / MERGED).cast("int"))
        best = F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*order))
        found = found.withColumn("rank", best).where(F.col("rank") <= candidates).drop("rank")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).drop("part")
