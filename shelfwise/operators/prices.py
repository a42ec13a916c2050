"""Price history analytics.

readings: listing_id, product_id, store, price, list_price, is_available, scraped_at.
listings: listing_id, product_id, store, listing_url, matching_status, is_active, image_url.

Per-key picks ("latest", "cheapest") are min/max of a struct in a hash or sort aggregate, not
row_number windows: partial aggregation leaves one row per key and task before the shuffle, so a
listing or product holding a large share of the rows costs no single task its whole history.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import discounted, median_half_even, percent, percent_half_even

RESOLVED = ("matched", "new_product")
STALE_AFTER_DAYS = 2
CARRY_DAYS = 2
HISTORY_WINDOW_DAYS = 30
MARKET_MARGIN_PERCENT = 20


def pick(df: DataFrame, keys: Sequence[str], order: Sequence[str], *, largest: bool) -> DataFrame:
    """One row per key: the largest or smallest by order, then by the remaining columns."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.struct(*order, *rest)
    best = F.max(row) if largest else F.min(row)
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*")


def latest_readings(readings: DataFrame, key: str = "listing_id",
                    order: Sequence[str] = ("scraped_at",)) -> DataFrame:
    """The newest reading of every listing."""
    return pick(readings, [key], order, largest=True)


def fresh_since(as_of: Column, days: int = STALE_AFTER_DAYS, zone: str | None = None) -> Column:
    """First instant of the local day `days` before as_of's. Without a zone the clock is local already."""
    if zone is None:
        return F.date_trunc("day", as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS")
    local_day = F.to_date(F.from_utc_timestamp(as_of, zone))
    return F.to_utc_timestamp(F.date_sub(local_day, days).cast("timestamp"), zone)


def newest_instant(readings: DataFrame) -> Column:
    """max(scraped_at) as a scalar subquery: an aggregate over one column, never a driver round trip."""
    return readings.agg(F.max("scraped_at")).scalar()


def resolved(listings: DataFrame) -> DataFrame:
    return listings.where(F.col("matching_status").isin(*RESOLVED))


def _live() -> Column:
    return F.col("is_available") & ~F.col("is_stale")


def offer_rollup(offers: DataFrame) -> DataFrame:
    """Everything the catalog shows about a product's offers, in one pass over them.

    Cheapest live offer (equal prices go to the first store name), newest reading, best live discount,
    stores with stock, highest live price, and the cheapest stale price of listings in stock when last
    read (the newest reading breaks ties).
    """
    live, stale = _live(), F.col("is_available") & F.col("is_stale")
    saving = percent(F.col("list_price") - F.col("price"), F.col("list_price"))
    newest_first = -F.unix_micros(F.col("scraped_at").cast("timestamp"))
    return offers.groupBy("product_id").agg(
        F.min(F.when(live, F.struct("price", "store"))).alias("low"),
        F.max("scraped_at").alias("last_updated"),
        F.max(F.when(live & discounted(F.col("price"), F.col("list_price")), saving)).alias("best_discount_percent"),
        F.array_sort(F.collect_set(F.when(live, F.col("store")))).alias("stores"),
        F.max(F.when(live, F.col("price"))).alias("highest_price"),
        F.min(F.when(stale, F.struct("price", "store", newest_first.alias("turn"), "scraped_at"))).alias("known"),
    ).select(
        "product_id", F.col("low.price").alias("lowest_price"), F.col("low.store").alias("lowest_price_store"),
        "last_updated", "best_discount_percent", "stores", F.size("stores").alias("store_count"), "highest_price",
        F.col("known.price").alias("last_known_price"), F.col("known.store").alias("last_known_price_store"),
        F.col("known.scraped_at").alias("last_known_price_at"))


def cheapest_offer(offers: DataFrame) -> DataFrame:
    """Products with a live offer, and the cheapest one."""
    best = F.min(F.struct("price", "store"))
    return offers.where(_live()).groupBy("product_id").agg(best.alias("b")).select(
        "product_id", F.col("b.price").alias("lowest_price"), F.col("b.store").alias("lowest_price_store"))


def offer_stats(offers: DataFrame) -> DataFrame:
    """Newest reading, best discount, stores with stock and highest price per product."""
    return offer_rollup(offers).select("product_id", "last_updated", "best_discount_percent", "stores", "store_count", "highest_price")


def last_known_price(offers: DataFrame) -> DataFrame:
    """Products whose in-stock listings include stale readings, with the cheapest of those."""
    return offer_rollup(offers).where("last_known_price IS NOT NULL").select(
        "product_id", "last_known_price", "last_known_price_store", "last_known_price_at")


def product_image(latest: DataFrame, listings: DataFrame) -> DataFrame:
    """Picture of the cheapest available listing that has one, unread prices last. latest: one row per listing, its newest reading."""
    pictured = resolved(listings).where(
        F.col("is_active") & F.col("image_url").isNotNull() & F.col("product_id").isNotNull())
    ranked = F.struct(
        F.when(F.col("is_available"), 0).otherwise(1),
        F.when(F.col("price").isNull(), 1).otherwise(0),
        F.col("price"), F.col("store"), F.col("listing_url"), F.col("image_url"),
    )
    return (
        pictured.select("listing_id", "product_id", "store", "listing_url", "image_url")
        .join(latest.select("listing_id", "price", "is_available"), "listing_id", "left")
        .groupBy("product_id").agg(F.min(ranked).alias("b"))
        .select("product_id", F.col("b.image_url").alias("image_url"))
    )


def history_check(readings: DataFrame, window_days: int = HISTORY_WINDOW_DAYS, order: Sequence[str] = ("scraped_at",)) -> DataFrame:
    """Is a listing's list price above every undiscounted price it charged in the window before now?

    The window ends at the current reading, both ends included. Readings are merged per listing and instant before they
    meet one row per listing (operators.state), so no listing's series is ever held and a much read one isn't one task's.
    """
    from .state import instants, listing_state

    return history_verdicts(listing_state(instants(readings, order), window_days))


def history_verdicts(state: DataFrame) -> DataFrame:
    """The verdict on every listing of operators.state.listing_state."""
    on_sale = discounted(F.col("price"), F.col("list_price"))
    status = (
        F.when(~on_sale, "no_list_price")
        .when(F.col("undiscounted_points") == 0, "insufficient_data")
        .when(F.col("list_price") > F.col("reference"), "above_history")
        .otherwise("consistent")
    )
    return state.select(
        "listing_id", F.col("scraped_at").alias("current_at"), F.col("price").alias("current_price"),
        F.col("list_price").alias("current_list_price"), F.col("is_available").alias("current_available"),
        status.alias("history_status"),
        F.when(on_sale, F.col("reference")).alias("history_reference"),
        F.when(on_sale, F.col("reference_at")).alias("history_reference_at"),
        "observed_from", "points_in_window", "undiscounted_points",
    )


def store_floor(offers: DataFrame) -> DataFrame:
    """Per product, every store's lowest undiscounted available price as a sorted (price, store) array.

    The array holds one entry per store selling the product, so the store dimension bounds it.
    """
    plain = offers.where(F.col("is_available") & ~discounted(F.col("price"), F.col("list_price")))
    floor = plain.groupBy("product_id", "store").agg(F.min("price").alias("price"))
    return floor.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("price", "store"))).alias("floors"))


def market_check(offers: DataFrame, references: DataFrame | None = None,
                 margin_percent: int = MARKET_MARGIN_PERCENT) -> DataFrame:
    """Is an offer's list price far above the median of the other stores' undiscounted prices?

    Stores are reduced to their lowest price before offers meet them: an offer joins one row
    per product instead of every other offer of it.
    """
    floors = store_floor(offers if references is None else references)
    others = F.filter(F.col("floors"), lambda f: f["store"] != F.col("store"))
    joined = offers.join(floors, "product_id", "left").withColumn("others", others)
    on_sale = discounted(F.col("price"), F.col("list_price"))
    enough = on_sale & (F.coalesce(F.size("others"), F.lit(0)) > 0)
    reference = F.when(enough, median_half_even(F.transform("others", lambda o: o["price"])))
    joined = joined.withColumn("market_reference", reference)
    limit = F.col("market_reference") * (100 + margin_percent)
    status = (
        F.when(~on_sale, "no_list_price").when(~enough, "insufficient_data")
        .when(F.col("list_price") * 100 > limit, "above_market").otherwise("within_market")
    )
    return joined.select(
        *offers.columns, status.alias("market_status"), "market_reference",
        F.when(enough, F.array_sort(F.transform("others", lambda o: o["store"])))
        .otherwise(F.array().cast("array<string>")).alias("market_stores"),
        percent_half_even(F.col("list_price") - F.col("market_reference"), F.col("market_reference"))
        .alias("percent_above"),
    )


CURRENT = ("current_at", "current_price", "current_list_price", "current_available")


def both_checks(state: DataFrame, offers: DataFrame) -> DataFrame:
    """History and market verdicts for every current offer; stale offers are checked but are no reference.

    state: operators.state.listing_state over the readings that the offers come from.
    """
    market = market_check(offers, offers.where(~F.col("is_stale")))
    return market.join(history_verdicts(state).drop(*CURRENT), "listing_id")


def verified_discounts(state: DataFrame, offers: DataFrame, products: DataFrame, stores: Sequence[str] = (), brand: str | None = None) -> DataFrame:
    """Available fresh discounts whose list price the listing's own history supports.

    state: operators.state.listing_state over the readings that the offers come from. Sort with DISCOUNT_ORDER and page with
    orderBy/offset/limit.
    """
    fresh = offers.where(~F.col("is_stale"))
    sale = fresh.where(F.col("is_available") & discounted(F.col("price"), F.col("list_price")))
    supported = history_verdicts(state).where("history_status = 'consistent'").drop(*CURRENT)
    amount = F.col("list_price") - F.col("price")
    rows = (
        market_check(sale, fresh).join(supported, "listing_id")
        .join(products.select("product_id", "canonical_name", "brand", "volume_ml"), "product_id")
        .withColumn("discount_amount", amount)
        .withColumn("discount_percent", percent_half_even(amount, F.col("list_price")))
    )
    if stores:
        rows = rows.where(F.col("store").isin(*stores))
    if brand is not None:
        rows = rows.where(F.lower("brand") == brand.lower())
    return rows


DISCOUNT_ORDER = (F.desc, "discount_amount"), (F.desc, "discount_percent"), (F.asc, "canonical_name"), (F.asc, "listing_url")


def discount_order() -> list[Column]:
    return [direction(column) for direction, column in DISCOUNT_ORDER]


def price_points(readings: DataFrame, listings: DataFrame) -> DataFrame:
    """Every reading of every resolved listing, inactive ones included: one row per point.

    Series are left as rows keyed by listing; nest_series builds arrays for the products asked for.
    """
    kept = resolved(listings).where(F.col("product_id").isNotNull()).select(
        "listing_id", "product_id", "store", "listing_url")
    return readings.drop("product_id", "store").join(kept, "listing_id")


def nest_series(points: DataFrame) -> DataFrame:
    """One row per listing with its points in time order, for serving chosen products."""
    point = F.struct("scraped_at", "price", "list_price", "is_available")
    return points.groupBy("product_id", "listing_id", "store", "listing_url").agg(
        F.array_sort(F.collect_list(point)).alias("points"))


def local_day(instant: Column, zone: str | None = None) -> Column:
    return F.to_date(instant if zone is None else F.from_utc_timestamp(instant, zone))


def daily_values(readings: DataFrame, keys: Sequence[str] = ("listing_id",), zone: str | None = None,
                 order: Sequence[str] = ("scraped_at",)) -> DataFrame:
    """Last reading of each local day; out of stock means no price."""
    value = F.max(F.struct(*order, F.when(F.col("is_available"), F.col("price")).alias("value")))
    return (
        readings.withColumn("day", local_day(F.col("scraped_at"), zone)).groupBy(*keys, "day")
        .agg(value.alias("v")).select(*keys, "day", F.col("v.value").alias("value"))
    )


def daily_grid(daily: DataFrame, keys: Sequence[str] = ("listing_id",), carry_days: int = CARRY_DAYS) -> DataFrame:
    """Daily values carried forward up to carry_days, never past a listing's last reading.

    Each value is spread over the days it may cover and the newest value wins a day: a hash
    aggregate on (keys, day), with no ordered window over a listing's whole life.
    """
    last = daily.groupBy(*keys).agg(F.max("day").alias("last_day"))
    reach = F.least(F.date_add("day", carry_days), F.col("last_day"))
    spread = daily.join(last, list(keys)).select(
        *keys, F.col("day").alias("read_day"), "value", F.explode(F.sequence("day", reach)).alias("day"))
    newest = F.max(F.struct("read_day", "value"))
    return spread.groupBy(*keys, "day").agg(newest.alias("n")).select(
        *keys, "day", F.col("n.value").alias("value"), (F.col("n.read_day") != F.col("day")).alias("carried"))


def daily_band(grid: DataFrame, group: str = "product_id") -> DataFrame:
    """Lowest and highest price per group and day over the group's continuous calendar; empty days are null."""
    span = grid.groupBy(group).agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    calendar = span.select(group, F.explode(F.sequence("first_day", "last_day")).alias("day"))
    band = grid.groupBy(group, "day").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return calendar.join(band, [group, "day"], "left")


def band_change(band: DataFrame, group: str = "product_id") -> DataFrame:
    """Last priced day's low minus the first priced day's low."""
    priced = band.where(F.col("low").isNotNull())
    return priced.groupBy(group).agg(
        F.min_by("low", "day").alias("first_low"), F.max_by("low", "day").alias("last_low"),
    ).withColumn("change", F.col("last_low") - F.col("first_low"))


def product_facts(readings: DataFrame, offers: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """In-stock price range of the last days, stores with stock now of all stores, and the saving."""
    live = _live()
    now = offers.groupBy("product_id").agg(
        F.size(F.collect_set(F.when(live, F.col("store")))).alias("stores_in_stock"),
        F.size(F.collect_set("store")).alias("stores"),
        F.min(F.when(live, F.col("price"))).alias("low"), F.max(F.when(live, F.col("price"))).alias("high"),
    )
    since = as_of - F.expr(f"INTERVAL {int(days)} DAYS")
    recent = (
        readings.where(F.col("is_available") & (F.col("scraped_at") >= since))
        .groupBy("product_id").agg(F.min("price").alias("range_low"), F.max("price").alias("range_high"))
    )
    saving = F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low"))
    return now.join(recent, "product_id", "left").withColumn("saving", saving)


def price_ladder(offers: DataFrame) -> DataFrame:
    """Each offer beside its product's lowest live price and its share of the product's top price."""
    live = _live()
    scale = offers.groupBy("product_id").agg(
        F.min(F.when(live, F.col("price"))).alias("lowest_price"),
        F.max(F.coalesce("list_price", "price")).alias("scale_price"))
    lowest = live & (F.col("price") == F.col("lowest_price"))
    return offers.join(scale, "product_id").select(
        *offers.columns, F.coalesce(lowest, F.lit(False)).alias("is_lowest"),
        F.when(live, F.col("price") - F.col("lowest_price")).alias("over_lowest"),
        F.greatest(F.lit(6.0), percent(F.col("price"), F.col("scale_price"))).alias("share_percent"),
    )


def best_image(offers: DataFrame, ranks: Sequence[str]) -> DataFrame:
    """Image of the best ranked store that has one."""
    rank = F.lit(len(ranks))
    for position, store in reversed(list(enumerate(ranks))):
        rank = F.when(F.col("store") == store, position).otherwise(rank)
    return (
        offers.where(F.col("image_url").isNotNull()).groupBy("product_id")
        .agg(F.min(F.struct(rank, F.col("is_stale"), F.col("price"), F.col("store"), F.col("listing_url"), F.col("image_url"))).alias("b"))
        .select("product_id", F.col("b.image_url").alias("image_url"))
    )


def series_order(latest: DataFrame, offers: DataFrame, listings: DataFrame) -> DataFrame:
    """Series of a product, cheapest first, stale last, then by last price; repeated stores are numbered.

    latest: one row per listing, its newest reading. Windows run over one row per listing of a product, not over readings.
    """
    from pyspark.sql import Window

    last = latest.select("listing_id", F.col("price").alias("last_price"))
    series = resolved(listings).select("listing_id", "product_id", "store", "listing_url").join(last, "listing_id")
    live = offers.where(_live()).groupBy("product_id").agg(
        F.min(F.struct("price", "store", "listing_url")).alias("c"))
    state = offers.select("listing_id", "is_stale")
    rows = (
        series.join(state, "listing_id", "left").join(live, "product_id", "left")
        .withColumn("stale", F.coalesce("is_stale", F.lit(True)))
        .withColumn("cheapest", F.coalesce(F.col("listing_url") == F.col("c.listing_url"), F.lit(False)))
    )
    by_product = Window.partitionBy("product_id")
    place = F.row_number().over(by_product.orderBy("store", "listing_url"))
    repeats = F.count(F.lit(1)).over(Window.partitionBy("product_id", "store"))
    numbered = rows.withColumn("place", place).withColumn("repeats", repeats)
    rank = F.row_number().over(by_product.orderBy(F.desc("cheapest"), "stale", "last_price", "place"))
    label = F.when(F.col("repeats") > 1, F.concat("store", F.lit(" ("), F.col("place").cast("string"), F.lit(")"))).otherwise(F.col("store"))
    return numbered.select("product_id", "listing_id", label.alias("label"), "cheapest", "stale", "last_price",
                           rank.alias("position"))
