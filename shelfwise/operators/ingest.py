"""Loading snapshots into listings and prices.

cards: store, file, scraped_at, position and the raw product fields. listings and prices are the
tables of shelfwise.schemas. Each function is one set-based step; plans.load strings them together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X
from ..functions.urls import normalize_url, store_sku
from .prices import local_day

# fixed values: thresholds that results depend on
MAX_DEACTIVATION_SHARE = 0.25
MAX_SNAPSHOTS_WITHOUT_PRICE = 3
NEW_SHARE = 0.10
# end fixed values


# ------------------------------------------------------------------ cards to listings

def parsed_cards(cards: DataFrame) -> DataFrame:
    """Every card with its parsed columns and `problem`, null when it can be loaded. Narrow."""
    missing = F.coalesce(F.trim("url") == "", F.lit(True)) | F.coalesce(F.trim("name") == "", F.lit(True))
    # One projection per step: a text expression used several times is computed once, and no
    # generated method grows past the compiler's limit.
    steps = cards.select(
        "*", missing.alias("_missing"), normalize_url(F.col("url"), F.col("store")).alias("listing_url"),
        F.coalesce(F.nullif("concentration", F.lit("")), X.extract_concentration(F.col("name"))).alias("_code"),
        X.expand_abbreviations(F.col("name")).alias("_expanded"))
    steps = steps.select("*", F.trim(F.coalesce(F.nullif("volume", F.lit("")), X.extract_volume(F.col("_expanded")))).alias("_size"),
                         X.to_concentration(F.col("_code")).alias("_parsed"))
    problem = (
        F.when(F.col("_missing"), "missing url/name").when(F.col("_code").isNotNull() & F.col("_parsed").isNull(), "unknown concentration")
        .when(X.bad_price(F.col("current_price")) | X.bad_price(F.col("previous_price")), "unrecognized price"))
    return steps.select(
        "store", "file", "scraped_at", "position", problem.alias("problem"), "listing_url",
        store_sku(F.col("store"), F.col("listing_url")).alias("store_sku"), F.trim("name").alias("raw_name"),
        F.nullif(F.trim("brand"), F.lit("")).alias("raw_brand"), F.col("_parsed").alias("parsed_concentration"),
        F.when(F.coalesce(F.col("volume_note") == "", F.lit(True)), X.to_volume_ml(F.col("_size"))).alias("parsed_volume_ml"),
        X.to_price(F.col("current_price")).alias("price"), X.to_price(F.col("previous_price")).alias("list_price"),
        F.coalesce(F.col("availability") != fixed.OUT_OF_STOCK, F.lit(True)).alias("is_available"),
        X.image_url(F.col("image_url")).alias("image_url"), X.declared_gender(F.col("declared_gender")).alias("declared_gender"))


def accepted(parsed: DataFrame) -> DataFrame:
    """Loadable cards, one per listing URL of a snapshot: the last one read."""
    rest = [c for c in parsed.columns if c not in ("store", "file", "listing_url", "position", "problem")]
    best = F.max(F.struct("position", *rest)).alias("r")
    return parsed.where("problem IS NULL").groupBy("store", "file", "listing_url").agg(best).select(
        "store", "file", "listing_url", *[F.col(f"r.{c}").alias(c) for c in rest])


def problems(parsed: DataFrame) -> DataFrame:
    return parsed.where("problem IS NOT NULL").select("store", "file", "position", "listing_url", "problem")


# ------------------------------------------------------------------ days

def priced_today(prices: DataFrame, listings: DataFrame, snapshots: DataFrame, zone: str | None = None) -> DataFrame:
    """(store, listing_url) with a price on the local day of the store's snapshot."""
    days = snapshots.select("store", local_day(F.col("scraped_at"), zone).alias("day"))
    keyed = prices.select("listing_id", local_day(F.col("scraped_at"), zone).alias("day"))
    return keyed.join(listings.select("listing_id", "store", "listing_url"), "listing_id").join(days, ["store", "day"]).select(
        "store", "listing_url").distinct()


def keep_priced_today(cards: DataFrame, already: DataFrame) -> DataFrame:
    return cards.join(already, ["store", "listing_url"], "left_anti")


def append_prices(prices: DataFrame, new: DataFrame) -> DataFrame:
    """One price per listing and instant: loading a snapshot again adds nothing."""
    fresh = new.dropDuplicates(["listing_id", "scraped_at"]).join(
        prices.select("listing_id", "scraped_at"), ["listing_id", "scraped_at"], "left_anti")
    return prices.unionByName(fresh.select(*prices.columns))


def without_today(prices: DataFrame, new: DataFrame, zone: str | None = None) -> DataFrame:
    """Prices without the day's prices of the listings just read."""
    day = local_day(F.col("scraped_at"), zone)
    read = new.select("listing_id", day.alias("day")).distinct()
    return prices.withColumn("day", day).join(read, ["listing_id", "day"], "left_anti").select(*prices.columns)


def replace_today(prices: DataFrame, new: DataFrame, zone: str | None = None) -> DataFrame:
    """The day's prices of the listings read give way to the new ones."""
    return without_today(prices, new, zone).unionByName(new.select(*prices.columns))


# ------------------------------------------------------------------ cards without a price

def unpriced_kinds(cards: DataFrame, listings: DataFrame, prices: DataFrame, reported: DataFrame | None = None,
                   patient_stores: tuple[str, ...] = (), limit: int = MAX_SNAPSHOTS_WITHOUT_PRICE) -> DataFrame:
    """Why each card without a price has none: store, listing_url, kind, active.

    patient_stores say themselves which skus have no price (reported: store, sku). There a card of a
    listing with a price history was just not read, until `limit` snapshots in a row. "Snapshots
    since the last price" is a difference of ranks among the store's distinct price times.
    """
    bare = cards.where("price IS NULL").select("store", "listing_url", "store_sku", "scraped_at")
    known = listings.select("listing_id", "store", "listing_url", "is_active")
    last = prices.groupBy("listing_id").agg(F.max("scraped_at").alias("last_at"))
    times = known.select("listing_id", "store").join(prices.select("listing_id", "scraped_at"), "listing_id").select(
        "store", "scraped_at").distinct()
    # A store has one time per snapshot: the ranked rows are snapshots, not prices.
    from pyspark.sql import Window

    ranked = times.withColumn("place", F.row_number().over(Window.partitionBy("store").orderBy("scraped_at")))
    # How many of them lie before a card's time: a running count over both, the card's time ahead of an equal one.
    both = times.withColumn("counts", F.lit(1)).unionByName(bare.select("store", "scraped_at").distinct().withColumn("counts", F.lit(0)))
    running = F.sum("counts").over(Window.partitionBy("store").orderBy("scraped_at", "counts").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = both.withColumn("snapshots", running).where("counts = 0").drop("counts")
    rows = (
        bare.join(known, ["store", "listing_url"], "left").join(last, "listing_id", "left")
        .join(ranked.select("store", F.col("scraped_at").alias("last_at"), "place"), ["store", "last_at"], "left")
        .join(before, ["store", "scraped_at"], "left")
    )
    if reported is None:
        rows = rows.withColumn("told", F.lit(False))
    else:
        told = reported.select("store", F.col("sku").alias("store_sku"), F.lit(True).alias("told")).distinct()
        rows = rows.join(told, ["store", "store_sku"], "left")
    since = F.greatest(F.coalesce("snapshots", F.lit(0)) - F.coalesce("place", F.lit(0)), F.lit(0))
    patient = F.col("store").isin(*patient_stores) if patient_stores else F.lit(False)
    kind = (
        F.when(~patient, "no_price").when(F.coalesce("told", F.lit(False)), "store_unpriced")
        .when(F.col("last_at").isNull(), "never_priced").when(since + 1 >= limit, "too_long").otherwise("not_read"))
    return rows.select("store", "listing_url", kind.alias("kind"), F.coalesce("is_active", F.lit(False)).alias("active"))


# ------------------------------------------------------------------ guard

def missing_counts(listings: DataFrame, present: DataFrame) -> DataFrame:
    """Active listings per store, and how many of them are absent from `present` (store, listing_url)."""
    seen = present.select("store", "listing_url").distinct().withColumn("seen", F.lit(True))
    return listings.where("is_active").join(seen, ["store", "listing_url"], "left").groupBy("store").agg(
        F.count(F.lit(1)).alias("active_before"), F.count_if(F.col("seen").isNull()).alias("missing"))


def deactivation_guard(state: DataFrame, share: float = MAX_DEACTIVATION_SHARE) -> DataFrame:
    """state: store, active_before, missing, going, complete and optionally limit. Adds blocked.

    Missing listings count only when the snapshot is complete; nothing is deactivated past the limit.
    """
    limit = F.greatest(F.lit(share), F.coalesce("limit", F.lit(share))) if "limit" in state.columns else F.lit(share)
    leaving = F.when(F.col("complete"), F.col("missing")).otherwise(0) + F.col("going")
    blocked = (F.col("active_before") > 0) & (leaving / F.col("active_before") > limit)
    return state.withColumn("blocked", F.coalesce(blocked, F.lit(False))).withColumn(
        "complete", F.col("complete") & ~F.coalesce(blocked, F.lit(False)))


def new_share_alert(cards: DataFrame, listings: DataFrame, share: float = NEW_SHARE) -> DataFrame:
    """store, n_read, n_new, alert: too many listings unknown to a store that already has some."""
    known = listings.select("store", "listing_url").distinct().withColumn("known", F.lit(True))
    stores = listings.select("store").distinct().withColumn("has", F.lit(True))
    counts = cards.select("store", "listing_url").distinct().join(known, ["store", "listing_url"], "left").groupBy("store").agg(
        F.count(F.lit(1)).alias("n_read"), F.count_if(F.col("known").isNull()).alias("n_new"))
    return counts.join(stores, "store", "left").select(
        "store", "n_read", "n_new", (F.coalesce("has", F.lit(False)) & (F.col("n_new") / F.col("n_read") > share)).alias("alert"))


# ------------------------------------------------------------------ listing table

REFRESHED = ("store_sku", "raw_name", "raw_brand", "parsed_concentration", "parsed_volume_ml", "declared_gender")


def new_listing_id(store: Column, url: Column) -> Column:
    """A stable id for a new listing: the same snapshot loaded anywhere gives the same id."""
    return F.md5(F.concat_ws("|", store, url))


def upsert_listings(listings: DataFrame, actions: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """The listing table after a load, with `change`: inserted, updated, skipped rows are absent, null is untouched.

    actions: accepted cards with `action`: upsert (refresh everything, insert when unknown), touch
    (known listings: seen and active flag) or seen (known listings: seen only). gone: (store,
    listing_url) to deactivate. One full outer join on (store, listing_url).
    """
    key = ["store", "listing_url"]
    new = actions.select(*key, *[F.col(c).alias(f"n_{c}") for c in REFRESHED], F.col("image_url").alias("n_image"),
                         F.col("scraped_at").alias("n_at"), F.col("price").isNotNull().alias("n_active"), "action")
    rows = listings.join(new, key, "full").where("listing_id IS NOT NULL OR action = 'upsert'")
    if gone is None:
        rows = rows.withColumn("leave", F.lit(False))
    else:
        rows = rows.join(gone.select(*key, F.lit(True).alias("leave")), key, "left").withColumn("leave", F.coalesce("leave", F.lit(False)))
    is_new, write, touch = F.col("listing_id").isNull(), F.col("action") == "upsert", F.col("action").isin("upsert", "touch")
    renamed = ~F.col("raw_name").eqNullSafe(F.col("n_raw_name")) | ~F.col("raw_brand").eqNullSafe(F.col("n_raw_brand"))
    write, touch = F.coalesce(write, F.lit(False)), F.coalesce(touch, F.lit(False))
    values = {
        "listing_id": F.coalesce("listing_id", new_listing_id(F.col("store"), F.col("listing_url")).cast(dict(listings.dtypes)["listing_id"])),
        "image_url": F.when(write, F.coalesce("n_image", "image_url")).otherwise(F.col("image_url")),
        "first_seen_at": F.when(write, F.least("first_seen_at", "n_at")).otherwise(F.col("first_seen_at")),
        "last_seen_at": F.greatest("last_seen_at", "n_at"),
        "is_active": F.when(F.col("leave"), F.lit(False)).when(touch, F.col("n_active")).otherwise(F.col("is_active")),
    }
    if "embedding" in listings.columns:
        values["embedding"] = F.when(~(write & renamed), F.col("embedding"))
    if "matching_status" in listings.columns:
        values["matching_status"] = F.coalesce("matching_status", F.lit("pending"))
    for column in REFRESHED:
        if column in listings.columns:
            values[column] = F.when(write, F.col(f"n_{column}")).otherwise(F.col(column))
    change = F.when(is_new, "inserted").when(F.col("action").isNotNull(), "updated")
    return rows.select(*[values.get(c, F.col(c)).alias(c) for c in listings.columns], change.alias("change"))


def deactivate(listings: DataFrame, present: DataFrame, stores: DataFrame) -> DataFrame:
    """(store, listing_url) of active listings of `stores` absent from `present`."""
    return listings.where("is_active").join(stores.select("store"), "store", "left_semi").join(
        present.select("store", "listing_url"), ["store", "listing_url"], "left_anti").select("store", "listing_url")


# ------------------------------------------------------------------ change detection

MATCHING_INPUT = ("listing_id", "store", "is_active", "raw_brand", "raw_name", "parsed_volume_ml", "parsed_concentration",
                  "listing_url", "declared_gender")


def fingerprint(table: DataFrame, columns: tuple[str, ...] = MATCHING_INPUT) -> DataFrame:
    """One row (n, fingerprint) that changes when any row does.

    Order-free sums of row hashes: a partial aggregate per task, instead of an ordered concatenation
    of the whole table.
    """
    row = F.concat_ws("|", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("∅"))) for c in columns])
    high = F.conv(F.substring(F.md5(row), 1, 12), 16, 10).cast("decimal(38,0)")
    low = F.conv(F.substring(F.md5(row), 13, 12), 16, 10).cast("decimal(38,0)")
    return table.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(high), F.lit(0)).cast("string").alias("h"),
                     F.coalesce(F.sum(low), F.lit(0)).cast("string").alias("l")).select(
        "n", F.md5(F.concat_ws("-", "h", "l")).alias("fingerprint"))


def changed(before: DataFrame, after: DataFrame, columns: tuple[str, ...] = MATCHING_INPUT) -> DataFrame:
    """One row: does matching have to run again?"""
    both = fingerprint(before, columns).unionByName(fingerprint(after, columns))
    return both.agg((F.min("fingerprint") != F.max("fingerprint")).alias("changed"))
