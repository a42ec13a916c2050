"""Load one snapshot per store into the listing and price tables."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import completeness as C
from ..operators import ingest as I
from ..session import cut


@dataclass
class Loaded:
    listings: DataFrame   # new table plus `change`
    prices: DataFrame     # the appended prices only
    kept_prices: DataFrame  # prices of before that stay
    stats: DataFrame      # one row per store


def load(heads: DataFrame, cards: DataFrame, listings: DataFrame, prices: DataFrame, *,
         deactivate_missing: bool = False, keep_priced_today: bool = False, replace_today: bool = False,
         zone: str | None = None, alerts: DataFrame | None = None, reported: DataFrame | None = None,
         patient_stores: tuple[str, ...] = (), stop_rules: Mapping[str, str] = C.STOP_RULES,
         total_rules: Mapping[str, str] = C.TOTAL_RULES, max_share: float = I.MAX_DEACTIVATION_SHARE) -> Loaded:
    """Every store of `heads` at once: all decisions are one row per store and join back to the cards.

    heads: snapshots.headers rows, one per store. cards: snapshots.products rows of those files.
    alerts: store, alert, limit (optional). Nothing is written: the caller swaps the returned tables in.
    """
    if keep_priced_today and replace_today:
        raise ValueError("keep_priced_today and replace_today exclude each other")
    parsed = cut(I.parsed_cards(cards))
    found = I.accepted(parsed)
    counts = found.groupBy("store").agg(
        F.count_if(F.col("price").isNotNull()).alias("n_read"), F.count_if(F.col("price").isNull()).alias("unpriced"))
    skipped = I.problems(parsed).groupBy("store").agg(F.count(F.lit(1)).alias("skipped"))
    already = I.priced_today(prices, listings, heads, zone) if keep_priced_today else found.select("store", "listing_url").limit(0)
    present = found.select("store", "listing_url").unionByName(already).distinct()
    missing = I.missing_counts(listings, present)
    state = (
        heads.join(counts, "store", "left").join(skipped, "store", "left").join(missing, "store", "left")
        .fillna(0, ["n_read", "unpriced", "skipped", "active_before", "missing"])
    )
    state = C.completeness(C.clean_stop(state, stop_rules), total_rules)
    rest = I.keep_priced_today(found, already) if keep_priced_today else found
    kinds = cut(I.unpriced_kinds(rest, listings, prices, reported, patient_stores))
    unread = kinds.groupBy("store").agg(
        F.count_if(F.col("kind") == "not_read").alias("price_not_read"),
        F.count_if((F.col("kind") != "not_read") & F.col("active")).alias("going"))
    state = state.join(unread, "store", "left").fillna(0, ["price_not_read", "going"])
    if alerts is None:
        state = state.withColumn("alert", F.lit(False)).withColumn("limit", F.lit(None).cast("double"))
    else:
        state = state.join(alerts.select("store", "alert", "limit"), "store", "left").fillna(False, ["alert"])
    state = state.withColumn("complete", F.col("complete") & (F.col("price_not_read") == 0) & ~F.col("alert")).withColumn(
        "going", F.when(F.col("alert"), 0).otherwise(F.col("going")))
    if not deactivate_missing:
        state = state.withColumn("missing", F.lit(0).cast("bigint"))
    state = cut(I.deactivation_guard(state, max_share))
    verdict = state.select("store", "blocked", "alert", "complete", (F.col("step") == "done").alias("finished"))

    held = kinds.join(verdict.select("store", "blocked", "alert"), "store").where(
        (F.col("kind") == "not_read") | (F.col("active") & (F.col("blocked") | F.col("alert")))).select(
        "store", "listing_url", F.lit(True).alias("held"))
    actions = (
        rest.join(held, ["store", "listing_url"], "left").join(verdict.select("store", "finished"), "store")
        .withColumn("action", F.when(F.col("held"), "seen").when(F.col("finished"), "upsert").otherwise("touch"))
    )
    gone = None
    if deactivate_missing:
        gone = I.deactivate(listings, present, verdict.where("complete"))
    updated = cut(I.upsert_listings(listings, actions, gone))
    ids = updated.select("store", "listing_url", "listing_id")
    offered = actions.where("price IS NOT NULL AND action <> 'seen'").join(ids, ["store", "listing_url"]).select(
        "listing_id", "price", "list_price", F.lit("CLP").alias("currency"), "is_available", "scraped_at")
    kept = prices
    if replace_today:
        kept = I.without_today(prices, offered, zone)
    fresh = offered.join(kept.select("listing_id", "scraped_at"), ["listing_id", "scraped_at"], "left_anti").select(*offered.columns)
    fresh = cut(fresh)
    unknown = actions.where("action <> 'upsert'").join(listings.select("store", "listing_url"), ["store", "listing_url"], "left_anti")
    owners = listings.select("listing_id", "store")
    counted = {
        "unknown": unknown, "kept_today": found.join(already, ["store", "listing_url"], "left_semi"),
        "replaced_today": prices.join(kept, ["listing_id", "scraped_at"], "left_anti").join(owners, "listing_id") if replace_today else found.limit(0),
        "still_in": held.where("held")}
    for name, rows in counted.items():
        state = state.join(rows.groupBy("store").agg(F.count(F.lit(1)).alias(name)), "store", "left").fillna(0, [name])
    return Loaded(updated, fresh, kept, load_stats(state, updated, actions, fresh, gone))


def _notes() -> Column:
    """What an operator should know beside the completeness notes, only where it holds."""
    said = [(F.col("step") != "done", F.concat(F.lit("unfinished: step "), F.coalesce("step", F.lit("unknown")))),
            (F.col("blocked"), F.lit("deactivation blocked: too many listings would go")), (F.col("alert"), F.lit("total fell: nothing is deactivated")),
            (F.col("price_not_read") > 0, F.concat(F.lit("prices not read: "), F.col("price_not_read").cast("string"))),
            (F.col("unknown") > 0, F.concat(F.lit("unknown listings skipped: "), F.col("unknown").cast("string"))),
            (F.col("still_in") > 0, F.concat(F.lit("listings kept without a price: "), F.col("still_in").cast("string")))]
    return F.array_compact(F.array(*(F.when(holds, text) for holds, text in said)))


def load_stats(state: DataFrame, updated: DataFrame, actions: DataFrame, fresh: DataFrame, gone: DataFrame | None) -> DataFrame:
    """One audit row per store. Skipped are cards that can't be read, and listings that are only touched or seen but not known."""
    changes = updated.groupBy("store").agg(
        F.count_if(F.col("change") == "inserted").alias("inserted"), F.count_if(F.col("change") == "updated").alias("updated"))
    added = fresh.join(updated.select("listing_id", "store"), "listing_id").groupBy("store").agg(F.count(F.lit(1)).alias("prices_added"))
    rows = state.join(changes, "store", "left").join(added, "store", "left")
    if gone is None:
        rows = rows.withColumn("left_out", F.lit(0).cast("bigint"))
    else:
        rows = rows.join(gone.groupBy("store").agg(F.count(F.lit(1)).alias("left_out")), "store", "left")
    rows = rows.fillna(0, ["inserted", "updated", "prices_added", "left_out"])
    leaving = F.when(F.col("blocked"), 0).otherwise(F.col("going")) + F.col("left_out")
    return rows.select(
        "store", "file", "scraped_at", F.col("n_products").alias("products"),
        F.when(F.col("step") == "done", "full").otherwise("prices_only").alias("mode"), F.col("stop_label").alias("stop_reason"),
        "complete", "inserted", "updated", "prices_added",
        (F.col("skipped") + F.col("unknown")).alias("skipped"), "unpriced", "price_not_read", "kept_today", "replaced_today",
        leaving.alias("deactivated"), F.concat(F.coalesce("notes", F.array().cast("array<string>")), _notes()).alias("notes"))
