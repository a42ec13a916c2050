"""The state of every listing, computed from the readings once and read by everything that shows offers.

readings: listing_id, price, list_price, is_available, scraped_at and others. Readings of one listing and instant are merged first: such
rows are mergeable (see merge_instants), their number doesn't depend on how often an instant was read, and a listing with a large share
of all readings is spread over its instants. The state has one row per listing: its latest reading and what the window before it held.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import discounted
from .prices import HISTORY_WINDOW_DAYS, RESOLVED

MUCH_READ = 1_000_000   # readings of a listing, beyond which they are merged per instant before they meet
VALUES = ("price", "list_price", "is_available")
HISTORY = ("reference", "reference_at", "observed_from", "points_in_window", "undiscounted_points")


def _last(order: Sequence[str], keep: Sequence[str]) -> Column:
    names = [c for c in dict.fromkeys((*order, *VALUES, *keep)) if c != "scraped_at"]
    return F.struct(*names)


def instants(readings: DataFrame, order: Sequence[str] = ("scraped_at",), keep: Sequence[str] = ()) -> DataFrame:
    """One row per listing and instant: the last reading by `order`, readings and undiscounted readings in stock, the highest price of these.

    order[0] is scraped_at; readings that it leaves equal are told apart by their values. `keep` are columns to carry along.
    """
    usable = ~discounted(F.col("price"), F.col("list_price")) & F.col("is_available")
    return readings.groupBy("listing_id", "scraped_at").agg(
        F.max(_last(order, keep)).alias("last"), F.count(F.lit(1)).alias("points"), F.count(F.when(usable, 1)).alias("undiscounted"),
        F.max(F.when(usable, F.col("price"))).alias("highest"))


def merge_instants(*parts: DataFrame) -> DataFrame:
    """The instants of all readings, from those of parts of them; a reading in two parts counts twice."""
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both.groupBy("listing_id", "scraped_at").agg(
        F.max("last").alias("last"), F.sum("points").alias("points"), F.sum("undiscounted").alias("undiscounted"), F.max("highest").alias("highest"))


def current_state(merged: DataFrame) -> DataFrame:
    """The latest reading of each listing: listing_id, scraped_at and the columns of `last`."""
    newest = merged.groupBy("listing_id").agg(F.max(F.struct("scraped_at", "last")).alias("now"))
    return newest.select("listing_id", "now.scraped_at", "now.last.*")


def listing_state(merged: DataFrame, window_days: int = HISTORY_WINDOW_DAYS) -> DataFrame:
    """current_state with the window that ends at the latest reading, both ends included.

    reference is the highest undiscounted price in stock in the window, reference_at its last instant, observed_from the window's first
    reading. A listing's instants meet one row; the aggregate after it combines within tasks, and skewed joins are split at run time.
    """
    current = current_state(merged)
    now = current.select("listing_id", F.struct(*(c for c in current.columns if c != "listing_id")).alias("now"))
    start = F.col("now.scraped_at") - F.expr(f"INTERVAL {int(window_days)} DAYS")
    window = (
        merged.select("listing_id", "scraped_at", "points", "undiscounted", "highest").join(now, "listing_id").where(F.col("scraped_at") >= start)
        .groupBy("listing_id").agg(
            F.first("now").alias("now"),  # the same in all rows of a listing, which has one at least: the latest itself
            F.max(F.when(F.col("undiscounted") > 0, F.struct("highest", "scraped_at"))).alias("top"), F.min("scraped_at").alias("observed_from"),
            F.sum("points").alias("points_in_window"), F.sum("undiscounted").alias("undiscounted_points")))
    return window.select("listing_id", "now.*", F.col("top.highest").alias("reference"), F.col("top.scraped_at").alias("reference_at"), "observed_from",
                         "points_in_window", "undiscounted_points")


def much_read(readings: DataFrame, limit: int = MUCH_READ, buckets: int = 10_000) -> DataFrame | None:
    """The listings with more than `limit` readings, None if there are none: looked for in those buckets of listings alone that hold so many."""
    bucket = F.pmod(F.xxhash64("listing_id"), F.lit(buckets))
    full = [r["b"] for r in readings.groupBy(bucket.alias("b")).count().where(F.col("count") > limit).collect()]
    if not full:
        return None
    return readings.where(bucket.isin(full)).groupBy("listing_id").count().where(F.col("count") > limit).select("listing_id")


def readings_state(readings: DataFrame, window_days: int = HISTORY_WINDOW_DAYS, order: Sequence[str] = ("scraped_at",), keep: Sequence[str] = (),
                   limit: int = MUCH_READ) -> DataFrame:
    """listing_state of the instants of readings, for readings that are kept nowhere as instants.

    Merging readings per instant ships them once more, and few readings share an instant: they meet their listing's latest as they are. Only
    listings read more than `limit` times are merged first, so that none of them is one task's; there are at most so many of them
    as the limit goes into all readings.
    """
    hot = much_read(readings, limit)
    few = readings if hot is None else readings.join(F.broadcast(hot), "listing_id", "left_anti")
    usable = ~discounted(F.col("price"), F.col("list_price")) & F.col("is_available")
    current = few.groupBy("listing_id").agg(F.max(F.struct("scraped_at", _last(order, keep).alias("last"))).alias("now"))
    start = F.col("now.scraped_at") - F.expr(f"INTERVAL {int(window_days)} DAYS")
    state = (
        few.select("listing_id", "scraped_at", F.coalesce(usable, F.lit(False)).alias("usable"), F.when(usable, F.col("price")).alias("highest"))
        .join(current, "listing_id").where(F.col("scraped_at") >= start).groupBy("listing_id").agg(
            F.first("now").alias("now"), F.max(F.when(F.col("usable"), F.struct("highest", "scraped_at"))).alias("top"),
            F.min("scraped_at").alias("observed_from"), F.count(F.lit(1)).alias("points_in_window"), F.count_if("usable").alias("undiscounted_points"))
        .select("listing_id", "now.scraped_at", "now.last.*", F.col("top.highest").alias("reference"), F.col("top.scraped_at").alias("reference_at"),
                "observed_from", "points_in_window", "undiscounted_points"))
    if hot is None:
        return state
    return state.unionByName(listing_state(instants(readings.join(F.broadcast(hot), "listing_id", "left_semi"), order, keep), window_days))


def offers_of(state: DataFrame, listings: DataFrame, since: Column) -> DataFrame:
    """The state of every active, resolved listing with a product, and whether it is stale."""
    wanted = listings.where(F.col("matching_status").isin(*RESOLVED) & F.col("is_active") & F.col("product_id").isNotNull()).select(
        "listing_id", "product_id", "store", "listing_url", "image_url")
    return state.drop("product_id", "store").join(wanted, "listing_id").withColumn("is_stale", F.col("scraped_at") < since)


def publish(state: DataFrame, table: str, buckets: int) -> None:
    """Store the state as a table bucketed by listing: joins on listing_id read it without a shuffle."""
    state.write.format("parquet").bucketBy(buckets, "listing_id").sortBy("listing_id").mode("overwrite").saveAsTable(table)
