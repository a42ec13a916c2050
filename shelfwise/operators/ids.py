"""Stable product identifiers across runs.

plan: product_key, listing_id (this run). existing: product_id, product_key, created_at.
previous: listing_id, product_id (before this run). history: listing_id, readings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, is_empty, keep

MAX_ROUNDS = 10_000
HOPS = 20


def reading_counts(readings: DataFrame) -> DataFrame:
    return readings.groupBy("listing_id").agg(F.count(F.lit(1)).alias("readings"))


def old_parts(plan: DataFrame, previous: DataFrame, history: DataFrame) -> DataFrame:
    """Where each old product's listings are now: listings and readings per (product_id, product_key)."""
    moved = plan.join(previous.where("product_id IS NOT NULL"), "listing_id").join(history, "listing_id", "left")
    return moved.groupBy("product_id", "product_key").agg(
        F.count(F.lit(1)).alias("listings"), F.sum(F.coalesce("readings", F.lit(0))).alias("readings"))


def preferences(parts: DataFrame, existing: DataFrame) -> DataFrame:
    """parts with `preference`, smallest first: the part an old product would keep its id with.

    Its own key comes first unless another part has strictly more readings; without its own key,
    most listings, then most readings. Keys break ties.
    """
    own = existing.select("product_id", F.col("product_key").alias("own_key"))
    rows = parts.join(own, "product_id", "left").withColumn("is_own", F.coalesce(F.col("product_key") == F.col("own_key"), F.lit(False)))
    heads = rows.groupBy("product_id").agg(
        F.bool_or("is_own").alias("has_own"), F.max(F.when(F.col("is_own"), F.col("readings"))).alias("own_readings"),
        F.min(F.when(~F.col("is_own"), F.struct((-F.col("readings")).alias("r"), "product_key"))).alias("rival"))
    ahead = ~F.col("is_own") & (F.col("product_key") == F.col("rival.product_key")) & (F.col("readings") > F.col("own_readings"))
    kept = F.struct(F.when(ahead, 0).when(F.col("is_own"), 1).otherwise(2).alias("p"), (-F.col("readings")).alias("x"),
                    F.lit(0).cast("bigint").alias("y"), F.col("product_key"))
    lost = F.struct(F.lit(0).alias("p"), (-F.col("listings")).alias("x"), (-F.col("readings")).alias("y"), F.col("product_key"))
    return rows.join(heads, "product_id").withColumn("preference", F.when(F.col("has_own"), kept).otherwise(lost)).select(
        "product_id", "product_key", "listings", "readings", "preference")


def seniority(previous: DataFrame, existing: DataFrame, history: DataFrame) -> DataFrame:
    """product_id and `senior`, smallest first: most readings, then oldest, then lowest id."""
    total = previous.where("product_id IS NOT NULL").join(history, "listing_id", "left").groupBy("product_id").agg(
        F.sum(F.coalesce("readings", F.lit(0))).alias("total"))
    rows = total.join(existing.select("product_id", "created_at"), "product_id", "left")
    return rows.select("product_id", F.struct((-F.col("total")).alias("r"), F.col("created_at").isNull().alias("u"),
                                              F.col("created_at"), F.col("product_id").cast("string").alias("i")).alias("senior"))


def stable_matching(ranked: DataFrame, senior: DataFrame) -> DataFrame:
    """product_id, product_key: each old product keeps at most one key and each key one product.

    Rounds of two aggregates: every product asks for its best remaining key, every key keeps its most
    senior asker, refused requests leave the table. The outcome is the unique stable matching, the same
    in any order and at any parallelism; products alone with their key settle in the first round.
    """
    open_rows = cut(ranked.join(senior, "product_id").select("product_id", "product_key", "preference", "senior"))
    for _ in range(MAX_ROUNDS):
        asked = open_rows.groupBy("product_id").agg(F.min(F.struct("preference", "product_key", "senior")).alias("r")).select(
            "product_id", F.col("r.product_key").alias("product_key"), F.col("r.senior").alias("senior"))
        asked = keep(asked)
        best = asked.groupBy("product_key").agg(F.min("senior").alias("best"))
        refused = keep(asked.join(best, "product_key").where(F.col("senior") != F.col("best")).select("product_id", "product_key"))
        if is_empty(refused):
            held = cut(asked.select("product_id", "product_key"))
            asked.unpersist()
            refused.unpersist()
            return held
        open_rows = cut(open_rows.join(refused, ["product_id", "product_key"], "left_anti"))
        asked.unpersist()
        refused.unpersist()
    raise RuntimeError("matching did not settle")


def assign_ids(plan: DataFrame, existing: DataFrame, previous: DataFrame, history: DataFrame) -> DataFrame:
    """product_key, product_id, how: kept (its listings had it), reused (an unpointed row with the key), new (null id)."""
    parts = cut(old_parts(plan, previous, history))
    held = stable_matching(preferences(parts, existing), seniority(previous, existing, history))
    keys = plan.select("product_key").distinct()
    rows = existing.select("product_key", F.col("product_id").alias("row_id"))
    idle = (
        rows.join(held.select(F.col("product_id").alias("row_id")), "row_id", "left_anti")
        .join(parts.select(F.col("product_id").alias("row_id")), "row_id", "left_anti")
    )
    placed = keys.join(held, "product_key", "left").join(idle, "product_key", "left")
    how = F.when(F.col("product_id").isNotNull(), "kept").when(F.col("row_id").isNotNull(), "reused").otherwise("new")
    return placed.select("product_key", F.coalesce("product_id", "row_id").alias("product_id"), how.alias("how"))


def displaced(assigned: DataFrame, existing: DataFrame) -> DataFrame:
    """Old rows whose key went to another product: their remaining listings follow the key."""
    keys = assigned.select("product_key", F.col("product_id").alias("holder"))
    used = assigned.where("product_id IS NOT NULL").select("product_id")
    return existing.select("product_id", "product_key").join(keys, "product_key").join(used, "product_id", "left_anti").select(
        "product_id", "product_key", "holder")


def id_audit(assigned: DataFrame, parts: DataFrame, existing: DataFrame, moved: DataFrame) -> DataFrame:
    """One row of counters: fusions, splits, swaps (0 by construction), rekeyed, displaced, reused, new."""
    fused = parts.groupBy("product_key").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("fusions"))
    split = parts.groupBy("product_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("splits"))
    given = assigned.where("product_id IS NOT NULL")
    foreign = given.join(parts.select("product_id").distinct(), "product_id").join(
        parts.select("product_id", "product_key"), ["product_id", "product_key"], "left_anti")
    rekeyed = given.join(existing.select("product_id", F.col("product_key").alias("own")), "product_id", "left")
    counts = [
        fused, split, foreign.agg(F.count(F.lit(1)).alias("swaps")),
        rekeyed.agg(F.count_if(~F.col("own").eqNullSafe(F.col("product_key"))).alias("rekeyed")),
        moved.agg(F.count(F.lit(1)).alias("displaced")),
        assigned.agg(F.count_if(F.col("how") == "reused").alias("reused"), F.count_if(F.col("how") == "new").alias("new")),
    ]
    # Long form: one (counter, value) row each, so no one-row tables are joined.
    long_rows = None
    for table in counts:
        for name in table.columns:
            row = table.select(F.lit(name).alias("counter"), F.col(name).cast("bigint").alias("value"))
            long_rows = row if long_rows is None else long_rows.unionByName(row)
    return long_rows


def id_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(counter, value): swaps, fusions, splits between two listing_id -> product_id maps.

    A swap is an id in use before and after with no listing in common.
    """
    both = before.select("listing_id", F.col("product_id").alias("old")).join(
        after.select("listing_id", F.col("product_id").alias("new")), "listing_id")
    fusions = both.groupBy("new").agg((F.min("old") != F.max("old")).alias("x")).agg(F.count_if("x").alias("value"))
    splits = both.groupBy("old").agg((F.min("new") != F.max("new")).alias("x")).agg(F.count_if("x").alias("value"))
    stayed = both.where("old = new").select(F.col("old").alias("product_id"))
    swaps = before.select("product_id").distinct().join(after.select("product_id"), "product_id", "left_semi").join(
        stayed, "product_id", "left_anti").agg(F.count(F.lit(1)).alias("value"))
    named = lambda df, name: df.select(F.lit(name).alias("counter"), "value")
    return named(fusions, "fusions").unionByName(named(splits, "splits")).unionByName(named(swaps, "swaps"))


def reassign_listings(previous: DataFrame, status: DataFrame, ids: DataFrame, moved: DataFrame) -> DataFrame:
    """listing_id, product_id, status, confidence after a run.

    Resolved listings take their product's id, pending ones keep theirs, and listings left on a
    displaced row follow its key.
    """
    planned = status.join(ids.select("product_key", F.col("product_id").alias("new_id")), "product_key", "left")
    rows = previous.select("listing_id", F.col("product_id").alias("old_id")).join(planned, "listing_id", "full")
    kept = rows.withColumn("product_id", F.coalesce("new_id", "old_id"))
    follow = moved.select(F.col("product_id"), F.col("holder"))
    return kept.join(follow, "product_id", "left").select(
        "listing_id", F.coalesce("holder", "product_id").alias("product_id"), "status", F.round("confidence", 3).alias("confidence"))


def retire(products: DataFrame, previous: DataFrame, now: DataFrame, history: DataFrame) -> DataFrame:
    """Products without listings now, and where theirs went: most listings, then most readings, then highest id."""
    gone = products.join(now.select("product_id"), "product_id", "left_anti")
    votes = (
        previous.join(gone.select("product_id"), "product_id", "left_semi")
        .join(now.select("listing_id", F.col("product_id").alias("target")), "listing_id").where("target IS NOT NULL AND target <> product_id")
        .join(history, "listing_id", "left").groupBy("product_id", "target")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("readings", F.lit(0))).alias("r"))
    )
    best = votes.groupBy("product_id").agg(F.max(F.struct("n", "r", F.col("target").cast("string").alias("t"), "target")).alias("b"))
    return gone.join(best, "product_id", "left").select(
        "product_id", F.col("b.target").alias("replaced_by"),
        F.when(F.col("b.target").isNotNull(), "merged").otherwise("no_listings").alias("reason"), "canonical_name")


def redirects(retired: DataFrame, products: DataFrame, hops: int = HOPS) -> DataFrame:
    """Every retired id with the last id of its chain and whether that product exists.

    Steps are composed by doubling, so `hops` links take about log2(hops) joins and a cycle just stops.
    """
    step = cut(retired.select(F.col("product_id").alias("x"), F.col("replaced_by").alias("y"), F.lit(True).alias("known")))
    reach = retired.select("product_id", F.col("replaced_by").alias("target"))
    remaining = hops - 1
    while remaining:
        if remaining & 1:
            moved = step.select(F.col("x").alias("target"), "y", "known")
            reach = reach.join(moved, "target", "left").select(
                "product_id", F.when(F.col("known"), F.col("y")).otherwise(F.col("target")).alias("target"))
        remaining >>= 1
        if remaining:
            after = step.select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("known").alias("more"))
            step = cut(step.join(after, "y", "left").select(
                "x", F.when(F.col("more"), F.col("z")).otherwise(F.col("y")).alias("y"), "known"))
    live = products.select(F.col("product_id").alias("target"), F.lit(True).alias("exists"))
    return reach.join(live, "target", "left").select("product_id", "target", F.coalesce("exists", F.lit(False)).alias("exists"))


def lookup_outcome(wanted: DataFrame, products: DataFrame, closure: DataFrame) -> DataFrame:
    """found, replaced (with the new id), retired or unknown for every asked product_id."""
    live = products.select("product_id", F.lit(True).alias("live"))
    old = closure.select("product_id", "target", "exists", F.lit(True).alias("old"))
    rows = wanted.select("product_id").join(live, "product_id", "left").join(old, "product_id", "left")
    outcome = F.when(F.col("live"), "found").when(F.col("old") & F.col("exists"), "replaced").when(F.col("old"), "retired").otherwise("unknown")
    return rows.select("product_id", outcome.alias("outcome"), F.when(outcome == "replaced", F.col("target")).alias("new_id"))
