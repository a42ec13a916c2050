"""Did a snapshot end cleanly, and does it hold the whole catalog?

heads: one flat row per snapshot (sources.snapshots.headers), with `n_read` priced listings and
`active_before`. Which rule a store follows is data: a mapping from store to rule name.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_COVERAGE = 0.8
BOUNDARY_TOLERANCE = 1
DROP_SHARE, STREAK_TOLERANCE, ACCEPT_AFTER, LIMIT_MARGIN, HISTORY = 0.10, 0.03, 3, 0.03, 60

# fixed values: rules of the known stores
STOP_RULES = {"preunic": "exhausted", "maicao": "short_page", "salcobrand": "all_pages", "beautyperfumes": "empty_page",
              "dperfumes": "all_pages", "dreamsparfums": "all_cards"}
TOTAL_RULES = {"preunic": "categories", "maicao": "total_or_coverage", "salcobrand": "total", "beautyperfumes": "coverage",
               "dperfumes": "seen", "dreamsparfums": "seen"}
# end fixed values


def _by_rule(rules: Mapping[str, str], rule: str) -> Column:
    stores = [s for s, r in rules.items() if r == rule]
    return F.col("store").isin(*stores) if stores else F.lit(False)


def clean_stop(heads: DataFrame, rules: Mapping[str, str] = STOP_RULES) -> DataFrame:
    """heads with ended_cleanly and stop_label."""
    done = F.coalesce(F.col("step") == "done", F.lit(False))
    reason = F.coalesce("stop_reason", F.lit("unknown"))
    exhausted = F.coalesce("catalog_exhausted", F.lit(False))
    failed = F.filter(F.coalesce("categories", F.array().cast(dict(heads.dtypes)["categories"])), lambda c: F.coalesce(c["error"] != "", F.lit(False)))
    whole = ((F.col("pages_fetched") > 0) & (F.col("page_size") > 0) & (F.col("final_products") == F.col("site_total_reported"))
             & (F.col("site_total_reported") == F.col("pages_fetched") * F.col("page_size")))
    unparsed = F.coalesce(F.col("unparsed_cards") > 0, F.lit(False))
    clean = (
        F.when(~done, F.lit(False))
        .when(_by_rule(rules, "exhausted"), (F.size(failed) == 0) & exhausted)
        .when(_by_rule(rules, "short_page"), F.when(reason == "empty_page", F.coalesce(whole, F.lit(False))).otherwise(reason == "short_page"))
        .when(_by_rule(rules, "empty_page"), exhausted & (reason == "empty_page"))
        .when(_by_rule(rules, "all_cards"), ~unparsed & exhausted & (reason == "all_pages"))
        .otherwise(exhausted & (reason == "all_pages"))
    )
    path = lambda url: F.regexp_replace(F.coalesce(url, F.lit("")), r"^[a-z]+://[^/]*|[?#].*$", "")
    label = (
        F.when(~done, F.concat(F.lit("unfinished:"), F.coalesce("step", F.lit("unknown"))))
        .when(_by_rule(rules, "exhausted"), F.when(F.size(failed) > 0, F.concat(F.lit("category_failed:"), F.array_join(
            F.transform(failed, lambda c: path(c["category_url"])), ","))).when(exhausted, "catalog_exhausted").otherwise("load_more_stopped"))
        .when(_by_rule(rules, "all_cards") & unparsed, "unparsed_cards").otherwise(reason)
    )
    return heads.withColumn("ended_cleanly", clean).withColumn("stop_label", label)


def category_report(heads: DataFrame) -> DataFrame:
    """Per snapshot with categories: did every category match its own total?"""
    rows = heads.where("categories IS NOT NULL").select("file", F.explode("categories").alias("c"))
    failed = F.coalesce(F.col("c.error") != "", F.lit(False))
    good = ~failed & F.col("c.site_total").isNotNull() & F.coalesce("c.listing_complete", F.lit(False))
    name = F.regexp_replace(F.col("c.category_url"), r"^[a-z]+://[^/]*|[?#].*$", "")
    note = (
        F.when(failed, F.concat(F.lit("category "), name, F.lit(" failed: "), F.col("c.error")))
        .when(F.col("c.site_total").isNull(), F.concat(F.lit("category "), name, F.lit(": the page total was not captured")))
        .when(~good, F.concat(F.lit("category "), name, F.lit(": "), F.col("c.urls_distinct").cast("string"),
                              F.lit(" distinct listings, the page reports "), F.col("c.site_total").cast("string")))
    )
    return rows.groupBy("file").agg(F.bool_and(good).alias("categories_good"), F.array_sort(F.collect_list(note)).alias("category_notes"))


def completeness(heads: DataFrame, rules: Mapping[str, str] = TOTAL_RULES, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """heads (after clean_stop, with n_read and active_before) plus complete and notes."""
    n, total, seen = F.col("n_read"), F.col("site_total"), F.col("products_seen")
    text = lambda c: c.cast("string")
    covered = F.when(F.coalesce("active_before", F.lit(0)) == 0, F.lit(True)).otherwise(n / F.col("active_before") >= min_coverage)
    total_note = F.when(total.isNull(), "the store's product total was not captured").when(
        n != total, F.concat(F.lit("read "), text(n), F.lit(" listings, the store reports "), text(total)))
    seen_note = F.when(total.isNull() | seen.isNull(), "the store's product total was not captured").when(
        seen != total, F.concat(F.lit("saw "), text(seen), F.lit(" products, the store reports "), text(total)))
    cover_note = F.when(~covered, F.concat(text(n), F.lit(" listings of the "), text(F.col("active_before")), F.lit(" active")))
    by_category = _by_rule(rules, "categories") & F.col("categories").isNotNull()
    flagged = F.coalesce(~F.col("listing_complete"), F.lit(False))
    union_note = F.when(n != F.coalesce("urls_distinct", F.lit(-1)), F.concat(
        F.lit("read "), text(n), F.lit(" listings, the categories hold "), text(F.coalesce("urls_distinct", F.lit(0)))))
    rows = heads.join(category_report(heads), "file", "left")
    whole = (
        F.when(by_category, F.coalesce("categories_good", F.lit(True)) & union_note.isNull())
        .when(_by_rule(rules, "categories"), ~flagged & total_note.isNull())
        .when(_by_rule(rules, "total"), total_note.isNull())
        .when(_by_rule(rules, "total_or_coverage"), F.when(total.isNull(), covered).otherwise(total_note.isNull()))
        .when(_by_rule(rules, "seen"), seen_note.isNull()).otherwise(covered)
    )
    fallback = F.when(total.isNull(), "store total not captured: used the coverage rule")
    notes = (
        F.when(by_category, F.concat(F.coalesce("category_notes", F.array().cast("array<string>")), F.array_compact(F.array(union_note))))
        .when(_by_rule(rules, "categories"), F.array_compact(F.array(total_note, F.when(flagged, "listing not complete"))))
        .when(_by_rule(rules, "total"), F.array_compact(F.array(total_note)))
        .when(_by_rule(rules, "total_or_coverage"), F.when(total.isNull(), F.array_compact(F.array(fallback, cover_note))).otherwise(F.array_compact(F.array(total_note))))
        .when(_by_rule(rules, "seen"), F.array_compact(F.array(seen_note))).otherwise(F.array_compact(F.array(cover_note)))
    )
    stopped = F.array(F.concat(F.lit("scrape did not end cleanly ("), "stop_label", F.lit(")")))
    return rows.withColumn("notes", F.when(F.col("ended_cleanly"), notes).otherwise(stopped)).withColumn(
        "complete", F.col("ended_cleanly") & whole).drop("categories_good", "category_notes")


def page_coverage(pages: DataFrame, announced: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """Were all announced pages captured, with all announced products?

    pages: keys, page, product_id, total. announced: keys, n_pages, site_total. More than one total
    seen means the catalog moved while it was read.
    """
    read = pages.groupBy(*keys).agg(
        F.count_distinct("page").alias("pages"), F.min("page").alias("first_page"), F.max("page").alias("last_page"),
        F.count_distinct("product_id").alias("products"), F.count_distinct("total").alias("totals_seen"))
    full = (F.col("pages") == F.col("n_pages")) & (F.col("first_page") == 0) & (F.col("last_page") == F.col("n_pages") - 1)
    return announced.join(read, list(keys), "left").select(
        *keys, "pages", "products", "totals_seen",
        (F.coalesce(full, F.lit(False)) & (F.coalesce("products", F.lit(0)) == F.col("site_total"))).alias("whole"))


# ------------------------------------------------------------------ two noisy passes

def choose_listing(cards: DataFrame, passes: DataFrame, tolerance: int = BOUNDARY_TOLERANCE) -> DataFrame:
    """Which of two readings of one listing to use: file, source, complete, rejected, n_union, n_recovered.

    cards: file, pass (1, 2), position, url. passes: file, pass, site_total, batch_ends. Tied cards swap
    places at batch boundaries, so a union is whole only when both passes saw one total, the union has
    it, and every URL of a single pass sits next to a boundary there.
    """
    ends = F.slice("batch_ends", 1, F.greatest(F.size("batch_ends") - 1, F.lit(0)))
    near = F.exists("ends", lambda e: (F.col("position") >= e - 1 - tolerance) & (F.col("position") <= e + tolerance))
    placed = cards.join(passes.select("file", "pass", ends.alias("ends")), ["file", "pass"]).withColumn("near", near)
    urls = placed.groupBy("file", "url").agg(
        F.bool_or(F.col("pass") == 1).alias("in_1"), F.bool_or(F.col("pass") == 2).alias("in_2"), F.bool_and("near").alias("near"))
    counts = urls.groupBy("file").agg(
        F.count_if("in_1").alias("n_1"), F.count_if("in_2").alias("n_2"), F.count(F.lit(1)).alias("n_union"),
        F.count_if(~F.col("in_1")).alias("n_recovered"),
        F.count_if((F.col("in_1") != F.col("in_2")) & ~F.col("near")).alias("away"))
    totals = passes.groupBy("file").agg(
        F.max(F.when(F.col("pass") == 1, F.col("site_total"))).alias("total_1"), F.max(F.when(F.col("pass") == 2, F.col("site_total"))).alias("total_2"),
        F.bool_or(F.col("pass") == 2).alias("twice"))
    rows = totals.join(counts, "file")
    first = F.coalesce(F.col("n_1") == F.col("total_1"), F.lit(False))
    second = F.coalesce(F.col("n_2") == F.col("total_2"), F.lit(False))
    source = F.when(first | ~F.col("twice"), "first_pass").when(second, "second_pass").otherwise("union")
    rejected = F.when(source == "union", F.when(
        F.col("total_1").isNull() | ~F.col("total_1").eqNullSafe(F.col("total_2")), "same_page_total")
        .when(F.col("n_union") != F.col("total_1"), "union_matches_total").when(F.col("away") > 0, "differences_at_batch_boundaries"))
    complete = F.when(source == "first_pass", first).otherwise(rejected.isNull())
    return rows.select("file", source.alias("source"), complete.alias("complete"), rejected.alias("rejected"), "n_union",
                       F.when(source == "union", F.col("n_recovered")).otherwise(0).alias("n_recovered"))


def chosen_urls(cards: DataFrame, chosen: DataFrame) -> DataFrame:
    """URLs of the chosen listing in reading order (first pass first)."""
    rows = cards.join(chosen.select("file", "source"), "file").where(
        (F.col("source") == "union") | ((F.col("source") == "first_pass") & (F.col("pass") == 1)) | ((F.col("source") == "second_pass") & (F.col("pass") == 2)))
    return rows.groupBy("file", "url").agg(F.min(F.struct("pass", "position")).alias("at")).select("file", "url", "at.pass", "at.position")


def repeated_urls(cards: DataFrame) -> DataFrame:
    """URLs a pass shows more than once, with how often and where first and last."""
    return cards.groupBy("file", "pass", "url").agg(
        F.count(F.lit(1)).alias("times"), F.min("position").alias("first"), F.max("position").alias("last")).where("times > 1")


# ------------------------------------------------------------------ totals over time

def totals_history(totals: DataFrame, keep: int = HISTORY) -> DataFrame:
    """Totals of the newest `keep` snapshots of every store. totals: store, scraped_at, key, total.

    Rank over distinct (store, scraped_at), then join: the window sees snapshots, never listings.
    """
    times = totals.select("store", "scraped_at").distinct()
    newest = times.withColumn("age", F.row_number().over(Window.partitionBy("store").orderBy(F.desc("scraped_at")))).where(F.col("age") <= keep)
    return totals.join(newest.select("store", "scraped_at"), ["store", "scraped_at"])


#: Of a key (the store or a category): the total it is judged by, and the level and length of a run of low totals.
KEY_STATE = ["base", "level", "run"]
REVIEW = ["store", "scraped_at", "key", "total", "base", "verdict", "run", "limit"]
DROP_SCHEMA = "store string, scraped_at timestamp, key string, total long, base long, verdict string, run int, limit double"


def judge_snapshot(state: pd.DataFrame, totals: pd.Series) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Verdicts on one snapshot's totals by key, and the state after it, all keys at once.

    A total is low if it falls short of its base by more than a share. Low categories of a store that holds up are reorganized. Other low
    totals alert, until as many near each other came in a row as make the level accepted. All but alerts become the new base.
    """
    known = state.reindex(totals.index)
    low = totals < known["base"] * (1 - DROP_SHARE)
    whole = state["base"].get("store", np.nan)
    holds = np.isnan(whole) or totals.get("store", 0) >= whole * (1 - DROP_SHARE)
    moved = low & (totals.index != "store") & holds
    counted = low & ~moved
    again = counted & ((totals - known["level"]).abs() <= known["level"] * STREAK_TOLERANCE)
    run = (known["run"].where(again, 0) + 1).where(counted, 0)
    verdict = np.select([moved, counted & (run >= ACCEPT_AFTER), counted], ["reorganized", "accepted", "alert"], "ok")
    open_ = verdict == "alert"
    after = pd.DataFrame({"base": known["base"].where(open_, totals), "level": known["level"].where(again, totals).where(open_), "run": run.where(open_, 0.0)})
    return pd.DataFrame({"total": totals, "base": known["base"], "verdict": verdict, "run": run}), after.combine_first(state)


def raised_limit(accepted: tuple[float, float, int] | None, rows: pd.DataFrame) -> tuple[float, float, int] | None:
    """The store's accepted drop (share, total, age) after a snapshot: new with its acceptance, in force while the next totals stay near it."""
    if "store" not in rows.index:
        return None
    store = rows.loc["store"]
    if store["verdict"] == "accepted":
        return (store["base"] - store["total"]) / store["base"], store["total"], 0
    if accepted is None or accepted[2] + 2 > ACCEPT_AFTER or abs(store["total"] - accepted[1]) > accepted[1] * STREAK_TOLERANCE:
        return None
    return accepted[0], accepted[1], accepted[2] + 1


def review_snapshots(frame: pd.DataFrame) -> pd.DataFrame:
    """All totals of one store's snapshots (store, scraped_at, key, total) with their verdicts, judged oldest first."""
    state, accepted, out = pd.DataFrame(columns=KEY_STATE, dtype=float), None, []
    for at, snapshot in frame.groupby("scraped_at", sort=True):
        rows, state = judge_snapshot(state, snapshot.set_index("key")["total"].astype(float))
        accepted = raised_limit(accepted, rows)
        limit = np.nan if accepted is None else accepted[0] + LIMIT_MARGIN
        rows["limit"] = np.where(rows.index == "store", limit, np.nan)
        out.append(rows.reset_index(names="key").assign(scraped_at=at))
    if not out:
        return pd.DataFrame(columns=REVIEW)
    every = pd.concat(out).assign(store=frame["store"].iloc[0])
    return every.astype({"total": "int64", "base": "Int64", "run": "int32"})[REVIEW]


def drop_review(totals: DataFrame, keep: int = HISTORY) -> DataFrame:
    """Verdict on every total of the newest snapshots of each store, judged oldest first.

    The fold is inherently ordered; a store brings at most `keep` snapshots to its task.
    """
    recent = totals_history(totals, keep).select("store", F.col("scraped_at").cast("timestamp").alias("scraped_at"), "key", "total")
    return recent.groupBy("store").applyInPandas(review_snapshots, DROP_SCHEMA)
