"""Run records: statuses, retries, reports.

store_rows: run_id, store, file, scraped_at, is_backfill, status, stop_reason, prices_added, error. runs: run_id,
started_at, finished_at, status, errors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prices import local_day

RATE_LIMITED = "rate_limited"
ABANDONED = "abandoned: the run stopped without closing its row"


def store_status(complete: Column, prices_added: Column, error: Column) -> Column:
    """ok when the file is complete, partial when it still added prices, else failed."""
    return F.when(error.isNotNull(), "failed").when(complete, "ok").when(prices_added > 0, "partial").otherwise("failed")


def backfill_flags(store_rows: DataFrame, own: DataFrame) -> DataFrame:
    """A store row is a backfill unless its file is the one this run scraped (own: store, file)."""
    mine = own.select("store", "file", F.lit(True).alias("mine"))
    newest = store_rows.groupBy("store").agg(F.max("scraped_at").alias("newest"))
    return store_rows.join(mine, ["store", "file"], "left").join(newest, "store").withColumn(
        "is_backfill", F.col("mine").isNull()).withColumn("may_deactivate", F.col("scraped_at") == F.col("newest")).drop("mine", "newest")


def run_status(runs: DataFrame, store_rows: DataFrame) -> DataFrame:
    """Per run: ok when everything worked or there was nothing to do, partial when any price was loaded, else failed."""
    rolled = store_rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("rows"), F.bool_and(F.col("status") == "ok").alias("all_ok"),
        F.bool_or(F.coalesce(F.col("prices_added") > 0, F.lit(False))).alias("any_price"))
    clean = F.size(F.coalesce("errors", F.array().cast("array<string>"))) == 0
    status = (
        F.when(clean & F.col("rows").isNotNull() & F.col("all_ok"), "ok").when(clean & F.col("rows").isNull(), "ok")
        .when(F.coalesce("any_price", F.lit(False)), "partial").otherwise("failed"))
    return runs.join(rolled, "run_id", "left").select("run_id", status.alias("status"))


def retry_candidates(store_rows: DataFrame, runs: DataFrame, today: Column, zone: str | None = None) -> DataFrame:
    """Stores whose only own row today failed or was partial because of a rate limit."""
    todays = runs.where(local_day(F.col("started_at"), zone) == today).select("run_id")
    own = store_rows.where(~F.col("is_backfill")).join(todays, "run_id", "left_semi")
    rows = own.groupBy("store").agg(F.count(F.lit(1)).alias("n"), F.first("status").alias("status"), F.first("stop_reason").alias("stop_reason"))
    return rows.where((F.col("n") == 1) & F.col("status").isin("failed", "partial") & (F.col("stop_reason") == RATE_LIMITED)).select("store")


def close_abandoned(runs: DataFrame, now: Column) -> DataFrame:
    """Runs still marked running and never finished become failed."""
    dead = (F.col("status") == "running") & F.col("finished_at").isNull()
    closed = F.concat(F.coalesce("errors", F.array().cast("array<string>")), F.array(F.lit(ABANDONED)))
    return runs.withColumns({
        "errors": F.when(dead, closed).otherwise(F.col("errors")),
        "finished_at": F.when(dead, now).otherwise(F.col("finished_at")),
        "status": F.when(dead, "failed").otherwise(F.col("status")),
    })


def run_report(runs: DataFrame, store_rows: DataFrame, newest: int) -> DataFrame:
    """The newest runs with their store rows nested; a run's rows are bounded by its stores and files."""
    last = runs.orderBy(F.desc("run_id")).limit(newest)
    entry = F.struct("store", "scraped_at", "status", "prices_added", "stop_reason")
    nested = store_rows.join(F.broadcast(last.select("run_id")), "run_id").groupBy("run_id").agg(F.array_sort(F.collect_list(entry)).alias("stores"))
    return last.join(nested, "run_id", "left")


def summary_line(report: DataFrame) -> DataFrame:
    """One line of text per reported run."""
    part = lambda s: F.concat(s["store"], F.lit(" "), s["status"], F.lit(" +"), F.coalesce(s["prices_added"], F.lit(0)).cast("string"))
    stores = F.coalesce(F.nullif(F.array_join(F.transform("stores", part), " | "), F.lit("")), F.lit("no stores loaded"))
    errors = F.size(F.coalesce("errors", F.array().cast("array<string>"))).cast("string")
    return report.select("run_id", F.concat(F.date_format("started_at", "yyyy-MM-dd HH:mm"), F.lit("  "), F.upper("status"), F.lit(" "), stores, F.lit(" | errors "), errors).alias("line"))
