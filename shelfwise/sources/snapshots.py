"""Snapshot documents: reading, gating, picking files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import SNAPSHOT

PRICE_VERSION = 2


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot JSON files, one row each, with the file name. Unreadable files keep a null store."""
    return spark.read.schema(SNAPSHOT).option("multiLine", True).json(path).withColumn("file", F.input_file_name())


def headers(snapshots: DataFrame) -> DataFrame:
    """One flat row per file: progress and pagination, no products. A file is a snapshot, or a part of one (whole)."""
    return snapshots.select(
        "file", F.coalesce("part", F.lit(1)).alias("part"), F.coalesce("parts", F.lit(1)).alias("parts"), "store", "category_url", F.try_to_timestamp("scraped_at").alias("scraped_at"),
        F.coalesce("price_extraction_version", F.lit(1)).alias("version"), F.col("progress.step").alias("step"),
        F.coalesce(F.size("products"), F.lit(0)).alias("n_products"), "pagination.*")


def whole(heads: DataFrame) -> DataFrame:
    """One row per snapshot: the header of its first part with all products counted, its `files`, and whether it is `complete`.

    Parts of one snapshot share store and time; a part that comes again counts once.
    """
    snapshot = F.when(F.col("parts") > 1, F.concat_ws(" ", "store", F.col("scraped_at").cast("string"), "parts")).otherwise(F.col("file"))
    own = F.struct(*heads.columns)
    each = heads.groupBy(snapshot.alias("snapshot"), "part").agg(F.min_by(own, "file").alias("h"))
    met = each.groupBy("snapshot").agg(
        F.min_by("h", "part").alias("h"), F.sum("h.n_products").cast("int").alias("n"), F.collect_list("h.file").alias("files"))
    return met.select(*[F.col("n").alias(c) if c == "n_products" else F.col(f"h.{c}").alias(c) for c in heads.columns], "files",
                      (F.size("files") >= F.col("h.parts")).alias("complete"))


def products(snapshots: DataFrame) -> DataFrame:
    """One row per product of a snapshot with its position, that of later parts behind that of earlier ones."""
    place = (F.coalesce("part", F.lit(1)).cast("bigint") - 1) * 2**32 + F.col("position")
    return snapshots.select("file", "part", "store", F.try_to_timestamp("scraped_at").alias("scraped_at"), F.posexplode("products").alias("position", "p")).select(
        "file", "store", "scraped_at", place.alias("position"), "p.*")


def gate(heads: DataFrame, stores: Sequence[str], allow_unfinished: bool = False, version: int = PRICE_VERSION) -> DataFrame:
    """heads with `rejected`: why a snapshot cannot be loaded, null when it can."""
    reason = F.when(F.col("store").isNull() | ~F.col("store").isin(*stores), "unknown_store")
    if not allow_unfinished:
        reason = reason.when(~F.coalesce(F.col("step") == "done", F.lit(False)), "unfinished")
    return heads.withColumn("rejected", reason.when(F.col("version") < version, "old_price_version"))


def latest_finished(heads: DataFrame) -> DataFrame:
    """The newest finished snapshot of every store, by file name."""
    done = heads.where("step = 'done'")
    return done.groupBy("store").agg(F.max("file").alias("file")).join(done, ["store", "file"])


def pending(heads: DataFrame, loaded: DataFrame, last_prices: DataFrame) -> DataFrame:
    """Snapshots with products, newer than the store's last price and not recorded as loaded.

    loaded: file. last_prices: store, last_price_at. Load them oldest first.
    """
    rows = heads.where("n_products > 0 AND scraped_at IS NOT NULL").join(loaded.select("file"), "file", "left_anti")
    return rows.join(last_prices, "store", "left").where(
        F.col("last_price_at").isNull() | (F.col("scraped_at") > F.col("last_price_at"))).drop("last_price_at")
