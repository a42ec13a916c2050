"""Structured Streaming jobs.

Every job takes a streaming DataFrame and returns one; drain() runs it over what is available and
leaves the result as a table, restartable from its checkpoint.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.completeness import DROP_SCHEMA, HISTORY, review_snapshots
from ..plans.load import load
from ..schemas import SNAPSHOT
from ..session import cut, is_empty, spread
from ..sources.snapshots import gate, headers, products, whole
from ..sources.tables import VersionedTable


def file_stream(spark: SparkSession, schema: StructType, folder: str, file_format: str, pattern: str, per_batch: int = 100) -> DataFrame:
    return (spark.readStream.schema(schema).format(file_format).option("pathGlobFilter", pattern)
            .option("maxFilesPerTrigger", per_batch).load(folder))


def snapshot_stream(spark: SparkSession, folder: str, per_batch: int = 1) -> DataFrame:
    """Snapshot files as they arrive, oldest first, each once."""
    return (spark.readStream.schema(SNAPSHOT).option("multiLine", True).option("maxFilesPerTrigger", per_batch)
            .option("latestFirst", False).option("recursiveFileLookup", True).json(folder).withColumn("file", F.input_file_name()))


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run a job to the end of the available input; handle gets each micro-batch once per batch id."""
    query = (stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Write every micro-batch under its batch id and read them back with `batch`.

    A batch replayed after a failure overwrites its own folder, so the table stays exact.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    run_batches(stream, write, f"{folder}/checkpoint", mode)
    return stream.sparkSession.read.schema(StructType(stream.schema.fields).add("batch", "long")).parquet(f"{folder}/out")


def newest_update(drained: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of every key of an update-mode result."""
    rest = [c for c in drained.columns if c not in (*keys, "batch")]
    return drained.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def first_of_day(readings: DataFrame, watermark: str = "2 days") -> DataFrame:
    """One price per listing and local day: later or repeated readings of the day are dropped."""
    return (readings.withColumn("day", F.to_date("scraped_at")).withWatermark("scraped_at", watermark)
            .dropDuplicatesWithinWatermark(["listing_id", "day"]))


def daily_band(readings: DataFrame, watermark: str = "2 days") -> DataFrame:
    """Lowest, highest and last price of every listing and day; state leaves with the watermark."""
    return (readings.withWatermark("scraped_at", watermark).groupBy("listing_id", F.window("scraped_at", "1 day").alias("w"))
            .agg(F.min("price").alias("low"), F.max("price").alias("high"), F.max_by("price", F.struct("scraped_at", "price")).alias("last"))
            .select("listing_id", F.col("w.start").alias("day"), "low", "high", "last"))


LATEST_SCHEMA = "listing_id string, scraped_at timestamp, price long, is_stale boolean"


BUCKETS = 1024   # of listings, each with one state: a listing of its own would cost its task a call per batch


def stale_at(micros: pd.Series, stale_days: int, zone: str) -> pd.Series:
    """Milliseconds of the local midnight at which each reading turns stale: that after stale_days whole days without another.

    A midnight that a clock change skips is the first instant after it, one that comes twice is the first of both.
    """
    days = pd.DatetimeIndex(pd.to_datetime(micros.astype("int64"), unit="us", utc=True)).tz_convert(zone).tz_localize(None).normalize()
    ends = (days + pd.Timedelta(days=stale_days + 1)).tz_localize(zone, nonexistent="shift_forward", ambiguous=np.ones(len(days), dtype=bool))
    return pd.Series(ends.as_unit("ms").asi8, index=micros.index)


def _pack(frame: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _newest(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["at", "price"]).drop_duplicates("listing_id", keep="last")


def latest_price(readings: DataFrame, stale_days: int = 2, watermark: str = "2 days", zone: str = "UTC", buckets: int = BUCKETS) -> DataFrame:
    """Running latest price per listing; a listing unread past its stale bound, a local midnight, reports once as stale.

    A state holds the latest readings of a bucket of listings, one each, and its timer rings for the first of them to turn stale. Rows stream
    through in chunks, whatever a listing's volume. Late and repeated readings change nothing: the latest instant counts, of equal ones the
    highest price. Readings without an instant or a price say nothing. A checkpoint belongs to its number of buckets.
    """
    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        parts = [pa.ipc.open_stream(bytes(state.get[0])).read_all().to_pandas()] if state.exists else []
        touched: set = set()
        if not state.hasTimedOut:
            for frame in frames:
                at = frame["scraped_at"].astype("datetime64[us]").astype("int64")
                part = _newest(frame[["listing_id", "price"]].assign(at=at))
                touched.update(part["listing_id"])
                parts = [_newest(pd.concat([*parts, part], ignore_index=True))]
        if not parts:
            return
        known = parts[0]
        bound = stale_at(known["at"], stale_days, zone)
        read = known["listing_id"].isin(touched)
        stale = ~read & (bound < mark)
        told = known[read | stale]
        if len(told):
            yield pd.DataFrame({"listing_id": told["listing_id"], "scraped_at": pd.to_datetime(told["at"], unit="us"), "price": told["price"],
                                "is_stale": stale[told.index]})
        if stale.all():
            state.remove()
            return
        state.update((_pack(known[~stale]),))
        state.setTimeoutTimestamp(max(int(bound[~stale].min()), mark + 1))

    rows = readings.where("scraped_at IS NOT NULL AND price IS NOT NULL").withWatermark("scraped_at", watermark)
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("listing_id"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInPandasWithState(follow, LATEST_SCHEMA, "readings binary", "update", GroupStateTimeout.EventTimeTimeout)


def drop_alerts(totals: DataFrame, keep: int = HISTORY) -> DataFrame:
    """Verdicts on totals (store, scraped_at, key, total) as they arrive, in update mode: each batch reviews its stores' newest snapshots anew.

    State is a store's newest `keep` snapshots, as in the batch review. So neither the order of arrival nor how a snapshot's totals are
    spread over files and batches matters; newest_review() reads the result.
    """
    def review(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = pd.read_json(io.StringIO(state.get[0]), orient="split", convert_dates=False, dtype={"key": str}) if state.exists else None
        for frame in frames:
            new = frame[["scraped_at", "key", "total"]].assign(scraped_at=frame["scraped_at"].astype("int64"))
            known = new if known is None else pd.concat([known, new])
            known = known.drop_duplicates(["scraped_at", "key"], keep="last")
            known = known[known["scraped_at"].isin(np.sort(known["scraped_at"].unique())[-keep:])]
        state.update((known.to_json(orient="split", index=False),))
        yield review_snapshots(known.assign(store=key[0], scraped_at=pd.to_datetime(known["scraped_at"], unit="ns")))

    exact = totals.withColumn("scraped_at", F.col("scraped_at").cast("timestamp"))
    return exact.groupBy("store").applyInPandasWithState(review, DROP_SCHEMA, "snapshots string", "update", GroupStateTimeout.NoTimeout)


def newest_review(drained: DataFrame) -> DataFrame:
    """Each store's last review, of all those drained."""
    last = drained.groupBy("store").agg(F.max("batch").alias("batch"))
    return drained.join(F.broadcast(last), ["store", "batch"]).drop("batch")


def snapshot_loader(table: VersionedTable, stores: Sequence[str], **options) -> Callable[[DataFrame, int], None]:
    """A handler for run_batches that loads snapshots (snapshot_stream) into the parts "listings" and "prices" of a table, each batch once.

    A batch's snapshots that pass the gate are loaded oldest first, one of each store at a time, with plans.load and its options. Both
    parts move with one pointer whose token is the batch's number: a batch replayed after a failure finds it and loads nothing.
    A snapshot may come in several files (`part` of `parts`), each read whole by one task: what of it came waits beside the tables, in the part
    "waiting", until the batch that brings the rest.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        token = f"batch-{batch_id:010d}"
        if table.has(token):
            return
        if table.holds("waiting"):
            batch = batch.unionByName(table.read("waiting"))
        turn = F.row_number().over(Window.partitionBy("store", "complete").orderBy("scraped_at", "file"))
        heads = cut(whole(gate(headers(batch), stores).where("rejected IS NULL")).withColumn("turn", turn))
        # A snapshot is one row of its file: its cards are dealt to all tasks before they are parsed, and whole snapshots are kept nowhere.
        cards = cut(spread(products(batch), "url"))
        listings, prices = table.read("listings"), table.read("prices")
        ready, late = heads.where("complete"), heads.where("NOT complete").select(F.explode("files").alias("file"))
        for n in range(1, (ready.agg(F.max("turn").alias("n")).first()["n"] or 0) + 1):
            chosen = ready.where(F.col("turn") == n)
            files = chosen.select("file", F.explode("files").alias("part_file"))
            own = cards.withColumnRenamed("file", "part_file").join(F.broadcast(files), "part_file").drop("part_file")
            done = load(chosen.drop("turn", "rejected", "files", "complete"), own, listings, prices, **options)
            listings = done.listings.select(*listings.columns)  # cut by load, as the new prices are: the tables aren't copied once more
            prices = done.kept_prices.select(*prices.columns).unionByName(done.prices.select(*prices.columns))
            if options.get("replace_today"):
                prices = cut(prices)
        waiting = {} if is_empty(late) else {"waiting": batch.join(F.broadcast(late), "file", "left_semi")}
        table.commit({"listings": listings, "prices": prices, **waiting}, token)

    return handle
