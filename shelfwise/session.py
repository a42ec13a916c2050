"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "32m",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: str = "8", memory: str = "12g", **extra: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster the submitter makes the session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("shelfwise")
    settings = {
        **DEFAULTS,
        "spark.sql.shuffle.partitions": cores,
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _require_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


@contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files: its result is in files of its own, so nothing reads them again.

    Otherwise they stay on the executors' disks until the driver happens to collect its garbage, those of all steps together.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """Materialise a loop's intermediate table in the shared checkpoint folder.

    Iterative operators call this once per round: the plan stays short and a
    lost executor re-reads the files instead of replaying every earlier round.
    """
    _require_checkpoint_dir(df.sparkSession)
    with _shuffles_end(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # planned anew: a plan keeps the setting it was made under


def store(*parts: DataFrame, packed: bool = False) -> DataFrame:
    """A table that many later steps read in parts, written once as Parquet beside the checkpoints: each reads only its columns.

    Plain, so that the size of the files is that of the rows: of compressed ones a planner would broadcast far more than its threshold.
    packed: compressed, for tables of listings and pairs, which grow with the input and would fill the disk. Several parts of one table
    are written one after the other, so that only one part's shuffles are on disk at a time. It stays until it is removed or the folder goes.
    """
    spark = parts[0].sparkSession
    path = work_folder(spark, "table")
    options = {"compression": "zstd"} if packed else {"compression": "none", "parquet.enable.dictionary": "false"}
    for part in parts:
        with _shuffles_end(spark):
            part.write.mode("append").options(**options).parquet(path)
    return spark.read.parquet(path)


def remove(table: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more."""
    spark = table.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def keep(df: DataFrame) -> DataFrame:
    """Keep a table that one job reads several times, in memory with spill to disk."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A scan's narrow rows dealt by key, where it comes in fewer partitions than the session shuffles into.

    For heavy work per row after a small file: one row group can't be split, whatever spark.sql.files.maxPartitionBytes says. A large
    table comes in many partitions and is passed on as it is.
    """
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted, *keys)


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder beside the checkpoints, reachable by every executor."""
    _require_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{purpose}-{uuid.uuid4().hex}"

