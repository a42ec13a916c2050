"""Table sinks, exports and the incremental vector refresh."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def merge(table: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The next version of a table: changed rows replace, new rows are added, `change` says which.

    A row equal to its stored version counts as unchanged. Keys compare null-safe, as a unique key that
    treats nulls as equal. changes holds one row per key.
    """
    values = [c for c in table.columns if c not in keys]
    old, new = table.withColumn("_old", F.lit(True)).alias("o"), changes.select(*table.columns).withColumn("_new", F.lit(True)).alias("n")
    on = None
    for k in keys:
        test = F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
        on = test if on is None else on & test
    same = F.lit(True)
    for c in values:
        same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    change = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull() | same, "unchanged").otherwise("updated")
    pick: list[Column] = [F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys]
    pick += [F.when(F.col("_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in values]
    return old.join(new, on, "full").select(*pick, change.alias("change"))


def require_named(fragrances: DataFrame) -> None:
    """Refuse to write a plan with unnamed lines; reads at most a handful of rows."""
    bad = [r["identity"] for r in fragrances.where(F.coalesce(F.trim("name"), F.lit("")) == "").select("identity").take(5)]
    if bad:
        raise ValueError(f"refusing to write: lines without a name, e.g. {bad}")


class Conflict(RuntimeError):
    """Another writer moved the pointer first."""


class VersionedTable:
    """A table whose versions are folders under root/data, and whose pointer is the highest numbered file under root/pointer.

    A pointer file is created with its number or not at all, so of two writers that saw the same version one wins. It says which folder
    holds the version and by which token it was written: a commit that is replayed finds its token and does nothing. Readers see whole versions
    only; what a failed writer left has no pointer and is cleaned. root is a folder that every executor reaches.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._paths(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._paths("/".join((self.root, *parts)))

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(f.getPath().getName() for f in self._files.listStatus(path)) if self._files.exists(path) else []

    def pointers(self) -> list[tuple[int, str]]:
        """(version, token) of all commits, oldest first: a pointer's name is the version, its content the token."""
        out = []
        for name in self._names("pointer"):
            if name.isdigit():
                stream = self._files.open(self._path("pointer", name))
                try:
                    out.append((int(name), bytes(stream.readAllBytes()).decode()))
                finally:
                    stream.close()
        return out

    def version(self) -> int:
        """The current version's number; 0 before the first commit."""
        names = [n for n in self._names("pointer") if n.isdigit()]
        return int(names[-1]) if names else 0

    def read(self, part: str = "", version: int | None = None) -> DataFrame:
        """A version, the current one if not given; of a version made of several tables, one part."""
        wanted = self.version() if version is None else version
        for number, token in self.pointers():
            if number == wanted:
                return self.spark.read.parquet(f"{self.root}/data/{token}/{part}".rstrip("/"))
        raise ValueError(f"{self.root} has no version {wanted}")

    def holds(self, part: str) -> bool:
        """Is there such a part in the current version?"""
        return any(part in self._names(f"data/{token}") for _, token in self.pointers()[-1:])

    def has(self, token: str) -> bool:
        return any(known == token for _, known in self.pointers())

    def commit(self, table: DataFrame | Mapping[str, DataFrame], token: str, expected: int | None = None, partition_by: Sequence[str] = ()) -> int:
        """Write `table`, or several by name, as the version after `expected` (the current one, if not given) and move the pointer; returns the version.

        A token that was committed before returns its version and writes nothing. Raises Conflict if the pointer is not at
        `expected` any more; the folder written stays behind as an orphan.
        """
        for number, known in self.pointers():
            if known == token:
                return number
        before = self.version() if expected is None else expected
        for name, part in ({"": table} if isinstance(table, DataFrame) else table).items():
            writer = part.write.mode("overwrite")
            if partition_by:
                writer = writer.partitionBy(*partition_by)
            writer.parquet(f"{self.root}/data/{token}/{name}".rstrip("/"))
        pointer = self._path("pointer", f"{before + 1:010d}")
        try:
            stream = self._files.create(pointer, False)
        except Py4JJavaError as error:
            raise Conflict(f"version {before + 1} of {self.root} exists") from error
        try:
            stream.write(bytearray(token.encode()))
        finally:
            stream.close()
        if self.version() != before + 1:
            raise Conflict(f"{self.root} moved on from version {before}")
        return before + 1

    def clean(self, keep: int = 2) -> list[str]:
        """Delete the folders that none of the newest `keep` versions uses; returns their names. Not while a writer is at work."""
        used = {token for _, token in self.pointers()[-keep:]}
        gone = [name for name in self._names("data") if name not in used]
        for name in gone:
            self._files.delete(self._path("data", name), True)
        return gone


def orphans(table: DataFrame, used: DataFrame, key: str) -> DataFrame:
    return table.join(used.select(key), key, "left_anti")


def export_table(table: DataFrame, path: str, without: Sequence[str] = ("embedding",)) -> DataFrame:
    """Write a table without its vector column; returns its manifest row (columns, rows) read back from the copy."""
    slim = table.drop(*without)
    slim.write.mode("overwrite").parquet(path)
    return manifest(slim.sparkSession.read.parquet(path), path)


def manifest(table: DataFrame, name: str) -> DataFrame:
    return table.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), F.lit(",".join(table.columns)).alias("columns"), "rows")


def restore_table(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Read an export and check it against its manifest (one row)."""
    want = expected.first()
    table = spark.read.parquet(path)
    got = manifest(table, path).first()
    if (got["columns"], got["rows"]) != (want["columns"], want["rows"]):
        raise ValueError(f"{path}: expected {want['rows']} rows of {want['columns']}, found {got['rows']} of {got['columns']}")
    return table


def vector_digest(vector: Column) -> Column:
    return F.md5(F.array_join(F.transform(vector, lambda v: F.round(v.cast("double"), 7).cast("string")), ","))


def refresh_vectors(cached: DataFrame, digests: DataFrame, source: DataFrame, key: str = "listing_id") -> DataFrame:
    """Cached vectors whose digest still holds, new ones for the rest; a stale vector is never kept.

    cached: key, digest, embedding. digests: key, digest (cheap to read). source: key, embedding; only the
    missing keys' vectors leave the source scan.
    """
    state = digests.join(cached.select(key, F.col("digest").alias("had"), F.col("embedding").alias("kept")), key, "left")
    good = state.where(F.col("had") == F.col("digest")).select(key, "digest", F.col("kept").alias("embedding"), F.lit(False).alias("read"))
    stale = state.where(~F.coalesce(F.col("had") == F.col("digest"), F.lit(False))).select(key, "digest")
    return good.unionByName(stale.join(source.select(key, "embedding"), key).select(key, "digest", "embedding", F.lit(True).alias("read")))


def fill_vectors(table: DataFrame, cached: DataFrame, key: str = "listing_id") -> DataFrame:
    """Null vectors filled from cached ones."""
    return table.join(cached.select(key, F.col("embedding").alias("_v")), key, "left").withColumn(
        "embedding", F.coalesce("embedding", "_v")).drop("_v")
