"""Tables written by jobs: batch folders, versions and merged partitions.

Every write is idempotent. Redoing a batch, a version or a merge after a lost
executor or a failed driver overwrites the same folder with the same rows, and
a folder counts only once Spark has put its _SUCCESS marker there, or once a
manifest names it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parasol.operators.change import upsert


def _listing(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """(name, committed) of the sub-folders of ``path``; names only, no data."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    found = []
    for status in fs.listStatus(folder):
        if status.isDirectory():
            marker = jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
            found.append((status.getPath().getName(), fs.exists(marker)))
    return sorted(found)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def empty(spark: SparkSession, schema: StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)


class BatchTable:
    """Append-only table of one folder per micro-batch.

    ``by`` names columns that split each folder further, so that a filter on
    them skips files.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, by: tuple[str, ...] = ()):
        self.spark, self.path, self.by = spark, path, by
        self.schema = schema if isinstance(schema, StructType) else empty(spark, schema).schema

    def write(self, df: DataFrame, batch_id: int) -> None:
        if self.by:
            df = df.hint("rebalance", *self.by)  # one file per value, more only for a large one
        df.write.mode("overwrite").partitionBy(*self.by).parquet(f"{self.path}/batch_id={batch_id}")

    def _open(self, folders: list[str]) -> DataFrame:
        reader = self.spark.read.schema(self.schema).option("basePath", self.path)
        return reader.parquet(*folders).select(*self.schema.names)

    def read(self, before: int | None = None) -> DataFrame:
        """Rows of committed batches, those before ``before`` if given."""
        done = [name for name, ok in _listing(self.spark, self.path)
                if ok and (before is None or int(name.split("=")[1]) < before)]
        if not done:
            return empty(self.spark, self.schema)
        return self._open([f"{self.path}/{name}" for name in done])

    def newest(self, before: int) -> int | None:
        """The last committed batch before ``before``."""
        return max((b for b in (int(n.split("=")[1]) for n, ok in _listing(self.spark, self.path) if ok) if b < before), default=None)

    def read_batch(self, batch_id: int) -> DataFrame:
        return self._open([f"{self.path}/batch_id={batch_id}"])


class VersionedTable:
    """Small table rewritten as a whole; the newest committed version is current."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def version(self) -> int:
        done = [int(name.split("=")[1]) for name, ok in _listing(self.spark, self.path) if ok]
        return max(done, default=0)

    def read(self) -> DataFrame | None:
        v = self.version()
        return self.spark.read.parquet(f"{self.path}/v={v}") if v else None

    def write(self, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v={self.version() + 1}")


class MergedTable:
    """Large table partitioned by a column that never changes for a key.

    A merge reads and rewrites only the partitions its changes fall into, so
    its cost follows the changes, not the table. It writes new folders beside
    the old ones; a manifest of one row per partition names the folder that
    counts and is switched last. Until then readers see the table as it was,
    and a merge cut short is simply done again.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], partition: str):
        self.spark, self.path, self.keys, self.partition = spark, path, keys, partition
        self.manifest = VersionedTable(spark, f"{path}/manifest")

    def _folders(self) -> dict[str, int]:
        """The merge that wrote each partition; as many rows as partitions."""
        saved = self.manifest.read()
        return {r["value"]: r["merge"] for r in saved.collect()} if saved is not None else {}

    def _read(self, folders: dict[str, int]) -> DataFrame | None:
        if not folders:
            return None
        paths = [f"{self.path}/data/merge={n}/{self.partition}={value}" for value, n in sorted(folders.items())]
        return self.spark.read.option("basePath", f"{self.path}/data").parquet(*paths).drop("merge")

    def read(self, partitions: list[str] | None = None) -> DataFrame | None:
        """The table, or only the given values of the partition column."""
        return self._read({v: m for v, m in self._folders().items() if partitions is None or v in partitions})

    def merge(self, changes: DataFrame, matched: list[str] | None = None, filled: list[str] = (), newer: str | None = None) -> list[str]:
        """``changes`` are unique by key and carry every column; returns the partitions they touch.

        Known keys take the columns in ``matched`` (all if None), ``filled`` and ``newer`` as ``upsert`` does.
        """
        n, folders = self.manifest.version() + 1, self._folders()
        staged = f"{self.path}/staged/merge={n}"  # computed once, also for what it touches
        changes.write.mode("overwrite").parquet(staged)
        changes = self.spark.read.schema(changes.schema).parquet(staged)
        touched = [str(r[0]) for r in changes.select(self.partition).distinct().collect()]  # partition names
        if not touched:
            return []
        merged, old = changes, self._read({v: m for v, m in folders.items() if v in touched})
        if old is not None:
            old = old.select(*[F.col(f.name).cast(f.dataType) for f in changes.schema.fields])
            merged = upsert(old, changes, [*self.keys, self.partition], matched=matched, filled=filled, newer=newer)
        self._switch(merged, n, folders, touched)
        return touched

    def replace(self, rows: DataFrame, partitions: list[str]) -> None:
        """``rows`` are all there is of the given partitions from now on."""
        if partitions:
            self._switch(rows, self.manifest.version() + 1, self._folders(), partitions)

    def _switch(self, rows: DataFrame, n: int, folders: dict[str, int], touched: list[str]) -> None:
        # Rebalancing keeps files large: small partitions share a task, a hot one is split.
        (rows.hint("rebalance", self.partition).write.mode("overwrite")
         .partitionBy(self.partition).parquet(f"{self.path}/data/merge={n}"))
        named = sorted({**folders, **dict.fromkeys(touched, n)}.items())
        self.manifest.write(self.spark.createDataFrame(named, "value string, merge int").coalesce(1))
