"""Running a stream over what has arrived, and snapshot tables kept by ``foreachBatch``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import discard, keep, new_folder
from ..plans.versions import VersionedTable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State larger than executor memory, and required by arbitrary stateful processing."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def read_feed(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet change feed as a stream. ``path`` is a folder or a pattern of files and folders."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def drain(stream: DataFrame, label: str) -> DataFrame:
    """Append everything available to a Parquet sink and return the table."""
    spark = stream.sparkSession
    out = new_folder(spark, label)
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", new_folder(spark, f"{label}-progress"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


class SnapshotTable:
    """A keyed table advanced by micro-batches: version n = merge(version n-1, batch n).

    Everything a restart needs lies in ``folder``: the versions (``plans.versions``) and the progress of the stream. A
    replayed batch writes its version again from the same predecessor. Another object on the same folder goes on
    where the last one stopped. Where ``bucket`` is given, ``merge`` must treat rows of different buckets apart; a batch then reads and
    rewrites the buckets of its rows, not the table.
    """

    def __init__(
        self,
        spark: SparkSession,
        label: str,
        merge: Callable[[DataFrame | None, DataFrame], DataFrame],
        folder: str | None = None,
        bucket: Column | None = None,
    ):
        self.spark = spark
        self.folder = folder or new_folder(spark, label)
        self.merge = merge
        self.versions = VersionedTable(spark, self.folder, bucket)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        rows = keep(batch, "batch")  # the batch is computed once, though its buckets are listed first
        self.versions.advance(batch_id, rows, lambda known: self.merge(known, rows))
        discard(rows)

    def follow(self, stream: DataFrame, mode: str = "update") -> DataFrame:
        """Run over everything that has arrived since the last run and return the newest version."""
        query = (
            stream.writeStream.foreachBatch(self)
            .option("checkpointLocation", f"{self.folder}/progress")
            .outputMode(mode)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        done = self.versions.newest()
        table = self.versions.table(done[0]) if done else None
        return self.merge(None, self.spark.createDataFrame([], stream.schema)) if table is None else table


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key as an aggregate: it combines before the shuffle, in batch and in streams."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_newest")
    return df.groupBy(*keys).agg(newest).select(*keys, "_newest.*")
