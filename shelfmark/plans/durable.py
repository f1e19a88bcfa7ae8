"""Cut points in the shared checkpoint folder.

Iterative jobs and global numbering need data that is computed once and survives the loss of an
executor. They write it as Parquet into the folder the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="shelfmark-")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only a local session without one gets its own."""
    named = spark.conf.get(CHECKPOINT_SETTING, None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder every executor can reach")
    return _local_folder()


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return the written table: short lineage, columnar, prunable."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept.kept_in = path
    return kept


def discard(df: DataFrame) -> None:
    """Delete the files behind a table made by ``keep`` (superseded rounds of a loop)."""
    remove(df.sparkSession, df.kept_in)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)  # PySpark has no call of its own to delete on any file system
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
