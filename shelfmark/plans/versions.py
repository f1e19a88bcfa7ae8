"""Tables kept in versions of which each rewrites only the buckets it touches.

``folder`` holds ``data/batch-n`` (the rows version n wrote, one folder per bucket) and ``version-n`` (its manifest: one row per
bucket that holds rows, with the batch that wrote it, and one without a bucket). A version counts once its manifest is
written, which is a single file and comes last, so a job that dies leaves the last one intact and may run again. The version before the
newest stays readable for that; older ones and buckets that only they hold are deleted.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .durable import remove

MANIFEST = "version long, bucket long, batch long"
BUCKETS = 16
_BUCKET = "_bucket"


def key_bucket(*keys: str, buckets: int = BUCKETS) -> Column:
    """Bucket of a key. Every key lies in one bucket whatever its rows; a table must keep its number of buckets."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets))


def time_bucket(at: str, seconds: int) -> Column:
    """Bucket of a time: new rows touch the newest buckets only."""
    return F.floor(F.unix_seconds(at) / seconds)


class VersionedTable:
    """``bucket``: bigint column over the columns of the table; without one the table is a single bucket."""

    def __init__(self, spark: SparkSession, folder: str, bucket: Column | None = None):
        self.spark, self.folder = spark, folder
        self.bucket = F.lit(0) if bucket is None else bucket
        self.whole = bucket is None

    def versions(self, below: int | None = None) -> dict[int, dict[int, int]]:
        """The finished versions (below one), newest first: for each, which batch wrote a bucket. Few are ever kept."""
        try:
            rows = self.spark.read.schema(MANIFEST).json(f"{self.folder}/version-*").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []
        found = sorted({r.version for r in rows if below is None or r.version < below}, reverse=True)
        return {v: {r.bucket: r.batch for r in rows if r.version == v and r.bucket is not None} for v in found}

    def newest(self) -> list[int]:
        return list(self.versions())

    def held(self, version: int) -> dict[int, int]:
        """Bucket -> the batch that wrote it, of a version."""
        return self.versions().get(version, {})

    def _batch(self, batch: int) -> str:
        return f"{self.folder}/data/batch-{batch}"

    def _read(self, held: dict[int, int]) -> DataFrame | None:
        paths = [f"{self._batch(batch)}/{_BUCKET}={bucket}" for bucket, batch in sorted(held.items())]
        return self.spark.read.parquet(*paths) if paths else None

    def table(self, version: int) -> DataFrame | None:
        """The rows of a version; None where it holds none."""
        return self._read(self.held(version))

    def advance(self, version: int, rows: DataFrame, merge: Callable[[DataFrame | None], DataFrame]) -> None:
        """Write ``version``. ``rows`` name what changes by the columns of ``bucket``; ``merge`` gets the known rows of
        the buckets they touch (None if there are none) and returns the rows these buckets hold from now on."""
        before = self.versions(version)
        held = next(iter(before.values()), {})
        touched = {r[0] for r in rows.select(self.bucket.cast("long")).distinct().collect()}  # one number a bucket
        now = {b: v for b, v in held.items() if b not in touched}
        if touched:
            new = merge(self._read({b: v for b, v in held.items() if b in touched}))
            now |= {b: version for b in self._write(new, version)}
        lines = [{"version": version}] + [{"version": version, "bucket": b, "batch": v} for b, v in sorted(now.items())]
        parsed = F.from_json(F.lit(json.dumps(lines)), f"array<struct<{MANIFEST}>>")
        manifest = self.spark.range(1).coalesce(1).select(F.inline(parsed))
        manifest.write.mode("overwrite").json(f"{self.folder}/version-{version}")
        for old in list(before)[:0:-1]:  # the oldest first; the one before this version stays
            self._forget(old, before[old], held)

    def _write(self, new: DataFrame, version: int) -> set[int]:
        """The buckets that got rows."""
        tagged = new.withColumn(_BUCKET, self.bucket.cast("long"))
        # an adaptive rebalance keeps a bucket in few files and splits one that is too large for a task
        dealt = tagged if self.whole else tagged.hint("rebalance", F.col(_BUCKET))
        dealt.write.mode("overwrite").partitionBy(_BUCKET).parquet(self._batch(version))
        files = self.spark.read.schema(tagged.schema).parquet(self._batch(version)).inputFiles()  # a listing, no job
        return {int(m[1]) for m in (re.search(rf"/{_BUCKET}=(-?\d+)/", f) for f in files) if m}

    def _forget(self, old: int, held: dict[int, int], still: dict[int, int]) -> None:
        """Delete what only ``old`` holds. Its manifest goes last, so that a run that dies here is repeated whole."""
        for bucket, batch in held.items():
            if still.get(bucket) != batch:
                remove(self.spark, f"{self._batch(batch)}/{_BUCKET}={bucket}")
        remove(self.spark, f"{self.folder}/version-{old}")
