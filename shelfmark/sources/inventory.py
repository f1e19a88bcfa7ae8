"""File inventories and catalog snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import text as T
from ..functions.numbers import positive_int
from ..operators.ordering import default_listing_order
from ..plans.durable import new_folder
from ..plans.skew import number_rows
from ..plans.versions import VersionedTable, key_bucket


def scan_file_inventory(spark: SparkSession, root: str, exts: tuple[str, ...] = fv.AUDIO_EXTENSIONS) -> DataFrame:
    """(path, size, mtime_ms) of files below ``root`` with one of the extensions; hidden names skipped.
    Only the listing is read: the content column is pruned."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    below = F.substr(F.regexp_replace("path", r"^[a-z]+:/*", "/"), F.lit(len(root.rstrip("/")) + 1))
    visible = ~below.rlike(r"/\.")
    wanted = F.lower(F.regexp_extract(name, r"\.([^.]+)\z", 1)).isin(*exts)
    return files.where(wanted & visible).select(
        "path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms")
    )


def index_catalog_rows(raw: DataFrame, root: str = "") -> DataFrame:
    """Typed catalog rows from tag structs.

    ``raw``: path, size, mtime_ms, ok, tags struct<title, artist array, album, album_artist, track,
    total_tracks, disc, year, genre array, isrc>, props struct<codec, lossless, bitrate, sample_rate,
    bits_per_sample, duration_ms>, has_cover, lyrics. Unreadable rows keep what the name suggests.
    """
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*\z", "")
    guess_artist, guess_title = T.split_title(stem, F.lit(None).cast("string"))
    ok = F.coalesce(F.col("ok"), F.lit(False))
    tag = lambda c: F.when(ok, F.col(f"tags.{c}"))
    text = lambda c: T.blank_to_null(tag(c))
    listed = lambda c, sep: F.when(ok & (F.size(f"tags.{c}") > 0), F.array_join(F.col(f"tags.{c}"), sep))
    prop = lambda c: F.when(ok, F.col(f"props.{c}"))
    title = F.coalesce(text("title"), guess_title)
    artist = F.coalesce(listed("artist", ", "), guess_artist)
    key_artist = F.coalesce(F.when(ok, F.try_element_at(F.col("tags.artist"), F.lit(1))), artist)
    rel = F.when(F.col("path").startswith(root), F.substr("path", F.lit(len(root) + 1))).otherwise(F.col("path"))
    number = lambda c: positive_int(c)
    return raw.select(
        "path", rel.alias("rel_path"), "size", "mtime_ms",
        F.lower(F.regexp_extract(name, r".\.([^.]*)\z", 1)).alias("format"),
        prop("codec").alias("codec"), prop("lossless").alias("lossless"),
        number(prop("bitrate")).alias("bitrate"), number(prop("sample_rate")).alias("sample_rate"),
        number(prop("bits_per_sample")).alias("bits_per_sample"), number(prop("duration_ms")).alias("duration_ms"),
        title.alias("title"), artist.alias("artist"), text("album").alias("album"), text("album_artist").alias("album_artist"),
        number(tag("track")).alias("track_number"), number(tag("total_tracks")).alias("track_total"),
        number(tag("disc")).alias("disc_number"), number(tag("year")).alias("year"),
        listed("genre", "; ").alias("genre"), text("isrc").alias("isrc"),
        (ok & F.coalesce("has_cover", F.lit(False))).alias("has_artwork"),
        (ok & F.coalesce(F.trim("lyrics") != "", F.lit(False))).alias("has_lyrics"),
        T.match_key(key_artist, title).alias("match_key"),
    )


def merge_upsert_invalidate(index: DataFrame, changes: DataFrame, gone: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """The next snapshot: changed rows replace their tags and lose every derived column, unchanged rows
    keep both, new rows get an id, vanished ones go. One full outer join on the path.

    ``changes`` holds path plus the columns to set; ``gone`` holds path. Text ids of new rows are random, numbers follow the largest id of the
    index in order of path. Where ``index`` is a part of the index, ``whole`` is all of it.
    """
    own = [c for c in changes.columns if c != "path"]
    new = changes.select("path", F.lit(True).alias("_new"), *[F.col(c).alias(f"_n_{c}") for c in own])
    left = index.join(gone.select("path"), "path", "left_anti").withColumn("_old", F.lit(True))
    both = left.join(new, "path", "full_outer")
    fresh = F.coalesce(F.col("_new"), F.lit(False))
    cols: list[Column] = []
    for c in index.columns:
        if c == "path":
            cols.append(F.col("path"))
        elif c == "id":
            cols.append(F.coalesce("id", F.uuid()).alias("id") if _text_ids(index) else F.col("id"))
        elif c in own:
            cols.append(F.when(fresh, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c))
        elif c in fv.DERIVED_COLUMNS:
            cols.append(F.when(~fresh, F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    merged = both.select(*cols)
    return merged if "id" not in index.columns or _text_ids(index) else _with_numbers(merged, whole or index)


def _text_ids(index: DataFrame) -> bool:
    return index.schema["id"].dataType.simpleString() == "string"


def _with_numbers(merged: DataFrame, index: DataFrame) -> DataFrame:
    """Rows without an id numbered from the largest id of the index on."""
    new = number_rows(merged.where("id is null").drop("id"), [], ["path"], "_n").withColumn("_k", F.lit(1))
    top = index.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top")).withColumn("_k", F.lit(1))  # a single row
    made = (F.col("_top") + F.col("_n")).cast(index.schema["id"].dataType)
    numbered = new.join(F.broadcast(top), "_k").withColumn("id", made)
    return merged.where("id is not null").unionByName(numbered.select(*merged.columns))


def write_snapshot(df: DataFrame, folder: str | None = None) -> str:
    """Write a new snapshot directory and return it. The input snapshot is never overwritten."""
    path = folder or new_folder(df.sparkSession, "snapshot")
    df.write.mode("errorifexists").parquet(path)
    return path


def bucketed_index(spark: SparkSession, folder: str) -> VersionedTable:
    """The index kept in buckets of paths below ``folder``."""
    return VersionedTable(spark, folder, key_bucket("path"))


def create_index(index: DataFrame, folder: str) -> DataFrame:
    """The first version of a bucketed index."""
    kept = bucketed_index(index.sparkSession, folder)
    if kept.newest():
        raise ValueError(f"{folder} holds an index already")
    kept.advance(0, index, lambda known: index)
    return _newest(kept, index)


def upsert_index(spark: SparkSession, folder: str, changes: DataFrame, gone: DataFrame) -> DataFrame:
    """``merge_upsert_invalidate`` on a bucketed index: only buckets with a changed or vanished path are read and written again,
    but for the largest id. Empty changes leave every bucket as it is. The version before stays readable."""
    kept = bucketed_index(spark, folder)
    last = kept.newest()[0]
    whole = kept.table(last)
    if whole is None:
        raise ValueError("an index without rows has no columns to merge into; create it from rows")
    named = changes.select("path").unionByName(gone.select("path"))
    kept.advance(
        last + 1, named, lambda known: merge_upsert_invalidate(whole.limit(0) if known is None else known, changes, gone, whole)
    )
    return _newest(kept, whole)


def _newest(kept: VersionedTable, like: DataFrame) -> DataFrame:
    table = kept.table(kept.newest()[0])
    return like.limit(0) if table is None else table


def catalog_projection(lib: DataFrame) -> DataFrame:
    """The 22 listing columns in their fixed order; columns the catalog lacks are null."""
    have = set(lib.columns)
    return lib.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in fv.CATALOG_COLUMNS])


def export_catalog_columns(lib: DataFrame, path: str) -> None:
    """Gzipped JSON lines in listing order, range-sorted so that the files concatenate in order."""
    order = [k.on(k.value) for k in default_listing_order()]
    catalog_projection(lib).orderBy(*order).write.option("compression", "gzip").option("ignoreNullFields", "false").json(path)


def append_change_log(ops: DataFrame, path: str) -> None:
    """Append operations (kind, from_path, to_path, detail, at) to the log, one folder per kind."""
    ops.write.mode("append").partitionBy("kind").parquet(path)
