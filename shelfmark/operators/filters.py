"""Row filters and per-row classification over the catalog and source items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.numbers import truthy

SEARCHED = ("title", "artist", "album", "album_artist", "genre", "year", "rel_path")

ISSUES = {
    "no_art": "has_artwork",
    "no_lyrics": "has_lyrics",
    "no_album": "album",
    "no_year": "year",
    "no_genre": "genre",
    "no_track_no": "track_number",
}


def haystack(columns=SEARCHED) -> Column:
    """Searchable text of a row: non-empty values joined by blanks, lower-cased."""
    return F.lower(F.concat_ws(" ", *[F.when(truthy(F.col(c)), F.col(c).cast("string")) for c in columns]))


def search_catalog(df: DataFrame, q: str) -> DataFrame:
    """Rows whose text contains every term of ``q``."""
    hay = haystack()
    return reduce(lambda d, term: d.where(hay.contains(term)), q.lower().split(), df)


def filter_quality(df: DataFrame, tier: str) -> DataFrame:
    lossless = F.coalesce(F.col("lossless"), F.lit(False))
    rate = F.coalesce(F.col("bitrate"), F.lit(0))
    if tier == "lossless":
        return df.where(lossless)
    if tier == "high":
        return df.where(lossless | (rate >= fv.HIGH_BITRATE))
    if tier == "low":
        return df.where(~lossless & (rate < fv.LOW_BITRATE))
    return df


def issue_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({name: ~truthy(F.col(c)) for name, c in ISSUES.items()})


def filter_missing_metadata(df: DataFrame, issues: list[str]) -> DataFrame:
    """Rows that have every one of the named issues."""
    return reduce(lambda d, i: d.where(~truthy(F.col(ISSUES[i]))), issues, df)


def artist_facet_value() -> Column:
    return F.coalesce(F.col("album_artist"), F.col("artist"))


def filter_facets(
    df: DataFrame, artist: str | None = None, album: str | None = None, formats: list[str] | None = None
) -> DataFrame:
    """Case-sensitive equality on artist and album, membership on format; empty means no restriction."""
    if artist:
        df = df.where(artist_facet_value() == artist)
    if album:
        df = df.where(F.col("album") == album)
    if formats:
        df = df.where(F.coalesce(F.col("format"), F.lit("")).isin(*formats))
    return df


def item_class() -> Column:
    state = F.col("state")
    return (
        F.when(~F.col("present"), "removed")
        .when(F.col("ignored"), "ignored")
        .when(state.isin("done", "library", "skipped"), "have")
        .when(state.isin("queued", *fv.ACTIVE_STATUSES), "pipeline")
        .otherwise("missing")
    )


def classify_items(items: DataFrame, only: str | None = None, q: str | None = None) -> DataFrame:
    """Adds ``class``; optionally keeps one class and rows whose title, artist or album contain ``q``."""
    out = items.withColumn("class", item_class())
    if only and only != "all":
        out = out.where(F.col("class") == only)
    if q:
        hits = [F.lower(F.coalesce(F.col(c), F.lit(""))).contains(q.lower()) for c in ("title", "artist", "album")]
        out = out.where(reduce(lambda a, b: a | b, hits))
    return out


def flag_match_confidence(
    df: DataFrame, low: float = fv.CONFIDENCE_LOW, reject: float = fv.CONFIDENCE_REJECT
) -> DataFrame:
    """``flag`` from the score, plus ``lossy_origin`` for a lossless container with a lossy source."""
    score = F.col("score")
    return df.withColumns(
        {
            "flag": F.when(score < reject, "fail").when(score < low, "check").otherwise("match"),
            "lossy_origin": F.coalesce(
                (F.col("container") == "flac") & ~F.col("lossless_origin"), F.lit(False)
            ),
        }
    )
