"""Facets, counters and grouped summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import text as T
from ..functions.numbers import half_up
from ..plans.skew import SortKey, number_rows, spread_join, top_n
from .filters import artist_facet_value, item_class


def library_totals(df: DataFrame) -> DataFrame:
    ms = F.coalesce(F.sum("duration_ms"), F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        ms.alias("total_ms"),
        (ms / 3_600_000.0).alias("hours"),
    )


def artist_facet(df: DataFrame, q: str = "") -> DataFrame:
    """Files per artist, optionally only artists containing ``q``, in base-letter order."""
    who = F.coalesce(artist_facet_value(), F.lit("Unknown"))
    out = df.groupBy(who.alias("artist")).agg(F.count(F.lit(1)).alias("files"))
    if q:
        out = out.where(F.lower("artist").contains(q.lower()))
    return out.orderBy(T.collated_key(F.col("artist")), "artist")


def format_facet(df: DataFrame) -> DataFrame:
    return df.where(F.col("format") != "").select("format").distinct().orderBy("format")


def album_columns() -> dict[str, Column]:
    return {
        "album_key": F.coalesce(F.col("album"), F.lit("(no album)")),
        "artist_key": F.coalesce(artist_facet_value(), F.lit("Unknown")),
    }


def album_rollup(df: DataFrame, order: list[Column]) -> DataFrame:
    """One row per album: size, year of its first row and first cover in the given order.

    First-of-group values are ``min_by`` aggregates, combined before the shuffle; the member rows stay
    in long form (``album_tracks``) so that an album of any size never becomes one array.
    """
    spot = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    cols = df.withColumns(album_columns()).withColumn("_spot", spot)
    cover_spot = F.when(F.col("has_artwork"), F.col("_spot"))
    return cols.groupBy("artist_key", "album_key").agg(
        F.count(F.lit(1)).alias("tracks"),
        F.min_by("year", "_spot").alias("year"),
        F.min_by(F.when(F.col("has_artwork"), F.col("id")), cover_spot).alias("cover_id"),
    )


def album_tracks(df: DataFrame, order: list[SortKey | Column | str]) -> DataFrame:
    """Member rows of ``album_rollup`` with their place in the album."""
    return number_rows(df.withColumns(album_columns()), ["artist_key", "album_key"], order, "place")


def status_counts(tracks: DataFrame, now: Column) -> DataFrame:
    """One row: rows per state and rows done since midnight of ``now``."""
    s = F.col("status")
    return tracks.agg(
        F.count_if(s == "queued").alias("queued"),
        F.count_if(s.isin(*fv.ACTIVE_STATUSES)).alias("active"),
        F.count_if(s == "done").alias("done"),
        F.count_if(s == "failed").alias("failed"),
        F.count_if(s == "skipped").alias("skipped"),
        F.count_if((s == "done") & (F.col("finished_at") >= F.date_trunc("day", now))).alias("done_today"),
    )


def source_coverage(sources: DataFrame, items: DataFrame) -> DataFrame:
    """Per source over present items: total, have and missing. Failed is neither."""
    state = F.col("state")
    per = (
        items.where("present")
        .groupBy("source_id")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(state.isin("done", "library", "skipped")).alias("have"),
            F.count_if(state.isin("new", "cancelled") & ~F.col("ignored")).alias("missing"),
        )
    )
    zero = F.lit(0).cast("bigint")
    return sources.join(per, "source_id", "left").select(
        sources["*"], *[F.coalesce(c, zero).alias(c) for c in ("total", "have", "missing")]
    )


def item_class_counts(items: DataFrame) -> DataFrame:
    return (
        items.withColumn("class", item_class())
        .rollup("class")
        .agg(F.count(F.lit(1)).alias("items"))
        .select(F.coalesce("class", F.lit("all")).alias("class"), "items")
    )


def rejection_histogram(evaluated: DataFrame) -> DataFrame:
    """Rows per (target, verdict) with the target's looked-at total; accepted rows count as looked at.

    Two-step: verdict counts combine before the shuffle, totals come from those few rows.
    """
    per = evaluated.groupBy("target_id", "verdict").agg(F.count(F.lit(1)).alias("files"))
    whole = Window.partitionBy("target_id")  # a handful of verdict rows per target
    return per.withColumn("looked_at", F.sum("files").over(whole)).where(F.col("verdict") != "accepted")


def describe_rejections(histogram: DataFrame) -> DataFrame:
    """One line per target: busy first, then reasons by count."""
    one = F.struct(
        (F.col("verdict") != "busy").alias("late"),
        (-F.col("files")).alias("neg"),
        F.concat_ws(
            " ", F.col("files").cast("string"),
            F.when(F.col("verdict") == "busy", "on busy peers").otherwise(F.col("verdict")),
        ).alias("line"),
    )
    lines = F.array_sort(F.collect_list(one))  # at most one entry per verdict
    return histogram.groupBy("target_id").agg(
        F.first("looked_at").alias("looked_at"),
        F.array_join(F.transform(lines, lambda x: x["line"]), ", ").alias("report"),
    )


# ---- shared files by folder --------------------------------------------------------------------


def file_parts(file: Column) -> dict[str, Column]:
    """name, ext, dir and folders of a path with slashes or backslashes."""
    parts = F.filter(F.split(file, r"[\\/]+"), lambda p: p != "")
    name = F.coalesce(F.try_element_at(parts, F.lit(-1)), file)
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return {
        "name": name,
        "ext": F.lower(F.regexp_extract(name, r"(?s)^.+\.([^.]*)\z", 1)),
        "dir": F.array_join(folders, "\\"),
        "folders": folders,
    }


def folder_files(hits: DataFrame, wanted: str = "any") -> DataFrame:
    """Distinct audio hits of the wanted format with their folder columns."""
    kinds = {"any": fv.HIT_AUDIO_FORMATS, "lossless": fv.LOSSLESS_HIT_FORMATS, "flac": ("flac",)}[wanted]
    parts = file_parts(F.col("file"))
    return (
        top_n(hits.withColumn("_ext", parts["ext"]).where(F.col("_ext").isin(*kinds)), ["user_name", "file"], [F.col("hit_id")])
        .drop("_ext")
        .withColumns(
            {
                "name": parts["name"],
                "ext": parts["ext"],
                "dir": parts["dir"],
                "label": F.coalesce(
                    T.blank_to_null(F.array_join(F.slice(parts["folders"], F.greatest(F.size(parts["folders"]) - 1, F.lit(1)), F.lit(2)), " / ")),
                    F.lit("(root)"),
                ),
            }
        )
        .withColumn("file_lossless", F.col("ext").isin(*fv.LOSSLESS_HIT_FORMATS))
    )


def folder_rollup(files: DataFrame) -> DataFrame:
    """Files of ``folder_files`` grouped by (user, folder); peer state is that of the first hit."""
    first = lambda c: F.min_by(c, "hit_id").alias(c)
    return files.groupBy("user_name", "dir").agg(
        F.min("label").alias("label"),
        F.bool_and("file_lossless").alias("lossless"),
        F.sum("size").alias("total_size"),
        F.count(F.lit(1)).alias("files"),
        first("slots"), first("speed"), first("queue_length"),
    )


def folder_listing(files: DataFrame) -> DataFrame:
    """Files of each folder in natural name order."""
    return number_rows(files, ["user_name", "dir"], [T.natural_key(F.col("name")), "name", "hit_id"], "place")


# ---- value statistics --------------------------------------------------------------------------


def weighted_mode(df: DataFrame, keys: list[str], col: str, n: str | None = None, tie: Column | None = None) -> DataFrame:
    """Per key the non-empty value most rows carry; ties go to the smallest value."""
    weight = F.col(n) if n else F.lit(1)
    per = df.where(F.col(col).isNotNull() & (F.col(col).cast("string") != "")).groupBy(*keys, col).agg(F.sum(weight).alias("_n"))
    return top_n(per, keys, [F.col("_n").desc(), F.col(col)]).select(*keys, col, F.col("_n").alias("votes"))


def column_coverage(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"), *[F.count(c).alias(f"with_{c}") for c in cols])


def common_or_mixed(df: DataFrame, fields: list[str]) -> DataFrame:
    """Per field the single common value over all rows, or mixed. Min and max settle it in one pass."""
    text = {f: F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields}
    bounds = df.agg(*[F.struct(F.min(t).alias("lo"), F.max(t).alias("hi")).alias(f) for f, t in text.items()])
    return (
        bounds.unpivot([], fields, "field", "b")
        .select(
            "field",
            F.when(F.col("b.lo") == F.col("b.hi"), F.col("b.lo")).alias("value"),
            (F.col("b.lo") != F.col("b.hi")).alias("mixed"),
        )
    )


# ---- series ------------------------------------------------------------------------------------


def series_peaks(
    series: DataFrame, buckets: int = fv.SERIES_BUCKETS, scale: float = fv.SERIES_SCALE
) -> DataFrame:
    """(series_id, bucket, peak): loudest point per bucket on 0..255; points past the last bucket are
    ignored and empty buckets are 0. Expects ``idx`` from 1."""
    sizes = series.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    width = F.greatest(F.lit(1), F.floor(F.col("points") / buckets)).cast("bigint")
    points = spread_join(
        series, sizes.select("series_id", F.col("n").alias("points")), ["series_id"], counts=sizes
    )
    filled = (
        points.withColumn("bucket", F.floor((F.col("idx") - 1) / width).cast("int"))
        .where(F.col("bucket") < buckets)
        .groupBy("series_id", "bucket")
        .agg(F.max(F.abs("value")).alias("top"))
    )
    grid = sizes.select("series_id", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    peak = half_up(F.coalesce(F.col("top"), F.lit(0.0)) / scale * 255).cast("int")
    return grid.join(filled, ["series_id", "bucket"], "left").select("series_id", "bucket", peak.alias("peak"))


def series_level(series: DataFrame, scale: float = fv.SERIES_SCALE) -> DataFrame:
    """RMS level of each series in dB, one decimal; -70 when silent."""
    v = F.col("value").cast("double")
    rms = F.sqrt(F.avg(v * v)) / scale
    return (
        series.groupBy("series_id")
        .agg(rms.alias("rms"))
        .select(
            "series_id",
            F.when(F.col("rms") > 0, half_up(20 * F.log10("rms") * 10) / 10)
            .otherwise(F.lit(fv.SILENCE_LEVEL))
            .alias("level"),
        )
    )


def gain_plan(peaks: DataFrame, levels: DataFrame) -> DataFrame:
    """Playback gain per series: toward -18 dB, never below -12 nor above the peak headroom or +6."""
    top = peaks.groupBy("series_id").agg(F.greatest(F.max("peak"), F.lit(1)).alias("peak"))
    headroom = F.greatest(F.lit(0.0), -20 * F.log10(F.col("peak") / 255.0) - 1)
    wanted = F.lit(fv.TARGET_LEVEL) - F.col("level")
    gain = F.greatest(F.lit(-12.0), F.least(wanted, headroom, F.lit(6.0)))
    return levels.join(top, "series_id").select("series_id", gain.alias("gain_db"))


# ---- votes and outcomes ------------------------------------------------------------------------


def genre_vote(votes: DataFrame, max_genres: int = 3, parents: DataFrame | None = None) -> DataFrame:
    """Top genres per entity: at least a quarter of the top vote, no generic name when a kept one
    ends in it, best ``max_genres``, title-cased. ``parents`` (entity -> parent) supplies a fallback.

    A name is generic when some longer kept name ends in " name" or "-name", so each kept name is
    expanded to its own suffixes and those are removed by an anti join: no pairs within an entity.
    """
    named = votes.groupBy("entity", F.lower("name").alias("name")).agg(F.max("votes").alias("votes"))
    top = named.groupBy("entity").agg(F.max("votes").alias("top"), F.count(F.lit(1)).alias("n"))
    strong = spread_join(named, top.drop("n"), ["entity"], counts=top.select("entity", "n")).where(
        F.col("votes") >= F.greatest(F.lit(1.0), F.col("top") * 0.25)
    )
    cut = F.sequence(F.lit(2), F.length("name"))
    suffixes = strong.where(F.col("name").rlike("[ -]")).select(
        "entity",
        F.explode(
            F.transform(
                F.filter(cut, lambda i: F.substr("name", i - 1, F.lit(1)).isin(" ", "-")),
                lambda i: F.substr("name", i),
            )
        ).alias("name"),
    )
    specific = strong.join(suffixes.distinct(), ["entity", "name"], "left_anti")
    best = top_n(specific, ["entity"], [F.col("votes").desc(), F.col("name")], max_genres, "place")
    out = best.select("entity", "place", T.title_case(F.col("name")).alias("genre"), "votes")
    if parents is None:
        return out
    lacking = parents.join(out.select("entity").distinct(), "entity", "left_anti")
    inherited = lacking.join(out.withColumnRenamed("entity", "parent"), "parent").select(out.columns)
    return out.unionByName(inherited)


def best_score_per_key(hits: DataFrame, n: int, at_least: float = 0.5) -> DataFrame:
    """Per query and recording the highest score; best ``n`` recordings by score, then source count."""
    best = top_n(hits, ["query_id", "recording_id"], [F.col("score").desc(), F.col("sources").desc()])
    ranked = best.where(F.col("score") >= at_least)
    return top_n(
        ranked, ["query_id"], [F.col("score").desc(), F.col("sources").desc(), F.col("recording_id")], n, "place"
    )


def outcome_summary(results: DataFrame, shown: int = 5) -> DataFrame:
    """Per job: matched, unmatched, total, and the first names that found no match."""
    per = results.groupBy("job_id").agg(
        F.count_if("matched").alias("matched"),
        F.count_if(~F.col("matched")).alias("unmatched"),
        F.count(F.lit(1)).alias("total"),
    )
    names = (
        top_n(results.where(~F.col("matched")), ["job_id"], [F.col("seq")], shown, "_place")
        .groupBy("job_id")
        .agg(F.array_sort(F.collect_list(F.struct("_place", "name"))).alias("_names"))  # at most `shown`
    )
    rest = F.col("unmatched") - shown
    text = F.array_join(F.transform("_names", lambda x: x["name"]), ", ")
    return per.join(names, "job_id", "left").select(
        "job_id", "matched", "unmatched", "total",
        F.when(rest > 0, F.concat(text, F.lit(" and "), rest.cast("string"), F.lit(" more")))
        .otherwise(F.coalesce(text, F.lit(""))).alias("unmatched_names"),
    )


