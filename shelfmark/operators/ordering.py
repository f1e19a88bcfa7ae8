"""Rankings, sorts, limits and queue positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import text as T
from ..functions.numbers import half_up, truthy
from ..plans.durable import keep
from ..plans.skew import SortKey, number_rows, spread_join, top_n

TEXT_KEYS = ("title", "artist", "album", "genre", "format")


def quality_score() -> Column:
    """Lossless first (by depth and rate), then bitrate weighted by codec efficiency."""
    eff = F.lit(1.0)
    codec = F.lower(F.coalesce(F.col("codec"), F.col("format"), F.lit("")))
    for name, f in fv.CODEC_EFFICIENCY.items():
        eff = F.when(codec == name, F.lit(f)).otherwise(eff)
    hi = (
        100_000.0
        + F.coalesce(F.col("bits_per_sample"), F.lit(16)) * 1000.0
        + F.coalesce(F.col("sample_rate"), F.lit(44100)) / 100.0
    )
    lossy = F.coalesce(F.col("bitrate"), F.lit(0)) * eff
    return F.when(F.coalesce(F.col("lossless"), F.lit(False)), hi).otherwise(lossy).cast("double")


def completeness_score() -> Column:
    present = [
        F.coalesce((F.col(c).cast("string") != "").cast("int"), F.lit(0))
        for c in ("title", "artist", "album", "album_artist", "year", "track_number", "genre")
    ]
    total = F.lit(0)
    for p in present:
        total = total + p
    flag = lambda c, n: F.when(F.coalesce(F.col(c), F.lit(False)), n).otherwise(0)
    recording = F.when(F.coalesce(F.col("mb_recording_id") != "", F.lit(False)), 1).otherwise(0)
    return total + flag("has_artwork", 2) + flag("has_lyrics", 1) + recording


def is_copy_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1).rlike(fv.COPY_NAME)


def keeper_columns(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "quality": quality_score(),
            "completeness": completeness_score(),
            "copy_named": is_copy_name(F.col("rel_path")),
        }
    )


def keeper_order() -> Column:
    """Smallest is the keeper: better sound, fuller tags, no copy name, own download, oldest."""
    return F.struct(
        (-F.col("quality")).alias("q"),
        (-F.col("completeness")).alias("c"),
        F.col("copy_named").cast("int").alias("n"),
        (1 - F.coalesce(F.col("from_pipeline"), F.lit(False)).cast("int")).alias("p"),
        F.col("added_at").alias("t"),
        F.col("id").alias("id"),
    )


def pick_keeper(members: DataFrame, group: str = "component") -> DataFrame:
    """(group, keeper_id): an aggregate, so groups of any size combine before the shuffle."""
    return (
        keeper_columns(members)
        .withColumn("_order", keeper_order())
        .groupBy(group)
        .agg(F.min("_order").alias("_best"))
        .select(group, F.col("_best.id").alias("keeper_id"))
    )


def rank_candidates(scored: DataFrame, n: int = 6) -> DataFrame:
    """Top ``n`` considered rows per target with their place; place 1 is the match."""
    return top_n(scored, ["target_id"], [F.col("score").desc(), F.col("cand_id")], n, "place")


def listing_positions(listing: DataFrame, existing: DataFrame, partial: bool) -> DataFrame:
    """Position of each listed item: the provider's for a full listing. For a partial one the known
    position, else the source's highest position plus the count of distinct items seen so far."""
    first = top_n(listing, ["source_id", "external_id"], [F.col("position")])
    if not partial:
        return first
    counted = number_rows(first, ["source_id"], ["position", "external_id"], "_seen")
    top = existing.groupBy("source_id").agg(F.max("position").alias("_top"))
    known = existing.select("source_id", "external_id", F.col("position").alias("_known"))
    joined = spread_join(counted, top, ["source_id"], "left").join(known, ["source_id", "external_id"], "left")
    base = F.greatest(F.coalesce(F.col("_top"), F.lit(0)), F.lit(0))
    return joined.withColumn("position", F.coalesce("_known", base + F.col("_seen"))).select(listing.columns)


EXT_OF_PATH = r"(\.[^./]*)\z"
NUMBERED_PATH = r"^(.*) \(([2-9]|[1-9]\d+)\)((?:\.[^./]*)?)\z"


def resolve_path_collisions(plan: DataFrame, existing: DataFrame) -> DataFrame:
    """Give every changed row a free path: the first taker keeps the name, later ones get " (2)", " (3)".

    ``plan``: id, from_path, to_path, changed. ``existing``: path of files on disk. The k-th taker of a
    name gets its k-th free number: takers and the numbers already in use are merged in one numbered
    list per name, and the place in that list is the number. A generated name that another row also
    claims stays with the smallest id; only the losers go round again, against the names settled so far. Every round settles at least one
    row of each claimed name, so the rounds end.
    """
    taken = existing.select("path").unionByName(plan.where("not changed").select(F.col("to_path").alias("path")))
    movers = plan.where("changed").select("id", "from_path", "to_path")
    settled = plan.where("not changed").select("id", "from_path", "to_path", F.lit(False).alias("changed"))
    while True:
        checked = keep(_claim_names(movers, taken.distinct()), "paths")
        good = checked.where("_mine")
        settled = settled.unionByName(good.select("id", "from_path", F.col("path").alias("to_path"), F.lit(True).alias("changed")))
        movers = checked.where("not _mine").select("id", "from_path", "to_path")
        if movers.isEmpty():
            return settled
        taken = taken.unionByName(good.select("path"))


def _claim_names(movers: DataFrame, taken: DataFrame) -> DataFrame:
    """One round: number the takers of each name past the numbers in use, then check for double claims."""
    numbered = F.regexp_extract("path", NUMBERED_PATH, 2)
    used = taken.select(F.col("path").alias("to_path"), F.lit(1).cast("bigint").alias("_n")).unionByName(
        taken.where(F.col("path").rlike(NUMBERED_PATH)).select(
            F.concat(F.regexp_extract("path", NUMBERED_PATH, 1), F.regexp_extract("path", NUMBERED_PATH, 3)).alias("to_path"),
            numbered.try_cast("bigint").alias("_n"),
        ).where("_n is not null")  # a number beyond 64 bits is no slot that a file could get
    )
    used = used.join(movers.select("to_path").distinct(), "to_path", "left_semi")
    used = number_rows(used, ["to_path"], ["_n"], "_j").select(
        "to_path", (F.col("_n") - F.col("_j") + 1).alias("_spot"), F.lit(0).alias("_kind"), F.lit(None).cast("bigint").alias("id"),
        F.lit(None).cast("string").alias("from_path"),
    )
    takers = number_rows(movers, ["to_path"], ["id"], "_spot").select(
        "to_path", "_spot", F.lit(1).alias("_kind"), "id", "from_path"
    )
    merged = number_rows(takers.unionByName(used), ["to_path"], ["_spot", "_kind", "id"], "_n").where("_kind = 1")
    ext = F.regexp_extract("to_path", EXT_OF_PATH, 1)
    stem = F.substr("to_path", F.lit(1), F.length("to_path") - F.length(ext))
    path = F.when(F.col("_n") == 1, F.col("to_path")).otherwise(
        F.concat(stem, F.lit(" ("), F.col("_n").cast("string"), F.lit(")"), ext)
    )
    named = merged.select("id", "from_path", "to_path", path.alias("path"))
    owner = named.groupBy("path").agg(F.min("id").alias("_owner"))
    return named.join(owner, "path").select("id", "from_path", "to_path", "path", (F.col("_owner") == F.col("id")).alias("_mine"))


def auto_number(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return number_rows(df, keys, order, "track_number", "track_total")


def reorder_midpoint(queue: DataFrame, moves: DataFrame) -> DataFrame:
    """New position of moved rows: halfway between the row they go before and that row's predecessor
    (2 below it when first); last + 1 when ``before_id`` is null. Priority falls back to 0.

    ``moves``: id, before_id. The moved row itself does not count as a predecessor, so the two rows
    ahead of the anchor are looked up.
    """
    lined = number_rows(
        queue.where("status = 'queued'").select("id", "priority", "position"),
        [],
        [SortKey(F.col("priority"), "desc_nulls_last"), "position", "id"],
        "_at",
    )
    spot = lined.select(F.col("_at"), F.col("id").alias("_id"), F.col("position").alias("_pos"))
    last = lined.agg(F.max_by(F.struct("id", "position"), "_at").alias("_last"), F.max("_at").alias("_end"))
    before_last = spot.join(last, F.col("_at") == F.col("_end") - 1).select(F.col("_pos").alias("_last2"))
    anchored = (
        moves.where("before_id is not null and before_id <> id")
        .join(spot.select(F.col("_id").alias("before_id"), F.col("_at").alias("_anchor"), F.col("_pos").alias("_after")), "before_id")
        .join(spot.select((F.col("_at") + 1).alias("_anchor"), F.col("_id").alias("_p1"), F.col("_pos").alias("_v1")), "_anchor", "left")
        .join(spot.select((F.col("_at") + 2).alias("_anchor"), F.col("_pos").alias("_v2")), "_anchor", "left")
    )
    own_gap = F.col("_p1").eqNullSafe(F.col("id"))
    ahead = F.coalesce(F.when(own_gap, F.col("_v2")).otherwise(F.col("_v1")), F.col("_after") - 2)
    moved = anchored.select("id", "before_id", ((ahead + F.col("_after")) / 2).alias("position"))
    # the end of the queue is one row, joined on a constant key
    tail = last.withColumn("_k", F.lit(1)).join(before_last.withColumn("_k", F.lit(1)), "_k", "left")
    to_end = (
        moves.where("before_id is null")
        .withColumn("_k", F.lit(1))
        .join(F.broadcast(tail), "_k")
        .select(
            "id", "before_id",
            (F.when(F.col("_last.id") == F.col("id"), F.col("_last2")).otherwise(F.col("_last.position")) + 1).alias("position"),
        )
    )
    return moved.unionByName(to_end).withColumn("priority", F.lit(0))


def sort_keys(specs: list[tuple[str, str]]) -> list[SortKey]:
    """Sort keys for catalog listings: empty values last in both directions, text by base letter with
    numbers as numbers; after ``album`` ties fall back to disc (1) and track (0)."""
    keys: list[SortKey] = []
    for name, direction in specs:
        c = F.col(name)
        value = T.collated_key(T.blank_to_null(c)) if name in TEXT_KEYS else c
        keys.append(SortKey(value, f"{direction}_nulls_last"))
        if name == "album":
            named = F.coalesce(F.col("album"), F.lit("")) != ""
            keys.append(SortKey(F.when(named, F.coalesce(F.col("disc_number"), F.lit(1)))))
            keys.append(SortKey(F.when(named, F.coalesce(F.col("track_number"), F.lit(0)))))
    return [*keys, SortKey(F.col("id"))]


def sort_catalog(df: DataFrame, specs: list[tuple[str, str]]) -> DataFrame:
    return df.orderBy(*[k.on(k.value) for k in sort_keys(specs)])


def default_listing_order() -> list[SortKey]:
    return [SortKey(F.col(c)) for c in ("album_artist", "album", "disc_number", "track_number", "id")]


def queue_views(
    tracks: DataFrame, now: Column, open_rows_shown: int = fv.OPEN_ROWS, finished_rows_shown: int = fv.FINISHED_ROWS
) -> dict[str, DataFrame]:
    """The three queue listings: open, finished, and the one row to claim next."""
    open_rows = tracks.where(~F.col("status").isin(*fv.FINISHED_STATUSES))
    finished = tracks.where(F.col("status").isin(*fv.FINISHED_STATUSES))
    due = tracks.where((F.col("status") == "queued") & (F.col("retry_at").isNull() | (F.col("retry_at") <= now)))
    by_queue = [F.col("priority").desc(), F.col("position"), F.col("id")]
    return {
        "open": open_rows.orderBy(*by_queue).limit(open_rows_shown),
        "finished": finished.orderBy(F.col("finished_at").desc(), F.col("id")).limit(finished_rows_shown),
        "next": due.orderBy(*by_queue).limit(1),
    }


def rank_lossless_picks(accepted: DataFrame, prefer_hires: bool = False, n: int | None = None) -> DataFrame:
    """Order accepted hits per target; ``n`` keeps only the first few."""
    order = [F.col("preferred").cast("int"), half_up(F.col("score") * 20)]
    hires = F.col("hi_res").cast("int")
    if prefer_hires:
        order.append(hires)
    order += [F.col("evidence_count"), F.col("slots").cast("int"), -hires]
    keys = [-o for o in order] + [F.col("queue_length"), -F.col("speed"), F.col("hit_id")]
    if n is not None:
        return top_n(accepted, ["target_id"], keys, n, "place")
    return number_rows(accepted, ["target_id"], keys, "place")


def group_weight() -> Column:
    return F.when(F.col("exact"), 3).when(F.col("acoustic"), 2).otherwise(1)


def rank_groups(groups: DataFrame) -> DataFrame:
    """Place of each duplicate group: exact, then acoustic, then metadata; artists from z to a."""
    weighted = groups.withColumn("weight", group_weight())
    return number_rows(
        weighted,
        [],
        [
            SortKey(F.col("weight"), "desc_nulls_last"),
            SortKey(T.collated_key(F.coalesce("first_artist", F.lit(""))), "desc_nulls_last"),
            "component",
        ],
        "place",
    )


def rank_folders(folders: DataFrame, n: int = 150) -> DataFrame:
    return folders.orderBy(
        F.col("slots").desc(), F.col("lossless").desc(), "queue_length", F.col("speed").desc(), "user_name", "dir"
    ).limit(n)


def due_sources(sources: DataFrame, now: Column) -> DataFrame:
    due = F.col("enabled") & (F.col("interval_minutes") > 0) & (F.col("next_check_at") <= now)
    return sources.where(due).orderBy("next_check_at", "id")


def pending_batch(lib: DataFrame, col: str, n: int) -> DataFrame:
    return lib.where(F.col(col).isNull()).orderBy("id").limit(n)


def first_non_null_merge(members: DataFrame, columns: tuple[str, ...] = fv.MERGED_COLUMNS, group: str = "component") -> DataFrame:
    """One row per group: the keeper's own non-empty value of each column, else the first non-empty one
    among the others by id. ``members`` carries the group, id, is_keeper and the columns."""
    present = [c for c in columns if c in members.columns]
    spot = F.struct((~F.col("is_keeper")).alias("late"), F.col("id").alias("id"))
    ready = members.select(
        group, "id", "is_keeper", *[F.struct(F.when(truthy(F.col(c)), spot).alias("at"), F.col(c).alias("v")).alias(c) for c in present]
    )
    merged = [F.min_by(F.col(f"{c}.v"), F.col(f"{c}.at")).alias(c) for c in present]
    return ready.groupBy(group).agg(F.max(F.when(F.col("is_keeper"), F.col("id"))).alias("keeper_id"), *merged)
