"""Release choice, recording matching, confidence, and merging found values into the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import text as T
from ..functions.numbers import clamp, half_up, truthy
from ..plans.durable import keep
from ..plans.skew import spread_join, top_n

DIFF_FIELDS = ("title", "artist", "album", "album_artist", "year", "track_number", "disc_number", "genre")


def is_studio_album(status: Column, primary: Column, secondary: Column, title: Column) -> Column:
    return F.coalesce(
        (status == "Official") & (primary == "Album") & (F.size(secondary) == 0) & ~title.rlike(fv.LIVE_TITLE),
        F.lit(False),
    )


def release_kind(status: Column, primary: Column, secondary: Column, title: Column) -> Column:
    sec = F.transform(secondary, F.lower)
    has = lambda *names: F.arrays_overlap(sec, F.array(*[F.lit(n) for n in names]))
    return (
        F.when(status == "Bootleg", "bootleg")
        .when(has("live") | title.rlike(fv.LIVE_TITLE), "live")
        .when(has("compilation", "dj-mix", "mixtape/street"), "compilation")
        .when(has("soundtrack"), "soundtrack")
        .when(primary == "Album", "album")
        .when(primary == "EP", "ep")
        .when(primary == "Single", "single")
        .otherwise("other")
    )


def kind_weight(kind: Column) -> Column:
    w = F.lit(0.3)
    for name, value in fv.KIND_WEIGHT.items():
        w = F.when(kind == name, F.lit(value)).otherwise(w)
    return w


def classify_release(releases: DataFrame) -> DataFrame:
    """Adds kind, kind_weight and studio to rows with status, primary_type, secondary_types, title."""
    args = (F.col("status"), F.col("primary_type"), F.col("secondary_types"), F.col("title"))
    return releases.withColumns({"kind": release_kind(*args), "studio": is_studio_album(*args)}).withColumn(
        "kind_weight", kind_weight(F.col("kind"))
    )


def same_name(a: Column, b: Column) -> Column:
    return F.coalesce((a != "") & (b != "") & (T.normalize(a) == T.normalize(b)), F.lit(False))


def _artist_close(at_least: float) -> Column:
    q, c = F.col("q_artist"), F.col("artist")
    return (T.primary_artist(q) == T.primary_artist(c)) | (T.similarity(q, c) >= at_least)


def match_recordings(pairs: DataFrame, first: Column | None = None) -> DataFrame:
    """Best recording per query from text search; rows where ``first`` holds go before all others.

    Query columns q, q_title, q_artist, q_ms; candidate columns recording_id, title, artist,
    duration_ms, score, has_studio. Other songs, other cuts and weak hits are dropped; studio albums
    go first, then the closest length, then the score.
    """
    return _best_recordings(pairs.where(_recording_fits()), first)


def _length_gap() -> Column:
    return F.when((F.col("q_ms") > 0) & (F.col("duration_ms") > 0), F.abs(F.col("q_ms") - F.col("duration_ms")))


def _recording_fits() -> Column:
    """Same song and cut, near in length and no weak hit; needs no release."""
    near = F.coalesce(_length_gap() <= F.greatest(F.lit(15_000.0), F.col("q_ms") * 0.1), F.lit(True))
    return (
        (F.col("score") >= 0.8)
        & near
        & (T.similarity(F.col("q_title"), F.col("title")) >= 0.7)
        & (T.new_markers(T.normalize(F.col("title")), T.normalize(F.col("q_title"))) == 0)
        & _artist_close(0.6)
    )


def _best_recordings(fitting: DataFrame, first: Column | None = None) -> DataFrame:
    gap = _length_gap()
    order = [F.col("has_studio").desc(), F.coalesce(gap, F.lit(5_000)), F.col("score").desc(), F.col("recording_id")]
    return top_n(fitting, ["q"], [first.desc(), *order] if first is not None else order)


def acoustic_plausible() -> Column:
    artist = F.trim(F.coalesce(F.col("q_artist"), F.lit("")))
    blank = (artist == "") | artist.rlike(r"(?i)^unknown( artist)?\z")
    title_ok = (F.coalesce(F.col("q_title"), F.lit("")) != "") & (T.similarity(F.col("q_title"), F.col("title")) >= 0.5)
    return blank | _artist_close(0.5) | title_ok


def match_by_fingerprint(pairs: DataFrame) -> DataFrame:
    """Best recording per query from a fingerprint lookup, ignoring implausible hits."""
    return _best_heard(pairs.where(_print_fits()))


def _print_fits() -> Column:
    return (F.col("score") >= 0.85) & acoustic_plausible()


def _best_heard(fitting: DataFrame) -> DataFrame:
    return top_n(fitting, ["q"], [F.col("has_studio").desc(), F.col("score").desc(), F.col("recording_id")])


def confidence() -> Column:
    """0..1 with two decimals from q_*, title, artist, duration_ms, score, kind and verified."""
    kind = F.when(F.col("kind").isNull(), F.lit(0.3)).otherwise(kind_weight(F.col("kind")))
    heard = F.least(F.lit(1.0), 0.55 + 0.25 * F.col("score") + 0.2 * kind)
    title = T.let(
        lambda q, t: T.dice(T.words_of(q), T.words_of(t)) * F.when(T.new_markers(t, q) > 0, 0.5).otherwise(1.0),
        T.normalize(F.col("q_title")), T.normalize(F.col("title")),
    )
    artist = F.when(
        T.primary_artist(F.col("q_artist")) == T.primary_artist(F.col("artist")), F.lit(1.0)
    ).otherwise(T.similarity(F.col("q_artist"), F.col("artist")))
    dur = F.when(
        (F.col("q_ms") > 0) & (F.col("duration_ms") > 0),
        clamp(1.0 - (F.abs(F.col("q_ms") - F.col("duration_ms")) - 2000.0) / 20_000.0, 0.0, 1.0),
    ).otherwise(F.lit(0.6))
    read = 0.3 * title + 0.2 * artist + 0.25 * dur + 0.25 * kind
    return half_up(F.when(F.col("verified"), heard).otherwise(read) * 100) / 100.0


def match_confidence(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("confidence", confidence())


def pick_release(cands: DataFrame) -> DataFrame:
    """Release per recording: the one titled like ``prefer_album``, else the earliest studio album,
    else the best ranked. Columns: recording_id, release_id, title, date, rank, studio, prefer_album."""
    named = same_name(F.col("title"), F.col("prefer_album"))
    tier = F.when(named, 0).when(F.col("studio"), 1).otherwise(2)
    tiered = cands.withColumn("tier", tier)
    by_date = F.when(F.col("tier") == 1, F.coalesce(T.blank_to_null(F.col("date")), F.lit("9999")))
    return top_n(tiered, ["recording_id"], [F.col("tier"), by_date, F.col("rank"), F.col("release_id")])


def album_options(scored: DataFrame, n: int = 30) -> DataFrame:
    """One option per (query, album): most confident, then earliest; best ``n`` per query."""
    option = F.coalesce(F.col("release_group").cast("string"), F.col("release_id").cast("string"))
    order = [F.col("confidence").desc(), F.coalesce(F.col("year"), F.lit(9999)), F.col("release_id")]
    best = top_n(scored.withColumn("option", option), ["q", "option"], order)
    return top_n(best, ["q"], [F.col("confidence").desc(), F.col("option")], n, "place")


def merge_enrichment(df: DataFrame, keep_album: bool = False) -> DataFrame:
    """Merge e_* columns into the tags of the same row (null e_* everywhere = nothing found).

    With ``keep_album`` the current album stays and only gaps around it are filled. The artist is
    adopted when it is the same artist; the genre only when empty.
    """
    cur, e = F.col, lambda c: F.col(f"e_{c}")
    found = F.col("e_title").isNotNull()
    holds = F.lit(keep_album) & truthy(cur("album"))
    same_artist = same_name(cur("artist"), e("artist")) | (
        T.primary_artist(cur("artist")) == T.primary_artist(e("artist"))
    )
    fill = lambda c: F.when(holds & truthy(cur(c)), cur(c)).otherwise(F.coalesce(e(c), cur(c)))
    album_artist = F.when(
        holds, F.coalesce(cur("album_artist"), F.when(same_name(cur("album"), e("album")), e("album_artist")))
    ).otherwise(F.coalesce(e("album_artist"), cur("album_artist")))
    merged = {
        "title": e("title"),
        "artist": F.when(same_artist, e("artist")).otherwise(cur("artist")),
        "album": F.when(holds, cur("album")).otherwise(F.coalesce(e("album"), cur("album"))),
        "album_artist": album_artist,
        "year": fill("year"),
        "track_number": fill("track_number"),
        "disc_number": fill("disc_number"),
        "genre": F.coalesce(F.when(truthy(cur("genre")), cur("genre")), T.blank_to_null(e("genre"))),
    }
    if "track_total" in df.columns and "e_track_total" in df.columns:
        merged["track_total"] = fill("track_total")
    return df.withColumns({f"m_{c}": F.when(found, v).otherwise(F.col(c)) for c, v in merged.items()})


def _asked(candidates: DataFrame, query: DataFrame, studio: DataFrame, fits: Column) -> DataFrame:
    """Candidates that fit their query beside it, with whether a studio album has them. Texts are compared once, before the second join."""
    fitting = keep(spread_join(candidates.withColumnRenamed("id", "q"), query, ["q"]).where(fits), "fitting")
    return spread_join(fitting, studio, ["recording_id"], "left").withColumn("has_studio", F.coalesce("has_studio", F.lit(False)))


def _queries(lib: DataFrame, prefer_album: Column) -> DataFrame:
    return lib.select(
        F.col("id").alias("q"), F.col("title").alias("q_title"), F.col("artist").alias("q_artist"), F.col("duration_ms").alias("q_ms"),
        prefer_album.alias("prefer_album"),
    ).where(truthy(F.col("q_title")) & truthy(F.col("q_artist")))


def _release_of(pick: DataFrame, typed: DataFrame) -> DataFrame:
    """The release chosen for each picked recording, as ``pick_release`` orders them."""
    renamed = {"title": "album_title", "track_number": "e_track_number", "disc_number": "e_disc_number", "album_artist": "e_album_artist", "track_total": "e_track_total"}
    choice = spread_join(typed.withColumnsRenamed(renamed), pick.select("q", "recording_id", "prefer_album"), ["recording_id"])
    if "e_track_total" not in choice.columns:
        choice = choice.withColumn("e_track_total", F.lit(None).cast("int"))
    named = same_name(F.col("album_title"), F.col("prefer_album"))
    tier = F.when(named, 0).when(F.col("studio"), 1).otherwise(2)
    by_date = F.when(F.col("tier") == 1, F.coalesce(T.blank_to_null(F.col("date")), F.lit("9999")))
    release = top_n(choice.withColumn("tier", tier), ["q"], [F.col("tier"), by_date, F.col("rank"), F.col("release_id")])
    return release.select("q", "release_id", "album_title", "year", "kind", "release_group", "e_album_artist", "e_track_number", "e_track_total", "e_disc_number")


def identify_recordings(lib: DataFrame, candidates: DataFrame, releases: DataFrame) -> DataFrame:
    """(id, title, artist, album, track_number, duration_ms) of songs known by rough text alone.

    The text search of ``enrich_catalog`` without fingerprints and extras, to be run before a file is looked for. The release titled like the row's
    album is preferred. Rows without title, artist or a confident match are left out.
    """
    typed = keep(classify_release(releases), "releases")
    studio = typed.groupBy("recording_id").agg(F.bool_or("studio").alias("has_studio"))
    pick = keep(_best_recordings(_asked(candidates, _queries(lib, F.col("album")), studio, _recording_fits()), F.col("album_only")), "picks")
    full = pick.join(_release_of(pick, typed), "q", "left")
    plain = lambda c, name: T.ascii_punctuation(F.col(c)).alias(name)
    return full.select(
        F.col("q").alias("id"), plain("title", "title"), plain("artist", "artist"), plain("album_title", "album"),
        F.col("e_track_number").alias("track_number"), "duration_ms",
    )


def original_years(releases: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(release_group, first_year): the year a release group first came out, from ``groups`` (release_group, first_date) where given, else the earliest
    year of its releases, which combines before the shuffle."""
    if groups is None:
        dated = releases.select("release_group", F.col("year").cast("int").alias("y"))
    else:
        dated = groups.select("release_group", F.substring("first_date", 1, 4).try_cast("int").alias("y"))
    dated = dated.where((F.col("y") > 0) & F.col("release_group").isNotNull())
    return dated.groupBy(F.col("release_group").cast("string").alias("release_group")).agg(F.min("y").alias("first_year"))


def enrich_catalog(
    lib: DataFrame,
    candidates: DataFrame,
    releases: DataFrame,
    genres: DataFrame,
    printed: DataFrame | None = None,
    keep_album: bool = False,
    groups: DataFrame | None = None,
) -> DataFrame:
    """Choose recording, release and genres for catalog rows and merge them in.

    ``candidates``: id, recording_id, title, artist, artist_id, duration_ms, score, album_only. A
    fingerprint match (``printed``, same columns) wins; else the best of the album-only search; else
    the best of all. ``releases``: recording_id, release_id, title, date, year, rank, status,
    primary_type, secondary_types, release_group, album_artist, track_number, disc_number and optionally track_total.
    ``genres``: entity, place, genre of release groups and artists. The year is that of the release group's first release
    (``original_years``), else of the chosen one.
    """
    typed = keep(classify_release(releases), "releases")
    studio = typed.groupBy("recording_id").agg(F.bool_or("studio").alias("has_studio"))
    query = _queries(lib, F.col("album") if keep_album else F.lit(None).cast("string"))

    # the album-only search comes first, all results second: one pass with that as the leading key
    picks = _best_recordings(_asked(candidates, query, studio, _recording_fits()), F.col("album_only")).withColumn("_step", F.lit(1)).withColumn("verified", F.lit(False))
    if printed is not None:
        heard = _best_heard(_asked(printed, query, studio, _print_fits())).withColumn("_step", F.lit(0)).withColumn("verified", F.lit(True))
        picks = picks.unionByName(heard, allowMissingColumns=True)
    pick = keep(top_n(picks, ["q"], [F.col("_step")]).drop("album_only", "has_studio", "_step"), "picks")
    full = keep(pick.join(_release_of(pick, typed), "q", "left").withColumn("confidence", confidence()), "chosen")

    joined_genres = (
        genres.groupBy("entity")
        .agg(F.array_sort(F.collect_list(F.struct("place", "genre"))).alias("_g"))  # at most three
        .select(F.col("entity").cast("string").alias("entity"), F.array_join(F.transform("_g", lambda x: x["genre"]), "; ").alias("_genre"))
    )
    group_g = joined_genres.select(F.col("entity").alias("release_group"), F.col("_genre").alias("_by_group"))
    artist_g = joined_genres.select(F.col("entity").alias("artist_id"), F.col("_genre").alias("_by_artist"))
    full = full.withColumns({c: F.col(c).cast("string") for c in ("release_group", "artist_id")})
    full = spread_join(spread_join(full, group_g, ["release_group"], "left"), artist_g, ["artist_id"], "left")
    full = spread_join(full, original_years(typed, groups), ["release_group"], "left")
    e = full.select(
        F.col("q").alias("id"), "recording_id", "release_id", "confidence", "verified",
        T.ascii_punctuation(F.col("title")).alias("e_title"), T.ascii_punctuation(F.col("artist")).alias("e_artist"),
        T.ascii_punctuation(F.col("album_title")).alias("e_album"), T.ascii_punctuation(F.col("e_album_artist")).alias("e_album_artist"),
        F.coalesce("first_year", "year").alias("e_year"), "e_track_number", "e_track_total", "e_disc_number", F.coalesce("_by_group", "_by_artist").alias("e_genre"),
    )
    return merge_enrichment(lib.join(e, "id", "left"), keep_album)


def route_matches(enriched: DataFrame, review_below: float = fv.REVIEW_BELOW, artwork: str = "missing") -> DataFrame:
    """Adds ``route`` (staged, review, unmatched) and ``takes_artwork``."""
    route = (
        F.when(F.col("recording_id").isNull(), "unmatched")
        .when(F.col("confidence") >= review_below, "staged")
        .otherwise("review")
    )
    wants = {"replace": F.lit(True), "missing": ~F.coalesce(F.col("has_artwork"), F.lit(False)), "keep": F.lit(False)}[artwork]
    return enriched.withColumns({"route": route, "takes_artwork": F.col("recording_id").isNotNull() & wants})


def match_diff(enriched: DataFrame, fields: tuple[str, ...] = DIFF_FIELDS) -> DataFrame:
    """(id, field, before, after, changed): proposals never clear a value."""
    show = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cells = F.array(
        *[
            F.struct(F.lit(f).alias("field"), show(f).alias("before"), F.coalesce(F.col(f"m_{f}").cast("string"), show(f)).alias("after"))
            for f in fields
        ]
    )
    return enriched.where("recording_id is not null").select("id", F.explode(cells).alias("c")).select(
        "id", "c.field", "c.before", "c.after", (F.col("c.before") != F.col("c.after")).alias("changed")
    )


# ---- album identity ----------------------------------------------------------------------------


def album_identity(incoming: DataFrame, lib: DataFrame) -> DataFrame:
    """Canonical album artist, album spelling and release id for incoming rows.

    ``incoming``: seq, album_artist, artist, album, release_id. ``lib``: album_artist, album,
    mb_release_id. Catalog rows of the same album (ASCII case-insensitive) by the same album artist
    decide, commonest value first; with no album artist given, the Various Artists rows do. Where the
    catalog knows nothing, the first row of the run for that album decides; then the catalog's commonest
    spelling of the artist; then the row itself.
    """
    named = truthy(F.col("album_artist"))
    own = F.when(named, F.col("album_artist")).otherwise(F.col("artist"))
    rows = incoming.withColumns(
        {
            "_own": own,
            "_who": T.normalize(own),
            "_alb": F.lower(F.when(truthy(F.col("album")), F.col("album"))),
            "_norm_alb": T.normalize(F.col("album")),
            "_named": named,
        }
    )
    known = lib.where("album is not null").select(
        F.lower("album").alias("_alb"), T.normalize(F.col("album_artist")).alias("_who"), "album_artist", "album", "mb_release_id"
    )
    counts = keep(
        known.groupBy("_alb", "_who", "album_artist", "album", "mb_release_id").agg(F.count(F.lit(1)).alias("_n")), "albums"
    )

    def commonest(col: str) -> DataFrame:
        votes = counts.where(truthy(F.col(col))).groupBy("_alb", "_who", col).agg(F.sum("_n").alias("_v"))
        return top_n(votes, ["_alb", "_who"], [F.col("_v").desc(), F.col(col)]).select("_alb", "_who", F.col(col).alias(f"_best_{col}"))

    table = counts.groupBy("_alb", "_who").agg(F.min("album_artist").alias("_any"))
    for c in ("album_artist", "album", "mb_release_id"):
        table = table.join(commonest(c), ["_alb", "_who"], "left")
    table = keep(table, "identities")
    direct = spread_join(rows, table.withColumn("_hit", F.lit(True)), ["_alb", "_who"], "left")
    various = table.where(F.col("_who") == "various artists").select(
        "_alb", *[F.col(c).alias(f"_va{c}") for c in ("_best_album_artist", "_best_album", "_best_mb_release_id")], F.lit(True).alias("_va")
    )
    both = spread_join(direct, various, ["_alb"], "left")
    use_va = F.col("_hit").isNull() & F.col("_va") & ~F.col("_named")
    pick = lambda c: F.when(use_va, F.col(f"_va_best_{c}")).otherwise(F.col(f"_best_{c}"))
    spelled = lib.where("album_artist is not null").groupBy(F.lower("album_artist").alias("_low"), "album_artist").agg(F.count(F.lit(1)).alias("_n"))
    spelled = top_n(spelled, ["_low"], [F.col("_n").desc(), F.col("album_artist")]).select("_low", F.col("album_artist").alias("_spelling"))
    both = spread_join(both.withColumn("_low", F.lower("_own")), spelled, ["_low"], "left")
    ready = keep(
        both.select(
            *incoming.columns, "_own", "_alb",
            F.when(use_va, F.lit("various artists")).otherwise(F.col("_who")).alias("_key_who"), "_norm_alb",
            pick("album_artist").alias("_p_artist"), pick("album").alias("_p_album"), pick("mb_release_id").alias("_p_release"),
            F.coalesce("_spelling", "_own").alias("_spelling"),
        ),
        "identity-rows",
    )
    # what each row would hand out by itself; the first row of a key fixes the value for later ones
    has_album = F.col("_alb").isNotNull()
    first = (
        ready.where(has_album)
        .groupBy("_key_who", "_norm_alb")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min_by(F.coalesce("_p_artist", "_spelling"), "seq").alias("_f_artist"),
            F.min_by(F.coalesce("_p_album", "album"), "seq").alias("_f_album"),
            F.min_by(F.coalesce("_p_release", "release_id"), F.when(F.coalesce("_p_release", "release_id").isNotNull(), F.col("seq"))).alias("_f_release"),
            F.min(F.when(F.coalesce("_p_release", "release_id").isNotNull(), F.col("seq"))).alias("_f_seq"),
        )
    )
    joined = spread_join(ready, first.drop("n"), ["_key_who", "_norm_alb"], "left", counts=first.select("_key_who", "_norm_alb", "n"))
    earlier_release = F.when(F.col("_f_seq") <= F.col("seq"), F.col("_f_release"))
    return joined.select(
        *incoming.columns,
        F.when(has_album, F.coalesce("_p_artist", "_f_artist")).otherwise(F.col("_spelling")).alias("out_album_artist"),
        F.when(has_album, F.coalesce("_p_album", "_f_album")).alias("out_album"),
        F.when(has_album, F.coalesce(F.col("_p_release"), earlier_release, F.col("release_id"))).otherwise(F.col("release_id")).alias("out_release_id"),
    )


def fill_gaps_by_precedence(base: DataFrame, sources: list[str], columns: dict[str, str]) -> DataFrame:
    """Column-wise precedence merge. ``sources`` are column prefixes ('' is the base row); ``columns``
    maps each output column to the order it follows, e.g. {'album': 'base,source'}."""
    prefix = {s.rstrip("_") or "base": s for s in sources}
    out = {}
    for col, order in columns.items():
        picks = [F.col(f"{prefix[name.strip()]}{col}") for name in order.split(",")]
        out[f"f_{col}"] = F.coalesce(*[F.when(p.cast("string") != "", p) for p in picks])
    return base.withColumns(out)


