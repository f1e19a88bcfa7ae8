"""Filtering, sorting, facets and totals over the catalog, queue and source items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters, ordering, rollups
from ..operators.lookups import resolve_item_states
from ..plans.skew import number_rows
from . import registered
from .sql import natural, truthy, with_
from .views import ctes, table, view

HAY = "lower(concat_ws(' ', " + ", ".join(
    f"case when {truthy(c)} then cast({c} as varchar) end"
    for c in ("title", "artist", "album", "album_artist", "genre", "year", "rel_path")
) + "))"


@registered(with_(ctes("catalog"), f"select id, title from catalog where contains({HAY}, 'src1') and contains({HAY}, 'en') and contains({HAY}, 'th')"))
def search_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return filters.search_catalog(view(spark, sf, "catalog"), "SRC1 en  th").select("id", "title")


@registered(with_(ctes("catalog"), """
select 'lossless' as tier, id from catalog where coalesce(lossless, false)
union all select 'high', id from catalog where coalesce(lossless, false) or coalesce(bitrate, 0) >= 256
union all select 'low', id from catalog where not coalesce(lossless, false) and coalesce(bitrate, 0) < 192"""))
def filter_quality(spark: SparkSession, sf: str) -> DataFrame:
    c = view(spark, sf, "catalog")
    tiers = [filters.filter_quality(c, t).select(F.lit(t).alias("tier"), "id") for t in ("lossless", "high", "low")]
    return tiers[0].unionByName(tiers[1]).unionByName(tiers[2])


@registered(with_(ctes("catalog"), f"""
select id, not has_artwork as no_art, not has_lyrics as no_lyrics, not {truthy('album')} as no_album, not {truthy('year')} as no_year,
       not {truthy('genre')} as no_genre, not {truthy('track_number')} as no_track_no
from catalog where not has_artwork and not has_lyrics"""))
def filter_missing_metadata(spark: SparkSession, sf: str) -> DataFrame:
    c = filters.filter_missing_metadata(view(spark, sf, "catalog"), ["no_art", "no_lyrics"])
    return filters.issue_flags(c).select("id", *filters.ISSUES)


@registered(with_(ctes("catalog"), "select id from catalog where coalesce(album_artist, artist) = 'src3' and album = 'src3 en' and format in ('flac', 'mp3')"))
def filter_facets(spark: SparkSession, sf: str) -> DataFrame:
    return filters.filter_facets(view(spark, sf, "catalog"), "src3", "src3 en", ["flac", "mp3"]).select("id")


STATES = """
select i.source_id, i.external_id, i.position, i.present, i.ignored, i.title, i.artist, i.album, i.match_key, b.track_id,
       case when (b.status is null or b.status in ('failed', 'cancelled', 'skipped')) and k.match_key is not null then 'library'
            else coalesce(b.status, 'new') end as state
from source_items i
left join (select external_id, track_id, status from (select *, row_number() over (partition by external_id order by
             case status when 'done' then 6 when 'queued' then 4 when 'skipped' then 3 when 'failed' then 2 when 'cancelled' then 1 else 0 end desc, track_id) as rn
           from job_states) where rn = 1) b on b.external_id = i.external_id
left join (select distinct concat('known|', p_partkey) as match_key from part where p_size < 20) k on k.match_key = i.match_key
"""
CLASS = """case when not present then 'removed' when ignored then 'ignored' when state in ('done', 'library', 'skipped') then 'have'
when state in ('queued', 'resolving', 'matching', 'downloading', 'processing', 'tagging', 'moving') then 'pipeline' else 'missing' end"""
STATE_CTES = {**ctes("source_items", "job_states"), "states": STATES}


def item_states(spark: SparkSession, sf: str) -> DataFrame:
    lib = table(spark, sf, "part").where("p_size < 20").select(F.concat(F.lit("known|"), "p_partkey").alias("match_key"))
    return resolve_item_states(view(spark, sf, "source_items"), view(spark, sf, "job_states"), lib)


@registered(with_(STATE_CTES, "select source_id, external_id, state, track_id from states"), "resolve_item_states")
def _resolve_item_states(spark: SparkSession, sf: str) -> DataFrame:
    return item_states(spark, sf).select("source_id", "external_id", "state", "track_id")


@registered(with_(STATE_CTES, f"select source_id, external_id, {CLASS} as class from states where contains(lower(title), 'high')"))
def classify_items(spark: SparkSession, sf: str) -> DataFrame:
    return filters.classify_items(item_states(spark, sf), q="HIGH").select("source_id", "external_id", "class")


@registered(with_(STATE_CTES, f"""select class, count(*) as items from (select {CLASS} as class from states) group by class
union all select 'all', count(*) from states"""))
def item_class_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.item_class_counts(item_states(spark, sf))


@registered(with_(STATE_CTES, """select c_custkey as source_id, c_name as name, coalesce(total, 0) as total, coalesce(have, 0) as have, coalesce(missing, 0) as missing
from customer left join (select source_id, count(*) as total, count(*) filter (where state in ('done', 'library', 'skipped')) as have,
  count(*) filter (where state in ('new', 'cancelled') and not ignored) as missing from states where present group by 1) on source_id = c_custkey"""))
def source_coverage(spark: SparkSession, sf: str) -> DataFrame:
    sources = table(spark, sf, "customer").select(F.col("c_custkey").alias("source_id"), F.col("c_name").alias("name"))
    return rollups.source_coverage(sources, item_states(spark, sf))


@registered("""select l_orderkey as order_id, l_linenumber as line, l_suppkey as supp, l_partkey as part,
case when l_discount * 10 < 0.35e0 then 'fail' when l_discount * 10 < 0.6e0 then 'check' else 'match' end as flag,
l_returnflag = 'A' and l_linestatus <> 'F' as lossy_origin from lineitem""")
def flag_match_confidence(spark: SparkSession, sf: str) -> DataFrame:
    scored = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("supp"), F.col("l_partkey").alias("part"),
        (F.col("l_discount") * 10).alias("score"),
        F.when(F.col("l_returnflag") == "A", "flac").otherwise("mp3").alias("container"), (F.col("l_linestatus") == "F").alias("lossless_origin"),
    )
    return filters.flag_match_confidence(scored).drop("score", "container", "lossless_origin")


@registered(with_(ctes("catalog"), """select count(*) as files, sum(size)::bigint as bytes, sum(duration_ms)::bigint as total_ms,
round(sum(duration_ms) / 3600000e0, 6) as hours from catalog"""))
def library_totals(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.library_totals(view(spark, sf, "catalog")).withColumn("hours", F.round("hours", 6))


@registered(with_(ctes("catalog"), """select artist, count(*) as files from (select coalesce(album_artist, artist, 'Unknown') as artist from catalog)
where contains(lower(artist), 'src1') group by 1"""))
def artist_facet(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.artist_facet(view(spark, sf, "catalog"), "Src1")


@registered(with_(ctes("catalog"), "select distinct format from catalog where format <> ''"))
def format_facet(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.format_facet(view(spark, sf, "catalog"))


ALBUM_KEYS = "coalesce(album_artist, artist, 'Unknown') as artist_key, coalesce(album, '(no album)') as album_key"


@registered(with_({**ctes("catalog"), "r": f"""select *, {ALBUM_KEYS}, row_number() over (partition by coalesce(album_artist, artist, 'Unknown'), coalesce(album, '(no album)')
  order by duration_ms, id) as rn from catalog"""}, """
select a.artist_key, a.album_key, a.tracks, a.year, b.id as cover_id from
 (select artist_key, album_key, count(*) as tracks, max(case when rn = 1 then year end) as year,
         min(case when has_artwork then rn end) as cover_rn from r group by 1, 2) a
 left join r b on b.artist_key = a.artist_key and b.album_key = a.album_key and b.rn = a.cover_rn"""))
def album_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.album_rollup(view(spark, sf, "catalog"), [F.col("duration_ms"), F.col("id")])


@registered(with_(ctes("catalog"), f"""select id, {ALBUM_KEYS}, row_number() over (partition by coalesce(album_artist, artist, 'Unknown'), coalesce(album, '(no album)')
  order by duration_ms, id) as place from catalog"""))
def album_tracks(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.album_tracks(view(spark, sf, "catalog"), ["duration_ms", "id"]).select("id", "artist_key", "album_key", "place")


@registered(with_(ctes("feed"), """select count(*) filter (where status = 'queued') as queued, count(*) filter (where status in ('resolving', 'downloading')) as active,
count(*) filter (where status = 'done') as done, count(*) filter (where status = 'failed') as failed, count(*) filter (where status = 'skipped') as skipped,
count(*) filter (where status = 'done' and ts >= timestamp '2024-01-20') as done_today from feed"""))
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    now = F.lit("2024-01-20 15:30:00").cast("timestamp")
    return rollups.status_counts(view(spark, sf, "feed").withColumnRenamed("ts", "finished_at"), now)


@registered(with_({**ctes("catalog"), "v": """select album, album_artist, count(*) as n from catalog where album_artist <> '' group by 1, 2"""}, """
select album, album_artist, n as votes from (select *, row_number() over (partition by album order by n desc, album_artist) as rn from v) where rn = 1"""))
def weighted_mode(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.weighted_mode(view(spark, sf, "catalog"), ["album"], "album_artist")


@registered(with_(ctes("catalog"), "select count(*) as total, count(audio_hash) as with_audio_hash, count(bitrate) as with_bitrate from catalog"))
def column_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.column_coverage(view(spark, sf, "catalog"), ["audio_hash", "bitrate"])


@registered(with_(ctes("catalog"), " union all ".join(
    f"select '{f}' as field, case when count(distinct coalesce(cast({f} as varchar), '')) = 1 then min(coalesce(cast({f} as varchar), '')) end as value, "
    f"count(distinct coalesce(cast({f} as varchar), '')) > 1 as mixed from catalog" for f in ("artist", "album", "year", "genre", "codec"))))
def common_or_mixed(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.common_or_mixed(view(spark, sf, "catalog"), ["artist", "album", "year", "genre", "codec"])


# ---- series ------------------------------------------------------------------------------------

SERIES = "select user_id as series_id, row_number() over (partition by user_id order by ts, event_id) as idx, value from events"
PEAKS = """select g.series_id, g.bucket::int as bucket, floor(coalesce(p.top, 0) / 100e0 * 255 + 0.5e0)::int as peak from
 (select series_id, unnest(range(0, 20)) as bucket from (select distinct series_id from series)) g
 left join (select series_id, (idx - 1) // greatest(1, n // 20) as bucket, max(abs(value)) as top
            from (select *, count(*) over (partition by series_id) as n from series) group by 1, 2) p
 on p.series_id = g.series_id and p.bucket = g.bucket"""
LEVELS = """select series_id, case when r > 0 then floor(20 * log10(r) * 10 + 0.5e0) / 10e0 else -70e0 end as level
from (select series_id, sqrt(avg(value * value)) / 100e0 as r from series group by 1)"""


def series(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("series_id"), "ts", "event_id", "value")
    return number_rows(e, ["series_id"], ["ts", "event_id"], "idx").select("series_id", "idx", "value")


@registered(with_({"series": SERIES}, PEAKS))
def series_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.series_peaks(series(spark, sf), 20, 100.0)


@registered(with_({"series": SERIES}, f"select series_id, round(level, 4) as level from ({LEVELS})"))
def series_level(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("series_id"), "value")
    return rollups.series_level(e, 100.0).withColumn("level", F.round("level", 4))


@registered(with_({"series": SERIES, "peaks": PEAKS, "levels": LEVELS}, """select l.series_id, round(greatest(-12e0, least(-18e0 - l.level,
 greatest(0e0, -20 * log10(greatest(p.peak, 1) / 255e0) - 1), 6e0)), 6) as gain_db
from levels l join (select series_id, max(peak) as peak from peaks group by 1) p using (series_id)"""))
def gain_plan(spark: SparkSession, sf: str) -> DataFrame:
    s = series(spark, sf)
    plan = rollups.gain_plan(rollups.series_peaks(s, 20, 100.0), rollups.series_level(s, 100.0))
    return plan.withColumn("gain_db", F.round("gain_db", 6))


# ---- sorts and limits --------------------------------------------------------------------------


@registered(with_(ctes("catalog"), f"""select id, row_number() over (order by {natural('album')} desc nulls last,
 case when album <> '' then disc_number end nulls first, case when album <> '' then coalesce(track_number, 0) end nulls first,
 {natural("nullif(title, '')")} asc nulls last, id) as place from catalog"""))
def sort_catalog(spark: SparkSession, sf: str) -> DataFrame:
    keys = ordering.sort_keys([("album", "desc"), ("title", "asc")])
    return number_rows(view(spark, sf, "catalog"), [], keys, "place").select("id", "place")


@registered(with_(ctes("catalog"), """select id, row_number() over (order by album_artist nulls first, album nulls first, disc_number nulls first,
 track_number nulls first, id) as place from catalog"""))
def default_listing_order(spark: SparkSession, sf: str) -> DataFrame:
    return number_rows(view(spark, sf, "catalog"), [], ordering.default_listing_order(), "place").select("id", "place")


@registered(with_(ctes("queue"), """select 'open' as view, id from (select id from queue where status not in ('done', 'failed', 'skipped', 'cancelled')
  order by priority desc, position, id limit 500)
union all select 'finished', id from (select id from queue where status in ('done', 'failed', 'skipped', 'cancelled') order by finished_at desc, id limit 150)
union all select 'next', id from (select id from queue where status = 'queued' and (retry_at is null or retry_at <= timestamp '1999-01-01')
  order by priority desc, position, id limit 1)"""))
def queue_views(spark: SparkSession, sf: str) -> DataFrame:
    views = ordering.queue_views(view(spark, sf, "queue"), F.lit("1999-01-01").cast("timestamp"))
    parts = [v.select(F.lit(k).alias("view"), "id") for k, v in views.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@registered(with_(ctes("queue"), """select id, finished_at + interval 1 hour as next_check_at from queue
where status <> 'failed' and interval_minutes > 0 and finished_at + interval 1 hour <= timestamp '1999-01-01'"""))
def due_sources(spark: SparkSession, sf: str) -> DataFrame:
    q = view(spark, sf, "queue").withColumns(
        {"enabled": F.col("status") != "failed", "next_check_at": F.expr("finished_at + interval 1 hour")}
    )
    return ordering.due_sources(q, F.lit("1999-01-01").cast("timestamp")).select("id", "next_check_at")


@registered(with_(ctes("catalog"), "select id from catalog where bitrate is null order by id limit 32"))
def pending_batch(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.pending_batch(view(spark, sf, "catalog"), "bitrate", 32).select("id")


@registered(with_(ctes("catalog"), """select id, row_number() over (partition by artist order by title, id) as track_number,
 count(*) over (partition by artist) as track_total from catalog"""))
def auto_number(spark: SparkSession, sf: str) -> DataFrame:
    c = view(spark, sf, "catalog").select("id", "artist", "title")
    return ordering.auto_number(c, ["artist"], ["title", "id"]).select("id", "track_number", "track_total")


MOVES = """select id, case when mod(id, 11) = 0 then null else id - 3 end as before_id from queue where status = 'queued'"""


@registered(with_({**ctes("queue"), "moves": MOVES, "q": "select *, row_number() over (order by priority desc, position, id) as spot from queue where status = 'queued'"}, """
select m.id, round(case when m.before_id is null
   then (select position from q where q.id <> m.id order by spot desc limit 1) + 1
   else (a.position + coalesce((select position from q p where p.spot < a.spot and p.id <> m.id order by p.spot desc limit 1), a.position - 2)) / 2 end, 6) as position, 0 as priority
from moves m left join q a on a.id = m.before_id where m.before_id is null or a.id is not null"""))
def reorder_midpoint(spark: SparkSession, sf: str) -> DataFrame:
    q = view(spark, sf, "queue")
    moves = q.where("status = 'queued'").select("id", F.when(F.col("id") % 11 != 0, F.col("id") - 3).alias("before_id"))
    out = ordering.reorder_midpoint(q, moves)
    return out.select("id", F.round("position", 6).alias("position"), "priority")


@registered(with_({**STATE_CTES, "old": "select source_id, external_id, position from source_items where mod(external_id, 4) <> 0",
  "n": "select source_id, external_id, row_number() over (partition by source_id order by position, external_id) as seen from source_items where mod(external_id, 3) <> 0"}, """
select n.source_id, n.external_id, coalesce(o.position, coalesce(t.top, 0) + n.seen) as position from n
left join (select source_id, max(position) as top from old group by 1) t using (source_id)
left join old o on o.source_id = n.source_id and o.external_id = n.external_id"""))
def listing_positions(spark: SparkSession, sf: str) -> DataFrame:
    items = view(spark, sf, "source_items").select("source_id", "external_id", "position")
    return ordering.listing_positions(items.where("external_id % 3 <> 0"), items.where("external_id % 4 <> 0"), True)


