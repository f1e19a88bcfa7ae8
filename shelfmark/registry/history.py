"""Inventories, snapshots, exports, logs, listings, legacy import and queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lookups
from ..plans.durable import new_folder
from ..sources import inventory, listings
from ..streaming import feeds as S
from ..streaming.run import read_feed
from . import registered
from .browse import STATE_CTES, item_states
from .sql import match_key, split_title, with_
from .views import ctes, table, view

CURRENT = "select path, size, mtime from snapshots where snap = 'cur'"
PREVIOUS = "select path, size, mtime from snapshots where snap = 'prev'"
DIFF = """select coalesce(p.path, c.path) as path, case when c.path is null then 'gone' when p.path is null then 'new'
 when p.size is not distinct from c.size and p.mtime is not distinct from c.mtime then 'unchanged' else 'changed' end as change
from prev p full join cur c on p.path = c.path"""
SNAP = {**ctes("snapshots"), "prev": PREVIOUS, "cur": CURRENT, "diff": DIFF}


def snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    s = view(spark, sf, "snapshots")
    return s.where("snap = 'prev'").drop("snap"), s.where("snap = 'cur'").drop("snap")


@registered("select distinct source, lang, true as listed from documents")
def scan_file_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Documents are written as one folder per source and language, and the folders are listed."""
    root = new_folder(spark, "inventory")
    table(spark, sf, "documents").select("doc_id", "source", "lang").write.partitionBy("source", "lang").parquet(root)
    files = inventory.scan_file_inventory(spark, root, ("parquet",))
    part = lambda c: F.regexp_extract("path", f"/{c}=([^/]*)/", 1).alias(c)
    return files.groupBy(part("source"), part("lang")).agg((F.sum("size") > 0).alias("listed"))


@registered(with_(SNAP, "select * from diff"))
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.snapshot_diff(*snapshots(spark, sf))


@registered(with_(SNAP, """select coalesce(p.path, c.path) as path, coalesce(c.size, p.size) as size, p.path is not null as kept_id,
 case when d.change = 'unchanged' then 'old' else 'read' end as title, case when d.change = 'unchanged' then md5(cast(p.path as varchar)) end as audio_hash
from prev p full join cur c on p.path = c.path join diff d on d.path = coalesce(p.path, c.path) where d.change <> 'gone'"""))
def merge_upsert_invalidate(spark: SparkSession, sf: str) -> DataFrame:
    prev, cur = snapshots(spark, sf)
    diff = lookups.snapshot_diff(prev, cur)
    index = prev.withColumns({"id": F.col("path"), "title": F.lit("old"), "audio_hash": F.md5(F.col("path").cast("string"))})
    changes = cur.join(diff.where("change in ('new', 'changed')"), "path", "left_semi").withColumn("title", F.lit("read"))
    merged = inventory.merge_upsert_invalidate(index, changes, diff.where("change = 'gone'"))
    written = spark.read.schema(merged.schema).parquet(inventory.write_snapshot(merged))
    return written.select("path", "size", (F.col("id") == F.col("path")).alias("kept_id"), "title", "audio_hash")


@registered(with_({**SNAP, "fresh": "select path, (select max(path) from prev) + 1000 + row_number() over (order by path) as id from diff where change = 'new'"},
"""select coalesce(p.path, c.path) as path, coalesce(c.size, p.size) as size, coalesce(p.path + 1000, f.id) as id,
 case when d.change = 'unchanged' then 'old' else 'read' end as title, case when d.change = 'unchanged' then md5(cast(p.path as varchar)) end as audio_hash
from prev p full join cur c on p.path = c.path join diff d on d.path = coalesce(p.path, c.path) left join fresh f on f.path = c.path where d.change <> 'gone'"""))
def upsert_index(spark: SparkSession, sf: str) -> DataFrame:
    """The same merge on an index in buckets, with numbers as ids."""
    prev, cur = snapshots(spark, sf)
    diff = lookups.snapshot_diff(prev, cur)
    index = prev.withColumns({"id": F.col("path") + 1000, "title": F.lit("old"), "audio_hash": F.md5(F.col("path").cast("string"))})
    changes = cur.join(diff.where("change in ('new', 'changed')"), "path", "left_semi").withColumn("title", F.lit("read"))
    folder = new_folder(spark, "index")
    inventory.create_index(index, folder)
    return inventory.upsert_index(spark, folder, changes, diff.where("change = 'gone'")).select("path", "size", "id", "title", "audio_hash")


@registered(with_(SNAP, "select case change when 'gone' then 'delete' when 'new' then 'move' else 'retag' end as kind, path as from_path, change as detail from diff where change <> 'unchanged'"))
def append_change_log(spark: SparkSession, sf: str) -> DataFrame:
    diff = lookups.snapshot_diff(*snapshots(spark, sf)).where("change <> 'unchanged'")
    kind = F.when(F.col("change") == "gone", "delete").when(F.col("change") == "new", "move").otherwise("retag")
    path = new_folder(spark, "log")
    ops = diff.select(kind.alias("kind"), F.col("path").alias("from_path"), F.col("change").alias("detail"))
    inventory.append_change_log(ops.where("kind = 'delete'"), path)
    inventory.append_change_log(ops.where("kind <> 'delete'"), path)
    return spark.read.schema("from_path bigint, detail string, kind string").parquet(path)


@registered(with_(ctes("catalog"), "select id, title, album_artist, year, lossless, codec, mtime_ms from catalog"))
def export_catalog_columns(spark: SparkSession, sf: str) -> DataFrame:
    path, c = new_folder(spark, "export"), view(spark, sf, "catalog")
    inventory.export_catalog_columns(c, path)
    back = spark.read.schema(inventory.catalog_projection(c).schema).json(path)
    return back.select("id", "title", "album_artist", "year", "lossless", "codec", "mtime_ms")


TRACKS = """select track_id, status, case when track_id % 2 = 0 then external_id end as file_path from job_states"""


def linked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    cur = snapshots(spark, sf)[1]
    t = view(spark, sf, "job_states")
    tracks = t.select("track_id", "status", F.when(F.col("track_id") % 2 == 0, F.col("external_id")).alias("file_path"))
    files = lookups.link_files_to_tracks(cur.select("path", (F.col("path") * 2).alias("id")), tracks)
    return files, tracks


LINKED = {**SNAP, **ctes("job_states"), "tracks": TRACKS, "files": "select c.path, c.path * 2 as id, t.track_id from cur c left join (select file_path as path, max(track_id) as track_id from tracks where file_path is not null group by 1) t using (path)"}


@registered(with_(LINKED, "select * from files"))
def link_files_to_tracks(spark: SparkSession, sf: str) -> DataFrame:
    return linked(spark, sf)[0].select("path", "id", "track_id")


@registered(with_(LINKED, "select f.id, f.path, f.track_id, t.status as job_status from files f left join tracks t using (track_id)"))
def file_detail(spark: SparkSession, sf: str) -> DataFrame:
    files, tracks = linked(spark, sf)
    out = lookups.file_detail(files.withColumn("peaks", F.lit("[]")), tracks.withColumn("finished_at", F.lit(None).cast("timestamp")))
    return out.drop("job_finished_at")


@registered(with_(LINKED, "select t.track_id, f.id as file_id from tracks t join files f using (track_id)"))
def produced_files(spark: SparkSession, sf: str) -> DataFrame:
    files, tracks = linked(spark, sf)
    return lookups.produced_files(tracks, files)


@registered(with_(LINKED, "select t.track_id, coalesce(m.to_path, t.file_path) as file_path from tracks t left join (select path as from_path, path + 1000000 as to_path from diff where change = 'changed') m on m.from_path = t.file_path"))
def redirect_references(spark: SparkSession, sf: str) -> DataFrame:
    moves = lookups.snapshot_diff(*snapshots(spark, sf)).where("change = 'changed'")
    moves = moves.select(F.col("path").alias("from_path"), (F.col("path") + 1000000).alias("to_path"))
    return lookups.redirect_references(linked(spark, sf)[1], moves).select("track_id", "file_path")


# ---- indexing ----------------------------------------------------------------------------------

RAW = """select doc_id, concat('/music/', source, '/', case when doc_id % 3 = 0 then concat(source, ' - ') else '' end, 'Song ', doc_id, '.MP3') as path, n_chars as size, doc_id as mtime_ms,
 doc_id % 10 <> 0 as ok, case when doc_id % 6 = 0 then '' else concat('Title ', lang) end as t_title, doc_id % 4 as artists, source, lang,
 case when doc_id % 5 = 0 then 0 else doc_id % 30 end as track, n_chars * 50 as ms, doc_id % 7 = 0 as cover from documents"""
_GA, _GT = split_title("stem", "null")
_AR = "case when not ok or artists = 0 then guess_a when artists = 1 then source else source || ', Guest' end"
_TI = "case when ok and t_title <> '' then t_title else guess_t end"


@registered(with_({"raw": RAW, "g": r"select *, regexp_replace(regexp_extract(path, '([^/]+)$', 1), '\.[^.]*$', '') as stem from raw",
  "h": f"select *, {_GA} as guess_a, {_GT} as guess_t from g", "i": f"select *, {_AR} as artist_, {_TI} as title_, case when not ok or artists = 0 then guess_a else source end as key_artist from h"}, f"""
select path, substr(path, 8) as rel_path, 'mp3' as format, title_ as title, artist_ as artist, case when ok and track > 0 then track end as track_number,
 case when ok and ms > 0 then ms end as duration_ms, case when ok then lang || '; Pop' end as genre, ok and cover as has_artwork, ok and mod(doc_id, 2) = 0 as has_lyrics,
 {match_key('key_artist', 'title_')} as match_key from i"""))
def index_catalog_rows(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "documents").createOrReplaceTempView("documents")
    r = spark.sql(RAW)
    none = F.lit(None)
    artists = F.slice(F.array("source", F.lit("Guest")), F.lit(1), F.least("artists", F.lit(2)).cast("int"))
    tags = F.struct(
        F.col("t_title").alias("title"), artists.alias("artist"), none.cast("string").alias("album"), none.cast("string").alias("album_artist"),
        F.col("track").alias("track"), none.cast("int").alias("total_tracks"), none.cast("int").alias("disc"), none.cast("int").alias("year"),
        F.array("lang", F.lit("Pop")).alias("genre"), none.cast("string").alias("isrc"),
    )
    props = F.struct(
        F.lit("MP3").alias("codec"), F.lit(False).alias("lossless"), F.lit(320).alias("bitrate"), F.lit(44100).alias("sample_rate"),
        none.cast("int").alias("bits_per_sample"), F.col("ms").alias("duration_ms"),
    )
    raw = r.select(
        "path", "size", "mtime_ms", "ok", tags.alias("tags"), props.alias("props"), F.col("cover").alias("has_cover"),
        F.when(F.col("doc_id") % 2 == 0, "la la").otherwise(" ").alias("lyrics"),
    )
    out = inventory.index_catalog_rows(raw, "/music/")
    return out.select("path", "rel_path", "format", "title", "artist", "track_number", "duration_ms", "genre", "has_artwork", "has_lyrics", "match_key")


# ---- listings ----------------------------------------------------------------------------------


@registered("""select cast(o_custkey as varchar) as collection_id, cast(o_orderkey as varchar) as external_id, 'Order ' || o_orderpriority as title,
 case when o_orderkey % 13 = 0 then 'Unknown Artist' else o_orderstatus end as artist, year(o_orderdate)::int as year, 'u640' as artwork_url,
 row_number() over (partition by o_custkey order by o_orderkey) as position
from orders where o_orderkey % 50 <> 0 and o_orderkey % 31 <> 0 and o_orderkey % 17 <> 0""")
def ingest_collection_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Orders land as JSON listing pages of their customer, a thousand order keys per page."""
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    name = F.when(key % 13 != 0, F.array(F.struct(F.col("o_orderstatus").alias("name")))).otherwise(F.array().cast("array<struct<name:string>>"))
    image = lambda u, w: F.struct(F.lit(u).alias("url"), F.lit(w).alias("width"))
    item = F.struct(
        F.when(key % 50 != 0, key.cast("string")).otherwise("").alias("id"),
        F.when(key % 31 == 0, "[Private video]").otherwise(F.concat(F.lit("Order "), "o_orderpriority")).alias("title"),
        F.when(key % 17 == 0, "episode").otherwise("track").alias("type"), name.alias("artists"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("release_date"), F.array(image("u64", 64), image("u640", 640), image("u300", 300)).alias("images"),
    )
    pages = o.groupBy(F.col("o_custkey").cast("string").alias("collection_id"), F.floor(key / 1000).cast("int").alias("page")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", item.alias("i")))), lambda x: x["i"]).alias("items")
    )
    path = new_folder(spark, "listing")
    pages.write.json(path)
    out = listings.ingest_collection_listing(listings.read_listing_pages(spark, path))
    return out.select("collection_id", "external_id", "title", "artist", "year", "artwork_url", "position")


_FA, _FT = split_title("raw_title", "channel")


@registered(with_(ctes("uploads"), f"select cast(id as varchar) as external_id, {_FT} as title, {_FA} as artist, null::bigint as duration_ms, true as partial from uploads where raw_title <> '' and mod(id, 10) <> 0"))
def ingest_feed_xml(spark: SparkSession, sf: str) -> DataFrame:
    """Uploads land as XML feeds of a thousand entries, every tenth entry without an id."""
    u = view(spark, sf, "uploads")
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit(f"</{name}>"))
    ident = F.when(F.col("id") % 10 != 0, tag("yt:videoId", F.col("id").cast("string"))).otherwise(F.lit(""))
    author = F.when(F.col("channel").isNotNull(), F.concat(F.lit("<author>"), tag("name", F.col("channel")), F.lit("</author>"))).otherwise(F.lit(""))
    entry = F.concat(F.lit("<entry>"), ident, tag("title", F.col("raw_title")), author, F.lit("</entry>"))
    path = new_folder(spark, "feed")
    feeds_ = u.groupBy(F.floor(F.col("id") / 1000).alias("block")).agg(F.array_join(F.sort_array(F.collect_list(entry)), "\n").alias("entries"))
    head = '<feed xmlns:yt="http://www.youtube.com/xml/schemas/2015">'
    whole = F.concat(F.lit(head), F.col("entries"), F.lit("</feed>"))
    feeds_.select("block", whole.alias("value")).write.partitionBy("block").text(path)
    return listings.ingest_feed_xml(spark, path)


OLD = """select track_id as id, case when track_id % 3 = 0 then cast(null as bigint) else external_id end as id_a, id_a as id_b, case when line_status = 'F' then 'done' else 'failed' end as status,
 id_b as job_id, cast(quantity as int) as duration_s, concat(substr(cast(shipped as varchar(30)), 1, 10), ' 00:00:00') as created_at from jobs"""
NOW = "select o_orderkey as id_a, cast(null as bigint) as id_b from orders where o_orderstatus = 'F' union all select null, p_partkey from part where p_size < 25"
FORMATS = "select s_suppkey as job_id, case s_suppkey % 4 when 0 then 'flac' when 1 then 'opus' when 2 then 'wav' else null end as format from supplier"


@registered(with_({**ctes("jobs"), "old": OLD, "cur": NOW, "formats": FORMATS,
  "k": "select *, case when id_a is not null then 'a' else 'b' end as kind, coalesce(id_a, id_b) as ext from old where status = 'done'",
  "known": "select 'a' as kind, id_a as ext from cur where id_a is not null union select 'b', id_b from cur where id_b is not null",
  "f": "select *, row_number() over (partition by kind, ext order by id) as rn from k anti join known using (kind, ext)"}, """
select id, case kind when 'a' then 'spotify' else 'youtube' end as provider, duration_s * 1000 as duration_ms,
 case coalesce(format, 'mp3') when 'mp3' then 'mp3-320' when 'flac' then 'flac' when 'opus' then 'opus' else 'mp3-320' end as format_preset,
 epoch_ms(cast(created_at as timestamp)) as position from f left join formats using (job_id) where rn = 1"""))
def import_legacy_history(spark: SparkSession, sf: str) -> DataFrame:
    view(spark, sf, "jobs").createOrReplaceTempView("jobs")
    for t in ("orders", "part", "supplier"):
        table(spark, sf, t).createOrReplaceTempView(t)
    out = listings.import_legacy_history(spark.sql(OLD), spark.sql(FORMATS), spark.sql(NOW))
    return out.select("id", "provider", "duration_ms", "format_preset", "position")


ARRIVED = """select o_custkey as source_id, o_orderkey as external_id, concat('New ', o_orderpriority) as title, case when o_orderkey % 2 = 0 then o_orderstatus end as album,
 cast(null as bigint) as duration_ms, o_orderkey * 2 as position, o_custkey % 3 = 0 as partial, o_custkey % 5 = 0 as truncated from orders where o_orderkey % 3 <> 0"""
EXISTING = """select o_custkey as source_id, o_orderkey as external_id, concat('Old ', o_orderpriority) as title, 'kept' as album,
 o_orderkey * 10 as duration_ms, o_orderkey as position, o_orderkey % 8 <> 0 as present from orders where o_orderkey % 4 <> 0"""
MERGED = """select coalesce(e.source_id, a.source_id) as source_id, coalesce(e.external_id, a.external_id) as external_id, coalesce(a.title, e.title) as title, coalesce(a.album, e.album) as album,
 coalesce(a.duration_ms, e.duration_ms) as duration_ms,
 case when a.external_id is null then e.position when a.partial then coalesce(e.position, coalesce(t.top, 0) + a.seen) else a.position end as position,
 a.external_id is not null or (e.present and not coalesce(h.full_listing, false)) as present
from existing e full join (select *, row_number() over (partition by source_id order by position, external_id) as seen from arrived) a on a.source_id = e.source_id and a.external_id = e.external_id
left join (select source_id, max(position) as top from existing group by 1) t on t.source_id = coalesce(e.source_id, a.source_id)
left join (select source_id, bool_and(not partial and not truncated) as full_listing from arrived group by 1) h on h.source_id = coalesce(e.source_id, a.source_id)"""
LISTING = {"arrived": ARRIVED, "existing": EXISTING}


def arrivals(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    return spark.sql(EXISTING), spark.sql(ARRIVED)


@registered(with_(LISTING, MERGED))
def stream_listing_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Two landings as a stream, the known items as a first listing and the new listings second."""
    existing, arrived = arrivals(spark, sf)
    cols = ["source_id", "external_id", "title", "album", "duration_ms", "position", "partial", "truncated", "listed_at"]
    known = existing.withColumns({"partial": F.lit(False), "truncated": F.lit(False), "listed_at": F.lit(1)}).select(cols)
    path, folder = new_folder(spark, "landing"), new_folder(spark, "items")
    known.write.parquet(path)
    stream = read_feed(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in known.schema))
    S.stream_listing_merge(stream, folder)
    arrived.withColumn("listed_at", F.lit(2)).select(cols).write.mode("append").parquet(path)
    return S.stream_listing_merge(stream, folder)


@registered(with_(LISTING, """select e.source_id, e.external_id from existing e join (select source_id from arrived group by 1 having bool_and(not partial and not truncated)) h using (source_id)
 where not exists (select 1 from arrived a where a.source_id = e.source_id and a.external_id = e.external_id)"""))
def removed_items(spark: SparkSession, sf: str) -> DataFrame:
    existing, arrived = arrivals(spark, sf)
    headers = arrived.groupBy("source_id").agg(F.bool_or("partial").alias("partial"), F.bool_or("truncated").alias("truncated"))
    return S.removed_items(existing, arrived, headers).select("source_id", "external_id")


HEADERS = "select c_custkey as source_id, c_name as name, (c_custkey % 4) * 45 as interval_minutes, false as truncated, 7 as item_count, cast(null as timestamp) as next_check_at from customer"


@registered(with_({"headers": HEADERS, "arrived": ARRIVED, "c": "select source_id, count(*) as seen, count(*) filter (where mod(external_id, 4) = 0) as fresh, bool_or(partial) as partial, bool_or(truncated) as trunc from arrived group by 1"}, """
select h.source_id, case when c.source_id is not null and mod(h.source_id, 7) <> 0 then 'L' || h.source_id else name end as name, h.interval_minutes,
 case when c.source_id is not null and mod(h.source_id, 7) <> 0 and not partial then trunc else truncated end as truncated,
 case when c.source_id is null or mod(h.source_id, 7) = 0 then item_count when partial then item_count + fresh else seen end as item_count,
 case when c.source_id is null then null when interval_minutes > 0 then timestamp '2024-03-01' + to_minutes(case when mod(h.source_id, 7) = 0 then least(interval_minutes, 60) else interval_minutes end) end as next_check_at,
 coalesce(c.source_id is not null and mod(h.source_id, 7) = 0, false) as failed
from headers h left join c using (source_id)"""))
def merge_headers(spark: SparkSession, sf: str) -> DataFrame:
    _, arrived = arrivals(spark, sf)
    table(spark, sf, "customer").createOrReplaceTempView("customer")
    per = arrived.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("seen"), F.count_if(F.col("external_id") % 4 == 0).alias("fresh"), F.bool_or("partial").alias("partial"), F.bool_or("truncated").alias("truncated")
    )
    heads = per.select("source_id", F.concat(F.lit("L"), "source_id").alias("name"), "partial", "truncated", (F.col("source_id") % 7 == 0).alias("failed"))
    return S.merge_headers(spark.sql(HEADERS), heads, per.select("source_id", "seen", "fresh"), F.lit("2024-03-01").cast("timestamp"))


@registered(with_(STATE_CTES, """select source_id, external_id, 1000 + row_number() over (order by source_id, position, external_id) - 1 as queue_position from states
where present and not ignored and state in ('new', 'cancelled')"""))
def enqueue_missing(spark: SparkSession, sf: str) -> DataFrame:
    return S.enqueue_missing(item_states(spark, sf), F.lit(1000)).select("source_id", "external_id", "queue_position")


