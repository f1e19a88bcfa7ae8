"""Releases, recordings, enrichment, album identity and genre votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import enrichment, rollups
from ..plans.durable import keep
from ..sources import listings
from . import registered
from .sql import LIVE, dice, markers, norm, primary, with_, words
from .views import ctes, table, view

KIND = f"""case when status = 'Bootleg' then 'bootleg' when secondary_type = 'Live' or regexp_matches(title, '{LIVE}') then 'live'
 when secondary_type = 'Compilation' then 'compilation' when primary_type = 'Album' then 'album' when primary_type = 'EP' then 'ep' when primary_type = 'Single' then 'single' else 'other' end"""
STUDIO = f"(status = 'Official' and primary_type = 'Album' and secondary_type is null and not regexp_matches(title, '{LIVE}'))"
WEIGHT = "case kind when 'album' then 1e0 when 'ep' then 0.7e0 when 'single' then 0.6e0 when 'soundtrack' then 0.5e0 when 'compilation' then 0.35e0 when 'live' then 0.2e0 when 'bootleg' then 0.1e0 else 0.3e0 end"
RANK = "(case when status = 'Official' then 0 else 2 end + case primary_type when 'Album' then 0 when 'EP' then 1 when 'Single' then 1 else 2 end + case when secondary_type is not null then 3 else 0 end)"
TYPED = f"select *, {KIND} as kind, {STUDIO} as studio, {RANK} as rank from releases"
CT = {**ctes("releases"), "typed": TYPED}


def releases(spark: SparkSession, sf: str) -> DataFrame:
    r = view(spark, sf, "releases")
    return r.withColumn(
        "secondary_types", F.when(F.col("secondary_type").isNotNull(), F.array("secondary_type")).otherwise(F.array().cast("array<string>"))
    )


def typed(spark: SparkSession, sf: str) -> DataFrame:
    rank = listings.release_rank(F.col("status"), F.col("primary_type"), F.col("secondary_types"))
    return enrichment.classify_release(releases(spark, sf)).withColumn("rank", rank)


@registered(with_(CT, f"select release_id, kind, studio, {WEIGHT} as kind_weight from typed"))
def classify_release(spark: SparkSession, sf: str) -> DataFrame:
    return typed(spark, sf).select("release_id", "kind", "studio", "kind_weight")


# the preferred album of a recording is the title of its last release
PREFER = "select recording_id, max_by(title, release_id) as prefer_album from releases where recording_id % 2 = 0 group by 1"


@registered(with_({**CT, "prefer": PREFER, "t": f"""select t.*, p.prefer_album, case when {norm('title')} = {norm('prefer_album')} and prefer_album <> '' then 0 when studio then 1 else 2 end as tier
 from typed t left join prefer p using (recording_id)"""}, """select recording_id, release_id, tier from (select *, row_number() over (partition by recording_id order by tier,
 case when tier = 1 then coalesce(released, '9999') end, rank, release_id) as rn from t) where rn = 1"""))
def pick_release(spark: SparkSession, sf: str) -> DataFrame:
    t = typed(spark, sf).withColumnRenamed("released", "date")
    t.createOrReplaceTempView("releases")
    prefer = spark.sql(PREFER)
    return enrichment.pick_release(t.join(prefer, "recording_id", "left")).select("recording_id", "release_id", "tier")


# every release is scored as a source for a query: the order's recording under a part name and brand
PAIRS = """select t.recording_id as q, t.release_id as recording_id, t.title, t.artist, t.duration_ms, 0.5e0 + t.score / 2 as score, t.kind, t.studio as has_studio,
 f.title as q_title, f.artist as q_artist, f.duration_ms as q_ms, t.release_id % 3 = 0 as verified, t.release_group, t.release_id, t.released
from typed t join (select recording_id, min_by(title, release_id) as title, min_by(artist, release_id) as artist, min_by(duration_ms, release_id) as duration_ms
                   from releases group by 1) f using (recording_id)"""
SPARK_PAIRS = PAIRS.replace("0.5e0", "0.5D")
_SIM_T = dice(words(norm("q_title")), words(norm("title")))
_SIM_A = dice(words(norm("q_artist")), words(norm("artist")))
_SAME = f"({primary('q_artist')} = {primary('artist')})"
_MARK = markers(norm("title"), norm("q_title"))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = keep(typed(spark, sf), "release-rows")
    rows.createOrReplaceTempView("releases")
    rows.createOrReplaceTempView("typed")
    return spark.sql(SPARK_PAIRS)


@registered(with_({**CT, "pairs": PAIRS}, f"""select q, recording_id from (select *, row_number() over (partition by q order by has_studio desc,
  case when q_ms > 0 and duration_ms > 0 then abs(q_ms - duration_ms) else 5000 end, score desc, recording_id) as rn from pairs
 where score >= 0.8e0 and abs(q_ms - duration_ms) <= greatest(15000e0, q_ms * 0.1e0) and {_SIM_T} >= 0.7e0 and {_MARK} = 0 and ({_SAME} or {_SIM_A} >= 0.6e0)) where rn = 1"""))
def match_recordings(spark: SparkSession, sf: str) -> DataFrame:
    return enrichment.match_recordings(pairs(spark, sf)).select("q", "recording_id")


@registered(with_({**CT, "pairs": PAIRS}, f"""select q, recording_id from (select *, row_number() over (partition by q order by has_studio desc, score desc, recording_id) as rn from pairs
 where score >= 0.85e0 and ({_SAME} or {_SIM_A} >= 0.5e0 or {_SIM_T} >= 0.5e0)) where rn = 1"""))
def match_by_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return enrichment.match_by_fingerprint(pairs(spark, sf)).select("q", "recording_id")


CONF = f"""select *, floor((case when verified then least(1e0, 0.55e0 + 0.25e0 * score + 0.2e0 * {WEIGHT}) else
 0.3e0 * {_SIM_T} * case when {_MARK} > 0 then 0.5e0 else 1e0 end + 0.2e0 * case when {_SAME} then 1e0 else {_SIM_A} end
 + 0.25e0 * greatest(0e0, least(1e0, 1e0 - (abs(q_ms - duration_ms) - 2000e0) / 20000e0)) + 0.25e0 * {WEIGHT} end) * 100 + 0.5e0) / 100e0 as confidence from pairs"""


@registered(with_({**CT, "pairs": PAIRS, "c": CONF}, "select q, release_id, confidence from c"))
def match_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return enrichment.match_confidence(pairs(spark, sf)).select("q", "release_id", "confidence")


@registered(with_({**CT, "pairs": PAIRS, "c": CONF, "o": """select *, row_number() over (partition by q, release_group order by confidence desc, coalesce(cast(substr(released, 1, 4) as int), 9999), release_id) as rn from c"""}, """
select q, release_id, place from (select *, row_number() over (partition by q order by confidence desc, cast(release_group as varchar)) as place from o where rn = 1) where place <= 30"""))
def album_options(spark: SparkSession, sf: str) -> DataFrame:
    c = enrichment.match_confidence(pairs(spark, sf)).withColumn("year", F.substring("released", 1, 4).try_cast("int"))
    return enrichment.album_options(c).select("q", "release_id", "place")


# ---- nested release candidates -----------------------------------------------------------------

NESTED = """select release_id as id, title, duration_ms as length, score * 100 as score,
 array(named_struct('name', artist, 'joinphrase', ' & '), named_struct('name', concat('Guest ', release_group), 'joinphrase', cast(null as string))) as credit,
 array(named_struct('id', concat(release_id, '-a'), 'title', title, 'date', released, 'country', 'XW', 'status', status,
         'credit', array(named_struct('name', artist, 'joinphrase', cast(null as string))),
         'group', named_struct('id', cast(release_group as string), 'primary_type', primary_type, 'secondary_types', case when secondary_type is null then array() else array(secondary_type) end),
         'media', array(named_struct('position', 1, 'track_count', 12, 'track_offset', cast(release_id % 12 as int), 'track', array(named_struct('number', 'A1', 'position', cast(null as int)))))),
       named_struct('id', concat(release_id, '-b'), 'title', concat(title, ' live'), 'date', '1990', 'country', cast(null as string), 'status', 'Bootleg',
         'credit', cast(null as array<struct<name: string, joinphrase: string>>),
         'group', named_struct('id', cast(null as string), 'primary_type', 'Single', 'secondary_types', cast(null as array<string>)),
         'media', array(named_struct('position', 2, 'track_count', 3, 'track_offset', cast(null as int), 'track', array(named_struct('number', '7', 'position', cast(null as int))))))) as releases
from releases"""


@registered(with_({**CT, "f": """select release_id as recording_id, artist || ' & Guest ' || release_group as artist, release_id || '-a' as release_id, cast(substr(released, 1, 4) as int) as year, release_group::varchar as release_group,
  artist as album_artist, mod(release_id, 12) + 1 as track_number, rank, coalesce(released, '9999') as d from typed
 union all select release_id, artist || ' & Guest ' || release_group, release_id || '-b', 1990, null, null, 7, 3, '1990' from typed"""}, """
select recording_id, artist, release_id, year, release_group, album_artist, track_number, rank, row_number() over (partition by recording_id order by rank, d, release_id) as place from f"""))
def flatten_release_candidates(spark: SparkSession, sf: str) -> DataFrame:
    view(spark, sf, "releases").createOrReplaceTempView("releases")
    flat = listings.flatten_release_candidates(spark.sql(NESTED))
    ranked = listings.rank_release_candidates(flat)
    return ranked.select("recording_id", "artist", "release_id", "year", "release_group", "album_artist", "track_number", "rank", "place")


# ---- votes -------------------------------------------------------------------------------------

_GENRES = {**ctes("genre_votes"), "n": "select entity, lower(name) as name, max(votes) as votes from genre_votes group by 1, 2",
  "strong": "select n.* from n join (select entity, max(votes) as top from n group by 1) using (entity) where votes >= greatest(1, top * 0.25e0)",
  "kept": "select * from strong s where not exists (select 1 from strong o where o.entity = s.entity and o.name <> s.name and (suffix(o.name, ' ' || s.name) or suffix(o.name, '-' || s.name)))",
  "placed": "select *, row_number() over (partition by entity order by votes desc, name) as place from kept"}
_CAP = "array_to_string(list_transform(string_split(name, ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')"


@registered(with_(_GENRES, f"select entity, place, {_CAP} as genre, votes from placed where place <= 3"))
def genre_vote(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.genre_vote(view(spark, sf, "genre_votes"))


# ---- enrichment --------------------------------------------------------------------------------

# catalog rows under part names; the candidates of a row are the releases of the order with its id
ENRICH_LIB = """select o_orderkey as id, p_name as title, p_brand as artist, case when o_orderkey % 3 = 0 then cast(null as varchar(9)) else p_name end as album,
 cast(null as varchar(9)) as album_artist, case when o_orderkey % 4 = 0 then 1980 end as year, cast(null as int) as track_number, cast(null as int) as track_total, 1 as disc_number,
 case when o_orderkey % 5 = 0 then 'Own' end as genre, p_size * 6000 as duration_ms, o_orderkey % 2 = 0 as has_artwork
from orders join (select l_orderkey, min(l_partkey) as pk from lineitem group by 1) l on l_orderkey = o_orderkey join part on p_partkey = pk"""
FOUND = {
    **CT, "lib": ENRICH_LIB,
    "cand": """select t.recording_id as id, t.title, t.artist, t.duration_ms, 0.5e0 + t.score / 2 as score, t.release_id as recording_id, t.kind, t.studio, t.released, t.release_group,
      mod(t.release_id, 2) = 0 as album_only from typed t""",
    "ok": f"""select c.*, l.title as q_title, l.artist as q_artist, l.duration_ms as q_ms from cand c join (select id, title, artist, duration_ms from lib) l using (id)
      where c.score >= 0.8e0 and abs(l.duration_ms - c.duration_ms) <= greatest(15000e0, l.duration_ms * 0.1e0)
       and {dice(words(norm('l.title')), words(norm('c.title')))} >= 0.7e0 and ({primary('l.artist')} = {primary('c.artist')} or {dice(words(norm('l.artist')), words(norm('c.artist')))} >= 0.6e0)""",
    "pick": """select * from (select *, row_number() over (partition by id order by album_only desc, studio desc, abs(q_ms - duration_ms), score desc, recording_id) as rn from ok) where rn = 1""",
    "conf": f"""select *, false as verified, floor((0.3e0 * {_SIM_T} + 0.2e0 * case when {_SAME} then 1e0 else {_SIM_A} end
      + 0.25e0 * greatest(0e0, least(1e0, 1e0 - (abs(q_ms - duration_ms) - 2000e0) / 20000e0)) + 0.25e0 * {WEIGHT}) * 100 + 0.5e0) / 100e0 as confidence from pick""",
    "merged": f"""select l.*, c.recording_id, c.confidence, coalesce(c.title, l.title) as m_title,
      case when c.title is not null and {primary('l.artist')} = {primary('c.artist')} then c.artist else l.artist end as m_artist,
      coalesce(c.title, l.album) as m_album, coalesce(f.first_year, cast(substr(c.released, 1, 4) as int), l.year) as m_year, mod(c.recording_id, 20) + 1 as m_track_total,
      coalesce(l.genre, case when c.title is not null then 'Group ' || mod(c.release_group, 7) end) as m_genre from lib l left join conf c using (id)
      left join (select release_group, min(cast(substr(released, 1, 4) as int)) as first_year from typed group by 1) f on f.release_group = c.release_group""",
}


def found_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    for t in ("orders", "lineitem", "part"):
        table(spark, sf, t).createOrReplaceTempView(t)
    lib = spark.sql(ENRICH_LIB)
    r = keep(releases(spark, sf).withColumn("rank", F.lit(0)), "release-rows")  # both sides are made of it
    cand = r.select(
        F.col("recording_id").alias("id"), F.col("release_id").alias("recording_id"), "title", "artist", F.col("artist").alias("artist_id"),
        "duration_ms", (0.5 + F.col("score") / 2).alias("score"), (F.col("release_id") % 2 == 0).alias("album_only"),
    )
    rel = r.select(
        F.col("release_id").alias("recording_id"), "release_id", "title", F.col("released").alias("date"),
        F.substring("released", 1, 4).try_cast("int").alias("year"), "rank", "status", "primary_type", "secondary_types", "release_group",
        F.lit(None).cast("string").alias("album_artist"), F.lit(None).cast("int").alias("track_number"), F.lit(None).cast("int").alias("disc_number"),
        (F.col("release_id") % 20 + 1).alias("track_total"),
    )
    groups = r.select("release_group").distinct()
    genres = groups.select(F.col("release_group").alias("entity"), F.lit(1).alias("place"), F.concat(F.lit("Group "), F.col("release_group") % 7).alias("genre"))
    return lib, cand, rel, genres


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    return enrichment.enrich_catalog(*found_sides(spark, sf))


@registered(with_(FOUND, "select id, title, artist, title as album, duration_ms from pick"))
def identify_recordings(spark: SparkSession, sf: str) -> DataFrame:
    lib, cand, rel, _ = found_sides(spark, sf)
    return enrichment.identify_recordings(lib, cand, rel).select("id", "title", "artist", "album", "duration_ms")


@registered(with_(FOUND, "select id, recording_id, confidence, m_title, m_artist, m_album, m_year, m_track_total, m_genre from merged"))
def enrich_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return enriched(spark, sf).select("id", "recording_id", "confidence", "m_title", "m_artist", "m_album", "m_year", "m_track_total", "m_genre")


@registered(with_(FOUND, """select id, case when recording_id is null then 'unmatched' when confidence >= 0.7e0 then 'staged' else 'review' end as route,
 recording_id is not null and not has_artwork as takes_artwork from merged"""))
def route_matches(spark: SparkSession, sf: str) -> DataFrame:
    return enrichment.route_matches(enriched(spark, sf)).select("id", "route", "takes_artwork")


@registered(with_(FOUND, " union all ".join(
    f"select id, '{f}' as field, coalesce(cast({f} as varchar), '') as before, coalesce(cast(m_{f} as varchar), cast({f} as varchar), '') as after, "
    f"coalesce(cast({f} as varchar), '') <> coalesce(cast(m_{f} as varchar), cast({f} as varchar), '') as changed from merged where recording_id is not null"
    for f in ("title", "artist", "album", "year", "genre"))))
def match_diff(spark: SparkSession, sf: str) -> DataFrame:
    return enrichment.match_diff(enriched(spark, sf), ("title", "artist", "album", "year", "genre"))


# ---- album identity ----------------------------------------------------------------------------

# rows come in with shouted artists and titles; half the albums are known to the catalog
INCOMING = """select doc_id as seq, case when doc_id % 4 = 0 then null else upper(source) end as album_artist, source as artist,
 case when doc_id % 9 = 0 then null when doc_id % 2 = 0 then upper(concat(source, ' ', lang)) else concat('Unknown ', source, ' ', lang) end as album,
 case when doc_id % 3 = 0 then concat('rel', doc_id) end as release_id from documents"""
LIB = "select album_artist, album, case when id % 2 = 0 then concat('r', id % 3) end as mb_release_id from catalog"


@registered(with_({**ctes("catalog"), "lib": LIB, "incoming": INCOMING,
  "i": f"select *, coalesce(album_artist, artist) as own, {norm('coalesce(album_artist, artist)')} as who, lower(album) as alb, {norm('album')} as nalb from incoming",
  "k": f"select lower(album) as alb, {norm('album_artist')} as who, album_artist, album, mb_release_id from lib where album is not null",
  "pa": "select alb, who, album_artist as p_artist from (select *, row_number() over (partition by alb, who order by n desc, album_artist) as rn from (select alb, who, album_artist, count(*) as n from k where album_artist <> '' group by 1, 2, 3)) where rn = 1",
  "pb": "select alb, who, album as p_album from (select *, row_number() over (partition by alb, who order by n desc, album) as rn from (select alb, who, album, count(*) as n from k where album <> '' group by 1, 2, 3)) where rn = 1",
  "pr": "select alb, who, mb_release_id as p_release from (select *, row_number() over (partition by alb, who order by n desc, mb_release_id) as rn from (select alb, who, mb_release_id, count(*) as n from k where mb_release_id <> '' group by 1, 2, 3)) where rn = 1",
  "sp": "select low, album_artist as spelling from (select *, row_number() over (partition by low order by n desc, album_artist) as rn from (select lower(album_artist) as low, album_artist, count(*) as n from lib where album_artist is not null group by 1, 2)) where rn = 1",
  "j": """select i.*, p_artist, p_album, p_release, coalesce(spelling, own) as spelling from i left join pa using (alb, who) left join pb using (alb, who) left join pr using (alb, who) left join sp on sp.low = lower(i.own)""",
  "f": """select who, nalb, arg_min(coalesce(p_artist, spelling), seq) as f_artist, arg_min(coalesce(p_album, album), seq) as f_album, arg_min(coalesce(p_release, release_id), seq) filter (where coalesce(p_release, release_id) is not null) as f_release,
     min(seq) filter (where coalesce(p_release, release_id) is not null) as f_seq from j where album is not null group by 1, 2"""}, """
select seq, case when album is null then spelling else coalesce(p_artist, f_artist) end as out_album_artist, case when album is not null then coalesce(p_album, f_album) end as out_album,
 case when album is null then release_id else coalesce(p_release, case when f_seq <= seq then f_release end, release_id) end as out_release_id from j left join f using (who, nalb)"""))
def album_identity(spark: SparkSession, sf: str) -> DataFrame:
    view(spark, sf, "catalog").createOrReplaceTempView("catalog")
    table(spark, sf, "documents").createOrReplaceTempView("documents")
    out = enrichment.album_identity(spark.sql(INCOMING), spark.sql(LIB))
    return out.select("seq", "out_album_artist", "out_album", "out_release_id")


@registered(with_(ctes("catalog"), """select id, coalesce(case when mod(id, 3) = 0 then 'Source Title' end, nullif(title, ''), 'Guess') as f_title,
 coalesce(nullif(album, ''), case when mod(id, 3) = 0 then 'Source Album' end) as f_album from catalog"""))
def fill_gaps_by_precedence(spark: SparkSession, sf: str) -> DataFrame:
    c = view(spark, sf, "catalog").withColumns(
        {
            "source_title": F.when(F.col("id") % 3 == 0, "Source Title"), "source_album": F.when(F.col("id") % 3 == 0, "Source Album"),
            "guess_title": F.lit("Guess"),
        }
    )
    out = enrichment.fill_gaps_by_precedence(c, ["", "source_", "guess_"], {"title": "source,base,guess", "album": "base,source"})
    return out.select("id", "f_title", "f_album")


