"""Match keys, titles, bulk edits, filename parsing, link parsing and path plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..operators import edits, linkage, ordering
from . import registered
from .sql import clean, match_key, norm, primary, split_title, truthy, with_
from .views import ctes, table, view


@registered(with_(ctes("uploads"), f"""select id, {clean('raw_title')} as clean_title, {norm('channel')} as norm_artist, {norm('raw_title')} as norm_title,
 {primary('channel')} as primary_artist, {match_key('channel', 'raw_title')} as match_key from uploads"""))
def build_match_keys(spark: SparkSession, sf: str) -> DataFrame:
    out = linkage.build_match_keys(view(spark, sf, "uploads"), "channel", "raw_title")
    return out.select("id", "clean_title", "norm_artist", "norm_title", "primary_artist", "match_key")


_ARTIST, _TITLE = split_title("raw_title", "channel")


@registered(with_(ctes("uploads"), f"select id, {_ARTIST} as guess_artist, {_TITLE} as guess_title from uploads"))
def split_titles(spark: SparkSession, sf: str) -> DataFrame:
    return linkage.split_titles(view(spark, sf, "uploads"), "raw_title", "channel").select("id", "guess_artist", "guess_title")


_SMALL = "(" + ",".join(f"'{w}'" for w in fv.SMALL_WORDS) + ")"


def _title_case(e: str) -> str:
    """Title case of text that is words and single blanks only."""
    lead = "regexp_extract(lower(w), '^([^\\p{L}]*)', 1)"
    cap = f"{lead} || upper(substr(lower(w), length({lead}) + 1, 1)) || substr(lower(w), length({lead}) + 2)"
    return (
        f"array_to_string(list_transform(string_split({e}, ' '), lambda w, i: case when not regexp_matches(w, '\\p{{L}}') then w "
        f"when regexp_full_match(w, '[A-Z0-9]{{2,}}') then w when regexp_full_match(w, '(?i)(?:i{{2,3}}|iv|vi{{1,3}}|ix|xi{{0,3}})') then upper(w) "
        f"when i > 1 and i < len(string_split({e}, ' ')) and lower(w) in {_SMALL} then lower(w) else replace({cap}, 'ẞ', 'SS') end), ' ')"
    )


def _cells(fields: tuple[str, ...], after: str) -> str:
    return " union all ".join(
        f"select id, '{f}' as field, coalesce(cast({f} as varchar), '') as before, {after.format(c=f'coalesce(cast({f} as varchar), {chr(39) * 2})')} as after from catalog"
        for f in fields
    )


@registered(with_({**ctes("catalog"),
  "lit": _cells(("album", "artist"), "regexp_replace({c}, '(?i)SRC1', 'a$b', 'g')"),
  "rx": _cells(("title", "rel_path"), r"regexp_replace({c}, '([a-z])([0-9]+)', '\2-\1', 'g')"),
  "cased": f"select id, 'title' as field, title as before, {_title_case('title')} as after from catalog"}, """
select 'literal' as edit, * from lit where before <> after union all select 'regex', * from rx where before <> after
union all select 'case', * from cased where before <> after"""))
def bulk_transform(spark: SparkSession, sf: str) -> DataFrame:
    c = view(spark, sf, "catalog")
    literal = edits.bulk_transform(c, ["album", "artist"], {"kind": "replace", "find": "SRC1", "replace": "a$b", "case_sensitive": False})
    regex = edits.bulk_transform(c, ["title", "rel_path"], {"kind": "replace", "find": "([a-z])([0-9]+)", "replace": "$2-$1", "regex": True})
    cased = edits.bulk_transform(c, ["title"], {"kind": "case", "mode": "title"})
    return (
        literal.withColumn("edit", F.lit("literal"))
        .unionByName(regex.withColumn("edit", F.lit("regex")))
        .unionByName(cased.withColumn("edit", F.lit("case")))
    )


_NAME = r"regexp_replace(rel_path, '\.[^.]+$', '')"
_FLAT = f"replace({_NAME}, '/', ' - ')"
_RX = r"(?i)^(.+?)\s*-\s*(.+?)\s*-\s*(\d+)$"


@registered(with_(ctes("catalog"), f"""select id, regexp_matches({_FLAT}, '{_RX}') as parsed,
 case when regexp_matches({_FLAT}, '{_RX}') then trim(regexp_extract({_FLAT}, '{_RX}', 1)) end as p_artist,
 case when regexp_matches({_FLAT}, '{_RX}') then trim(regexp_extract({_FLAT}, '{_RX}', 2)) end as p_album,
 case when regexp_matches({_FLAT}, '{_RX}') then trim(regexp_extract({_FLAT}, '{_RX}', 3)) end as p_track_number from catalog"""))
def parse_filenames(spark: SparkSession, sf: str) -> DataFrame:
    out = edits.parse_filenames(view(spark, sf, "catalog"), "%artist% - %album% - %track%", use_folder=True)
    return out.select("id", "parsed", "p_artist", "p_album", "p_track_number")


@registered(with_(ctes("hits"), """select hit_id, case when g <> '' then g else name end as guess_title, user_name as guess_artist,
 regexp_extract(file, ' - ([a-z]+) ', 1) as guess_album, cast(regexp_extract(file, '/([0-9]+) - [^/]*$', 1) as int) as guess_track_number
from (select *, regexp_extract(file, '([^/]+)$', 1) as name, trim(regexp_extract(file, '/[0-9]+ - ([^/]*)\\.[a-z0-9]+$', 1)) as g from hits) where g <> ''"""))
def guess_tags_from_paths(spark: SparkSession, sf: str) -> DataFrame:
    # hits without a title have nothing after the number, which then is no lead
    named = view(spark, sf, "hits").where(~F.col("file").rlike(r"/[0-9]+ - \.[a-z0-9]+$"))
    out = linkage.guess_tags_from_paths(named, "file")
    return out.select("hit_id", "guess_title", "guess_artist", "guess_album", "guess_track_number")


_SEG = lambda e: rf"""coalesce(nullif(regexp_replace(regexp_replace(regexp_replace({e}, '[<>:"/\\|?*]', '_', 'g'), '\s+', ' ', 'g'), '^[.\s]+|[.\s]+$', '', 'g'), ''), '_')"""
_OR = lambda *cs: "coalesce(" + ", ".join(f"case when {truthy(c)} then cast({c} as varchar) end" for c in cs) + ", '')"
_FOLDER = "coalesce(album_artist, artist)"
_TAIL = f"case when {truthy('track_number')} then lpad(cast(track_number as varchar), greatest(2, length(cast(track_number as varchar)))::int, '0') || ' - ' else '' end || {_OR('title')}"
_ALB = "case when " + truthy("album") + " then album else 'Singles' end"
RENDERED = f"select *, {_SEG(_FOLDER)} || '/' || {_SEG(_ALB)} || case when trim({_TAIL}) <> '' then '/' || {_SEG(f'trim({_TAIL})')} else '' end as rendered from catalog"


@registered(with_({**ctes("catalog"), "r": RENDERED}, "select id, rendered from r"))
def render_paths(spark: SparkSession, sf: str) -> DataFrame:
    return edits.render_paths(view(spark, sf, "catalog")).select("id", "rendered")


@registered(with_({**ctes("catalog"), "r": RENDERED, "w": "select id, rel_path, rendered as stem, '.' || format as ext, row_number() over (partition by rendered, format order by id) as nth from r"}, """
select id, rel_path as from_path, stem || case when nth > 1 then ' (' || nth || ')' else '' end || ext as to_path, true as changed from w"""))
def plan_reorganize(spark: SparkSession, sf: str) -> DataFrame:
    return edits.plan_reorganize(view(spark, sf, "catalog"))


COLLIDE_PLAN = "select doc_id as id, concat('old/', doc_id) as from_path, concat('new/', source, '.mp3') as to_path from documents"
COLLIDE_TAKEN = "select distinct concat('new/', source, case lang when 'en' then '' when 'fr' then ' (3)' when 'de' then ' (4)' else ' (9)' end, '.mp3') as path from documents"


@registered(with_({"plan": COLLIDE_PLAN, "taken": COLLIDE_TAKEN,
  "busy": r"select regexp_replace(path, '( \(\d+\))?\.mp3$', '.mp3') as to_path, coalesce(try_cast(regexp_extract(path, ' \((\d+)\)', 1) as bigint), 1) as n from taken",
  "slots": "select to_path, n from (select to_path, unnest(range(1, cnt + 20)) as n from (select to_path, count(*) as cnt from plan group by 1)) anti join busy using (to_path, n)",
  "free": "select to_path, n, row_number() over (partition by to_path order by n) as k from slots",
  "t": "select *, row_number() over (partition by to_path order by id) as k from plan"}, """
select t.id, t.from_path, case when n = 1 then t.to_path else regexp_replace(t.to_path, '\\.mp3$', '') || ' (' || n || ').mp3' end as to_path, true as changed from t join free using (to_path, k)"""))
def resolve_path_collisions(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "documents").createOrReplaceTempView("documents")
    return ordering.resolve_path_collisions(spark.sql(COLLIDE_PLAN).withColumn("changed", F.lit(True)), spark.sql(COLLIDE_TAKEN))


# page links, plus links of the known providers made from page numbers
LINK_TEXT = """select page_id as id, concat(url, ', https://youtu.be/', substr(md5(url), 1, 11), '?t=3 https://www.youtube.com/watch?v=', substr(md5(url), 1, 11),
 ' https://open.spotify.com/intl-de/album/', substr(md5(url), 1, 22), ' spotify:track:', substr(md5(url), 2, 22), ' music.youtube.com/playlist?list=',
 case when page_id % 2 = 0 then 'OLAK5uy_' else 'PL' end, substr(md5(url), 1, 9), ' https://m.youtube.com/@name', page_id, '/videos junk') as text from pages"""


@registered(with_({"t": LINK_TEXT, "p": "select page_id as id, substr(md5(url), 1, 11) as v, substr(md5(url), 1, 22) as a, substr(md5(url), 2, 22) as s, case when mod(page_id, 2) = 0 then 'OLAK5uy_' else 'PL' end || substr(md5(url), 1, 9) as l, url as u from pages"}, """
select id, 1 as seq, 'youtube' as provider, 'track' as kind, v as link_id, 'https://www.youtube.com/watch?v=' || v as url, true as valid from p
union all select id, 3, 'spotify', 'album', a, 'https://open.spotify.com/album/' || a, true from p
union all select id, 4, 'spotify', 'track', s, 'https://open.spotify.com/track/' || s, true from p
union all select id, 5, 'youtube', case when starts_with(l, 'OLAK') then 'album' else 'playlist' end, l, 'https://www.youtube.com/playlist?list=' || l, true from p
union all select id, 6, 'youtube', 'channel', '@name' || id, 'https://www.youtube.com/@name' || id, true from p
union all select id, 0, null, null, null, null, false from p union all select id, 7, null, null, null, null, false from p"""))
def parse_links(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "pages").createOrReplaceTempView("pages")
    return linkage.parse_links(spark.sql(LINK_TEXT), "text").drop("token")


# ---- staged edits ------------------------------------------------------------------------------

# every row has a patch: title set (sometimes to itself), year numeric, invalid or cleared, genre in "A; B" form
PATCHES = """select id, case when id % 4 = 0 then title else concat(' New ', id, ' ') end as s_title,
 case id % 5 when 0 then '2001.4' when 1 then 'abc' when 2 then '' else '1999' end as s_year, case when id % 3 = 0 then 'Rock ;Pop; ' end as s_genre from catalog"""


def patches(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = view(spark, sf, "catalog")
    c.createOrReplaceTempView("catalog")
    patch = F.map_from_arrays(
        F.array(F.lit("title"), F.lit("year"), F.lit("genre")), F.array("s_title", "s_year", "s_genre")
    )
    return c, spark.sql(PATCHES).select("id", patch.alias("patch"))


@registered(with_({**ctes("catalog"), "s": PATCHES, "v": """select c.id, c.title, c.year, c.genre, s.s_title as n_title,
 case mod(c.id, 5) when 0 then '2001' when 1 then cast(c.year as varchar) when 2 then null else '1999' end as n_year, s.s_genre as n_genre from catalog c join s using (id)"""}, """
select id, nullif(case when coalesce(n_title, '') <> coalesce(title, '') then n_title else title end, '~') as v_title, case when coalesce(n_year, '') <> coalesce(cast(year as varchar), '') then n_year else cast(year as varchar) end as v_year,
 case when coalesce(n_genre, '') <> coalesce(genre, '') then n_genre else genre end as v_genre,
 concat_ws(',', case when coalesce(n_title, '') <> coalesce(title, '') then 'title' end, case when coalesce(n_year, '') <> coalesce(cast(year as varchar), '') then 'year' end,
  case when coalesce(n_genre, '') <> coalesce(genre, '') then 'genre' end) as dirty from v"""))
def overlay_edits(spark: SparkSession, sf: str) -> DataFrame:
    base, staged = patches(spark, sf)
    return edits.overlay_edits(base, staged, ["title", "year", "genre"]).select("id", "v_title", "v_year", "v_genre", "dirty")


@registered(with_({**ctes("catalog"), "s": PATCHES}, """select id, nullif(trim(s_title), '') as title,
 case mod(id, 5) when 0 then 2001 when 1 then null when 2 then null else 1999 end as year, case when s_genre is not null then 'Rock; Pop' end as genre from s"""))
def apply_edits(spark: SparkSession, sf: str) -> DataFrame:
    base, staged = patches(spark, sf)
    return edits.apply_edits(base, staged)["library"].select("id", "title", "year", "genre")


EDITS = """select case when id % 11 = 0 then id + 1000000 else id end as id, case when id % 3 = 0 then concat('img', id % 2) end as art, id % 4 = 0 as sings,
 case when id % 8 = 0 then ' ' else 'la la' end as words, id % 5 = 0 as named, concat('r', id) as release, case when id % 7 = 0 then 'NaN' else ' 1990' end as year from catalog"""
EDITED = {**ctes("catalog"), "e": EDITS, "good": "select * from e where art is null or art <> 'img1'"}


def edited(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Edits of tags, lyrics, ids and artwork; one of the two pictures cannot be fetched, some files are unknown."""
    view(spark, sf, "catalog").createOrReplaceTempView("catalog")
    none = F.lit(None).cast("string")
    pair = lambda when, key, value: F.when(when, F.struct(F.lit(key).alias("key"), value.alias("value")))
    entries = F.array_compact(F.array(
        pair(F.col("art").isNotNull(), "artwork_url", F.col("art")), pair(F.col("sings"), "lyrics", F.col("words")),
        pair(F.col("named"), "mb_release_id", F.col("release")), pair(F.lit(True), "year", F.col("year")),
    ))
    base = view(spark, sf, "catalog").withColumns({"lyrics": none, "mb_release_id": none})
    asked = spark.sql(EDITS).select("id", F.map_from_entries(entries).alias("patch"))
    images = table(spark, sf, "region").select(F.concat(F.lit("img"), F.col("r_regionkey") * 2).alias("url"), (F.col("r_regionkey") == 0).alias("ok"))
    return edits.apply_edits(base, asked, images)


@registered(with_(EDITED, """select c.id, case when g.id is null or g.year = 'NaN' then c.year else 1990 end as year, case when g.named then g.release end as mb_release_id, case when g.sings then g.words end as lyrics,
 c.has_artwork or g.art is not null as has_artwork, case when g.sings then trim(g.words) <> '' else c.has_lyrics end as has_lyrics from catalog c left join good g on g.id = c.id"""))
def apply_edits_fields(spark: SparkSession, sf: str) -> DataFrame:
    return edited(spark, sf)["library"].select("id", "year", "mb_release_id", "lyrics", "has_artwork", "has_lyrics")


@registered(with_(EDITED, "select c.id, 'retag' as kind, c.rel_path as from_path, c.rel_path as to_path, g.year, g.art from good g join catalog c on c.id = g.id"))
def apply_edits_log(spark: SparkSession, sf: str) -> DataFrame:
    detail = lambda key, name: F.try_element_at("detail", F.lit(key)).alias(name)
    return edited(spark, sf)["log"].select("id", "kind", "from_path", "to_path", detail("year", "year"), detail("artwork_url", "art"))


@registered(with_(EDITED, """select id, 'file not found' as error from e where id not in (select id from catalog)
 union all select id, 'Could not download artwork' from e where art = 'img1' and id in (select id from catalog)
 union all select id, 'year is no number' from good where year = 'NaN' and id in (select id from catalog)"""))
def apply_edits_errors(spark: SparkSession, sf: str) -> DataFrame:
    return edited(spark, sf)["errors"]
