"""Lookups, scored matching, shared-file search and fingerprint checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import linkage, lookups, ordering, rollups
from . import registered
from .sql import clean, coverage, dice, markers, match_key, norm, primary, truthy, with_, words
from .views import ctes, table, view

# ---- existence and state -----------------------------------------------------------------------

WANTED = """select doc_id as item_id, upper(source) as artist, concat(regexp_extract(text, '([A-Za-zÀ-ÿ]+ [A-Za-zÀ-ÿ]+ [A-Za-zÀ-ÿ]+)', 1),
 case when doc_id % 3 = 0 then ' (Official Video)' when doc_id % 3 = 1 then ' - Mono' else ' more' end) as title from documents"""


@registered(with_({**ctes("keyed"), "wanted": WANTED, "w": f"select item_id, {match_key('artist', 'title')} as match_key from wanted"}, """
select w.item_id, w.match_key, h.id as existing_id from w left join (select match_key, min(id) as id from keyed where match_key is not null group by 1) h using (match_key)"""))
def lookup_existing(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "documents").createOrReplaceTempView("documents")
    wanted = spark.sql(WANTED).select("item_id", T.match_key(F.col("artist"), F.col("title")).alias("match_key"))
    return lookups.lookup_existing(wanted, view(spark, sf, "keyed")).select("item_id", "match_key", "existing_id")


@registered(with_(ctes("orders_hist"), """select id, status, force from orders_hist j where force or not (
 exists (select 1 from orders_hist d where d.status = 'done' and d.id_a = j.id_a and d.id <> j.id)
 or exists (select 1 from orders_hist d where d.status = 'done' and d.id_b = j.id_b and d.id <> j.id))"""))
def skip_already_done(spark: SparkSession, sf: str) -> DataFrame:
    h = view(spark, sf, "orders_hist")
    return lookups.skip_already_done(h, h).select("id", "status", "force")


UPGRADE_JOBS = "select event_id as track_id, user_id * 5 as upgrade_of, case event_type when 'purchase' then 'done' when 'error' then 'failed' else 'queued' end as status from events where value > 90"


@registered(with_({**ctes("catalog"), "t": UPGRADE_JOBS}, f"""select id, case when coalesce(lossless, false) then 'already lossless'
 when id in (select upgrade_of from t where status not in ('done', 'failed', 'skipped', 'cancelled')) then 'already queued'
 when not {truthy('title')} or not {truthy('artist')} then 'needs title and artist' else 'candidate' end as outcome from catalog"""))
def upgrade_candidates(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "events").createOrReplaceTempView("events")
    return lookups.upgrade_candidates(view(spark, sf, "catalog"), spark.sql(UPGRADE_JOBS)).select("id", "outcome")


# ---- search ------------------------------------------------------------------------------------

# every benchmark passage and every catalog title is looked for among the documents, by all its words
DOC_WORDS = f"select doc_id, {words(norm('text'))} as words from documents"
QUERY_WORDS = f"select item_id as query_id, {words(norm('text'))} as words from benchmark union all select 100000 + id, {words(norm('title'))} from catalog"


def search_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("words"))
    passages = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), T.tokens(F.col("text")).alias("words"))
    titles = view(spark, sf, "catalog").select((F.col("id") + 100000).alias("query_id"), T.tokens(F.col("title")).alias("words"))
    return passages.unionByName(titles), docs


@registered(with_({**ctes("catalog"), "d": DOC_WORDS, "q": QUERY_WORDS}, """
select query_id, doc_id from q join d on list_has_all(d.words, q.words) where len(q.words) > 0"""))
def all_words_search(spark: SparkSession, sf: str) -> DataFrame:
    queries, docs = search_sides(spark, sf)
    return lookups.all_words_search(queries, docs)


TOKEN_DICE = 0.8


@registered(with_({"w": f"select doc_id as id, {words(norm('text'))} as w from documents", "s": "select id, w from w where len(w) > 0"}, f"""
select x.id as a, y.id as b, {dice('x.w', 'y.w')} as dice from s x join s y on x.id < y.id where {dice('x.w', 'y.w')} >= {TOKEN_DICE}e0"""))
def token_similarity_join(spark: SparkSession, sf: str) -> DataFrame:
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), T.tokens(F.col("text")).alias("words"))
    return lookups.token_similarity_join(texts, TOKEN_DICE, every_pair=True)


PLAN_TARGETS = """select id as target_id, concat(title, case id % 4 when 0 then ' (feat. Guest) [Official Video]' when 1 then '' else ' ft. Other' end) as title,
 concat(artist, ', Friend') as artist, case when id % 2 = 0 then artist end as lead, concat(album, case when id % 3 = 0 then ' (Deluxe)' else '' end) as album from catalog"""
_BASE_ALBUM = rf"case when album <> '' then coalesce(nullif(trim(regexp_replace(album, '(?:\s*[(\[][^)\]]*[)\]])+\s*$', '')), ''), album) end"
_LONG = lambda e: f"list_filter(string_split({norm(e)}, ' '), lambda w: length(w) > 1)"
_FAMILIAR = lambda x: f"(len({x}) >= 2 or coalesce(length({x}[1]), 0) >= 8)"


@registered(with_({**ctes("catalog"), "targets": PLAN_TARGETS,
  "w": f"select target_id, {_LONG('coalesce(lead, artist)')} as a, {_LONG(clean('title'))} as t, {_LONG(f'coalesce({_BASE_ALBUM}, {chr(39) * 2})')} as b from (select target_id, title, artist, lead, case when mod(target_id, 11) = 0 then null else album end as album from targets)",
  "steps": f"""select target_id, 1 as o, 'artist + title' as label, array_to_string(list_concat(a, t), ' ') as query from w
   union all select target_id, 2, 'title only', array_to_string(t, ' ') from w where {_FAMILIAR('t')}
   union all select target_id, 2, 'title + album', (select string_agg(x, ' ' order by i) from (select x, min(i) as i from (select unnest(list_concat(t, b)) as x, generate_subscripts(list_concat(t, b), 1) as i) group by x)) from w where not {_FAMILIAR('t')} and len(b) > 0
   union all select target_id, 3, 'artist + album', array_to_string(list_concat(a, b), ' ') from w where len(b) > 0
   union all select target_id, 4, 'album only', array_to_string(b, ' ') from w where len(b) > 0 and {_FAMILIAR('b')}""",
  "kept": "select *, row_number() over (partition by target_id, query order by o) as rn from steps where query <> ''"}, """
select target_id, row_number() over (partition by target_id order by o) as step, label, query from kept where rn = 1"""))
def search_plan(spark: SparkSession, sf: str) -> DataFrame:
    view(spark, sf, "catalog").createOrReplaceTempView("catalog")
    t = spark.sql(PLAN_TARGETS).withColumn("artists", F.when(F.col("lead").isNotNull(), F.array("lead")))
    return linkage.search_plan(t.withColumn("album", F.when(F.col("target_id") % 11 != 0, F.col("album"))))


# ---- candidates --------------------------------------------------------------------------------

_CLEAN = clean("cand_title")
SCORED = f"""select *, greatest(0e0, least(1e0,
  case when dur is null then 0.55e0 * title + 0.45e0 * artist else 0.35e0 * title + 0.25e0 * artist + 0.4e0 * dur end
  - 0.4e0 * {markers('raw', 'tt')} + case when suffix(channel, ' - Topic') then 0.08e0 else 0e0 end + case when trusted then 0.08e0 else 0e0 end
  + case when regexp_matches(cand_title, '(?i)official audio') then 0.04e0 else 0e0 end)) as score from (
 select *, greatest({dice('ttw', 'ctw')}, {dice('atw', 'ctw')}) as title, {coverage('aw', 'allw')} as artist,
   case when gap is null then null when gap <= 2 then 1e0 when gap >= 30 then 0e0 else 1e0 - (gap - 2e0) / 28e0 end as dur from (
  select *, {words('tt')} as ttw, {words(norm("target_artist || ' ' || target_title"))} as atw, {words(norm(_CLEAN))} as ctw, {norm('cand_title')} as raw,
   {words(norm("' ' || coalesce(channel, '') || ' ' || cand_title"))} as allw, {words(norm('target_artist'))} as aw,
   case when target_ms > 0 and cand_sec > 0 then abs(target_ms / 1000e0 - cand_sec) end as gap
  from (select *, {norm('target_title')} as tt from candidates)))"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    c = view(spark, sf, "candidates").withColumns(
        {
            "target_artists": F.lit(None).cast("array<string>"),
            "cand_track": F.lit(None).cast("string"),
            "cand_artist": F.lit(None).cast("string"),
        }
    )
    return linkage.score_candidates(c)


@registered(with_({**ctes("candidates"), "scored": SCORED}, "select target_id, cand_id, floor(score * 1e6 + 0.5e0) / 1e6 as score from scored"))
def score_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("target_id", "cand_id", (F.floor(F.col("score") * 1e6 + 0.5) / 1e6).alias("score"))


RANKED = "select *, row_number() over (partition by target_id order by floor(score * 1e6 + 0.5e0) desc, cand_id) as place from scored"


@registered(with_({**ctes("candidates"), "scored": SCORED, "ranked": RANKED}, "select target_id, cand_id, place from ranked where place <= 6"))
def rank_candidates(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf).withColumn("score", F.floor(F.col("score") * 1e6 + 0.5))
    return ordering.rank_candidates(s).select("target_id", "cand_id", "place")


# the trusted list repeats some results of the general one
@registered(with_(ctes("candidates"), """select target_id, cand_id, bool_or(t) as trusted from (select target_id, cand_id, true as t from candidates where trusted
 union all select target_id, cand_id, false from candidates) group by 1, 2"""))
def candidate_union(spark: SparkSession, sf: str) -> DataFrame:
    c = view(spark, sf, "candidates").select("target_id", "cand_id", "trusted")
    return linkage.candidate_union(c.where("trusted").drop("trusted"), c.drop("trusted"))


FOUND = "select l_orderkey as query_id, l_partkey as recording_id, l_quantity / 50 as score, l_linenumber as sources from lineitem"


@registered(with_({"f": FOUND}, """select query_id, recording_id, score, sources, place from (
 select *, row_number() over (partition by query_id order by score desc, sources desc, recording_id) as place from (
  select *, row_number() over (partition by query_id, recording_id order by score desc, sources desc) as rn from f) where rn = 1 and score >= 0.5e0) where place <= 3"""))
def best_score_per_key(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "lineitem").createOrReplaceTempView("lineitem")
    return rollups.best_score_per_key(spark.sql(FOUND), 3)


OUTCOMES = "select user_id as job_id, event_id as seq, concat(event_type, ' ', event_id) as name, value > 20 as matched from events"


@registered(with_({"o": OUTCOMES, "r": "select *, row_number() over (partition by job_id order by seq) as rn from o where not matched"}, """
select job_id, matched, unmatched, total, coalesce(names, '') || case when unmatched > 5 then ' and ' || (unmatched - 5) || ' more' else '' end as unmatched_names from
 (select job_id, count(*) filter (where matched) as matched, count(*) filter (where not matched) as unmatched, count(*) as total from o group by 1)
 left join (select job_id, string_agg(name, ', ' order by rn) as names from r where rn <= 5 group by 1) using (job_id)"""))
def outcome_summary(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "events").createOrReplaceTempView("events")
    return rollups.outcome_summary(spark.sql(OUTCOMES))


# ---- shared files ------------------------------------------------------------------------------

HIT_FILES = """select * from (select *, row_number() over (partition by user_name, file order by hit_id) as rn,
  lower(regexp_extract(file, '\\.([^./]*)$', 1)) as ext, regexp_extract(file, '^(.*)/', 1) as folder, regexp_extract(file, '([^/]+)$', 1) as name from hits) where rn = 1 and ext in ('flac', 'mp3')"""
FOLDERS = """select user_name, replace(folder, '/', '\\') as dir, replace(folder, '/', ' / ') as label, bool_and(ext = 'flac') as lossless, sum(size)::bigint as total_size, count(*) as files,
 arg_min(slots, hit_id) as slots, arg_min(speed, hit_id) as speed, arg_min(queue_length, hit_id) as queue_length from hf group by 1, 2, 3"""


@registered(with_({**ctes("hits"), "hf": HIT_FILES}, FOLDERS))
def folder_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.folder_rollup(rollups.folder_files(view(spark, sf, "hits")))


@registered(with_({**ctes("hits"), "hf": HIT_FILES}, """select hit_id, replace(folder, '/', '\\') as dir,
 row_number() over (partition by user_name, folder order by lower(strip_accents(name)), name, hit_id) as place from hf"""))
def folder_listing(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.folder_listing(rollups.folder_files(view(spark, sf, "hits"))).select("hit_id", "dir", "place")


@registered(with_({**ctes("hits"), "hf": HIT_FILES, "f": FOLDERS}, "select user_name, dir from f order by slots desc, lossless desc, queue_length, speed desc, user_name, dir limit 150"))
def rank_folders(spark: SparkSession, sf: str) -> DataFrame:
    folders = rollups.folder_rollup(rollups.folder_files(view(spark, sf, "hits")))
    return ordering.rank_folders(folders).select("user_name", "dir")


# the results of a search for each catalog row: its own hit, and the hits that order lines point at
MATCH_PAIRS = """select c.id as target_id, c.title, c.artist, c.album, c.duration_ms as target_ms, c.track_number, h.* from
 (select id as target_id, id as found from catalog union select l_partkey, l_suppkey from lineitem) s
 join catalog c on c.id = s.target_id join hits h on h.hit_id = s.found where c.title <> ''"""
_GT = r"case when g1 <> '' then g1 else name end"
JUDGED = f"""select *, case when size < 2097152 then 'unusual size' when t < 0.6e0 then 'another title' when off > 12 then 'wrong length'
  when not a_ok and not (len_ok and (b_ok or n_ok)) then 'artist not confirmed' when raw < 0.7e0 and mk > 0 then 'another version (live, remix…)'
  when raw < 0.7e0 then 'weak match' when not slots then 'busy' else 'accepted' end as verdict,
  (a_ok::int + b_ok::int + n_ok::int + len_ok::int) as evidence_count, least(1e0, raw) as score,
  coalesce(seconds > 0 and size * 8e0 / seconds / 1000 > 1500, false) as hi_res from (
 select *, case when dur is null then 0.55e0 * t + 0.45e0 * who - 0.1e0 else 0.35e0 * t + 0.25e0 * who + 0.4e0 * dur end - 0.4e0 * mk as raw from (
  select *, case when a_ok then a when b_ok then 0.9e0 else 0.75e0 end as who from (
   select *, a >= 0.5e0 as a_ok, b >= 0.8e0 as b_ok, coalesce(off <= 3, false) as len_ok, coalesce(track_number > 0 and track_number = gno, false) as n_ok,
    case when off is null then null when off <= 2 then 1e0 when off >= 30 then 0e0 else 1e0 - (off - 2e0) / 28e0 end as dur from (
    select *, {dice('tw', 'gw')} as t, {coverage('aw', 'pw')} as a, {coverage('bw', 'dw')} as b, {markers('pn', 'tn')} as mk from (
     select *, {words('tn')} as tw, {words(norm(_GT))} as gw, {words(norm('artist'))} as aw, {words('pn')} as pw, {words(norm('album'))} as bw, {words('dn')} as dw from (
      select *, {norm('title')} as tn, {norm("regexp_replace(file, '[/_.]+', ' ', 'g')")} as pn, {norm("regexp_replace(regexp_extract(file, '^(.*)/', 1), '[/_.]+', ' ', 'g')")} as dn,
       regexp_extract(file, '([^/]+)$', 1) as name, trim(regexp_extract(file, '/[0-9]+ - ([^/]*)\\.[a-z0-9]+$', 1)) as g1, cast(regexp_extract(file, '/([0-9]+) - [^/]*$', 1) as int) as gno,
       case when target_ms > 0 and seconds > 0 then abs(target_ms / 1000e0 - seconds) end as off
      from (select *, row_number() over (partition by target_id, user_name, file order by hit_id) as rn from pairs where suffix(file, '.flac')) where rn = 1))))))"""
JUDGE_CTES = {**ctes("catalog", "hits"), "pairs": MATCH_PAIRS, "judged": JUDGED}


def judged(spark: SparkSession, sf: str) -> DataFrame:
    """``MATCH_PAIRS`` judged: texts are read once per catalog row and once per hit, then both join the pairs of their ids."""
    catalog = view(spark, sf, "catalog")
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey")
    found = catalog.select(F.col("id").alias("target_id"), F.col("id").alias("hit_id")).union(lines).distinct()
    targets = catalog.where("title <> ''").select(
        F.col("id").alias("target_id"), "title", "artist", F.lit(None).cast("array<string>").alias("artists"), "album",
        F.col("duration_ms").alias("target_ms"), "track_number",
        F.lit(None).cast("string").alias("prefer_user"), F.lit(None).cast("string").alias("prefer_dir"),
    )
    hits = view(spark, sf, "hits").withColumn("attribs", F.map_filter(F.create_map(F.lit(1), "seconds"), lambda k, v: v.isNotNull()))
    # the last join deals rows by target, as all that follows it does
    pairs = found.join(linkage.lossless_hits(hits), "hit_id").join(linkage.lossless_targets(targets), "target_id")
    return linkage.match_lossless(pairs, free_only=True)


@registered(with_(JUDGE_CTES, "select target_id, hit_id, verdict, evidence_count, hi_res, floor(score * 1e6 + 0.5e0) / 1e6 as score from judged"))
def match_lossless(spark: SparkSession, sf: str) -> DataFrame:
    return judged(spark, sf).select(
        "target_id", "hit_id", "verdict", "evidence_count", "hi_res", (F.floor(F.col("score") * 1e6 + 0.5) / 1e6).alias("score")
    )


@registered(with_(JUDGE_CTES, """select target_id, verdict, count(*) as files, any_value(n) as looked_at from
 (select *, count(*) over (partition by target_id) as n from judged) where verdict <> 'accepted' group by 1, 2"""))
def rejection_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.rejection_histogram(judged(spark, sf))


@registered(with_({**JUDGE_CTES, "l": """select target_id, hit_id, row_number() over (partition by target_id order by floor(score * 20 + 0.5e0) desc, evidence_count desc, slots desc, hi_res,
 queue_length, speed desc, hit_id) as place from judged where verdict in ('accepted', 'busy', 'weak match')"""}, "select * from l"))
def rank_lossless_picks(spark: SparkSession, sf: str) -> DataFrame:
    good = judged(spark, sf).where(F.col("verdict").isin("accepted", "busy", "weak match"))
    return ordering.rank_lossless_picks(good).select("target_id", "hit_id", "place")


# ---- nearest, as-of and verification -----------------------------------------------------------


@registered(with_(ctes("nearest"), """select q, rec, case when synced <> '' then 'synced' else 'plain' end as text_kind from (
 select *, row_number() over (partition by q order by hit desc, abs(have - wanted), rec) as rn from (
  select *, signature = 7 as hit from nearest) where hit or coalesce(plain <> '', false) or coalesce(synced <> '', false))
where rn = 1 and (hit or abs(have - wanted) <= 500) and not instrumental and (coalesce(plain <> '', false) or coalesce(synced <> '', false))"""))
def nearest_within_tolerance(spark: SparkSession, sf: str) -> DataFrame:
    n = view(spark, sf, "nearest")
    queries = table(spark, sf, "customer").select(F.col("c_custkey").alias("q"), F.lit(7).alias("signature"), F.col("c_acctbal").alias("wanted"))
    return lookups.nearest_within_tolerance(queries, n.drop("wanted"), 500.0)


@registered(with_(ctes("feed"), """select a.event_id as attempt_id, a.key as album_key, a.ts,
 (select cast(d.event_id as varchar) from feed d where d.status = 'done' and d.key = a.key and d.ts < a.ts order by d.ts desc, d.event_id desc limit 1) as preferred
from feed a where a.status = 'downloading'"""))
def last_success_preference(spark: SparkSession, sf: str) -> DataFrame:
    f = view(spark, sf, "feed").withColumnRenamed("key", "album_key")
    attempts = f.where("status = 'downloading'").select(F.col("event_id").alias("attempt_id"), "album_key", "ts")
    done = f.where("status = 'done'").select(F.col("event_id").alias("delivery_id"), "album_key", "ts", F.col("event_id").alias("source"))
    return lookups.last_success_preference(attempts, done)


_VERIFY = f"""select *, {dice(words(norm('target_title')), words(norm('cand_title')))} >= 0.5e0
 and ({primary('target_artist')} = {primary('channel')} or {dice(words(norm('target_artist')), words(norm('channel')))} >= 0.5e0) as agrees from candidates"""


@registered(with_({**ctes("candidates"), "v": _VERIFY, "heard": "select target_id, bool_or(agrees) as agrees from v where mod(cand_id, 5) <> 0 group by 1"}, """
select p_partkey as target_id, case when not (p_size % 4 <> 0) then 'not lossless' when p_retailprice * 10 > 0 and p_size > 0 and abs(floor(p_retailprice * 10) * 20 - p_size * 6000) > 7000 and p_size % 3 = 0 then 'length differs'
 when agrees = false then 'another recording' else 'ok' end as verdict from part left join heard on target_id = p_partkey"""))
def verify_produced(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    files = part.select(
        F.col("p_partkey").alias("target_id"), (F.col("p_size") % 4 != 0).alias("lossless"),
        F.when(F.col("p_size") % 3 == 0, F.floor(F.col("p_retailprice") * 10) * 20).otherwise(F.col("p_size") * 6000).alias("duration_ms"),
    )
    targets = part.select(
        F.col("p_partkey").alias("target_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"),
        F.lit(None).cast("array<string>").alias("artists"), (F.col("p_size") * 6000).alias("target_ms"),
    )
    prints = view(spark, sf, "candidates").select(
        "target_id", F.col("cand_title").alias("title"), F.col("channel").alias("artist"),
        F.when(F.col("cand_id") % 5 != 0, 0.9).otherwise(0.5).alias("score"),
    )
    return linkage.verify_produced(files, targets, prints).select("target_id", "verdict")
