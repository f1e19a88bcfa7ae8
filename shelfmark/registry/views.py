"""Catalog-shaped views over the given tables. The SQL runs unchanged on Spark and in the oracle."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import sql as S

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

CATALOG = """
select d.doc_id as id,
       regexp_extract(d.text, '([A-Za-zÀ-ÿ]+ [A-Za-zÀ-ÿ]+ [A-Za-zÀ-ÿ]+)', 1) as title,
       d.source as artist,
       case when d.doc_id % 11 = 0 then null else concat(d.source, ' ', d.lang) end as album,
       case d.doc_id % 5 when 0 then upper(d.source) when 1 then null else d.source end as album_artist,
       case when d.doc_id % 7 = 0 then null else 1990 + d.doc_id % 35 end as year,
       case when d.doc_id % 13 = 0 then null else d.lang end as genre,
       case when d.doc_id % 20 = 0 then null else d.doc_id % 20 end as track_number,
       1 + d.doc_id % 2 as disc_number,
       d.n_chars * 50 as duration_ms,
       d.n_chars as size,
       d.doc_id % 4 = 0 as lossless,
       case d.doc_id % 4 when 0 then 'flac' when 1 then 'opus' when 2 then 'aac' else 'mp3' end as format,
       case when d.doc_id % 17 = 0 then null else 96 + 32 * (d.doc_id % 8) end as bitrate,
       coalesce(l.quality, 0) = 1 as has_artwork,
       coalesce(l.toxic, 0) = 1 as has_lyrics,
       md5(d.text) as audio_hash,
       concat(d.source, '/', d.lang, '/', d.doc_id, case when d.doc_id % 9 = 0 then ' (copy)' else '' end, '.bin') as rel_path,
       cast(null as varchar(9)) as codec,
       cast(null as int) as sample_rate,
       cast(null as int) as bits_per_sample,
       cast(null as varchar(9)) as mb_recording_id,
       false as from_pipeline,
       d.doc_id as added_at,
       d.n_chars as mtime_ms
from documents d left join labels l on d.doc_id = l.doc_id
"""

SNAPSHOTS = """
select 'prev' as snap, o_orderkey as path, o_totalprice as size, o_orderdate as mtime from orders where o_orderkey % 10 <> 0
union all
select 'cur', o_orderkey, case when o_orderkey % 7 = 0 then o_totalprice + 1 else o_totalprice end, o_orderdate
from orders where o_orderkey % 10 <> 1
"""

SOURCE_ITEMS = """
select o_custkey as source_id, o_orderkey as external_id, o_orderkey as position,
       o_orderkey % 12 <> 0 as present, o_orderkey % 15 = 0 as ignored,
       concat('Item ', o_orderpriority) as title, o_orderstatus as artist, cast(null as varchar(9)) as album,
       case when o_orderkey % 6 = 0 then concat('known|', o_orderkey % 97) end as match_key
from orders
"""

# every order line with an id of its own: the line number of an order may repeat
LINES = """
select *, (l_orderkey * 10 + l_linenumber) * 1000 + row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey,
       l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as line_id
from lineitem
"""

JOBS = f"""
select line_id as track_id, l_orderkey as external_id, l_partkey as id_a, l_suppkey as id_b, l_returnflag as flag,
       l_linestatus as line_status, l_quantity as quantity, l_shipdate as shipped, l_discount as discount
from ({LINES}) l
"""

JOB_STATES = f"""
select track_id, external_id,
       case when flag = 'R' then 'failed' when flag = 'A' and line_status = 'F' then 'done'
            when flag = 'A' then 'cancelled' when line_status = 'O' then 'queued' else 'skipped' end as status
from ({JOBS}) j where external_id % 3 <> 0
"""

ORDERS_HIST = f"""
select track_id as id, id_a * 1000 + external_id % 1000 as id_a, id_b * 100000 + id_a as id_b,
       case when line_status = 'F' then 'done' else 'queued' end as status, quantity in (5, 10, 15, 20) as force
from ({JOBS}) j
"""

QUEUE = """
select o_orderkey as id, cast(substr(o_orderpriority, 1, 1) as int) as priority, o_totalprice as position,
       case o_orderstatus when 'O' then 'queued' when 'F' then 'done' else 'failed' end as status,
       case when o_orderkey % 4 = 0 then o_orderdate else null end as retry_at, o_orderdate as finished_at,
       (o_orderkey % 5) * 15 as interval_minutes
from orders
"""

# every part is wanted; its order lines are the search results, named after the part their supplier points at
CANDIDATES = f"""
select l.target_id, t.p_name as target_title, t.p_brand as target_artist, t.p_size * 6000 as target_ms,
       l.cand_id,
       concat(case when l.line % 4 = 0 then concat(c.p_brand, ' - ') else '' end, c.p_name,
              case l.line % 6 when 0 then ' (live)' when 1 then ' (Official Audio)' when 2 then ' remix' else '' end) as cand_title,
       concat(c.p_brand, case when l.line % 5 = 0 then ' - Topic' else '' end) as channel,
       case when l.cand_id % 9 = 0 then null else c.p_size * 6 end as cand_sec, l.line = 1 as trusted
from (select l_partkey as target_id, line_id as cand_id, l_linenumber as line, l_suppkey as supp from ({LINES}) x) l
join part t on t.p_partkey = l.target_id join part c on c.p_partkey = l.supp
"""

RELEASES = f"""
select l.recording_id, l.release_id, p.p_name as title, p.p_partkey % 40 as release_group,
       case when l.flag = 'R' then 'Bootleg' else 'Official' end as status,
       case when p.p_size < 30 then 'Album' when p.p_size < 40 then 'EP' else 'Single' end as primary_type,
       case when l.part % 5 = 0 then 'Compilation' when l.part % 7 = 0 then 'Live' else null end as secondary_type,
       case when l.line % 6 = 0 then null else substr(cast(l.shipped as varchar(30)), 1, 10) end as released,
       p.p_size * 6000 as duration_ms, l.discount * 10 as score, p.p_brand as artist
from (select l_orderkey as recording_id, line_id as release_id, l_linenumber as line, l_partkey as part, l_returnflag as flag,
             l_shipdate as shipped, l_discount as discount from ({LINES}) x) l
join part p on l.part = p.p_partkey
"""

HITS = """
select d.doc_id as hit_id, d.source as user_name,
       concat('music/', d.source, ' - ', d.lang, ' (2020) [FLAC]/', lpad(cast(1 + d.doc_id % 30 as varchar(3)), 2, '0'), ' - ',
              regexp_extract(d.text, '([A-Za-zÀ-ÿ]+ [A-Za-zÀ-ÿ]+)', 1),
              case d.doc_id % 3 when 0 then '.flac' when 1 then '.mp3' else '.jpg' end) as file,
       d.n_chars * 10000 as size, d.doc_id % 4 <> 0 as slots, d.doc_id % 97 as speed, d.doc_id % 11 as queue_length,
       case when d.doc_id % 5 = 0 then null else cast(floor(d.n_chars / 20) as int) end as seconds
from documents d
"""

GENRE_VOTES = """
select p_brand as entity, lower(concat(p_type, ' ', regexp_extract(p_name, '([a-z]+)$', 1))) as name, count(*) as votes from part group by 1, 2
union all
select p_brand, regexp_extract(p_name, '([a-z]+)$', 1), count(*) from part group by 1, 2
"""

NEAREST = """
select c.c_custkey as q, c.c_acctbal as wanted, o.o_orderkey as rec, o.o_totalprice / 50 as have,
       o.o_orderkey % 40 as signature, o.o_orderkey % 3 = 0 as instrumental,
       case when o.o_orderkey % 5 = 0 then '' else 'text' end as plain, case when o.o_orderkey % 4 = 0 then 'text' end as synced
from customer c join orders o on o.o_custkey = c.c_custkey
"""

FEED = """
select event_id, ts, user_id as key, value as speed,
       case event_type when 'signup' then 'queued' when 'view' then 'resolving' when 'click' then 'downloading'
            when 'purchase' then 'done' else 'failed' end as status,
       event_type = 'signup' and value < 2 as removed
from events
"""

UPLOADS = """
select doc_id as id,
       concat(case doc_id % 4 when 0 then concat(source, ' - ') when 1 then concat(lang, ' song - ') else '' end,
              regexp_extract(text, '([A-Za-zÀ-ÿ]+ [A-Za-zÀ-ÿ]+ [A-Za-zÀ-ÿ]+)', 1),
              case doc_id % 6 when 0 then ' (Official Video)' when 1 then ' [HD]' when 2 then ' | Some Channel' when 3 then concat(' - ', source) else '' end) as raw_title,
       case doc_id % 5 when 0 then concat(source, ' - Topic') when 1 then concat(source, 'VEVO') when 2 then source else null end as channel
from documents
"""

SQL = {
    "catalog": CATALOG, "snapshots": SNAPSHOTS, "source_items": SOURCE_ITEMS, "jobs": JOBS, "job_states": JOB_STATES,
    "orders_hist": ORDERS_HIST, "queue": QUEUE, "candidates": CANDIDATES, "releases": RELEASES, "hits": HITS,
    "genre_votes": GENRE_VOTES, "nearest": NEAREST, "feed": FEED, "uploads": UPLOADS,
}

# oracle-side catalog with its match key
KEYED = f"select c.*, {S.match_key('artist', 'title')} as match_key from catalog c"


def ctes(*names: str) -> dict[str, str]:
    """Views by name, as named subqueries for the oracle; 'keyed' is the catalog with match keys."""
    out: dict[str, str] = {}
    for n in names:
        if n == "keyed":
            out.setdefault("catalog", CATALOG)
            out["keyed"] = KEYED
        else:
            out[n] = SQL[n]
    return out


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A view by name over the tables in ``sf``."""
    if name == "keyed":
        return view(spark, sf, "catalog").withColumn("match_key", T.match_key(F.col("artist"), F.col("title")))
    text = SQL[name]
    for t in TABLES:
        if t in text:
            table(spark, sf, t).createOrReplaceTempView(t)
    return spark.sql(text)


@lru_cache(maxsize=None)
def feed_schema() -> str:
    return "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
