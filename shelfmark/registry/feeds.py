"""Streams over the events table, each compared with its batch meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import new_folder
from ..streaming import feeds as S
from ..streaming.run import drain, read_feed
from . import registered
from .sql import with_
from .views import ctes, feed_schema, table, view

# an append-mode window is complete once the watermark has passed its end
CUT = "(select max(ts) from events)"
# Spark filters before it observes event time, so a filtered stream's watermark follows its own rows
CUT_OF = "(select max(ts) from feed where status = '{}')"


def feed_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a stream, in feed columns."""
    events = read_feed(spark, f"{sf}/events*.parquet", feed_schema())
    status = (
        F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "view", "resolving")
        .when(F.col("event_type") == "click", "downloading").when(F.col("event_type") == "purchase", "done").otherwise("failed")
    )
    return events.select(
        "event_id", "ts", F.col("user_id").alias("key"), F.col("value").alias("speed"), status.alias("status"),
        ((F.col("event_type") == "signup") & (F.col("value") < 2)).alias("removed"),
    )


LATEST = "select * from (select *, row_number() over (partition by key order by ts desc, event_id desc) as rn from feed) where rn = 1 and not removed"


@registered("select event_id % 20 as part, count(*) as n from events group by 1")
def stream_file_monitor(spark: SparkSession, sf: str) -> DataFrame:
    """Events land in folders; the monitor names the new files, which are then read."""
    root = new_folder(spark, "landing")
    table(spark, sf, "events").select("event_id", (F.col("event_id") % 20).alias("part")).write.partitionBy("part").parquet(root)
    seen = drain(S.stream_file_monitor(spark, root), "seen")
    listed = seen.where("size > 0").select(F.regexp_extract("path", "/part=([0-9]+)/", 1).cast("bigint").alias("part")).distinct()
    return spark.read.parquet(root).groupBy(F.col("part").cast("bigint").alias("part")).agg(F.count(F.lit(1)).alias("n")).join(listed, "part")


@registered(with_({**ctes("feed"), "latest": LATEST}, "select key, event_id, ts, status, speed from latest"))
def stream_latest_state(spark: SparkSession, sf: str) -> DataFrame:
    return S.follow_latest_state(feed_stream(spark, sf)).select("key", "event_id", "ts", "status", "speed")


@registered(with_({**ctes("feed"), "latest": LATEST}, "select status, count(*) as keys, round(sum(case when status = 'downloading' then speed else 0 end), 4) as speed from latest group by 1"))
def stream_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return S.stream_status_counts(feed_stream(spark, sf)).withColumn("speed", F.round("speed", 4))


@registered(with_(ctes("feed"), f"""select date_trunc('second', ts) as tick, round(sum(speed), 4) as speed, max(speed) as top from feed where status = 'downloading'
group by 1 having date_trunc('second', ts) + interval 1 second <= {CUT_OF.format('downloading')} - interval 1 minute"""))
def stream_speed_history(spark: SparkSession, sf: str) -> DataFrame:
    out = drain(S.stream_speed_history(feed_stream(spark, sf)), "speed")
    return out.select("tick", F.round("speed", 4).alias("speed"), "top")


@registered(with_({**ctes("feed"), "g": "select *, case when ts - lag(ts) over (partition by key order by ts, event_id) < interval 30 second then 0 else 1 end as opens from feed",
  "s": "select *, sum(opens) over (partition by key order by ts, event_id rows unbounded preceding) as burst from g"}, f"""
select key, max(ts) + interval 30 second as fires_at, count(*) as events from s group by key, burst having max(ts) + interval 30 second <= {CUT} - interval 1 minute"""))
def stream_debounce(spark: SparkSession, sf: str) -> DataFrame:
    return drain(S.stream_debounce(feed_stream(spark, sf)), "bursts")


@registered(with_(ctes("feed"), f"""select cast(date_trunc('day', ts) as timestamp) as day, count(*) as done from feed where status = 'done' group by 1
having cast(date_trunc('day', ts) as timestamp) + interval 1 day <= {CUT_OF.format('done')} - interval 1 hour"""))
def stream_done_per_day(spark: SparkSession, sf: str) -> DataFrame:
    return drain(S.stream_done_per_day(feed_stream(spark, sf)), "per-day").select("day", "done")


@registered(with_(ctes("feed"), "select cast(date_trunc('day', ts) as timestamp) as day, count(*) as done from feed where status = 'done' group by 1"))
def done_per_day_live(spark: SparkSession, sf: str) -> DataFrame:
    """With the current day, which append mode would hold back."""
    return S.follow_done_per_day(feed_stream(spark, sf)).select("day", "done")


@registered(with_(ctes("feed"), "select date_trunc('second', ts) as tick, round(sum(speed), 4) as speed, max(speed) as top from feed where status = 'downloading' group by 1 order by 1 desc limit 120"))
def last_ticks(spark: SparkSession, sf: str) -> DataFrame:
    newest = S.last_ticks(S.follow_speed_history(feed_stream(spark, sf)), 120)
    return newest.select("tick", F.round("speed", 4).alias("speed"), "top")


@registered(with_({**ctes("feed"), "t": "select unnest(generate_series(b - interval 110 second, b, interval 10 second)) as tick, speed from (select time_bucket(interval 10 second, ts) as b, speed from feed where status = 'downloading')"}, f"""
select tick, round(sum(speed), 4) as speed, max(speed) as top from t group by 1 having tick + interval 120 second <= {CUT_OF.format('downloading')} - interval 1 minute"""))
def stream_speed_sliding(spark: SparkSession, sf: str) -> DataFrame:
    out = drain(S.stream_speed_history(feed_stream(spark, sf), "120 seconds", "10 seconds"), "sliding")
    return out.select("tick", F.round("speed", 4).alias("speed"), "top")


def openers(seconds: int, where: str) -> dict[str, str]:
    """Events that open a window of ``seconds``: the first of a key, then each first event after it ends."""
    return {
        **ctes("feed"),
        "e": f"select * from feed where {where}",
        "opens": f"""select key, min(ts) as ts from e group by 1
          union all select key, (select min(e.ts) from e where e.key = opens.key and e.ts >= opens.ts + interval {seconds} second) as ts from opens where ts is not null""",
        "w": "select key, ts as opened_at, lead(ts) over (partition by key order by ts) as next_at from opens where ts is not null",
    }


@registered(with_({**openers(6 * 3600, "status = 'done'"), "j": "select w.key, w.opened_at, e.* exclude (key) from w join e on e.key = w.key and e.ts >= w.opened_at and (w.next_at is null or e.ts < w.next_at)",
  "l": "select *, row_number() over (partition by key, opened_at order by ts, event_id) as rn from j"}, f"""
select key, opened_at, count(*) as done, round(sum(speed), 4) as total, count(*) > 10 as collapsed,
 string_agg('Item ' || event_id, chr(10) order by rn) filter (where rn <= 25) || case when count(*) > 25 then chr(10) || '…and ' || (count(*) - 25) || ' more' else '' end as lines
from l group by 1, 2 having opened_at + interval 6 hour <= {CUT_OF.format('done')} - interval 1 minute""", recursive=True))
def stream_completion_digest(spark: SparkSession, sf: str) -> DataFrame:
    """Completions are sparse in the table, so the digest window is six hours here."""
    done = feed_stream(spark, sf).where("status = 'done'")
    lines = done.select("key", "event_id", "ts", F.concat(F.lit("Item "), "event_id").alias("line"), F.col("speed").alias("size"))
    return drain(S.stream_completion_digest(lines, 6 * 3600), "digest").withColumn("total", F.round("total", 4))


@registered(with_({**openers(6 * 3600, "status = 'done'"), "j": "select w.key, w.opened_at, e.* exclude (key) from w join e on e.key = w.key and e.ts >= w.opened_at and (w.next_at is null or e.ts < w.next_at)",
  "l": "select *, row_number() over (partition by key, opened_at order by ts, event_id) as rn from j"}, """
select key, opened_at, count(*) as done, round(sum(speed), 4) as total, count(*) > 10 as collapsed,
 string_agg('Item ' || event_id, chr(10) order by rn) filter (where rn <= 25) || case when count(*) > 25 then chr(10) || '…and ' || (count(*) - 25) || ' more' else '' end as lines
from l group by 1, 2""", recursive=True))
def completion_digest_batch(spark: SparkSession, sf: str) -> DataFrame:
    done = view(spark, sf, "feed").where("status = 'done'").select("key", "event_id", "ts", F.concat(F.lit("Item "), "event_id").alias("line"), F.col("speed").alias("size"))
    return S.stream_completion_digest_batch(done, 6 * 3600).withColumn("total", F.round("total", 4))


@registered(with_(openers(3 * 3600, "true"), "select w.key, min(e.event_id) as event_id, w.opened_at as ts from w join e on e.key = w.key and e.ts = w.opened_at group by 1, 3", recursive=True))
def stream_dedupe_recent(spark: SparkSession, sf: str) -> DataFrame:
    return drain(S.stream_dedupe_recent(feed_stream(spark, sf), 3 * 3600), "accepted")


@registered(with_(openers(3 * 3600, "true"), "select w.key, min(e.event_id) as event_id, w.opened_at as ts from w join e on e.key = w.key and e.ts = w.opened_at group by 1, 3", recursive=True))
def dedupe_recent_batch(spark: SparkSession, sf: str) -> DataFrame:
    return S.stream_dedupe_recent_batch(view(spark, sf, "feed"), 3 * 3600)


@registered(with_(ctes("feed"), """select album_key, event_id, ts, value from (select key * 10 + mod(event_id, 3) as album_key, event_id, ts, status as value,
 row_number() over (partition by key * 10 + mod(event_id, 3) order by ts, event_id) as rn from feed) where rn = 1 and mod(album_key, 7) <> 0"""))
def stream_first_identity(spark: SparkSession, sf: str) -> DataFrame:
    keys = lambda f: f.withColumn("album_key", F.col("key") * 10 + F.col("event_id") % 3)
    known = keys(view(spark, sf, "feed")).select("album_key").distinct().where("album_key % 7 = 0")
    rows = keys(feed_stream(spark, sf)).select("album_key", "ts", "event_id", F.col("status").alias("value"))
    return S.follow_first_identity(rows, known)


@registered(with_({**ctes("feed"), "recent": "select key from (select key, max(ts) as t, arg_max(event_id, (ts, event_id)) as i from feed group by 1) order by t desc, i desc limit 50",
  "r": "select *, row_number() over (partition by key order by ts desc, event_id desc) as rn from feed"}, "select key, event_id from r where rn <= 40 and key in (select key from recent)"))
def stream_tail(spark: SparkSession, sf: str) -> DataFrame:
    lines = feed_stream(spark, sf).withColumn("line", F.concat_ws(" ", "status", F.col("event_id").cast("string")))
    return S.stream_tail(lines, 40, 50).select("key", "event_id")


@registered(with_(ctes("feed"), """select event_id, case when event_id % 9 <> 0 and event_id % 4 + 1 < 3 then 'queued' else 'failed' end as next_status,
 case when event_id % 9 <> 0 and event_id % 4 + 1 < 3 then ts + to_seconds(cast(least(1800, 30 * pow(2, event_id % 4)) as int)) end as retry_at from feed where status = 'failed'"""))
def retry_schedule(spark: SparkSession, sf: str) -> DataFrame:
    failed = feed_stream(spark, sf).where("status = 'failed'").select(
        "event_id", (F.col("event_id") % 4 + 1).alias("attempt"), (F.col("event_id") % 9 == 0).alias("permanent"), F.col("ts").alias("failed_at")
    )
    return drain(S.retry_schedule(failed), "retries").select("event_id", "next_status", "retry_at")


