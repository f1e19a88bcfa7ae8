"""Files, feeds and streams against their batch twins."""

import datetime as dt
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfmark.sources import inventory, listings
from shelfmark.streaming import feeds, run
from shelfmark.streaming.run import drain, read_feed

FEED = "event_id bigint, ts timestamp, key bigint, speed double, status string, removed boolean"


def test_inventory_skips_hidden_and_foreign(spark, tmp_path):
    for name in ("a.MP3", "sub/b.flac", "sub/.c.mp3", ".hidden/d.mp3", "e.jpg"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"12345")
    rows = inventory.scan_file_inventory(spark, str(tmp_path)).collect()
    assert sorted(os.path.basename(r["path"]) for r in rows) == ["a.MP3", "b.flac"]
    assert {r["size"] for r in rows} == {5} and all(r["mtime_ms"] > 0 for r in rows)


def test_feed_entries(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(
        '<feed xmlns:yt="u"><entry><yt:videoId>v1</yt:videoId><title>A &amp; B - Song</title><author><name>Chan</name></author></entry>'
        "<entry><title>no id</title></entry><entry><yt:videoId>v2</yt:videoId><title></title></entry>"
        "<entry><yt:videoId>v3</yt:videoId><title>Solo</title><author><name>Me - Topic</name></author></entry></feed>"
    )
    rows = listings.ingest_feed_xml(spark, str(tmp_path)).orderBy("external_id").collect()
    assert [(r["external_id"], r["artist"], r["title"], r["partial"]) for r in rows] == [("v1", "A & B", "Song", True), ("v3", "Me", "Solo", True)]


def events(spark, tmp_path, n=400, files=4):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=i * 4 + (i * 37) % 11), i * 7 % 5, float(i % 9), ["done", "downloading", "failed"][i % 3], i % 41 == 0) for i in range(n)]
    for f in range(files):
        part = rows[f * n // files : (f + 1) * n // files]
        spark.createDataFrame(part, FEED).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    path = str(tmp_path / "feed")
    return spark.read.schema(FEED).parquet(path), read_feed(spark, path, FEED, files_per_batch=1)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_latest_state_over_several_batches(spark, tmp_path):
    batch, stream = events(spark, tmp_path)
    want = feeds.stream_latest_state_batch(batch)
    assert rows_of(feeds.follow_latest_state(stream).select(want.columns)) == rows_of(want)


def test_dedupe_over_several_batches(spark, tmp_path):
    batch, stream = events(spark, tmp_path)
    assert rows_of(drain(feeds.stream_dedupe_recent(stream, 60), "once")) == rows_of(feeds.stream_dedupe_recent_batch(batch, 60))


def test_digest_over_several_batches(spark, tmp_path):
    batch, stream = events(spark, tmp_path)
    lines = lambda d: d.select("key", "event_id", "ts", F.concat(F.lit("n"), "event_id").alias("line"), F.col("speed").alias("size"))
    want = feeds.stream_completion_digest_batch(lines(batch), 120)
    closed = F.lit(batch.agg(F.max("ts")).first()[0]).cast("timestamp") - F.expr("interval 60 seconds")
    want = want.where(F.col("opened_at") + F.expr("interval 120 seconds") <= closed)
    got = drain(feeds.stream_completion_digest(lines(stream), 120), "digest").select(want.columns)
    assert rows_of(got) == rows_of(want) and want.count() > 10


def test_tail_keeps_newest_lines(spark, tmp_path):
    batch, stream = events(spark, tmp_path)
    got = feeds.stream_tail(stream.withColumn("line", F.col("status")), 6, 3).select("key", "event_id").toPandas()
    pdf = batch.toPandas().sort_values(["ts", "event_id"])
    recent = pdf.groupby("key").tail(1).sort_values(["ts", "event_id"]).key.tail(3)
    want = pdf[pdf.key.isin(recent)].groupby("key").tail(6)
    assert set(map(tuple, got.values)) == set(map(tuple, want[["key", "event_id"]].values))


def test_digest_text():
    text = feeds.digest_text([f"l{i}" for i in range(25)], 40)
    assert text.endswith("…and 15 more") and text.count("\n") == 25
    assert feeds.digest_text(["a", "b"], 2) == "a\nb"


def test_enqueue_to_the_top(spark):
    items = spark.createDataFrame(
        [(1, i, i, True, False, s) for i, s in enumerate(["new", "cancelled", "done", "failed", "queued"])],
        "source_id int, external_id int, position int, present boolean, ignored boolean, state string",
    )
    top = feeds.enqueue_missing(items, F.lit(0), top=True, floor=F.lit(100))
    assert sorted(r["queue_position"] for r in top.collect()) == [97, 98]
    asked = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "source_id int, external_id int")
    assert [r["external_id"] for r in feeds.enqueue_missing(items, F.lit(5), asked).collect()] == [3]


def test_sliding_speed_and_last_ticks(spark, tmp_path):
    batch, _ = events(spark, tmp_path)
    history = feeds.stream_speed_history(batch, "1 second")
    last = feeds.last_ticks(history, 5).toPandas()
    assert len(last) == 5 and isinstance(last, pd.DataFrame)
    assert feeds.stream_speed_history(batch, "120 seconds", "60 seconds").agg(F.max("speed")).first()[0] >= last["speed"].max()


@pytest.mark.parametrize("kind", ["latest", "identity", "tail", "counts"])
def test_snapshot_streams_resume_where_they_stopped(spark, tmp_path, kind):
    rows = [
        ("a", 1, 10, "queued", False), ("b", 2, 11, "queued", False), ("a", 3, 20, "done", False), ("c", 4, 21, "queued", False),
        ("b", 5, 30, "done", True), ("d", 6, 31, "queued", False),
    ]
    schema = "key string, event_id long, ts timestamp, status string, removed boolean, speed double, line string, album_key string, value double"
    full = [(k, i, dt.datetime(2024, 1, 1, 0, 0, t), s, r, float(i), f"line {i}", k, float(i)) for k, i, t, s, r in rows]
    feed, folder = str(tmp_path / "feed"), str(tmp_path / "table")
    none = spark.createDataFrame([], "album_key string")

    def follow():
        stream = run.read_feed(spark, feed, schema)
        if kind == "latest":
            return feeds.follow_latest_state(stream, folder)
        if kind == "counts":
            return feeds.stream_status_counts(stream, folder)
        if kind == "identity":
            return feeds.follow_first_identity(stream, none, folder)
        return feeds.stream_tail(stream, 2, 3, folder)

    for part in (full[:2], full[2:4], full[4:]):  # every run is a new object, as after a restart
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(feed)
        got = follow()
    again = follow()  # nothing new has arrived
    whole = spark.createDataFrame(full, schema)
    if kind in ("latest", "counts"):
        want = feeds.stream_latest_state_batch(whole)
        want = want if kind == "latest" else feeds.stream_status_counts_batch(want)
    elif kind == "identity":
        want = feeds.first_identity(None, whole.select("album_key", "ts", "event_id", "value"))
    else:
        want = feeds.merge_tail(2, 3)(None, whole.select("key", "event_id", "ts", "line"))
    for table in (got, again):
        assert rows_of(table.select(want.columns)) == rows_of(want)
    assert len([d for d in os.listdir(folder) if d.startswith("version-")]) == 2


def test_snapshot_of_an_empty_stream(spark, tmp_path):
    os.makedirs(tmp_path / "feed")
    stream = run.read_feed(spark, str(tmp_path / "feed"), "key string, event_id long, ts timestamp, line string")
    assert feeds.stream_tail(stream, folder=str(tmp_path / "table")).count() == 0


def test_listings_of_a_source_merge_in_order_however_they_arrive(spark, tmp_path):
    schema = "source_id int, external_id int, title string, album string, duration_ms int, position int, partial boolean, truncated boolean, listed_at int"
    one = [(1, i, f"t{i}", "old", 5, p, False, False, 10) for p, i in enumerate((7, 8, 9))]
    two = [(1, i, f"u{i}", None, None, p, False, False, 20) for p, i in enumerate((9, 7))]
    three = [(1, 6, "v6", None, 4, 0, True, False, 30), (2, 1, "w", None, None, 0, False, False, 30)]
    frame = lambda rows, n=1: spark.createDataFrame(rows, schema).repartition(n)
    want = {(1, 6, "v6", None, 4, 2, True), (1, 7, "u7", "old", 5, 1, True), (1, 8, "t8", "old", 5, 1, False), (1, 9, "u9", "old", 5, 0, True), (2, 1, "w", None, None, 0, True)}
    items = lambda df: {tuple(r) for r in df.select("source_id", "external_id", "title", "album", "duration_ms", "position", "present").collect()}
    whole = items(feeds.merge_listings(None, frame([*three, *one, *two], 4)))
    split = items(feeds.merge_listings(feeds.merge_listings(None, frame(one)), frame([*two, *three], 3)))
    assert whole == split == want
    for k, part in enumerate((one, [*three, *two])):
        frame(part, 2).write.mode("append").parquet(str(tmp_path / "feed"))
        streamed = feeds.stream_listing_merge(run.read_feed(spark, str(tmp_path / "feed"), schema), str(tmp_path / "table"))
    assert items(streamed) == want
