"""Tables in versions that rewrite the buckets they touch."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from shelfmark.plans.versions import BUCKETS, VersionedTable, key_bucket, time_bucket
from shelfmark.sources import inventory
from shelfmark.streaming import feeds, run

INDEX = "path string, size long, id long, title string, audio_hash string"


def folders(folder):
    """batch -> its bucket folders."""
    data = os.path.join(folder, "data")
    return {b: sorted(d for d in os.listdir(os.path.join(data, b)) if d.startswith("_bucket=")) for b in sorted(os.listdir(data))}


def replace(known, rows):
    return rows if known is None else known.join(rows, "key", "left_anti").unionByName(rows)


def advance(table, version, rows):
    table.advance(version, rows, lambda known: replace(known, rows))


def content(table, version):
    return sorted((tuple(r) for r in table.table(version).collect()), key=str)


def test_a_version_writes_the_buckets_it_touches(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path), key_bucket("key", buckets=16))
    frame = lambda rows: spark.createDataFrame(rows, "key long, value string")
    advance(table, 0, frame([(k, "a") for k in range(200)] + [(None, "none")]))
    first = table.held(0)
    assert set(first.values()) == {0} and len(first) == 16
    advance(table, 1, frame([(7, "b")]))
    second = table.held(1)
    changed = [b for b in first if second[b] != first[b]]
    assert len(changed) == 1 and folders(tmp_path)["batch-1"] == [f"_bucket={changed[0]}"]
    assert content(table, 1) == sorted([(k, "b" if k == 7 else "a") for k in range(200)] + [(None, "none")], key=str)
    assert content(table, 0)[0] == (0, "a") and table.newest() == [1, 0]


def test_a_repeated_version_starts_from_the_same_predecessor(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "key long, value string")
    once, twice = (VersionedTable(spark, str(tmp_path / n), key_bucket("key", buckets=4)) for n in ("once", "twice"))
    steps = [[(k, "a") for k in range(9)], [(1, "b"), (20, "b")], [(1, "c")], [], [(5, "d")]]
    for version, rows in enumerate(steps):
        advance(once, version, frame(rows))
        for _ in range(2):  # the second time as after a crash behind the commit, by another object
            advance(VersionedTable(spark, str(tmp_path / "twice"), key_bucket("key", buckets=4)), version, frame(rows))
        assert content(once, version) == content(twice, version) and once.held(version) == twice.held(version)
    assert content(once, 4) == sorted([(1, "c"), (5, "d"), (20, "b"), *[(k, "a") for k in (0, 2, 3, 4, 6, 7, 8)]], key=str)
    for name, table in (("once", once), ("twice", twice)):
        kept = {(b, v) for n in table.newest() for b, v in table.held(n).items()}
        assert {(int(d[8:]), int(b[6:])) for b, ds in folders(tmp_path / name).items() for d in ds} == kept
        assert sorted(d for d in os.listdir(tmp_path / name) if d.startswith("version-")) == ["version-3", "version-4"]


def test_a_write_that_dies_leaves_the_last_version(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path), key_bucket("key", buckets=4))
    rows = spark.createDataFrame([(k, "a") for k in range(9)], "key long, value string")
    advance(table, 0, rows)
    broken = rows.withColumn("value", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        table.advance(1, rows, lambda known: broken)
    assert table.newest() == [0] and content(table, 0) == [(k, "a") for k in range(9)]
    advance(table, 1, rows.limit(1))
    assert table.newest() == [1, 0]


def test_tables_without_rows(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path), key_bucket("key", buckets=4))
    none = spark.createDataFrame([], "key long, value string")
    assert table.newest() == []
    advance(table, 0, none)
    assert table.newest() == [0] and table.table(0) is None
    rows = spark.createDataFrame([(1, "a")], none.schema)
    advance(table, 1, rows)
    table.advance(2, rows, lambda known: known.limit(0))
    assert content(table, 1) == [(1, "a")] and table.table(2) is None


def test_one_bucket_and_buckets_of_time(spark, tmp_path):
    at = lambda *t: dt.datetime(2024, *t)
    rows = spark.createDataFrame([(at(1, 1, 0), 1), (at(1, 1, 23), 2), (at(1, 2, 0), 3), (at(3, 1, 5), 4)], "key timestamp, value int")
    whole, days = VersionedTable(spark, str(tmp_path / "w")), VersionedTable(spark, str(tmp_path / "d"), time_bucket("key", 86_400))
    for table, n in ((whole, 1), (days, 3)):
        advance(table, 0, rows)
        advance(table, 1, rows.where("value = 4").withColumn("value", F.lit(9)))
        assert sorted(r.value for r in table.table(1).collect()) == [1, 2, 3, 9]
        assert len(table.held(1)) == n and list(table.held(1).values()).count(1) == 1


def test_an_index_in_buckets_equals_the_whole_merge(spark, tmp_path):
    index = spark.createDataFrame([(f"p{i:03}", i, i * 2, "old", f"h{i}") for i in range(120)], INDEX)
    changes = spark.createDataFrame([("p003", 30, "read"), ("new1", 1, "read"), ("new0", 2, "read")], "path string, size long, title string")
    gone = spark.createDataFrame([("p004",), ("never",)], "path string")
    folder = str(tmp_path / "index")
    created = inventory.create_index(index, folder)
    assert created.count() == 120
    got = inventory.upsert_index(spark, folder, changes, gone)
    want = inventory.merge_upsert_invalidate(index, changes, gone)
    assert sorted(map(tuple, got.select(index.columns).collect())) == sorted(map(tuple, want.collect()), key=lambda r: r[0])
    assert {r.path: r.id for r in got.where("path like 'new%'").collect()} == {"new0": 239, "new1": 240}
    assert len(folders(folder)["batch-1"]) <= 5 < len(folders(folder)["batch-0"])
    nothing = inventory.upsert_index(spark, folder, changes.limit(0), gone.limit(0))
    assert nothing.count() == 121 and "batch-2" not in folders(folder)
    emptied = inventory.upsert_index(spark, folder, changes.limit(0), nothing.select("path"))
    assert emptied.count() == 0 and emptied.columns == got.columns
    with pytest.raises(ValueError):
        inventory.create_index(index, folder)


def test_a_batch_of_a_stream_rewrites_the_buckets_of_its_keys(spark, tmp_path):
    schema = "key string, event_id long, ts timestamp, status string, removed boolean, speed double"
    rows = [(f"k{i}", i, dt.datetime(2024, 1, 1, 0, 0, i % 60), "queued", False, 1.0) for i in range(300)]
    feed, folder = str(tmp_path / "feed"), str(tmp_path / "table")
    for part in (rows, [("k5", 900, dt.datetime(2024, 1, 1, 0, 1, 0), "done", False, 2.0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(feed)
        got = feeds.follow_latest_state(run.read_feed(spark, feed, schema), folder)
    assert {r.key: r.status for r in got.collect()} == {f"k{i}": "done" if i == 5 else "queued" for i in range(300)}
    table = feeds.SnapshotTable(spark, "latest", feeds.merge_latest, folder, key_bucket("key")).versions
    written = sorted(table.held(table.newest()[0]).values())
    assert len(written) == BUCKETS and written.count(written[0]) == BUCKETS - 1  # one bucket by a later batch
