"""State that ends, listings folded in one pass, scans over one key: against plain Python and batch twins."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import lookups
from shelfmark.plans.skew import carry_last
from shelfmark.streaming import feeds
from shelfmark.streaming.run import read_feed

START = dt.datetime(2024, 1, 1)
FEED = "event_id bigint, ts timestamp, key bigint, speed double, status string, removed boolean"
ITEM = "source_id int, external_id int, title string, album string, duration_ms int, position int, partial boolean, truncated boolean, listed_at int"


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def landed(spark, folder, parts):
    """One file per part, read one per micro-batch in the order they are written."""
    for part in parts:
        spark.createDataFrame(part, FEED).coalesce(1).write.mode("append").parquet(folder)
    return read_feed(spark, folder, FEED, files_per_batch=1)


def run(stream, folder, mode):
    out = []
    query = (
        stream.writeStream.foreachBatch(lambda df, _: out.extend(map(tuple, df.collect())))
        .option("checkpointLocation", folder).outputMode(mode).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return out, query


def state_rows(query):
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]][-1]


def busy(n=60, key=1):
    return [(i, at(i * 3), key, float(i), "done", False) for i in range(n)]


LATER = [(9000, at(5 * 86400), 9, 1.0, "done", False), (9001, at(9 * 86400), 9, 1.0, "done", False)]


def test_latest_state_ends_with_the_watermark(spark, tmp_path):
    keys = [(i, at(i), i, float(i), "done", False) for i in range(50)]
    stream = landed(spark, str(tmp_path / "feed"), [keys, LATER[:1], LATER[1:]])
    out, query = run(feeds.stream_latest_state(stream), str(tmp_path / "progress"), "update")
    assert {r[0] for r in out} == {*range(50), 9}
    assert state_rows(query) <= 2  # only the last event's slice, none of the fifty keys


def test_accepted_events_are_forgotten(spark, tmp_path):
    stream = landed(spark, str(tmp_path / "feed"), [busy(), busy(20, 2), LATER[:1], LATER[1:]])
    progress = str(tmp_path / "progress")
    out, _ = run(feeds.stream_dedupe_recent(stream, 30), progress, "append")
    batch = spark.read.schema(FEED).parquet(str(tmp_path / "feed"))
    assert sorted(out) == rows_of(feeds.stream_dedupe_recent_batch(batch, 30))
    left = spark.read.format("statestore").option("stateVarName", "accepted").load(progress)
    assert [r.key[0] for r in left.select("key").collect()] == [9]


def test_digest_state_is_empty_once_all_is_reported(spark, tmp_path):
    rows = busy(40)
    random.Random(3).shuffle(rows)  # arrives out of order, a minute of it in any batch
    parts = [[r for r in rows if r[0] < 15], [r for r in rows if r[0] >= 15], LATER[:1], LATER[1:]]
    lines = lambda d: d.select("key", "event_id", "ts", F.concat(F.lit("n"), "event_id").alias("line"), F.col("speed").alias("size"))
    stream = landed(spark, str(tmp_path / "feed"), parts)
    progress = str(tmp_path / "progress")
    out, _ = run(feeds.stream_completion_digest(lines(stream), 20), progress, "append")
    batch = feeds.stream_completion_digest_batch(lines(spark.read.schema(FEED).parquet(str(tmp_path / "feed"))), 20)
    want = [r for r in rows_of(batch.select("key", "opened_at", "done", "total", "collapsed", "lines")) if r[:2] != (9, LATER[1][1])]
    assert sorted(out, key=repr) == want and len(want) == 7
    for name, kind in (("waiting", "list"), ("open", "value")):
        reader = spark.read.format("statestore").option("stateVarName", name)
        if kind == "list":
            reader = reader.option("flattenCollectionTypes", "true")
        assert {r.key[0] for r in reader.load(progress).select("key").collect()} <= {9}


# ---- listings ----------------------------------------------------------------------------------


def one_by_one(known, arrived):
    """known: {(source, item): [title, album, ms, position, present]}; merges listing after listing."""
    state = {k: list(v) for k, v in known.items()}
    for source, when in sorted({(r[0], r[8]) for r in arrived}):
        first = {}
        for r in sorted((r for r in arrived if (r[0], r[8]) == (source, when)), key=lambda r: r[5]):
            first.setdefault(r[1], r)
        positions = [v[3] for (s, _), v in state.items() if s == source and v[3] is not None]
        top = max(positions, default=0)
        open_end = any(r[6] or r[7] for r in first.values())
        for seen, r in enumerate(sorted(first.values(), key=lambda r: (r[5], r[1])), 1):
            old = state.get((source, r[1]), [None, None, None, None, None])
            place = r[5] if not r[6] else top + seen if old[3] is None else old[3]
            state[source, r[1]] = [r[2], old[1] if r[3] is None else r[3], old[2] if r[4] is None else r[4], place, True]
        if not open_end:
            for (s, i), v in state.items():
                if s == source and i not in first:
                    v[4] = False
    return sorted(((*k, *v) for k, v in state.items()), key=repr)


def listings(seed, sources, many, items):
    rnd = random.Random(seed)
    rows = []
    for source in range(sources):
        for when in range(1, many + 1):
            partial, truncated = rnd.random() < 0.5, rnd.random() < 0.2
            for place, i in enumerate(rnd.sample(range(items), rnd.randint(1, 6))):
                rows.append((source, i, f"t{when}", rnd.choice([None, f"a{when}"]), rnd.choice([None, when]), place * 2, partial, truncated and not partial, when))
    return rows


ITEMS = ["source_id", "external_id", "title", "album", "duration_ms", "position", "present"]


@pytest.mark.parametrize(("seed", "sources", "many", "items"), [(1, 3, 12, 15), (2, 1, 1000, 400), (3, 40, 3, 8)])
def test_any_number_of_listings_folds_in_one_pass(spark, seed, sources, many, items):
    rows = listings(seed, sources, many, items)
    want = one_by_one({}, rows)
    frame = lambda r: spark.createDataFrame(r, ITEM)
    assert rows_of(feeds.merge_listings(None, frame(rows)).select(ITEMS)) == want
    cut = many // 3
    first = feeds.merge_listings(None, frame([r for r in rows if r[8] <= cut])) if cut else None
    assert rows_of(feeds.merge_listings(first, frame([r for r in rows if r[8] > cut])).select(ITEMS)) == want


def test_known_items_without_position_and_untouched_sources(spark):
    known = {(1, 1): ["k", "a", 5, None, True], (1, 2): ["k", None, None, 40, False], (2, 1): ["k", None, None, 3, True]}
    rows = [(1, 1, "x", None, None, 0, True, False, 1), (1, 3, "x", None, None, 1, True, False, 1), (1, 3, "y", "b", 7, 9, False, True, 2), (1, 4, "z", None, None, 0, True, False, 3)]
    existing = spark.createDataFrame([(*k, *v) for k, v in known.items()], "source_id int, external_id int, title string, album string, duration_ms int, position int, present boolean")
    got = rows_of(feeds.merge_listings(existing, spark.createDataFrame(rows, ITEM)).select(ITEMS))
    assert got == one_by_one(known, rows)


# ---- scans -------------------------------------------------------------------------------------


def windows_of(times, seconds):
    out, opened = [], None
    for t in times:
        opened = t if opened is None or t >= opened + seconds else opened
        out.append(opened)
    return out


@pytest.mark.parametrize("step", [1, 4, 7])
def test_one_key_holds_the_whole_timeline(spark, step):
    rnd = random.Random(step)
    times = sorted(rnd.randrange(0, 600 * step) for _ in range(700))
    df = spark.createDataFrame([(1, i, at(t)) for i, t in enumerate(times)], "key bigint, event_id bigint, ts timestamp").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    got = {r.event_id: (r.opened_at - START).total_seconds() for r in feeds.opening_events(df, 10).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [got[i] for i in range(700)] == windows_of(times, 10)


def test_values_are_carried_over_task_boundaries(spark):
    rows = [(k, i, i if i % 97 == 0 else None) for k in (None, 1, 2) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, i int, v int").repartition(6)
    for inclusive in (False, True):
        got = {(r.k, r.i): r.c for r in carry_last(df, ["k"], ["i"], F.col("v"), "c", inclusive).collect()}
        want = lambda i: None if (j := i if inclusive else i - 1) < 0 else j // 97 * 97
        assert got == {(k, i): want(i) for k, i, _ in rows}


def test_neighbour_ranges_are_linear_and_hold_every_pair(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice([None, 0, 100, 100, 130, 131, rnd.randrange(1, 900)]), rnd.choice(["a", "a", None])) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, duration_ms int, match_key string").repartition(4)
    near = lookups.duration_neighbours(df, 30).collect()
    timed = sorted((d, i) for i, d, _ in rows if d and d > 0)
    assert [(r.id, r.rank) for r in sorted(near, key=lambda r: r.rank)] == [(i, n) for n, (_, i) in enumerate(timed, 1)]
    pairs = {(min(i, j), max(i, j), abs(a - b)) for n, (a, i) in enumerate(timed) for b, j in timed[:n] if abs(a - b) <= 30}
    assert sum(r.last - r.rank for r in near) == len(pairs)
    assert rows_of(lookups.duration_window_pairs(df, 30)) == sorted(pairs, key=repr)
    named = [(i, d) for i, d, k in rows if k and d and d > 0]
    far = {(i, j, abs(a - b)) for i, a in named for j, b in named if i < j and abs(a - b) > 30}
    assert rows_of(lookups.same_key_far_pairs(df, 30)) == sorted(far, key=repr)
