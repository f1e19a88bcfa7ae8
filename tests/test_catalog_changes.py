"""Purge, donors, ids, edits, identification, word bitmaps and live tables on small cases."""

import datetime as dt
import random

from pyspark.sql import functions as F

from shelfmark.operators import duplicates, edits, enrichment, lookups
from shelfmark.sources import inventory
from shelfmark.streaming import feeds


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_purge_stays_inside_the_quarantine(spark):
    log = spark.createDataFrame(
        [
            (1, "quarantine", "lib/a.mp3", "q/day/a.mp3"), (2, "quarantine", "lib/b.mp3", "q/../lib/b.mp3"), (3, "quarantine", "lib/c.mp3", "quality/c.mp3"),
            (4, "quarantine", "lib/d.mp3", "q/d.mp3"), (5, "restore", "q/d.mp3", "lib/d.mp3"), (6, "quarantine", "x", "./q/./day/../e.mp3"),
            (7, "quarantine", "x", "q"), (8, "quarantine", "lib/f.mp3", "q/f.mp3"), (9, "quarantine", "lib/a.mp3", "q/day/a.mp3"),
        ],
        "op_id long, kind string, from_path string, to_path string",
    ).withColumns({"at": F.col("op_id"), "detail": F.lit(None).cast("map<string,string>")})
    asked = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6, 7, 9, 9, 99)], "op_id long")
    gone = duplicates.purge(log, asked, "q")
    assert rows_of(gone) == [("delete", "./q/./day/../e.mp3", None), ("delete", "q/day/a.mp3", None)]
    after = log.unionByName(gone.withColumns({"op_id": F.lit(50).cast("long"), "at": F.lit(50).cast("long"), "detail": F.lit(None).cast("map<string,string>")}))
    assert {r.to_path for r in duplicates.quarantine_view(after).collect()} == {"q/../lib/b.mp3", "quality/c.mp3", "q", "q/f.mp3"}
    assert duplicates.purge(after, asked, "q").count() == 0


def test_donors_fill_what_the_keeper_lacks(spark):
    lib = spark.createDataFrame(
        [(1, False, True), (2, True, False), (3, True, True), (4, True, True), (5, True, True), (6, False, False), (7, None, False)],
        "id int, has_artwork boolean, has_lyrics boolean",
    ).withColumns({c: F.lit(None).cast("string") for c in ("title", "artist", "album")} | {"rel_path": F.concat(F.lit("p"), "id"), "size": F.col("id")})
    decisions = spark.createDataFrame([(1, 1, True), (1, 2, False), (1, 3, False), (4, 4, True), (4, 5, False), (6, 6, False), (6, 7, True)], "component int, id int, keep boolean")
    out = duplicates.resolve_duplicates(lib, decisions, "2024-01-01")
    assert rows_of(out["donors"]) == [(1, 2, None)]
    assert rows_of(out["library"].select("id", "has_artwork", "has_lyrics")) == [(1, True, True), (4, True, True), (7, None, False)]


def test_number_ids_follow_the_largest(spark):
    index = spark.createDataFrame([("a", 7, "x"), ("b", 3, "y")], "path string, id int, title string")
    changes = spark.createDataFrame([("b", "z"), ("d", "n"), ("c", "m")], "path string, title string")
    out = inventory.merge_upsert_invalidate(index, changes, spark.createDataFrame([("a",)], "path string"))
    assert rows_of(out) == [("b", 3, "z"), ("c", 8, "m"), ("d", 9, "n")] and out.schema["id"].dataType.simpleString() == "int"
    empty = inventory.merge_upsert_invalidate(index.limit(0), changes, spark.createDataFrame([], "path string"))
    assert [r.id for r in empty.orderBy("path").collect()] == [1, 2, 3]


def test_edits_of_artwork_lyrics_ids_and_place(spark):
    lib = spark.createDataFrame(
        [(i, f"old/{i}.mp3", "A", "T", "Al", "mp3", False, True, "w", None) for i in range(4)],
        "id int, rel_path string, artist string, title string, album string, format string, has_artwork boolean, has_lyrics boolean, lyrics string, mb_artist_id string",
    ).withColumns({"album_artist": F.col("artist"), **{c: F.lit(None).cast("int") for c in ("year", "track_number", "disc_number", "track_total")}, "genre": F.lit(None).cast("string")})
    asked = spark.createDataFrame(
        [(0, {"artwork_url": "good", "mb_artist_id": " m "}), (1, {"artwork_url": "bad", "title": "N"}), (2, {"lyrics": None, "title": "N", "artwork_url": ""}), (9, {"title": "N"})],
        "id int, patch map<string,string>",
    )
    images = spark.createDataFrame([("good", True), ("bad", False)], "url string, ok boolean")
    out = edits.apply_edits(lib, asked, images, "{artist}/{title}")
    got = rows_of(out["library"].select("id", "title", "has_artwork", "has_lyrics", "lyrics", "mb_artist_id"))
    assert got == [(0, "T", True, True, "w", " m "), (1, "T", False, True, "w", None), (2, "N", False, False, None, None), (3, "T", False, True, "w", None)]
    assert rows_of(out["errors"]) == [(1, "Could not download artwork"), (9, "file not found")]
    assert [r.id for r in out["log"].orderBy("id").collect()] == [0, 2]
    moves = {r.id: r.to_path for r in out["moves"].collect()}
    assert set(moves) == {0, 2} and moves[0] != moves[2] and all(p.endswith(".mp3") for p in moves.values())
    assert rows_of(edits.apply_edits(lib, asked)["errors"])[:2] == [(0, "Could not download artwork"), (1, "Could not download artwork")]


def test_original_year_is_that_of_the_group(spark):
    releases = spark.createDataFrame([("g", 1999), ("g", 1987), ("h", None), (None, 1950), ("k", 0)], "release_group string, year int")
    assert rows_of(enrichment.original_years(releases)) == [("g", 1987)]
    groups = spark.createDataFrame([("g", "1985-03-01"), ("h", ""), ("k", "unknown"), ("m", None)], "release_group string, first_date string")
    assert rows_of(enrichment.original_years(releases, groups)) == [("g", 1985)]


def test_all_words_over_several_bitmap_blocks(spark):
    n = 70_000  # two full blocks and a part
    docs = spark.range(n).select(
        F.col("id").alias("doc_id"),
        F.array_compact(F.array(F.lit("all"), F.when(F.col("id") % 2 == 0, "even"), F.when(F.col("id") % 9973 == 0, "rare"), F.when(F.col("id") == n - 1, "last"))).alias("words"),
    )
    queries = spark.createDataFrame([(1, ["all", "rare"]), (2, ["even", "rare"]), (3, ["last"]), (4, ["last", "even"]), (5, ["rare", "unknown"]), (6, []), (7, ["all", "even", "rare", "last"])], "query_id int, words array<string>")
    rare = range(0, n, 9973)
    want = [(1, i) for i in rare] + [(2, i) for i in rare if i % 2 == 0] + [(3, n - 1)]
    assert rows_of(lookups.all_words_search(queries, docs)) == sorted(want, key=repr)


def test_word_sets_of_common_words_lose_no_link(spark):
    rnd = random.Random(4)
    sets = [sorted(rnd.sample(range(60), rnd.randint(1, 45))) for _ in range(60)]
    sets += [sorted({*s, 70, 71}) for s in sets[:20]] + [s[1:] for s in sets[:20] if len(s) > 1]
    df = spark.createDataFrame([(i, [f"w{x}" for x in s]) for i, s in enumerate(sets)], "id int, words array<string>")
    for threshold in (0.5, 0.8):
        first = {}
        for i, s in enumerate(sets):
            first.setdefault(tuple(s), i)
        want = {(first[tuple(s)], i) for i, s in enumerate(sets) if first[tuple(s)] != i}
        heads = sorted(first.values())
        want |= {(i, j) for n, i in enumerate(heads) for j in heads[n + 1 :] if 2 * len({*sets[i]} & {*sets[j]}) >= threshold * (len(sets[i]) + len(sets[j])) - 1e-9}
        assert {(r.a, r.b) for r in lookups.token_similarity_join(df, threshold).collect()} == want


def test_updates_replace_rows_of_a_live_table(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    frame = lambda rows: spark.createDataFrame(rows, "day timestamp, day_end timestamp, done long")
    merge = feeds.replace_rows(["day", "day_end"])
    first = merge(None, frame([(day(1), day(2), 5), (day(2), day(3), 1)]))
    assert rows_of(merge(first, frame([(day(2), day(3), 4), (day(3), day(4), 2)]))) == [(day(1), day(2), 5), (day(2), day(3), 4), (day(3), day(4), 2)]
