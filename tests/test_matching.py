"""Scored matching, release choice and merging against literal cases."""

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import enrichment, filters, linkage, ordering, rollups

SCORE = "id string, target_title string, target_artist string, target_artists array<string>, target_ms bigint, cand_title string, channel string, cand_sec int, cand_track string, cand_artist string, trusted boolean"
WORLD = ("Around the World", "Daft Punk", None, 429000)


def test_score_candidates(spark):
    rows = [
        ("topic", *WORLD, "Around the World", "Daft Punk - Topic", 429, None, None, False),
        ("video", *WORLD, "Daft Punk - Around The World (Official Music Video Remastered)", "Daft Punk", 242, None, None, False),
        ("cover", *WORLD, "Around The World (Daft Punk Cover)", "Someone", 430, None, None, False),
        ("live", *WORLD, "Daft Punk - Around the World (Live 2007)", "Fan", 431, None, None, False),
        ("wanted", "Around the World (Live)", "Daft Punk", None, 300000, "Daft Punk - Around the World (Live)", "Daft Punk", 300, None, None, False),
        ("other", *WORLD, "Muse - Uprising", "Muse", 305, None, None, False),
    ]
    s = {r["id"]: r["score"] for r in linkage.score_candidates(spark.createDataFrame(rows, SCORE)).collect()}
    assert s["topic"] > 0.9 and s["topic"] > s["video"]
    assert s["cover"] < 0.6 and s["live"] < 0.6 and s["wanted"] > 0.8 and s["other"] < 0.3


PLAN = "target_id int, title string, artist string, artists array<string>, album string"


def plan(spark, *row):
    out = linkage.search_plan(spark.createDataFrame([(1, *row)], PLAN)).orderBy("step").collect()
    return [(r["label"], r["query"]) for r in out]


def test_search_plan(spark):
    assert plan(spark, "Cracker Island (feat. Thundercat) [Official Video]", "Gorillaz, Thundercat", ["Gorillaz", "Thundercat"], "Cracker Island") == [
        ("artist + title", "gorillaz cracker island"), ("title only", "cracker island"),
    ]
    assert [q for _, q in plan(spark, "Silent Running", "Gorillaz", None, "Cracker Island")] == [
        "gorillaz silent running", "silent running", "gorillaz cracker island", "cracker island",
    ]
    assert plan(spark, "Oil", "Gorillaz", None, "Cracker Island") == [
        ("artist + title", "gorillaz oil"), ("title + album", "oil cracker island"),
        ("artist + album", "gorillaz cracker island"), ("album only", "cracker island"),
    ]
    assert [label for label, _ in plan(spark, "Go", "The Chemical Brothers", None, None)] == ["artist + title"]


MB = 1024 * 1024
ALBUM = "music\\Pink Floyd\\Wish You Were Here (1975)\\"
SONG = f"{ALBUM}04 - Wish You Were Here.flac"
CD = {1: 334, 4: 44100, 5: 16}
HITS = (
    "hit_id int, user_name string, file string, size bigint, slots boolean, speed int, queue_length int, attribs map<int,int>, target_id int, "
    "title string, artist string, artists array<string>, target_ms bigint, album string, track_number int, prefer_user string, prefer_dir string"
)
FLOYD = (1, "Wish You Were Here", "Pink Floyd", ["Pink Floyd"], 334000, "Wish You Were Here", 4)


def hits(spark, *rows, prefer=(None, None)):
    full = []
    for i, (user, file, extra) in enumerate(rows):
        d = {"size": 35 * MB, "slots": True, "speed": 100, "queue": 0, "attribs": CD, **extra}
        full.append((i, user, file, d["size"], d["slots"], d["speed"], d["queue"], d["attribs"], *FLOYD, *prefer))
    return spark.createDataFrame(full, HITS)


def picked(df, **kw):
    return [r["user_name"] for r in ordering.rank_lossless_picks(df.where("verdict = 'accepted'"), **kw).orderBy("place").collect()]


def test_match_lossless_report(spark):
    judged = linkage.match_lossless(
        hits(
            spark,
            ("a", SONG, {}),
            ("mp3", SONG.replace(".flac", ".mp3"), {}),
            ("other-song", f"{ALBUM}01 - Shine On You Crazy Diamond.flac", {}),
            ("cover", "music\\Sparklehorse\\Good Morning Spider\\04 - Wish You Were Here.flac", {"attribs": {1: 250}}),
            ("live", "music\\Pink Floyd\\Pulse (Live)\\11 - Wish You Were Here.flac", {}),
            ("wrong-length", SONG, {"attribs": {1: 420}}),
            ("tiny", SONG, {"size": MB}),
        )
    )
    best = judged.where("verdict = 'accepted'").first()
    assert best["user_name"] == "a" and best["score"] > 0.9
    assert best["evidence"] == ["artist", "album", "track number", "length"]
    histogram = rollups.rejection_histogram(judged)
    got = {r["verdict"]: (r["files"], r["looked_at"]) for r in histogram.collect()}
    assert got == {
        "another title": (1, 6), "wrong length": (2, 6), "another version (live, remix…)": (1, 6), "unusual size": (1, 6),
    }
    assert rollups.describe_rejections(histogram).first()["report"].startswith("2 wrong length")


def test_match_lossless_without_artist(spark):
    bare = "Discography [1967-2014]\\1975 - Wish You Were Here\\04 -Wish You Were Here.flac"
    judged = linkage.match_lossless(
        hits(
            spark,
            ("bare", bare, {}),
            ("no-length", bare, {"attribs": {}}),
            ("stray", "stuff\\mix\\Wish You Were Here.flac", {}),
            ("same-name", "x\\Incubus\\Morning View\\03 - Wish You Were Here.flac", {}),
        )
    )
    assert picked(judged) == ["bare"]


def test_match_lossless_order(spark):
    rows = [
        ("queued", SONG, {"slots": False, "queue": 20}),
        ("hires", SONG, {"attribs": {1: 334, 4: 96000, 5: 24}}),
        ("cd", SONG, {}),
    ]
    assert picked(linkage.match_lossless(hits(spark, *rows))) == ["cd", "hires", "queued"]
    free = linkage.match_lossless(hits(spark, *rows), free_only=True)
    assert picked(free) == ["cd", "hires"] and free.where("verdict = 'busy'").count() == 1


def test_match_lossless_hi_res_preference(spark):
    rows = [
        ("cd", SONG, {}),
        ("hires", SONG, {"attribs": {1: 334, 4: 48000, 5: 24}}),
        ("big", SONG, {"size": 120 * MB, "attribs": {1: 334}}),
    ]
    judged = linkage.match_lossless(hits(spark, *rows))
    assert picked(judged, prefer_hires=True) == ["hires", "big", "cd"] and picked(judged)[0] == "cd"


def test_match_lossless_known_folder_and_exclusion(spark):
    other = "share\\Pink Floyd\\WYWH\\04 - Wish You Were Here.flac"
    df = hits(spark, ("fast", SONG, {"speed": 999}), ("known", other, {}), prefer=("known", "share\\Pink Floyd\\WYWH"))
    assert picked(linkage.match_lossless(df)) == ["known", "fast"]
    tried = spark.createDataFrame([(1, "known", other)], "target_id int, user_name string, file string")
    assert picked(linkage.match_lossless(df, excluded=tried)) == ["fast"]
    quiet = linkage.match_lossless(hits(spark, ("a", SONG, {"attribs": {}})))
    assert quiet.first()["score"] == pytest.approx(0.9)


FOLDER_HITS = "hit_id int, user_name string, file string, size bigint, slots boolean, speed int, queue_length int"


def test_folders(spark):
    gorillaz = "music\\Gorillaz\\Cracker Island (2023)\\"
    rows = [
        (0, "slow", "@@a\\Music\\Gorillaz\\Cracker Island\\02 - Cracker Island.flac", 1000, False, 100, 40),
        (1, "fast", f"{gorillaz}10 - Skinny Ape.flac", 1000, True, 100, 0),
        (2, "fast", f"{gorillaz}2 - Oil.flac", 1000, True, 100, 0),
        (3, "fast", f"{gorillaz}2 - Oil.flac", 1000, True, 100, 0),
        (4, "fast", f"{gorillaz}cover.jpg", 1000, True, 100, 0),
        (5, "mp3s", "x\\Gorillaz - Cracker Island.mp3", 1000, True, 100, 0),
    ]
    files = rollups.folder_files(spark.createDataFrame(rows, FOLDER_HITS))
    folders = rollups.folder_rollup(files)
    fast = folders.where("user_name = 'fast'").first()
    assert (fast["label"], fast["total_size"], fast["files"]) == ("Gorillaz / Cracker Island (2023)", 2000, 2)
    listing = rollups.folder_listing(files).where("user_name = 'fast'").orderBy("place")
    assert [r["name"] for r in listing.collect()] == ["2 - Oil.flac", "10 - Skinny Ape.flac"]
    assert [r["user_name"] for r in ordering.rank_folders(folders).collect()] == ["fast", "mp3s", "slow"]
    flac = rollups.folder_rollup(rollups.folder_files(spark.createDataFrame(rows, FOLDER_HITS), "flac"))
    assert [r["user_name"] for r in ordering.rank_folders(flac).collect()] == ["fast", "slow"]


# ---- recordings and releases -------------------------------------------------------------------

PAIR = "q int, q_title string, q_artist string, q_ms bigint, recording_id string, title string, artist string, duration_ms bigint, score double, has_studio boolean"
TOX = (1, "Toxicity", "System Of A Down", 220000)


def best(spark, fn, *rows):
    got = fn(spark.createDataFrame(list(rows), PAIR)).first()
    return got and got["recording_id"]


def test_match_recordings(spark):
    soad = "System of a Down"
    assert best(
        spark, enrichment.match_recordings,
        (*TOX, "live", "Toxicity", soad, 281000, 1.0, False), (*TOX, "single", "Toxicity", soad, 219500, 1.0, False), (*TOX, "album", "Toxicity", soad, 218939, 1.0, True),
    ) == "album"
    rick = (1, "Never Gonna Give You Up", "Rick Astley", 213000)
    inst = ("inst", "Never Gonna Give You Up (instrumental)", "Rick Astley", 213000, 1.0, False)
    orig = ("orig", "Never Gonna Give You Up", "Rick Astley", 213500, 1.0, False)
    assert best(spark, enrichment.match_recordings, (*rick, *inst), (*rick, *orig)) == "orig"
    asked = (1, "Never Gonna Give You Up (Instrumental)", "Rick Astley", 213000)
    assert best(spark, enrichment.match_recordings, (*asked, *inst), (*asked, *orig)) == "inst"
    assert best(spark, enrichment.match_recordings, (*TOX, "x", "Aerials", soad, 219000, 1.0, True)) is None
    assert best(spark, enrichment.match_recordings, (*TOX, "x", "Toxicity", "Toxicity Tribute Band", 219000, 1.0, True)) is None


def test_match_by_fingerprint(spark):
    soad = "System of a Down"
    wrong = (*TOX, "wrong", "Money Spread", "Lil Uzi Vert feat. Young Nudy", 219000, 0.98, True)
    right = (*TOX, "right", "Toxicity", soad, 219000, 0.95, True)
    weak = (*TOX, "weak", "Toxicity", soad, 219000, 0.6, True)
    other = (*TOX, "compilation", "Toxicity", soad, 219000, 0.97, False)
    assert best(spark, enrichment.match_by_fingerprint, wrong, right, weak, other) == "right"
    assert best(spark, enrichment.match_by_fingerprint, wrong) is None
    assert best(spark, enrichment.match_by_fingerprint, (1, "track01", "Unknown Artist", 1, *wrong[4:])) == "wrong"


REL = "recording_id int, release_id string, title string, date string, rank int, status string, primary_type string, secondary_types array<string>, prefer_album string"


def releases(spark, prefer):
    rows = [
        (1, "a", "Chop Suey!", "2001-08-13", 1, "Official", "Single", [], prefer),
        (1, "b", "Toxicity", "2002-04-23", 0, "Official", "Album", [], prefer),
        (1, "c", "Toxicity", "2001-09-04", 0, "Official", "Album", [], prefer),
        (1, "d", "Greatest Hits", "2010", 3, "Official", "Album", ["Compilation"], prefer),
    ]
    return enrichment.classify_release(spark.createDataFrame(rows, REL))


def test_pick_release(spark):
    assert enrichment.pick_release(releases(spark, None)).first()["release_id"] == "c"
    assert enrichment.pick_release(releases(spark, "greatest hits")).first()["release_id"] == "d"


def test_classify_release(spark):
    rows = [
        ("album", "Official", "Album", [], "X"), ("live", "Official", "Album", [], "Pledge of Allegiance Tour: Live"),
        ("bootleg", "Bootleg", "Album", [], "X"), ("compilation", "Official", "Album", ["Compilation"], "X"), ("single", "Official", "Single", [], "X"),
    ]
    df = spark.createDataFrame(rows, "want string, status string, primary_type string, secondary_types array<string>, title string")
    assert all(r["want"] == r["kind"] for r in enrichment.classify_release(df).collect())


def test_match_confidence(spark):
    base = (*TOX, "r", "Toxicity", "System of a Down", 219000, 1.0)
    rows = [(*base, k, False) for k in ("album", "single", "live", "bootleg")]
    rows += [(*base[:7], 281000, 1.0, "album", False), (1, "track01", "System Of A Down", 220000, "r", "Toxicity", "System of a Down", 219000, 0.97, "album", True)]
    df = spark.createDataFrame(rows, PAIR.replace("has_studio boolean", "kind string, verified boolean"))
    album, single, live, bootleg, far, heard = [r["confidence"] for r in enrichment.match_confidence(df).collect()]
    assert album >= 0.9 and album > single > live > bootleg and far < album - 0.15 and heard > 0.95


def test_genre_vote(spark):
    rows = [
        ("a", "alternative metal", 20), ("a", "metal", 10), ("a", "nu metal", 7), ("a", "rock", 3),
        ("b", "dance-pop", 5), ("b", "pop", 5), ("b", "soft rock", 2),
    ]
    votes = spark.createDataFrame(rows, "entity string, name string, votes bigint")
    got = {}
    for r in rollups.genre_vote(votes).orderBy("entity", "place").collect():
        got.setdefault(r["entity"], []).append(r["genre"])
    assert got == {"a": ["Alternative Metal", "Nu Metal"], "b": ["Dance-Pop", "Soft Rock"]}
    parents = spark.createDataFrame([("c", "a"), ("a", "b")], "entity string, parent string")
    assert rollups.genre_vote(votes, parents=parents).where("entity = 'c'").count() == 2


IN = "seq int, album_artist string, artist string, album string, release_id string"
KNOWN = "album_artist string, album string, mb_release_id string"


def identity(spark, incoming, known):
    lib = spark.createDataFrame(known, KNOWN)
    rows = spark.createDataFrame([(i, a, "Josh Homme", b, r) for i, (a, b, r) in enumerate(incoming)], IN)
    out = enrichment.album_identity(rows, lib).orderBy("seq").collect()
    return [(r["out_album_artist"], r["out_album"], r["out_release_id"]) for r in out]


def test_album_identity(spark):
    fresh = [("Disturbed", "Asylum", "pressing-a"), ("DISTURBED", "asylum", "pressing-b"), ("Disturbed", "Immortalized", "other")]
    assert identity(spark, fresh, [("x", "y", "z")]) == [
        ("Disturbed", "Asylum", "pressing-a"), ("Disturbed", "Asylum", "pressing-a"), ("Disturbed", "Immortalized", "other"),
    ]
    known = [("Tool", "Fear Inoculum", "common"), ("Tool", "Fear Inoculum", "common"), ("Tool", "Fear Inoculum", "rare"), ("TOOL", "Fear Inoculum", None), ("Various Artists", "Sound City - Real to Reel", "ost")]
    asked = [
        ("TOOL", "Fear Inoculum", "new"), ("TOOL", "Lateralus", None), ("TOOL", None, "solo"),
        (None, "Sound City - Real to Reel", None), ("Someone Else", "Fear Inoculum", "theirs"),
    ]
    assert identity(spark, asked, known) == [
        ("Tool", "Fear Inoculum", "common"), ("Tool", "Lateralus", None), ("Tool", None, "solo"),
        ("Various Artists", "Sound City - Real to Reel", "ost"), ("Someone Else", "Fear Inoculum", "theirs"),
    ]


LIB = "id int, title string, artist string, album string, album_artist string, year int, genre string, track_number int, disc_number int, bitrate int, format string, lossless boolean, has_artwork boolean, has_lyrics boolean, rel_path string"


def test_filters_and_sort(spark):
    rows = [
        (1, "One More Time", "Daft Punk", "Discovery", None, None, None, 1, None, 320, "mp3", False, True, True, ""),
        (2, "Aerodynamic", "Daft Punk", "Discovery", None, None, None, 2, None, 320, "mp3", False, False, True, ""),
        (3, "Uprising", "Muse", None, None, None, None, None, None, 900, "flac", True, True, True, ""),
        (4, "Low", "X", None, None, None, None, None, None, 128, "mp3", False, True, True, ""),
    ]
    df = spark.createDataFrame(rows, LIB)
    ids = lambda d: sorted(r["id"] for r in d.collect())
    assert ids(filters.search_catalog(df, "daft disc")) == [1, 2]
    assert ids(filters.filter_quality(df, "lossless")) == [3]
    assert ids(filters.filter_quality(df, "low")) == [4]
    assert ids(filters.filter_missing_metadata(df, ["no_art"])) == [2]
    assert [r["title"] for r in ordering.sort_catalog(df, [("album", "desc"), ("title", "asc")]).collect()] == ["One More Time", "Aerodynamic", "Low", "Uprising"]


def test_series(spark):
    import math

    points = [(1, i + 1, float(round(math.sin(i / 10) * 16384))) for i in range(16000)] + [(2, i + 1, 0.0) for i in range(100)]
    s = spark.createDataFrame(points, "series_id int, idx int, value double")
    peaks = rollups.series_peaks(s).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.max("peak").alias("top"))
    got = {r["series_id"]: (r["n"], r["top"]) for r in peaks.collect()}
    assert got[1][0] == 800 and got[1][1] > 120 and got[2] == (800, 0)
    levels = {r["series_id"]: r["level"] for r in rollups.series_level(s).collect()}
    assert levels[1] == pytest.approx(-9, abs=0.5) and levels[2] == -70
