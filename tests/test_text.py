"""Text columns against literal cases."""

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import numbers as N
from shelfmark.functions import text as T
from shelfmark.operators import edits, linkage, rollups
from shelfmark.plans.templates import path_column


def one(spark, build, *values):
    """Evaluate a column expression over literal strings that pass through a table."""
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names))
    return df.select(build(*[F.col(n) for n in names]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("Song Name (Official Video) [HD]", "Song Name"),
        ("Song Name (Lyrics) | Some Channel", "Song Name"),
        ("A - B (Official Music Video Remastered)", "A - B (Official Music Video Remastered)"),
    ],
)
def test_clean_title(spark, raw, clean):
    assert one(spark, T.clean_title, raw) == clean


@pytest.mark.parametrize(
    "raw, channel, artist, title",
    [
        ("Around the World", "Daft Punk - Topic", "Daft Punk", "Around the World"),
        ("Muse - Uprising (Official Video)", "MuseVEVO", "Muse", "Uprising"),
        ("Uprising", "MuseVEVO", "Muse", "Uprising"),
        ("Right Now - Fort Minor (feat. X) [Official Audio]", "Fort Minor", "Fort Minor (feat. X)", "Right Now"),
        ("Fort Minor - Right Now", "Fort Minor", "Fort Minor", "Right Now"),
        ('Who - "Quoted"', None, "Who", "Quoted"),
        ("Alone", None, "Unknown Artist", "Alone"),
    ],
)
def test_split_title(spark, raw, channel, artist, title):
    got = one(spark, lambda r, c: F.struct(*T.split_title(r, c)), raw, channel)
    assert tuple(got) == (artist, title)


def test_similarity(spark):
    assert one(spark, T.similarity, "Around the World", "around the world") == 1.0
    assert one(spark, T.similarity, "Beyoncé", "Beyonce") == 1.0
    assert one(spark, T.similarity, "One More Time", "Something Else") == 0.0
    assert one(spark, T.similarity, "", "x") == 0.0


def test_fold_covers_ligatures_and_width(spark):
    assert one(spark, T.normalize, "ﬁn Ｆｕｌｌ é") == "fin full e"


@pytest.mark.parametrize(
    "artist, title, key",
    [
        ("Daft Punk, Romanthony", "One More Time - 2021 Remaster", "daft punk|one more time"),
        ("A feat. B", "Song (feat. B)", "a|song"),
        ("Daft Punk", "Aerodynamic", "daft punk|aerodynamic"),
        ("Daft Punk ft. Pharrell", "Get Lucky", "daft punk|get lucky"),
        (None, "x", None),
        ("x", "", None),
    ],
)
def test_match_key(spark, artist, title, key):
    assert one(spark, T.match_key, artist, title) == key


@pytest.mark.parametrize(
    "text, mode, out",
    [
        ("the sound of the underground", "title", "The Sound of the Underground"),
        ("SONG FOR ABBA", "title", "SONG FOR ABBA"),
        ("live in NYC (part ii)", "title", "Live in NYC (Part II)"),
        ("rock and roll all nite", "title", "Rock and Roll All Nite"),
        ("dance-pop", "title", "Dance-Pop"),
        ("HELLO world", "sentence", "Hello world"),
        ("Hello", "upper", "HELLO"),
    ],
)
def test_change_case(spark, text, mode, out):
    assert one(spark, lambda c: T.change_case(c, mode), text) == out


def test_replace_text(spark):
    assert one(spark, lambda c: edits.replace_text(c, " (Official Video)", "", case_sensitive=False), "Song (Official video)") == "Song"
    assert one(spark, lambda c: edits.replace_text(c, r"(\d+)", "#$1", regex=True), "Track 01") == "Track #01"
    assert one(spark, lambda c: edits.replace_text(c, ".", "$"), "a.b") == "a$b"


@pytest.mark.parametrize(
    "name, pattern, fields",
    [
        ("03 - Daft Punk - Digital Love.mp3", "%track% - %artist% - %title%", {"track_number": "03", "artist": "Daft Punk", "title": "Digital Love"}),
        ("Muse - Uprising.mp3", "{artist} - {title}", {"artist": "Muse", "title": "Uprising"}),
        ("nomatch.mp3", "%artist% - %title%", None),
        ("x - Muse - Uprising.mp3", "%ignore% - %artist% - %title%", {"artist": "Muse", "title": "Uprising"}),
    ],
)
def test_parse_filenames(spark, name, pattern, fields):
    row = edits.parse_filenames(spark.createDataFrame([(name,)], "rel_path string"), pattern).first().asDict()
    got = {k[2:]: v for k, v in row.items() if k.startswith("p_")} if row["parsed"] else None
    assert got == fields


def test_parse_filenames_with_folders(spark):
    df = spark.createDataFrame([("a/Muse/Best/Uprising.mp3",)], "rel_path string")
    row = edits.parse_filenames(df, "%artist% - %album% - %title%", use_folder=True).first()
    assert (row["p_artist"], row["p_album"], row["p_title"]) == ("Muse", "Best", "Uprising")


FIELDS = "title string, artist string, albumartist string, album string, year int, track int, disc int, genre string"


@pytest.mark.parametrize(
    "template, values, path",
    [
        (None, {"artist": "Daft Punk", "album": "Discovery", "track": 1, "title": "One More Time"}, "Daft Punk/Discovery/01 - One More Time"),
        (None, {"artist": "Muse", "title": "Uprising"}, "Muse/Singles/Uprising"),
        ("{artist}/{title}", {"artist": "AC/DC", "title": 'What? Why: "Now"'}, "AC_DC/What_ Why_ _Now_"),
        ("{albumartist|artist}", {"artist": "A feat. B", "albumartist": "A"}, "A"),
        ("{artist}/{disc}{track:02}", {"artist": "x", "track": 123}, "x/123"),
    ],
)
def test_render_path(spark, template, values, path):
    names = [f.split()[0] for f in FIELDS.split(", ")]
    df = spark.createDataFrame([tuple(values.get(n) for n in names)], FIELDS)
    text = template or "{albumartist|artist}/{album|Singles}/[{track:02} - ]{title}"
    assert df.select(path_column(text, {n: F.col(n) for n in names}).alias("x")).first()["x"] == path


@pytest.mark.parametrize(
    "file, title, artist, album, number",
    [
        ("music\\Gorillaz\\Cracker Island (2023) [FLAC]\\03 - Silent Running.flac", "Silent Running", "Gorillaz", "Cracker Island", 3),
        ("x\\Daft Punk - Discovery\\04. Daft Punk - Harder Better.flac", "Harder Better", "Daft Punk", "Discovery", 4),
        ("x\\Daft Punk - Discovery\\1-04 Harder Better.flac", "Harder Better", "Daft Punk", "Discovery", 4),
        ("x\\Gorillaz - Cracker Island - 04 - Silent Running.flac", "Silent Running", "Gorillaz", "x", 4),
    ],
)
def test_guess_tags(spark, file, title, artist, album, number):
    row = linkage.guess_tags_from_paths(spark.createDataFrame([(file,)], "file string"), "file").first()
    assert (row["guess_title"], row["guess_artist"], row["guess_album"], row["guess_track_number"]) == (title, artist, album, number)


def test_plain_title_and_base_album(spark):
    assert one(spark, T.plain_title, "Cracker Island ft. Thundercat") == "Cracker Island"
    assert one(spark, T.plain_title, "Cracker Island (feat. Thundercat) [Official Video]") == "Cracker Island"
    assert one(spark, T.plain_title, "Feather") == "Feather"
    assert one(spark, T.base_album, "Rumours (Super Deluxe) [2013 Remaster]") == "Rumours"
    assert one(spark, T.base_album, "(What's the Story) Morning Glory?") == "(What's the Story) Morning Glory?"


def test_ascii_punctuation(spark):
    assert one(spark, T.ascii_punctuation, "I‐E‐A · Don’t “Stop”…") == 'I-E-A · Don\'t "Stop"...'


LINKS = [
    ("https://open.spotify.com/track/4uLU6hMCjMI75M1A2tKUQC?si=abc", "spotify", "track", "4uLU6hMCjMI75M1A2tKUQC"),
    ("https://open.spotify.com/intl-de/album/2noRn2Aes5aoNVsU6iWThc", "spotify", "album", "2noRn2Aes5aoNVsU6iWThc"),
    ("spotify:playlist:37i9dQZF1DXcBWIGoYBM5M", "spotify", "playlist", "37i9dQZF1DXcBWIGoYBM5M"),
    ("https://youtu.be/K0HSD_i2DvA?t=3", "youtube", "track", "K0HSD_i2DvA"),
    ("https://music.youtube.com/watch?v=Jb6gcoR266U&list=RDAMVM", "youtube", "track", "Jb6gcoR266U"),
    ("https://www.youtube.com/playlist?list=PLx0sYbCqOb8TBPRdmBHs5Iftvv9TPboYG", "youtube", "playlist", "PLx0sYbCqOb8TBPRdmBHs5Iftvv9TPboYG"),
    ("https://music.youtube.com/playlist?list=OLAK5uy_abcdef", "youtube", "album", "OLAK5uy_abcdef"),
    ("https://www.youtube.com/@DaftPunk/videos", "youtube", "channel", "@DaftPunk"),
    ("youtube.com/channel/UC_kRDKYrUlrbtrSiyu5Tflg", "youtube", "channel", "UC_kRDKYrUlrbtrSiyu5Tflg"),
    ("https://soundcloud.com/foo", None, None, None),
    ("junk", None, None, None),
]


def test_parse_links(spark):
    df = spark.createDataFrame([(i, link[0]) for i, link in enumerate(LINKS)], "id int, text string")
    got = {r["id"]: (r["provider"], r["kind"], r["link_id"]) for r in linkage.parse_links(df, "text").collect()}
    assert got == {i: link[1:] for i, link in enumerate(LINKS)}


def test_parse_links_drops_repeats(spark):
    text = "https://youtu.be/K0HSD_i2DvA\nhttps://www.youtube.com/watch?v=K0HSD_i2DvA, junk"
    rows = linkage.parse_links(spark.createDataFrame([(1, text)], "id int, text string"), "text").collect()
    assert sorted(r["valid"] for r in rows) == [False, True]


def test_references_round_trip(spark):
    df = spark.createDataFrame([("some user/42", "@@x\\Björk #1\\01 - a/b?+.flac", 12345)], "user string, file string, size bigint")
    coded = df.withColumn("ref", linkage.encode_reference(F.col("user"), F.col("file"), F.col("size")))
    back = coded.select(*[c.alias(k) for k, c in linkage.decode_reference(F.col("ref")).items()]).first()
    assert tuple(back) == ("some user/42", "@@x\\Björk #1\\01 - a/b?+.flac", 12345)


def test_natural_key_orders_numbers(spark):
    df = spark.createDataFrame([("10 - b",), ("2 - a",), ("É1",), ("e2",)], "n string")
    assert [r["n"] for r in df.orderBy(T.natural_key(F.col("n"))).collect()] == ["2 - a", "10 - b", "É1", "e2"]
    assert [r["n"] for r in df.orderBy(T.collated_key(F.col("n"))).collect()] == ["2 - a", "10 - b", "É1", "e2"]


def test_frames_unpack(spark):
    import base64
    import struct

    raw = base64.b64encode(struct.pack("<3I", 1, 4294967295, 77)).decode()
    assert one(spark, N.unpack_frames, raw) == [1, 4294967295, 77]
    assert one(spark, N.unpack_frames, "") == []


def test_file_parts(spark):
    got = one(spark, lambda c: F.struct(*[v.alias(k) for k, v in rollups.file_parts(c).items()]), "a\\b/c.d.FLAC")
    assert (got["name"], got["ext"], got["dir"], got["folders"]) == ("c.d.FLAC", "flac", "a\\b", ["a", "b"])


def test_fold_covers_all_planes_and_expansions(spark):
    assert one(spark, T.normalize, "𝐁𝐨𝐥𝐝 ㎏ Ǆ ½ A™") == "bold kg dz 1 2 atm"
    assert one(spark, T.fold, "한국 ǅ é") == "한국 Dz e"


def test_long_numbers_sort_as_numbers(spark):
    names = ["x 999999999999999999", "x 1000000000000000000", "x 0000000000000000000007", "x 7a", "x 123456789012345678901234567890"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    want = ["x 0000000000000000000007", "x 7a", *names[:2], names[4]]
    for key in (T.natural_key, T.collated_key):
        assert [r["n"] for r in df.orderBy(key(F.col("n"))).collect()] == want


def test_presence_follows_the_type(spark):
    row = spark.sql("select '' as e, '0' as z, 'false' as f, 0 as i, 0.0D as d, 3 as n, false as b, true as t, cast(null as string) as u, cast('NaN' as double) as nan")
    got = row.select(*[N.truthy(F.col(c)).alias(c) for c in row.columns]).first().asDict()
    assert got == dict(e=False, z=True, f=True, i=False, d=False, n=True, b=False, t=True, u=False, nan=False)


@pytest.mark.parametrize("value, number", [("12", 12), ("99999999999", None), ("NaN", None), ("Infinity", None), ("x", None), ("-1", None)])
def test_positive_int(spark, value, number):
    assert one(spark, N.positive_int, value) == number


@pytest.mark.parametrize(
    "find, replacement, want",
    [("b+", "[$&]", "a[bb]c"), ("(b)b", "$1$2$$", "ab$2$c"), ("bb", "x\\y", "ax\\yc"), ("bb", "$x$", "a$x$c"), ("(a)(b)", "$2$1", "babc")],
)
def test_replacement_dialect(spark, find, replacement, want):
    assert one(spark, lambda c: edits.replace_text(c, find, replacement, regex=True), "abbc") == want


def test_one_bad_cell_is_an_error_row_and_not_a_failed_job(spark):
    lib = spark.createDataFrame([(1, "a", 1999), (2, "b", 2000), (3, "c", 2001), (4, "d", 2002)], "id int, rel_path string, year int")
    patches = [(1, {"year": "99999999999"}), (2, {"year": "NaN"}), (3, {"year": "1984"}), (4, {"year": ""}), (9, {"year": "1"})]
    out = edits.apply_edits(lib, spark.createDataFrame(patches, "id int, patch map<string,string>"))
    assert dict(out["library"].select("id", "year").collect()) == {1: 1999, 2: 2000, 3: 1984, 4: None}
    assert sorted(map(tuple, out["errors"].collect())) == [(1, "year is no number"), (2, "year is no number"), (9, "file not found")]


def test_a_very_long_number_in_a_name_is_no_slot(spark):
    from shelfmark.operators.ordering import resolve_path_collisions

    plan = spark.createDataFrame([(1, "x", "n/a.mp3", True), (2, "y", "n/a.mp3", True)], "id int, from_path string, to_path string, changed boolean")
    disk = spark.createDataFrame([("n/a.mp3",), ("n/a (99999999999999999999).mp3",)], "path string")
    assert dict(resolve_path_collisions(plan, disk).select("id", "to_path").collect()) == {1: "n/a (2).mp3", 2: "n/a (3).mp3"}
