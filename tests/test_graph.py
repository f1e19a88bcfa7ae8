"""Duplicate evidence, components and groups; skewed keys on every path."""

import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import duplicates, lookups, ordering
from shelfmark.plans import durable
from shelfmark.plans.skew import SortKey, hot_keys, number_rows, spread_join, top_n


def noise(seed, n):
    out, x = [], seed
    for _ in range(n):
        x = (x * 1664525 + 1013904223) & 0xFFFFFFFF
        out.append(x)
    return out


A = noise(1, 400)
NOISY = [v ^ 0b1011 if i % 5 == 0 else v for i, v in enumerate(A)]
PRINTS = {
    1: A, 2: noise(9, 3) + A, 3: noise(9, 120) + A, 4: NOISY, 5: noise(9, 120) + NOISY, 6: noise(2, 400),
    7: [0] * 300 + noise(3, 400), 8: [0] * 300 + noise(4, 400), 9: A, 10: [0] * 300, 11: [0] * 300, 12: A[:10],
}


def prints(spark, table):
    return spark.createDataFrame([(k, v, len(v)) for k, v in table.items()], "id int, frames array<bigint>, length int")


def brute(a, b):
    """Alignment and bit error rate, step by step over two lists."""
    runs = []
    for f in (a, b):
        r = {}
        for i, v in enumerate(f):
            r.setdefault(v >> 18, []).append(i)
        runs.append(r)
    votes = {}
    for k, p in runs[0].items():
        q = runs[1].get(k, [])
        if len(p) * len(q) <= 64:
            for i in p:
                for j in q:
                    if abs(j - i) <= 200:
                        votes[j - i] = votes.get(j - i, 0) + 1
    at = min(votes, key=lambda o: (-votes[o], o)) if votes else 0

    def err(off):
        lo, hi = max(0, -off), min(len(a), len(b) - off)
        n = hi - lo
        if n < 16 or n < min(len(a), len(b)) / 2:
            return 1.0
        return sum(bin(a[i] ^ b[i + off]).count("1") for i in range(lo, hi)) / (n * 32)

    best = err(at)
    return 1 - (best if best > 0.4 else min(best, err(at - 1), err(at + 1)))


def test_acoustic_similarity_against_brute_force(crowded):
    pairs = [(i, j) for i in PRINTS for j in PRINTS if i < j] + [(3, 1)]
    df = crowded.createDataFrame(pairs, "a int, b int")
    out = duplicates.acoustic_similarity(df, prints(crowded, PRINTS), None).collect()
    got = {(r["a"], r["b"]): r["similarity"] for r in out}
    assert len(got) == len(pairs)
    for a, b in pairs:
        assert got[(a, b)] == pytest.approx(brute(PRINTS[a], PRINTS[b])), (a, b)
    assert got[(1, 9)] == 1 and got[(1, 2)] > 0.99 and got[(1, 3)] > 0.99 and got[(3, 1)] > 0.99
    assert got[(1, 4)] > 0.95 and got[(1, 5)] > 0.95 and got[(1, 6)] < 0.65 and got[(7, 8)] < 0.82


FILES = "id int, title string, artist string, album string, album_artist string, year int, track_number int, genre string, format string, codec string, lossless boolean, bitrate int, sample_rate int, bits_per_sample int, duration_ms bigint, size bigint, has_artwork boolean, has_lyrics boolean, mb_recording_id string, added_at bigint, from_pipeline boolean, rel_path string, audio_hash string, match_key string"


def file(i, **o):
    d = dict(id=i, title="t", artist="a", lossless=False, bitrate=320, duration_ms=1, size=10, has_artwork=False, has_lyrics=False, added_at=i, from_pipeline=False, rel_path=f"d/{i}.mp3", audio_hash=None, match_key=None, format="mp3")
    d.update(o)
    return tuple(d.get(f.split()[0]) for f in FILES.split(", "))


def test_find_duplicates(crowded):
    song = noise(1, 1500)
    sounds = {1: song, 2: song + noise(2, 320), 5: song + noise(3, 900)}
    soad, tool = "system of a down|hypnotize", "tool|lateralus"
    lib = crowded.createDataFrame(
        [
            file(1, duration_ms=189000, match_key=soad), file(2, duration_ms=229000, match_key=soad),
            file(3, duration_ms=200000, match_key=tool), file(4, duration_ms=562000, match_key=tool),
            file(5, duration_ms=300000, match_key="system of a down|lonely day"),
        ],
        FILES,
    )
    frames = crowded.createDataFrame([(k, i, f) for k, v in sounds.items() for i, f in enumerate(v)], "id int, pos int, frame bigint")
    groups = duplicates.find_duplicates(lib, frames)
    assert sorted((r["component"], r["files"], r["reasons"]) for r in groups.collect()) == [(1, 2, "acoustic,metadata"), (3, 2, "metadata")]
    gone = crowded.createDataFrame([("1,2",), ("3,4,9",), ("3",)], "group_key string")
    left = duplicates.find_duplicates(lib, frames, gone)
    assert [r["component"] for r in left.collect()] == [3]


def test_components_of_random_graphs(crowded):
    rnd = random.Random(7)
    for nodes, links in ((60, 45), (200, 150), (40, 200)):
        edges = [(rnd.randrange(nodes), rnd.randrange(nodes)) for _ in range(links)]
        edges += [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2001 + i) for i in range(50)]
        parent = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in edges:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
        want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
        got = duplicates.connected_components(crowded.createDataFrame(edges, "src int, dst int")).collect()
        assert {r["id"]: r["component"] for r in got} == want and len(got) == len(want)


def test_keeper_rules(spark):
    rows = [
        file(1, rel_path="Dupes/Aerodynamic (copy).mp3", added_at=1), file(2, rel_path="D/02 - Aerodynamic.mp3", added_at=5),
        file(11, rel_path="X/Song (2).mp3", added_at=0), file(12, rel_path="X/Song.mp3", added_at=9),
        file(21, bitrate=128), file(22, bitrate=320, rel_path="X/Song (copy).mp3"),
        file(31, format="opus", bitrate=160), file(32, format="mp3", bitrate=192),
        file(41, lossless=True, bitrate=900, format="flac"), file(42, bitrate=320),
    ]
    df = spark.createDataFrame(rows, FILES).withColumn("component", F.floor(F.col("id") / 10))
    got = {r["component"]: r["keeper_id"] for r in ordering.pick_keeper(df).collect()}
    assert got == {0: 2, 1: 12, 2: 22, 3: 31, 4: 41}


def test_resolve_duplicates(spark):
    rows = [file(1, album="", year=None, bitrate=900, rel_path="a/x.mp3"), file(2, album="Best", year=1999, genre="Pop", rel_path="b/x.mp3"), file(3, album="Later", year=2001), file(9, album="Else")]
    lib = spark.createDataFrame(rows, FILES)
    decisions = spark.createDataFrame([(1, 1, True), (1, 2, False), (1, 3, False)], "component int, id int, keep boolean")
    tracks = spark.createDataFrame([(7, "b/x.mp3"), (8, "zzz")], "track_id int, file_path string")
    log = spark.createDataFrame([("q/2024-01-02/b/x.mp3",)], "to_path string")
    out = duplicates.resolve_duplicates(lib, decisions, "2024-01-02", "q", tracks, log)
    kept = {r["id"]: (r["album"], r["year"], r["genre"]) for r in out["library"].collect()}
    assert kept == {1: ("Best", 1999, "Pop"), 9: ("Else", None, None)}
    assert {r["to_path"] for r in out["quarantine"].collect()} == {"q/2024-01-02/b/x (2).mp3", "q/2024-01-02/d/3.mp3"}
    assert {r["track_id"]: r["file_path"] for r in out["tracks"].collect()} == {7: "a/x.mp3", 8: "zzz"}
    assert out["log"].count() == 2


def test_path_collisions_follow_order(crowded):
    plan = [(i, f"o/{i}", "n/a.mp3", True) for i in range(1, 7)] + [(7, "o/7", "n/a (3).mp3", True), (8, "n/b.mp3", "n/b.mp3", False), (9, "o/9", "n/b.mp3", True)]
    df = crowded.createDataFrame(plan, "id int, from_path string, to_path string, changed boolean")
    taken = crowded.createDataFrame([("n/a.mp3",), ("n/a (4).mp3",), ("n/b.mp3",)], "path string")
    got = {r["id"]: r["to_path"] for r in ordering.resolve_path_collisions(df, taken).collect()}
    assert got[1] == "n/a (2).mp3" and got[2] == "n/a (3).mp3" and got[8] == "n/b.mp3" and got[9] == "n/b (2).mp3"
    assert len(set(got.values())) == len(plan) and not {got[i] for i in range(1, 8)} & {"n/a.mp3", "n/a (4).mp3"}


def skewed(spark, n=300):
    return spark.range(n).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 17).alias("k"), (F.col("id") * 7919 % 101).alias("v"))


def test_number_rows_matches_window(crowded):
    df = skewed(crowded)
    got = number_rows(df, ["k"], [SortKey(F.col("v"), "desc_nulls_last"), "id"], "p", "n")
    want = df.selectExpr("id", "row_number() over (partition by k order by v desc, id) as wp", "count(*) over (partition by k) as wn")
    assert got.join(want, "id").where("p = wp and n = wn").count() == 300
    assert number_rows(df, [], ["v", "id"], "p").agg(F.count_distinct("p"), F.max("p")).first() == (300, 300)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_matches_join(crowded, how):
    df = skewed(crowded)
    small = df.where("k < 9").groupBy("k").agg(F.min("v").alias("m"))
    assert sorted(map(tuple, spread_join(df, small, ["k"], how).collect())) == sorted(map(tuple, df.join(small, "k", how).collect()))


def test_spread_join_splits_hot_and_null_keys(crowded):
    df = skewed(crowded).withColumn("k", F.when(F.col("id") % 4 != 1, F.col("k")))
    hot = hot_keys(df.groupBy("k").agg(F.count(F.lit(1)).alias("n")), ["k"], "n", 3).where("k = 0").first()
    assert hot["_parts"] == -(-df.where("k = 0").count() // 3)
    small = df.where("k < 9").groupBy("k").agg(F.min("v").alias("m"))
    joined = spread_join(df, small, ["k"], "left")
    assert sorted(map(str, joined.collect())) == sorted(map(str, df.join(small, "k", "left").collect()))


def test_top_n_limits_before_the_shuffle(spark):
    df = top_n(skewed(spark), ["k"], [F.col("v").desc(), F.col("id")], 2)
    assert df._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2
    assert df.groupBy("k").count().where("count > 2").count() == 0


def test_range_pairs_against_brute_force(crowded):
    durations = [(i, d) for i, d in enumerate([5, 5, 5, 5, 9, 10, 14, 15, 16, 30, 30, 31, 59, 60, 61, 0, None])]
    df = crowded.createDataFrame(durations, "id int, duration_ms bigint").withColumn("match_key", F.when(F.col("id") % 2 == 0, "even"))
    want = {(a, b) for a, x in durations for b, y in durations if a < b and x and y and abs(x - y) <= 10}
    got = [(r["a"], r["b"]) for r in lookups.duration_window_pairs(df, 10).collect()]
    assert set(got) == want and len(got) == len(want)
    far = {(a, b) for a, x in durations for b, y in durations if a < b and x and y and abs(x - y) > 10 and a % 2 == b % 2 == 0}
    assert {(r["a"], r["b"]) for r in lookups.same_key_far_pairs(df, 10).collect()} == far


def test_token_similarity_against_brute_force(crowded):
    rnd = random.Random(3)
    sets = [sorted(set(rnd.choices("abcdefgh", k=rnd.randint(1, 6)))) for _ in range(40)]
    df = crowded.createDataFrame(list(enumerate(sets)), "id int, words array<string>")
    for t in (0.5, 0.8):
        dice = lambda a, b: 2 * len(set(a) & set(b)) / (len(a) + len(b))
        first = {}
        for i, s in enumerate(sets):
            first.setdefault(tuple(s), i)
        want = {(first[tuple(s)], i) for i, s in enumerate(sets) if first[tuple(s)] != i}
        heads = sorted(first.values())
        want |= {(a, b) for a in heads for b in heads if a < b and dice(sets[a], sets[b]) >= t}
        got = [(r["a"], r["b"]) for r in lookups.token_similarity_join(df, t).collect()]
        assert set(got) == want and len(got) == len(want)


def test_all_words_search_against_brute_force(crowded):
    rnd = random.Random(5)
    docs = [sorted(set(rnd.choices("abcdefghij", k=rnd.randint(1, 7)))) for _ in range(50)]
    asks = [sorted(set(rnd.choices("abcdefghijz", k=rnd.randint(0, 3)))) for _ in range(30)]
    q = crowded.createDataFrame(list(enumerate(asks)), "query_id int, words array<string>")
    d = crowded.createDataFrame(list(enumerate(docs)), "doc_id int, words array<string>")
    want = {(i, j) for i, a in enumerate(asks) for j, w in enumerate(docs) if a and set(a) <= set(w)}
    got = [(r["query_id"], r["doc_id"]) for r in lookups.all_words_search(q, d).collect()]
    assert set(got) == want and len(got) == len(want)


def test_shared_folder_follows_the_session():
    class Conf(dict):
        def get(self, key, default=None):
            return super().get(key, default)

    class Session:
        def __init__(self, **conf):
            self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})

    assert durable.shared_folder(Session(spark_checkpoint_dir="hdfs://c/x/", spark_master="yarn")) == "hdfs://c/x"
    local = Session(spark_master="local[2]")
    assert durable.shared_folder(local) == durable.shared_folder(local)
    with pytest.raises(RuntimeError):
        durable.shared_folder(Session(spark_master="yarn"))
