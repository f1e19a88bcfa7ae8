"""Work of linking, enrichment and numbering grows no faster than the rows: texts are prepared once, tables are shuffled once."""

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfmark.functions import fixed_values as fv
from shelfmark.functions import text as T
from shelfmark.operators import enrichment, linkage
from shelfmark.plans import skew
from shelfmark.registry import linking, tagging, views
from shelfmark.streaming import feeds

TEXTS = (
    None, "", " ", "Plain  title", "left ft. right", "A (feat. B) C", "A [with B]", "WITH (With you)", "Rock & Roll", "a|b", "a ｜ b", "é Übung ﬁ…",
    "x (Official Video) y", "x ( y )", "x [ y ]", "a  )", "tab\tand\nline", "FEAT x y", "left feat y", "K Å ½", "日本 語", "a_b-c", "ſoft", "A X B", "A and B", "A;B", "İ ft x",
)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_short_ways_give_the_same_forms(spark):
    """Against the steps one after the other."""
    rng = random.Random(5)
    bits = ["a", "B", " ", "  ", "(", ")", "[", "]", "|", "&", "feat", "ft.", "with", "é", "ß", "-", ",", " x ", " and ", "live", "hd", "\t"]
    texts = [*TEXTS, *["".join(rng.choices(bits, k=rng.randint(1, 9))) for _ in range(500)]]
    df = spark.createDataFrame([(t,) for t in texts], "c string").repartition(2)
    c = F.col("c")

    def steps(x):
        x = F.lower(T.fold(F.coalesce(x, F.lit(""))))
        x = F.regexp_replace(F.regexp_replace(x, fv.GUEST_CREDIT, ""), r"\s(?:feat|ft)\.?\s.*\z", "")
        return F.trim(F.regexp_replace(F.replace(x, F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}]+", " "))

    cleaned = F.regexp_replace(F.regexp_replace(c, fv.UPLOAD_NOISE, ""), r"\s*[|｜]\s*.*\z", "")
    cleaned = F.trim(F.regexp_replace(F.regexp_replace(cleaned, r"\s{2,}", " "), r"\s+([)\]])", "$1"))
    first = steps(F.regexp_replace(F.coalesce(c, F.lit("")), fv.ARTIST_SEPARATOR, ""))
    for short, long in ((T.normalize(c), steps(c)), (T.clean_title(c), cleaned), (T.primary_artist(c), first)):
        assert df.select(short.alias("s"), long.alias("l"), "c").where(~F.col("s").eqNullSafe(F.col("l"))).collect() == []


def test_titles_are_cleaned_once_per_pair(spark):
    rows = [("Song", "Band", None, 1000, "Song (Official Video)", "Band", 1, None, None, True)]
    df = spark.createDataFrame(
        rows, "target_title string, target_artist string, target_artists array<string>, target_ms long, cand_title string, channel string, cand_sec int, "
        "cand_track string, cand_artist string, trusted boolean",
    ).repartition(2)
    assert plan_of(linkage.score_candidates(df)).count("visualizer|") == 1


def test_rows_equal_in_their_order_keep_the_order_they_came_in(spark):
    rows = spark.range(0, 4000, 1, 1).select(F.col("id"), F.lit(None).cast("string").alias("k"), F.lit(1).alias("v"))
    out = skew.number_rows(rows, ["k"], ["v"])
    assert out.columns == ["id", "k", "v", "position"] and out.where("position <> id + 1").count() == 0


@pytest.mark.parametrize("hot", [0, 900])
def test_keyed_rows_are_numbered_in_one_shuffle(spark, monkeypatch, hot):
    monkeypatch.setattr(skew, "COUNTED_OF_HOT", 50)
    rng = random.Random(6)
    keys = [None, None, *range(40), *range(20), *["hot"] * hot]
    rows = [(None if k is None else str(k), rng.random(), i) for i, k in enumerate(keys)]
    spark.conf.set(skew.ROWS_PER_TASK, "100")
    try:
        out = skew.number_rows(spark.createDataFrame(rows, "k string, v double, id int"), ["k"], [skew.SortKey(F.col("v"), "desc_nulls_last"), "id"], "at", "n")
        plan = executed(out)
        got = {r.id: (r.at, r.n) for r in out.collect()}
    finally:
        spark.conf.unset(skew.ROWS_PER_TASK)
    groups = {}
    for k, v, i in sorted(rows, key=lambda r: (-r[1], r[2])):
        groups.setdefault(k, []).append(i)
    assert got == {i: (at, len(ids)) for ids in groups.values() for at, i in enumerate(ids, 1)}
    assert out.columns == ["k", "v", "id", "n", "at"] and dict(out.dtypes)["at"] == dict(out.dtypes)["n"] == "bigint"
    if not hot:
        assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_bases_of_many_sources_come_from_one_task(spark):
    end = 2**63 - 1
    spans = [("a", 0, 2, 5, False), ("a", 1, end, 3, True), ("a", 3, end, 1, True), ("b", 0, end, 7, False), ("c", 2, end, 1, True)]
    want = [("a", 1, 5), ("a", 3, 8), ("c", 2, 0)]
    for cut in range(1, len(spans)):  # a source may go on in the next batch
        parts = [pd.DataFrame(p, columns=["source_id", "since", "until", "top", "gives"]) for p in (spans[:cut], spans[cut:])]
        assert [tuple(r) for p in feeds._bases(iter(parts)) for r in p.itertuples(index=False)] == want
    arrived = spark.createDataFrame(
        [(s, i, "t", None, None, i, s % 2 == 0, False, at) for s in range(6) for at in (1, 2) for i in range(at * 3)],
        "source_id long, external_id long, title string, album string, duration_ms long, position long, partial boolean, truncated boolean, listed_at int",
    )
    plan = executed(feeds.merge_listings(None, arrived))
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan


def test_releases_are_made_once_for_both_sides(spark, tmp_path):
    day = datetime.datetime(2020, 1, 1)
    orders = [(i, i, "O", 1.0, day, "1-URGENT") for i in range(6)]
    lines = [(i % 6, i % 3, 1, i // 6, 1.0, 1.0, 0.05, 0.0, "N", "O", day) for i in range(12)]
    parts = [(i, f"part {i}", "Brand#1", "SMALL", 10, 1.0) for i in range(3)]
    schemas = {
        "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
        "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
        "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
        "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    }
    for name, rows in (("orders", orders), ("lineitem", lines), ("part", parts)):
        spark.createDataFrame(rows, schemas[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    _, cand, rel, _ = tagging.found_sides(spark, str(tmp_path))
    for df in (cand, rel, tagging.pairs(spark, str(tmp_path))):
        assert "lineitem.parquet" not in executed(df) and "row_number" not in executed(df)
    enriched = tagging.enriched(spark, str(tmp_path))
    assert enriched.count() == 6


def test_texts_of_a_search_are_compared_before_releases_are_joined(spark):
    cand = spark.createDataFrame([(1, 10, "Song", "Band", "Band", 1000, 0.9, True), (1, 11, "Other", "Band", "Band", 1000, 0.9, True)],
        "id int, recording_id int, title string, artist string, artist_id string, duration_ms int, score double, album_only boolean")
    query = enrichment._queries(spark.createDataFrame([(1, "Song", "Band", None, 1000)], "id int, title string, artist string, album string, duration_ms int"), F.col("album"))
    studio = spark.createDataFrame([(10, True), (11, True)], "recording_id int, has_studio boolean")
    asked = enrichment._asked(cand, query, studio, enrichment._recording_fits())
    assert [(r.q, r.recording_id, r.has_studio) for r in asked.collect()] == [(1, 10, True)]
    assert "regexp_replace" not in plan_of(asked).lower()


def test_texts_of_lossless_matching_are_read_before_pairs(spark, tmp_path):
    texts = ["alpha beta gamma", "alpha beta live", "delta alpha beta", "", None, "x", "beta gamma delta alpha"]
    docs = [(i, texts[i % 7], "en", f"src{i % 3}", 300 * i) for i in range(60)]
    lines = [(i % 25, i % 37) for i in range(200)] + [(None, 3), (3, None), (2, 900)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    judged = linking.judged(spark, str(tmp_path))
    above = plan_of(judged).split("Join ")[0].lower()
    assert "row_number" in above and not any(x in above for x in ("regexp", "split(", "rlike"))
    # as with pairs made by the SQL, whose words are read for each pair
    spark.read.parquet(f"{tmp_path}/lineitem.parquet").createOrReplaceTempView("lineitem")
    for name in ("catalog", "hits"):
        views.view(spark, str(tmp_path), name).createOrReplaceTempView(name)
    pairs = spark.sql(linking.MATCH_PAIRS).withColumns(
        {
            "artists": F.lit(None).cast("array<string>"), "prefer_user": F.lit(None).cast("string"), "prefer_dir": F.lit(None).cast("string"),
            "attribs": F.map_filter(F.create_map(F.lit(1), "seconds"), lambda k, v: v.isNotNull()),
        }
    )
    plain = linkage.match_lossless(pairs, free_only=True)
    assert sorted(judged.columns) == sorted(plain.columns)
    rows = lambda df: sorted(map(repr, df.drop("attribs").select(sorted(set(plain.columns) - {"attribs"})).collect()))
    got = rows(judged)
    assert got == rows(plain) and len(got) > 20


def test_markers_of_two_texts_are_those_one_has_alone(spark):
    bits = ["live", "alive", "sped up", "1 hour", "hour loop", "song", "cover", "", "demo demo", "bass boosted remix"]
    df = spark.createDataFrame([(f"{a} {b}".strip(), c) for a in bits for b in bits for c in ("", "live", "song cover", "1 hour loop")], "c string, t string")
    alone = F.size(F.array_except(T.markers(F.col("c")), T.markers(F.col("t"))))
    assert df.where(alone != T.new_markers(F.col("c"), F.col("t"))).collect() == []
