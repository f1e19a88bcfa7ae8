"""Words, windows and the quality rules against plain Python and SQL."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import check
from shelfmark.llm import line_rules, queries
from shelfmark.llm.words import slices, whole, windows, words_of

SF = "/root/testdata/sf0.001"
PIECES = st.sampled_from(["a", "B", "é", "漢", " ", "\n", "\t", "\x0b", "\x1c", " ", "12", "#", "|", "the"])
TEXTS = st.lists(st.one_of(st.none(), st.lists(PIECES, max_size=25).map("".join)), min_size=1, max_size=6)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 7))
def test_words_and_windows_are_those_of_the_texts(texts, size):
    got = words_of(pa.array(texts, pa.string()))
    assert got.counts().tolist() == [len(split(t)) for t in texts]
    flat = [w for t in texts for w in split(t)]
    assert len({(w, c) for w, c in zip(flat, got.codes.tolist())}) == len(set(flat))
    hashes = windows(got.codes, size)
    grams = [tuple(flat[i : i + size]) for i in range(len(flat) - size + 1)]
    assert len(hashes) == len(grams)
    assert len(set(zip(grams, hashes.tolist()))) == len(set(grams)) == len(set(hashes.tolist()))
    inside = whole(got.starts, len(flat), size)
    owner = np.repeat(np.arange(len(texts)), got.counts())
    assert inside.tolist() == [owner[i] == owner[i + size - 1] for i in range(len(grams))]


def test_slices_cover_every_row_and_respect_the_limit():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * n for n in (3, 50, 1, 1, 0, 8)] + [None]})
    parts = list(slices(batch, limit=10))
    assert [t for p in parts for t in p.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert [p.num_rows for p in parts] == [1, 1, 5]


def repeat_words(words):
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return len(hit)


ROWS = [
    (1, "one two three one two three " * 10, "a"), (2, None, None), (3, "", "a"), (4, " \n\t ", "b"),
    (5, "a a a a", "b"), (6, "x\nx\n\n x\nx|#", "b"), (7, "w " * 60, "b"), (1, "one two three one two three " * 10, "a"),
    (8, " ".join(f"u{i}" for i in range(70)), None), (None, " ".join(f"v{i}é" for i in range(70)), "c"),
]


def test_base_figures(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    got = sorted(map(repr, line_rules.quality(df).collect()))
    want = []
    for doc_id, text, _ in ROWS:
        w, t = split(text), text or ""
        full = [s for s in t.split("\n") if split(s)]
        r = repeat_words(w)
        failed = len(w) < 50 or 100 * r > 50 * len(w)
        want.append((doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(full) - len(set(full)), r, failed, not failed))
    assert got == sorted(f"Row(doc_id={a!r}, n_words={b}, word_chars={c}, n_symbols={d}, n_dup_lines={e}, n_repeat_words={f}, base_failed={g}, kept={h})" for a, b, c, d, e, f, g, h in want)


MENU = ["Menu 07 home about contact and much more of this kind", "Subscribe to the letter of our house and never miss a thing that we have to say to all of you", "All rights are kept by the owner 2024"]


def page(i, boilerplate, own):
    spell = lambda n: "".join("abcdefghij"[int(c)] for c in str(n))  # noqa: E731  digits compare as equal
    words = [f"w{spell(i)}x{spell(k)}" for k in range(own)]
    return "\n".join([" ".join(words[a : a + 10]) for a in range(0, own, 10)] + (MENU if boilerplate else []))


@pytest.fixture(scope="module")
def host(spark):
    rows = [(i, page(i, True, 70), "h") for i in range(90)]  # a shared line, most words their own
    rows += [(100 + i, page(i, True, 32), "h") for i in range(5)]  # little but the shared line
    rows += [(200 + i, page(999, False, 80), "h") for i in range(40)]  # copies of one clean text
    rows += [(300 + i, page(i, True, 70), "other") for i in range(3)]  # too few for a count
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)


def test_depleted_documents_go_and_copies_are_no_boilerplate(host):
    rows = line_rules.quality(host).collect()
    kept = {r.doc_id for r in rows if r.kept}
    assert not any(r.base_failed for r in rows)
    assert kept == {*range(90), *range(200, 240), 300, 301, 302}
    gone = {r.doc_id for r in line_rules.kept_documents(host).collect()}
    assert gone == kept


def test_a_host_of_nothing_but_depleted_pages_is_rejected(spark):
    spell = lambda n: "".join("abcdefghij"[int(c)] for c in str(n))
    shared = [" ".join(f"s{spell(k)}x{spell(j)}" for j in range(12)) for k in range(5)]
    rows = [(i, "\n".join([*shared, f"own {spell(i)}"]), "short") for i in range(60)]  # the own line is under 20 characters
    rows += [(100 + i, "\n".join([*shared, f"this page has one long line {spell(i)}"]), "long") for i in range(60)]
    rows += [(200 + i, "\n".join([*shared, "copied"]), "copies") for i in range(60)]
    rows += [(300 + i, "\n".join([*shared, f"own {spell(i % 20)}"]), "few") for i in range(60)]  # 20 different documents
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    judged = line_rules.quality(df).collect()
    assert not any(r.base_failed for r in judged)
    assert {r.doc_id for r in judged if r.kept} == {*range(200, 260), *range(300, 360)}
    assert {r.doc_id for r in line_rules.kept_documents(df).collect()} == {*range(200, 260), *range(300, 360)}
    limits = {(r.host, r.n_docs) for r in line_rules.boilerplate(line_rules.line_marks(df)).collect()}
    assert limits == {("short", 60), ("long", 60)}


def test_the_share_of_a_host_counts_copies_once(spark):
    rows = [(i, page(i, True, 32), "h") for i in range(30)] + [(1000 + i, page(999, False, 80), "h") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    assert {r.doc_id for r in line_rules.kept_documents(df).collect()} == set(range(1000, 4000))


def test_boilerplate_lines_are_removed_from_texts(host):
    texts = {r.doc_id: r.text for r in line_rules.cleaned(host).collect()}
    assert texts[3] == page(3, False, 70)
    assert texts[200] == page(999, False, 80) and texts[300] == page(0, True, 70)
    assert len(texts) == 138


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_sql(spark, name):
    message, _, ok = check.compare(spark, check.connect(SF), name, SF, queries.QUERIES, queries.ORACLES)
    assert ok, message


def test_method_matches_its_sql_where_lines_are_common(spark, host, tmp_path):
    host.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = check.duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    rel = con.sql(line_rules.OP1_SQL)
    at = list(rel.columns)
    want = sorted((r[at.index("doc_id")], r[at.index("kept")]) for r in rel.fetchall())
    assert sorted((r.doc_id, r.kept) for r in line_rules.quality(host).collect()) == want


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string, kept string, key string, lines string, host int")
    assert line_rules.quality(df).count() == 0 and line_rules.kept_documents(df).columns == df.columns
    one = spark.createDataFrame([(1, "a b", "s", "k", "y", "l", 3)], df.schema)
    assert line_rules.kept_documents(one).count() == 0 and line_rules.cleaned(one).collect() == one.collect()
