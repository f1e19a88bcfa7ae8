"""Line dedup against plain Python, SQL and planted cases."""

import hashlib
import re
from collections import defaultdict

import pytest

import check
from shelfmark.llm import line_dedup, queries

SF = "/root/testdata/sf0.001"
LONG = "This line is shared by many documents, all of them"
SCHEMA = "doc_id long, text string, lang string"


def key_of(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\f\r"))


def plain(rows, min_docs=5, min_chars=40):
    held = defaultdict(set)
    for doc, text, *_ in rows:
        for key in map(key_of, (text or "").split("\n")):
            if doc is not None and len(key) >= min_chars:
                held[key].add(doc)
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        gone = [len(d := held.get(key_of(s), ())) >= min_docs and doc != max(d) for s in lines]
        kept = "\n".join(s for s, g in zip(lines, gone) if not g)
        out.append((doc, len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def digest(df):
    rows = line_dedup.deduplicated(df).collect()
    return sorted(
        ((r.doc_id, r._line_total, r._line_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in rows), key=repr
    )


CASES = [
    (1, f"{LONG}\nown one\n{LONG}", "a"), (2, f" \t{LONG.upper()}\x0b\r\nown two", "a"), (3, LONG, None), (4, f"x\n\n{LONG}\n", "b"),
    (5, f"{LONG}\nlast\n{LONG}", "b"), (6, None, None), (7, "", "b"), (None, f"{LONG}\nno id", "a"), (4, f"other\n{LONG}", "b"),
    (1, f"{LONG}\nown one\n{LONG}", "a"), (8, "É" * 40 + "\né" + "é" * 39, "a"), (9, "\n\n\n", "a"), (10, "z" * 39 + "\n" + "z" * 40, "a"),
] + [(20 + i, "É" * 40 + f"\n{'é' * 40} \n" + "z" * 39 + "\n " + "z" * 40 + "\r", "c") for i in range(5)]


def test_every_case_equals_plain_python(spark):
    df = spark.createDataFrame(CASES, SCHEMA).repartition(3)
    assert digest(df) == plain(CASES)
    got = {(r.doc_id, r.text) for r in line_dedup.deduplicated(df).collect()}
    assert {(1, "own one"), (2, "own two"), (3, ""), (5, f"{LONG}\nlast\n{LONG}"), (6, None), (7, ""), (None, "no id"), (4, "x\n\n")} <= got


def test_limits_are_parameters(spark):
    rows = [(i, f"short\nown {i}", "a") for i in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.text for r in line_dedup.deduplicated(df, min_docs=3, min_chars=5).collect()}
    assert got == {0: "own 0", 1: "own 1", 2: "short\nown 2"}


def test_a_line_of_all_documents_and_a_long_text(spark):
    rows = [(i, f"{LONG}\n" + ("\n".join(f"{LONG} {k}" for k in range(5000)) if i == 3 else f"own {i}"), "a") for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert digest(df) == plain(rows)


def test_other_columns_pass_whatever_their_names(spark):
    df = spark.createDataFrame([(1, "t", 1, 2, 3, 4)], "doc_id long, text string, place int, a int, line int, n_lines int")
    row = line_dedup.deduplicated(df).first()
    assert row[:6] == (1, "t", 1, 2, 3, 4)


def test_empty_table(spark):
    assert line_dedup.deduplicated(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sql_agrees_and_no_python_runs(spark):
    message, _, ok = check.compare(spark, check.connect(SF), "op12_line_dedup", SF, queries.QUERIES, queries.ORACLES)
    assert ok, message
    plan = queries.QUERIES["op12_line_dedup"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


@pytest.mark.parametrize("text", ["a\r\nb", "\x1c" + "q" * 40, "q" * 40 + " "])
def test_odd_spaces_are_part_of_a_key(spark, text):
    rows = [(i, text, "a") for i in range(6)]
    assert digest(spark.createDataFrame(rows, SCHEMA)) == plain(rows)
