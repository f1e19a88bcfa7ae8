"""Pair searches shuffle their inputs, not their pairs: results over many blocks and cells against plain Python, and where rows travel."""

import random

import pyarrow as pa
import pytest

from shelfmark.operators import alignment, duplicates, lookups, word_cells
from shelfmark.registry import linking


def plan_of(spark, make):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return make()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def executed(spark, make):
    """The plan after it ran, with joins by shuffle."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = make()
        df.collect()
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_duration_pairs_meet_in_blocks_of_ranks(spark, monkeypatch):
    monkeypatch.setattr(lookups, "BLOCK_ROWS", 4)
    monkeypatch.setattr(lookups, "PAIRS_PER_TASK", 50)
    rng = random.Random(1)
    rows = [(i, rng.choice([rng.randint(1, 90), 40, None])) for i in range(70)]
    df = spark.createDataFrame(rows, "id int, duration_ms bigint")
    got = sorted((r.a, r.b, r.gap_ms) for r in lookups.duration_window_pairs(df, 9).collect())
    assert got == sorted((a, b, abs(x - y)) for a, x in rows for b, y in rows if a < b and x and y and abs(x - y) <= 9)
    plan = plan_of(spark, lambda: lookups.duration_window_pairs(df, 9))
    assert "hashpartitioning(block" in plan and "hashpartitioning(rank" not in plan  # no exchange of a row per pair


def test_alignment_is_the_same_in_one_cell_and_in_many(spark, monkeypatch):
    rng = random.Random(2)
    base = [rng.getrandbits(32) for _ in range(300)]
    prints = {i: base[(at := rng.randint(0, 60)) : at + rng.randint(10, 200)] for i in range(12)}
    prints |= {20 + i: [rng.choice(base[:9]) for _ in range(120)] for i in range(4)} | {40: []}
    pairs = [(a, b) for a in prints for b in prints if a < b] + [(1, 0), (1, 99), (None, 1), (0, 1)]
    df = spark.createDataFrame(pairs, "a int, b int")
    shown = spark.createDataFrame([(i, f, len(f)) for i, f in prints.items()], "id int, frames array<bigint>, length int")

    def rate(a, b, off):
        lo, hi = max(0, -off), min(len(a), len(b) - off)
        if hi - lo < 16 or hi - lo < min(len(a), len(b)) / 2:
            return 1.0
        return sum((a[i] ^ b[i + off]).bit_count() for i in range(lo, hi)) / ((hi - lo) * 32.0)

    def brute(a, b):
        where = lambda f: {k: [i for i, v in enumerate(f) if v >> 18 == k] for k in {v >> 18 for v in f}}
        x, y, votes = where(a), where(b), {}
        for k in x.keys() & y.keys():
            if len(x[k]) * len(y[k]) <= 64:
                for p in x[k]:
                    for q in y[k]:
                        if abs(q - p) <= 200:
                            votes[q - p] = votes.get(q - p, 0) + 1
        off = min(votes, key=lambda o: (-votes[o], o), default=0)
        err = rate(a, b, off)
        return off, 1.0 - (err if err > 0.4 else min(err, rate(a, b, off - 1), rate(a, b, off + 1)))

    want = sorted((a, b, *brute(prints[a], prints[b])) for a, b in pairs if a in prints and b in prints)
    run = lambda: sorted((r.a, r.b, r.offset, r.similarity) for r in duplicates.acoustic_similarity(df, shown, None).collect())
    assert run() == want
    monkeypatch.setattr(duplicates, "FRAMES_PER_GROUP", 500)
    assert run() == want
    monkeypatch.setattr(duplicates, "PRINTS_PER_GROUP", 4)
    assert run() == want
    plan = plan_of(spark, lambda: duplicates.acoustic_similarity(df, shown, None))
    assert "FlatMapCoGroups" in plan and "Join" not in plan  # neither keys nor frames travel with a pair


def test_word_set_pairs_are_judged_by_signature_before_they_travel(spark):
    rng = random.Random(3)
    sets = [sorted(rng.sample([f"w{i}" for i in range(60)], 20)) for _ in range(30)]
    sets += [sorted({*s[:18], "x", f"y{i}"}) for i, s in enumerate(sets[:10])]
    df = spark.createDataFrame(list(enumerate(sets)), "id int, words array<string>")
    dice = lambda a, b: 2 * len({*a} & {*b}) / (len(a) + len(b))
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and dice(a, b) >= 0.8}
    got = [(r.a, r.b) for r in lookups.token_similarity_join(df, 0.8).collect()]
    assert {*got} == want and len(got) == len(want) >= 10
    plan = plan_of(spark, lambda: lookups.token_similarity_join(df, 0.8))
    joins = [line for line in plan.splitlines() if "Join" in line and "bit_count" in line]
    assert any("[word" in line for line in joins)  # the join on the prefix drops them, before pairs are made distinct


@pytest.mark.parametrize("as_rows", [True, False])
def test_dismissals_of_any_length_need_no_text(spark, as_rows):
    members = spark.createDataFrame([(i, i % 3) for i in range(30)], "id bigint, component bigint")
    groups = spark.createDataFrame([(c, 10) for c in range(3)], "component bigint, files bigint")
    lists = {"x": [*range(0, 30, 3)], "y": [*range(1, 28, 3)], "z": [*range(0, 30, 3), 5]}  # whole; one missing; one too many
    if as_rows:
        gone = spark.createDataFrame([(k, i) for k, ids in lists.items() for i in ids + ids[:1]], "group_key string, id bigint")
    else:
        gone = spark.createDataFrame([(",".join(map(str, ids)),) for ids in lists.values()], "group_key string")
    out = lookups.exclude_dismissed(groups, members, gone)
    assert sorted(r.component for r in out.collect()) == [1, 2]
    if not as_rows:
        plan = plan_of(spark, lambda: lookups.exclude_dismissed(groups, members, gone))
        assert "sha2(" in plan  # the whole list does not travel with each of its ids


def test_search_over_many_cells_shuffles_no_found_rows(spark, monkeypatch):
    monkeypatch.setattr(lookups, "BLOCK_DOCS", 8)
    monkeypatch.setattr(lookups, "CELL_QUERIES", 10)
    rng = random.Random(4)
    docs = [(i, rng.sample("abcdefghij", rng.randint(0, 8))) for i in range(60)] + [(None, ["a", "b"]), (7000, None), (7001, ["a", None])]
    asked = [(i, rng.sample("abcdefghij", rng.randint(0, 4))) for i in range(40)] + [(900, ["a", "?"]), (901, ["a", None]), (None, ["a"])]
    d, q = spark.createDataFrame(docs, "doc_id int, words array<string>"), spark.createDataFrame(asked, "query_id int, words array<string>")
    got = sorted((r.query_id, r.doc_id) for r in lookups.all_words_search(q, d).collect())
    assert got == sorted((i, j) for i, w in asked for j, x in docs if i is not None and j is not None and w and None not in w and {*w} <= {*(x or [])})
    plan = plan_of(spark, lambda: lookups.all_words_search(q, d))
    above = plan[: plan.index("FlatMapCoGroups")]
    assert "Exchange" not in above and "Join" not in above
    assert lookups.all_words_search(q, d.limit(0)).count() == lookups.all_words_search(q.limit(0), d).count() == 0


@pytest.mark.parametrize("hot", ["500000", "3"])
def test_every_pair_of_like_word_sets_is_given(spark, monkeypatch, hot):
    """copies are paired with each other and with all rows that are like them, over many blocks and cells."""
    for name, value in (("MEMBERS_PER_BLOCK", 2), ("SIGNATURES_PER_GROUP", 6), ("WORDS_PER_GROUP", 60), ("PAIRS_PER_TASK", 20)):
        monkeypatch.setattr(lookups, name, value)
    rng = random.Random(6)
    sets = [rng.sample([f"w{i}" for i in range(40)], rng.randint(1, 12)) for _ in range(15)]
    sets += [rng.sample(s, len(s)) for s in sets[:5] for _ in range(6)] + [[*s, "x"] for s in sets[:8]] + [[], ["w1", None]]
    rows = list(enumerate(sets)) + [(None, sets[0]), (3, sets[0]), (20, sets[20])]  # no id, one id with two sets, a row that comes twice
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id int, words array<string>")
    plain = [(i, {*s} - {None}) for i, s in rows if i is not None]
    dice = lambda a, b: 2 * len(a & b) / (len(a) + len(b)) if a and b else 0
    want = sorted((i, j, dice(a, b)) for i, a in plain for j, b in plain if i < j and dice(a, b) >= 0.8)
    spark.conf.set("shelfmark.rowsPerTask", hot)
    got = sorted((r.a, r.b, r.dice) for r in lookups.token_similarity_join(df, 0.8, every_pair=True).collect())
    links = {(r.a, r.b) for r in lookups.token_similarity_join(df, 0.8).collect()}
    spark.conf.unset("shelfmark.rowsPerTask")
    assert got == want and links < {(a, b) for a, b, _ in want}


def test_the_query_gives_every_pair_of_like_documents(spark, tmp_path):
    """also copies of the smaller document's copies."""
    texts = {1: "one two three four five six", 2: "six five four three two one", 3: "One two, three four five six", 4: "one two three four five seven", 5: "else"}
    spark.createDataFrame([*texts.items()], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.a, r.b, round(r.dice, 3)) for r in linking.token_similarity_join(spark, str(tmp_path)).collect())
    assert got == [(1, 2, 1), (1, 3, 1), (1, 4, 0.833), (2, 3, 1), (2, 4, 0.833), (3, 4, 0.833)]


def test_words_travel_to_cells_not_with_pairs(spark):
    """candidate pairs are shuffled as numbers; words and full signatures go once to a cell."""
    df = spark.createDataFrame([(i, [f"w{j}" for j in range(i % 7, 20)]) for i in range(40)], "id int, words array<string>")
    plan = executed(spark, lambda: lookups.token_similarity_join(df, 0.8))
    assert "FlatMapCoGroups" in plan and "array_intersect" not in plan and "array<string>" not in plan
    assert "ReusedExchange" in plan  # prefixes are shuffled once for both sides


def test_blocks_of_a_search_widen_and_cells_give_rows_bit_by_bit(spark, monkeypatch):
    """queries travel to a bounded number of blocks, and no cell holds its rows found."""
    monkeypatch.setattr(lookups, "BLOCK_DOCS", 2)
    monkeypatch.setattr(lookups, "MOST_BLOCKS", 3)
    docs = spark.createDataFrame([(i, ["all", f"w{i % 4}"]) for i in range(70)], "doc_id int, words array<string>")
    places, listed = lookups.word_postings(docs, spark.createDataFrame([("all",), ("w1",)], "word string"))
    assert sorted(len(r.ids) for r in listed.collect()) == [22, 24, 24]
    assert dict(places.dtypes)["places"] == "array<smallint>" and {r.block for r in places.collect()} == {0, 1, 2}
    monkeypatch.setattr(lookups, "WIDEST_BLOCK", 10)
    assert sorted(len(r.ids) for r in lookups.word_postings(docs, places.select("word"))[1].collect()) == [10] * 7
    monkeypatch.setattr(word_cells, "ROWS_AT_ONCE", 50)
    asked = pa.table({"query_id": [1, 2, 3], "words": [["all"], ["w"], ["all", "w"]]})
    small = pa.array([[*range(-(1 << 15), 40 - (1 << 15))], [5 - (1 << 15)], None], pa.list_(pa.int16()))
    posted = pa.table({"word": ["all", "w", None], "places": small, "ids": pa.array([None, None, [*range(100, 140)]], pa.list_(pa.int32()))})
    both = word_cells.packed_cell(pa.concat_tables([asked] * 3), posted).to_batches()
    schema = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int32())])
    given = [*word_cells.found_rows(schema)(iter(both))]
    assert [b.num_rows for b in given] == [82, 44] and given[0].slice(38, 4).to_pylist() == [{"query_id": q, "doc_id": d} for q, d in ((1, 138), (1, 139), (2, 105), (3, 105))]


def test_pairs_are_spelled_out_from_arrays(spark, monkeypatch):
    """a row meets a block of ranks as one row; no pair outside a range is made and dropped."""
    monkeypatch.setattr(lookups, "BLOCK_ROWS", 4)
    rows = [(i, (i * 7) % 40 + 1, "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, duration_ms int, match_key string")
    for pairs, want in (
        (lookups.duration_window_pairs(df, 9), [(a, b, abs(x - y)) for a, x, _ in rows for b, y, _ in rows if a < b and abs(x - y) <= 9]),
        (lookups.same_key_far_pairs(df, 9), [(a, b, abs(x - y)) for a, x, k in rows for b, y, m in rows if a < b and k == m and abs(x - y) > 9]),
    ):
        assert sorted(map(tuple, pairs.collect())) == sorted(want)
    plan = plan_of(spark, lambda: lookups.duration_window_pairs(df, 9))
    assert "explode(sequence(_from" in plan and not any("rank" in line for line in plan.splitlines() if "Join" in line)


def test_votes_pass_over_prints_that_are_no_partners(monkeypatch):
    """work of a print grows with its partners, not with all prints of a cell that share its keys."""
    looked = []
    monkeypatch.setattr(alignment, "_ranges", lambda starts, sizes, real=alignment._ranges: looked.append(int(sizes.sum())) or real(starts, sizes))
    rng = random.Random(8)
    base = [rng.getrandbits(32) for _ in range(40)]
    shown = [(i, base[: 20 + i % 20] if i < 400 else base + [rng.getrandbits(32) for _ in range(i)]) for i in range(410)]
    ask = [(i, j) for i in range(400, 410) for j in range(400, 410) if i < j]
    asked = pa.table({"a": [a for a, _ in ask], "b": [b for _, b in ask]})
    found, shifts, alike = alignment.score_cell(asked, pa.table({"id": [i for i, _ in shown], "frames": pa.array([f for _, f in shown], pa.list_(pa.int64()))}))
    assert found.num_rows == 45 and {*shifts} == {0} and sum(looked) < 100_000
    wide = pa.table({"id": [1, 2], "frames": pa.array([[1 << 40] * 16, [-1] * 16], pa.list_(pa.int64()))})  # frames of more than 32 bits
    assert alignment.score_cell(pa.table({"a": [1], "b": [2]}), wide)[2][0] == 1 - 63 / 32
