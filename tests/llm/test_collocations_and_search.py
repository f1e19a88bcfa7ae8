"""Phrases and ranked search against plain Python and SQL."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import check
from shelfmark.llm import ball_search, collocations, queries
from shelfmark.llm.byte_words import bounded, byte_classes, cut_words, raw_texts

SF = "/root/testdata/sf0.001"
BITS = st.sampled_from(["a", "B", "é", "漢", " ", "\t", "\n", "\r", ".", ",", "x1", "\x01", "\x1c", "-"])
TEXTS = st.lists(st.one_of(st.none(), st.lists(BITS, max_size=30).map("".join)), min_size=1, max_size=6)


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def pieces(text):
    return [p for p in (re.findall(r"[^\x20\x09]+", x) for x in re.split(r"[.,;:!?\x0A-\x0D]", fold(text))) if p]


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 12))
def test_words_and_pieces_are_those_of_the_texts(texts, limit):
    classes = byte_classes(collocations._GAPS, collocations._WALLS)
    for some in [texts, *([t] for t in texts)]:
        got = []
        for data, offsets in bounded(*raw_texts(pa.array(some, pa.string())), classes, limit):
            cut = cut_words(data, offsets, classes)
            flat = [w.decode() for w in cut.words.take(pa.array(cut.codes)).to_pylist()]
            ends = np.flatnonzero(np.diff(cut.piece)) + 1
            got += [flat[a:b] for a, b in zip([0, *ends], [*ends, len(flat)]) if b > a]
        assert got == [p for t in some for p in pieces(t)]


@pytest.mark.parametrize("small", [0, 4, 10_000])
def test_multikey_counts_are_those_of_a_dictionary(small):
    rnd = random.Random(small)
    rows = Counter()
    for _ in range(4000):
        words = [rnd.choice([1, 1, 1, 2, 3, rnd.randrange(1, 40)]) for _ in range(rnd.randint(1, 4))]
        rows[(rnd.randrange(2), *words, *[0] * (4 - len(words)))] += rnd.randint(1, 3)
    keys = [np.array(k, np.int64) for k in zip(*rows)]
    counts = np.array(list(rows.values()), np.int64)
    want = Counter()
    for row, n in rows.items():
        for k in range(1, 6):
            if k == 1 or row[k - 1]:
                want[row[:k]] += n
    never = lambda depth, at: np.zeros(len(at), bool)
    got = {tuple(int(keys[d][row]) for d in range(k)): n for row, k, n in collocations.multikey_counts(keys, counts, 30, never, small)}
    assert got == {k: n for k, n in want.items() if n >= 30}
    odd = lambda depth, at: (keys[0][at] == 1) & (depth <= 2)  # noqa: E731  may go on elsewhere: given whatever the count
    got = {tuple(int(keys[d][row]) for d in range(k)): n for row, k, n in collocations.multikey_counts(keys, counts, 30, odd, small)}
    assert got == {k: n for k, n in want.items() if n >= 30 or (k[0] == 1 and len(k) <= 2)}


def plain_collocations(rows, least, top):
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for p in pieces(text):
            total[lang] += len(p)
            for i in range(len(p)):
                for k in range(1, 5):
                    if i + k <= len(p):
                        f[lang, tuple(p[i : i + k])] += 1
    big = {k: n for k, n in f.items() if len(k[1]) > 1 and n >= least}
    gone = {(lang, w[i : i + k]) for (lang, w), n in big.items() for k in range(2, len(w)) for i in range(len(w) - k + 1) if 100 * n >= 80 * f[lang, w[i : i + k]]}
    out = []
    for (lang, w), a in big.items():
        if (lang, w) not in gone:
            score, _, left, right = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out.append((lang, -score, -a, " ".join(w).encode(), left, right))
    ranked = []
    for lang in {r[0] for r in out}:
        for rank, (_, s, a, w, left, right) in enumerate(sorted(r for r in out if r[0] == lang)[:top], 1):
            ranked.append((lang, rank, w.decode(), -a, left, right, total[lang], -s))
    return sorted(ranked)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
PHRASES = ["New York city", "new york", "red Wine", "the the the the the", "é Ö x", "a\x01b c", "a", "b c d e f"]


def phrase_rows(n, seed):
    rnd = random.Random(seed)
    rows = [(" ".join(rnd.choice(PHRASES) + rnd.choice(["", ",", " of", "\n", "."]) for _ in range(rnd.randint(0, 40))), rnd.choice(["en", "de", None, "und"])) for _ in range(n)]
    return [*rows, (None, "en"), ("", None), ("the " * 3000, "xx"), rows[0], rows[0]]


@pytest.mark.parametrize("range_words", [1_000_000, 300])
def test_phrases_equal_plain_python_in_one_or_many_ranges(spark, range_words):
    rows = phrase_rows(120, 7)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    got = collocations.collocations(docs, least=10, top=6, range_words=range_words)
    assert sorted(map(tuple, got.select(COLUMNS).collect())) == plain_collocations(rows, 10, 6)


def test_phrases_of_no_rows_and_clashing_columns(spark):
    none = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(none).collect() == []
    few = spark.createDataFrame([("a b", "en", 1, 2, 3)], "text string, lang string, rank int, f int, range int")
    assert collocations.collocations(few).collect() == []
    assert collocations.collocations(few, least=1).count() == 1


@pytest.mark.parametrize("name", ["op11_collocations", "op13_ranked_search"])
def test_sql_agrees(spark, name):
    message, _, ok = check.compare(spark, check.connect(SF), name, SF, queries.QUERIES, queries.ORACLES)
    assert ok, message


# ---- ranked search -----------------------------------------------------------------------------


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", fold(text))


def plain_search(docs, items, top):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in held:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // n_terms
            weight = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
            score = sum(weight(t) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def corpus(seed, n):
    rnd = random.Random(seed)
    words = [f"w{int(rnd.paretovariate(0.6)) % 300}" for _ in range(4000)] + ["É9", "ñ", "漢字"]
    text = lambda size: rnd.choice([" ", "-", "_", "\n"]).join(rnd.choice(words) for _ in range(size))
    passage = text(40)
    docs = [(i, text(rnd.randint(0, 60)) + (" " + passage.upper() if i % 17 == 0 else "")) for i in range(n)]
    docs += [(n, None), (n + 1, "..."), (None, passage), (3, passage), (3, passage), *[(n + 5 + i, passage) for i in range(40)]]
    items = [(1, passage), (2, text(30)), (2, text(3)), (None, text(8)), (5, None), (6, "zzz"), (7, "w1 w1 w1 w2"), (7, "w1 w1 w1 w2")]
    return docs, items


@pytest.mark.parametrize(("seed", "chunk", "leaf", "sample"), [(1, 8192, 64, 8192), (2, 50, 3, 40), (3, 7, 1, 8192)])
def test_search_equals_plain_python(spark, monkeypatch, seed, chunk, leaf, sample):
    monkeypatch.setattr(ball_search, "CHUNK_DOCS", chunk)
    monkeypatch.setattr(ball_search, "SAMPLE_DOCS", sample)
    monkeypatch.setattr(ball_search.build, "__defaults__", (leaf,))
    docs, items = corpus(seed, 400)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    q = spark.createDataFrame(items, "item_id long, text string")
    want = plain_search(docs, items, 20)
    assert sorted(map(tuple, ball_search.ranked(d, q).collect()), key=repr) == want
    if seed == 2:  # a larger query set, block by block
        got = ball_search.ranked(d, q.where("item_id <> 7"), block_bytes=200)
        assert sorted(map(tuple, got.collect()), key=repr) == plain_search(docs, [i for i in items if i[0] not in (7, None)], 20)


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ball_search.ranked(docs.limit(0), items).collect() == []
    assert ball_search.ranked(docs, items.limit(0)).collect() == []
    wide = docs.selectExpr("*", "1 as n", "2 as terms", "3 as score", "4 as item_id")
    assert sorted(map(tuple, ball_search.ranked(wide, items).collect())) == plain_search([(1, "a b")], [(1, "a")], 20)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 5), st.integers(1, 40))
def test_bounds_hold_and_no_document_is_lost(seed, leaf, n):
    rnd = np.random.default_rng(seed)
    weights = rnd.integers(1, 20_000, 30)
    rows, starts = [], [0]
    for _ in range(n):
        some = np.sort(rnd.choice(30, rnd.integers(1, 12), replace=False))
        rows.append((some, rnd.integers(1, 1_000_000, len(some)) if rnd.random() < 0.7 else np.full(len(some), 999_999)))
        starts.append(starts[-1] + len(some))
    sparse = ball_search.Rows(np.array(starts), np.concatenate([t for t, _ in rows]), np.concatenate([v for _, v in rows]).astype(np.int64))
    roots = np.sqrt(weights.astype(float))
    tree = ball_search.build(sparse, roots, leaf)
    exact = np.where(rnd.random(30) < 0.4, weights * rnd.integers(1, 4, 30), 0).astype(np.int64)
    scaled = np.where(exact > 0, exact / roots, 0.0)
    norm = ball_search.raised(math.sqrt(float((scaled**2).sum())), 40)
    every = [int((exact[t] * v).sum()) for t, v in rows]
    for top in (1, 3, n):
        got = ball_search.search(tree, np.arange(n), exact, scaled, norm, (0, 0), top)
        assert got == sorted(((s, i) for i, s in enumerate(every) if s > 0), key=lambda r: (-r[0], r[1]))[:top]
    for node in tree.nodes:
        upper = ball_search.raised(float((scaled[node.terms] * node.center).sum()), len(node.terms)) + ball_search.raised(norm * node.radius, 16)
        assert all(every[i] <= upper * (1 + 1e-15) for i in tree.order[node.first : node.last])
