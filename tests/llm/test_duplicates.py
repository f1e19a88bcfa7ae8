"""Substring removal and similarity joins against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from shelfmark.llm import components, jaccard, suffixes


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def removed(rows, size):
    first = {}
    for d, t in rows:
        w = split(t)
        for i in range(len(w) - size + 1) if d is not None else ():
            k = tuple(w[i : i + size])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        w = split(t)
        gone = [False] * len(w)
        for i in range(len(w) - size + 1) if d is not None else ():
            if first[tuple(w[i : i + size])] < d:
                gone[i : i + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return collections.Counter(out)


def grouped(rows, size, percent):
    sets = {}
    for d, t in rows:
        w = split(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    best = {d: d for d in sets}
    changed = True
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    while changed:
        changed = False
        for a, b in links:
            m = min(best[a], best[b])
            if (best[a], best[b]) != (m, m):
                best[a] = best[b] = m
                changed = True
    return {(d, len(s), best[d]) for d, s in sets.items()}


def passages(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["é漢", "W1"]
    rows = []
    for i in range(n):
        base = [rng.choice(words) for _ in range(rng.choice([0, 1, 5, 8, 30, 60]))]
        for _ in range(rng.randint(0, 3) if rows else 0):
            other = split(rng.choice(rows)[1])
            a = rng.randrange(len(other) + 1)
            base[len(base) // 2 : len(base) // 2] = other[a : a + rng.randint(0, 40)]
        if rng.random() < 0.2:
            base += ["x"] * rng.randint(1, 40)
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(base)))
    return rows


def variants(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(n):
        if i < 30 or rng.random() < 0.3:
            base = [rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 8, 20, 60, 120, 400]))]
        else:
            base = split(rng.choice(rows)[1])
            for _ in range(rng.randint(0, 3)):
                if base:
                    base[rng.randrange(len(base))] = rng.choice(words)
            if rng.random() < 0.3:
                base = base + ["Tail"] * rng.randint(1, 9)
        rows.append((i, " ".join(base)))
    return rows


@pytest.mark.parametrize("group", [2000, 1, 4])
def test_repeats_go_from_all_but_the_smallest_id(spark, group):
    rows = passages(120, 5)
    rows += [(1000, None), (None, rows[3][1]), (90, rows[7][1]), (7, rows[7][1]), (2, rows[50][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = suffixes.without_repeats(df, window=8, prefix=3, group=group)
    assert collections.Counter(tuple(r) for r in got.collect()) == removed(rows, 8)


def test_kept_text_and_empty_table(spark):
    text = " ".join(f"q{i}" for i in range(60))
    df = spark.createDataFrame([(1, text, 5), (2, "own " + text + " tail", 6)], "doc_id long, text string, spans int")
    texts = {r.doc_id: r.kept_text for r in suffixes.without_repeats(df, texts=True).collect()}
    assert texts == {1: text, 2: "own tail"}
    assert suffixes.without_repeats(df.limit(0)).count() == 0


def test_nodes_of_a_suffix_tree():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 3, 200)
    for depth in (1, 2, 3, 5, 8, 13):
        rank = suffixes.node_ranks(codes, depth)
        grams = [tuple(codes[i : i + depth]) for i in range(len(codes) - depth + 1)]
        assert len(rank) == len(grams)
        assert [sorted(set(grams)).index(g) for g in grams] == rank.tolist()


@pytest.mark.parametrize("rare, unit", [(64, 500_000), (1, 300), (3, 100)])
def test_groups_of_similar_texts(spark, rare, unit):
    rows = [*variants(150, 7), (1000, None), (1001, "A b C d e"), (1002, "a B c d e")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = jaccard.near_duplicates(df, rare=rare, unit=unit)
    assert {tuple(r) for r in got.collect()} == grouped(rows, 4, 85)


def test_five_word_shingles_at_eighty_percent(spark):
    rows = variants(80, 11)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in jaccard.near_duplicates(df, size=5, percent=80).collect()} == grouped(rows, 5, 80)


def test_null_and_repeated_ids(spark):
    text = "a b c d e f g h i j k l"
    rows = [(None, text, 1), (5, text, 1), (5, "x y", 1), (9, text, 2), (8, "x  Y", 2), (8, "x  Y", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = collections.Counter(tuple(r) for r in jaccard.near_duplicates(df).collect())
    assert got == {(None, 9, None): 1, (5, 9, 5): 1, (5, 1, 5): 1, (9, 9, 5): 1, (8, 1, 5): 2}
    assert jaccard.near_duplicates(df.limit(0)).count() == 0


def test_prefix_arithmetic_never_loses_a_link():
    rng = random.Random(3)
    for _ in range(1500):
        n = rng.choice([3, 10, 47, 60, 100, 300])
        a = rng.sample(range(2000), n)
        b = a[: -(-n * 90 // 100)] + rng.sample(range(2000, 3000), rng.randint(0, n // 10))
        a, b = np.array(sorted(set(a))), np.array(sorted(set(b)))
        if 100 * len(np.intersect1d(a, b)) < 85 * len(np.union1d(a, b)):
            continue
        keys = []
        for s, o in ((a, b), (b, a)):
            pre, other = s[: jaccard.prefix_size(len(s), 85)], o[: jaccard.prefix_size(len(o), 85)]
            held = np.intersect1d(pre, other)  # all others stand in one class only
            counts = np.where(held % 3 == 0, 2, 100)
            order = np.lexsort((held, counts))
            alone, pairs = jaccard.index_keys(len(s), held[order], counts[order], 85, 64)
            keys.append({*held[order][alone].tolist(), *(("p", p) for p in pairs.tolist())})
        assert keys[0] & keys[1]


def test_components_of_chains_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    random.Random(2).shuffle(links)
    got = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(61)}, **{k: 100 for k in range(100, 140)}, 200: 200, 201: 200, 202: 200}


def test_pipeline_stage_finds_near_copies_by_five_words(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(100)]
    between = [w if i not in (30, 60) else f"other{i}" for i, w in enumerate(words)]
    apart = [w if i not in (20, 40, 60) else f"third{i}" for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(between)), (3, " ".join(apart)), (4, " ".join(f"v{i}" for i in range(100)))]
    assert {c for _, _, c in grouped(rows, 4, 85)} == {1, 2, 3, 4}  # the contract of op3 links none of them
    want = {d for d, _, c in grouped(rows, 5, 80) if d == c}
    assert want == {1, 3, 4}
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.jaccard_join(spark, df, "").collect()} == want


def test_long_repetitive_texts_are_no_small_group(spark):
    rows = [(1, "na " * 30_000), (2, "na " * 20_000 + "end"), (3, "ba na " * 15_000), (4, " ".join(f"u{i}" for i in range(80))), (5, "ba na " * 40 + "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed) for r in suffixes.without_repeats(df, group=1000).collect()}
    assert got == {1: (30_000, 0), 2: (20_001, 20_000), 3: (30_000, 0), 4: (80, 0), 5: (81, 80)}
    few = {r.doc_id: (r.n_words, r.n_removed) for r in suffixes.without_repeats(df).collect()}
    assert few == got
