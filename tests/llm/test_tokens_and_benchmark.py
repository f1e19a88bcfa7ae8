"""Tokens against the public library, tiling and contamination against brute force."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm import byte_bpe, gst, token_sections

ENCODE, SPELLED = byte_bpe.leaf_encoder()
PIECES = ["a", "b", " ", "  ", "\n", "é", "'s", "'", "re", "1", "23", "!", "?!", "漢", " ", "\t", "word", "ing", "😀", "\x1c", "<|endoftext|>"]
TEXTS = st.lists(st.sampled_from(PIECES), max_size=50).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.sampled_from([1, 2, 3, 8, 20]))
def test_tree_encoding_equals_encoding_the_whole(text, leaf):
    ids = byte_bpe.encode_tree(text, ENCODE, leaf)
    assert ids == ENCODE(text)
    assert byte_bpe.decode_tree(ids, SPELLED, 2) == text.encode()


def test_join_where_no_cut_is_settled():
    for text in ("x" * 5000, " " * 3000, "?!" * 2000, "漢字" * 1500 + " a"):
        assert byte_bpe.encode_tree(text, ENCODE, 64) == ENCODE(text)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_encoded_rows(spark):
    rows = [(1, "one two", 9), (2, None, 9), (3, "", 9), (1, "one two", 9), (None, "é" * 20000 + " <|endoftext|>", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, byte_bpe.encoded(df).drop("ids").collect()), key=repr)
    want = []
    for d, t, _ in rows:
        ids = ENCODE(t or "")
        want.append((d, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert got == sorted(want, key=repr)
    assert byte_bpe.encoded(df.limit(0)).count() == 0


@pytest.mark.parametrize("rule", token_sections.RULES)
def test_tokens_by_section(spark, rule):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice([*PIECES, "\n\n", ".\n"]) for _ in range(rng.randint(0, 40)))) for i in range(60)] + [(60, None)]
    spans_of = lambda t: [(k, min(k + 3, len(t))) for k in range(0, len(t), 4)]  # noqa: E731  gaps of one character
    for spans in (token_sections.line_spans, spans_of):
        got = {}
        for r in token_sections.token_sections(spark.createDataFrame(rows, "doc_id long, text string"), spans, rule).collect():
            got[r.doc_id, r.section] = (r.start, r.end, r.n_tokens, r.n_crossing)
        want = {}
        for d, text in rows:
            raw = (text or "").encode()
            at = [len((text or "")[:i].encode()) for i in range(len(text or "") + 1)]
            cuts = spans(text or "")
            owner = {b: k for k, (s, e) in enumerate(cuts) for b in range(at[s], at[e])}
            counts = {k: [s, e, 0, 0] for k, (s, e) in enumerate(cuts)}
            pos = 0
            for i in ENCODE(text or ""):
                held = [owner.get(b, -1) for b in range(pos, pos + len(SPELLED[i]))]
                pos += len(held)
                inside = [k for k in held if k >= 0]
                largest = max(sorted(set(inside)), key=inside.count) if inside else -1
                k = {"start": held[0], "end": held[-1], "largest": largest}[rule]
                c = counts.setdefault(k, [-1, -1, 0, 0])
                c[2] += 1
                c[3] += len(set(held)) > 1
            assert pos == len(raw)
            want |= {(d, k): tuple(c) for k, c in counts.items()}
        assert got == want


def tiles(a, b, least):
    """Greedy string tiling word by word."""
    used_a, used_b, out = [False] * len(a), [False] * len(b), []
    while True:
        best, found = least - 1, []
        for p in range(len(a)):
            for q in range(len(b)):
                k = 0
                while p + k < len(a) and q + k < len(b) and a[p + k] == b[q + k] and not used_a[p + k] and not used_b[q + k]:
                    k += 1
                if k > best:
                    best, found = k, [(p, q)]
                elif k == best >= least:
                    found.append((p, q))
        if not found:
            return out
        for p, q in found:
            if not any(used_a[p : p + best]) and not any(used_b[q : q + best]):
                used_a[p : p + best] = used_b[q : q + best] = [True] * best
                out.append((p, q, best))


@settings(max_examples=200, deadline=None)
@given(st.text("abcde", max_size=25), st.text("abcdef", max_size=40), st.integers(1, 4))
def test_tiles(a, b, least):
    assert gst.tile(a, b, least) == tiles(list(a), list(b), least)


def test_karp_rabin_tells_runs_apart():
    codes = np.random.default_rng(0).integers(0, 4, 300).astype(np.uint64)
    hashes = gst.karp_rabin(codes, 3)
    grams = [tuple(codes[i : i + 3]) for i in range(298)]
    assert len(set(hashes.tolist())) == len(set(grams)) == len(set(zip(grams, hashes.tolist())))


ITEM = [f"item{i}" for i in range(40)]
OTHER = [f"other{i}" for i in range(30)]


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, " ".join(ITEM)), (2, " ".join(OTHER)), (3, None), (4, ""), (None, "x y z"), (5, "Tiny item"), (6, " ".join(ITEM))]
    return spark.createDataFrame(rows, "item_id long, text string")


DOCS = [
    (1, "Before. " + " ".join(ITEM).upper() + "! after"),
    (2, " ".join(ITEM[20:] + ["gap"] + ITEM[:20])),  # reordered
    (3, " ".join(ITEM[:15]) + " and own words"),  # less than half
    (4, " ".join(OTHER[:18]) + " ; " + " ".join(ITEM[:25])),
    (5, "a text of its own"), (6, None), (7, ""), (8, "has (tiny) item, inside"), (1, "a text of its own"), (None, " ".join(ITEM)),
]


@pytest.mark.parametrize("block_words", [1_000_000, 60])
def test_contamination(spark, benchmark, block_words):
    df = spark.createDataFrame(DOCS, "doc_id long, text string").coalesce(1)
    got = [(r.doc_id, r.item_id, round(r.coverage, 4), r.n_tiles, r.contaminated) for r in gst.contamination(df, benchmark, block_words=block_words).collect()]
    assert got == [
        (1, 1, 1.0, 1, True), (2, 1, 1.0, 2, True), (3, 1, 0.375, 1, False), (4, 1, 0.625, 1, True), (5, None, 0.0, 0, False),
        (6, None, 0.0, 0, False), (7, None, 0.0, 0, False), (8, 5, 1.0, 1, True), (1, None, 0.0, 0, False), (None, 1, 1.0, 1, True),
    ]


def test_clean_documents_keep_their_columns(spark, benchmark):
    df = spark.createDataFrame([(*d, 7, "z") for d in DOCS], "doc_id long, text string, item_id int, coverage string").coalesce(1)
    kept = gst.clean_documents(df, benchmark)
    assert kept.columns == df.columns
    assert [(r.doc_id, r.item_id, r.coverage) for r in kept.collect()] == [(d, 7, "z") for d in (3, 5, 6, 7, 1)]
    assert gst.clean_documents(df, benchmark.limit(0)).count() == len(DOCS)
    assert gst.contamination(df.limit(0), benchmark).count() == 0


@pytest.mark.parametrize("block_words", [1_000_000, 20])
def test_items_that_repeat_an_id_or_have_none_are_all_searched(spark, block_words):
    passage = lambda name: " ".join(f"{name}{i}" for i in range(20))
    items = spark.createDataFrame([(1, passage("a")), (1, passage("b")), (None, passage("c")), (None, passage("d")), (2, passage("d"))], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"so {passage(n)} on") for k, n in enumerate("abcde")], "doc_id long, text string").coalesce(1)
    got = [tuple(r) for r in gst.contamination(docs, items, block_words=block_words).select("doc_id", "item_id", "coverage", "contaminated").collect()]
    assert got == [(0, 1, 1.0, True), (1, 1, 1.0, True), (2, None, 1.0, True), (3, 2, 1.0, True), (4, None, 0.0, False)]
    assert [r.doc_id for r in gst.clean_documents(docs, items, block_words=block_words).collect()] == [4]


def test_texts_of_usual_length_are_reduced():
    asked = []
    text = "Some words, 12 numbers and\nlines. " * 40
    ids = byte_bpe.encode_tree(text, lambda t: asked.append(t) or ENCODE(t))
    assert ids == ENCODE(text) and max(map(len, asked)) <= byte_bpe.LEAF_CHARS
