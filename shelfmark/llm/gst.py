"""Benchmark decontamination by greedy string tiling (operator 5).

Seeds are runs of ``min_match`` words that a benchmark item shares with a document. Seeds meet in two
ways: a benchmark block of at most ``block_words`` words is sent to every task, which looks up its seeds in the rolling hashes of
whole documents; a larger benchmark is cut into blocks by item, and documents are read once for each
block (a fixed query set against all rows). The size is read before anything is sent.

A document and an item with shared seeds are tiled: the longest matches of unmarked words, found by Karp-Rabin hashes of
falling length, are marked first until none of at least ``min_match`` words is left. Tiles never overlap, and their order
does not matter, so reordered passages count in full. Coverage is the marked share of the item's words; a document is
contaminated when an item reaches ``threshold`` of its words. An item shorter than ``min_match`` words is
one seed of its own length.

Words are compared with A-Z folded and punctuation at their ends taken off. Null or empty texts and empty items share no
seed: coverage 0, not contaminated. Of items with equal coverage the smallest id is reported; repeated documents are
judged each; an empty benchmark contaminates nothing. Every benchmark row is an item of its own, also where rows repeat an id or have none; only the id of
the best covered one is reported, and a null id comes last among equals.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import per_slice, table

MIN_MATCH = 8
THRESHOLD = 0.5
BLOCK_WORDS = 1_000_000
_EDGES = b""".,;:!?"'()[]{}<>|*#-_"""
_PRIME = np.uint64(0x100000001B3)


def folded_words(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return [w for w in (x.strip(_EDGES) for x in raw.lower().split()) if w]


def karp_rabin(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` codes, from one pass of prefix sums modulo 2**64."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for k in range(size):
            out = out * _PRIME + codes[k : k + n]
        return out ^ (out >> np.uint64(29))


def _open_runs(marked: np.ndarray, size: int) -> np.ndarray:
    """Starts of runs of ``size`` unmarked positions."""
    n = len(marked) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    ahead = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(ahead[size:] == ahead[:n])


def tile(item: Sequence, doc: Sequence, min_match: int) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in document, words), longest first; ties go to the smaller item and document start.

    The search length doubles while matches of that length exist and is then halved back by bisection, so the longest
    match is found with a logarithmic number of Karp-Rabin passes; equal hashes are compared word by word.
    """
    a, b = list(item), list(doc)
    ids = {w: i for i, w in enumerate(dict.fromkeys(a))}
    x = np.array([ids[w] + 1 for w in a], np.uint64)
    y = np.array([ids.get(w, -1) + 1 for w in b], np.uint64)
    taken_x, taken_y = np.zeros(len(x), bool), y == 0  # words that are not in the item never match
    tiles = []

    def matches(size: int) -> list[tuple[int, int]]:
        px, py = _open_runs(taken_x, size), _open_runs(taken_y, size)
        if not len(px) or not len(py):
            return []
        hx, hy = karp_rabin(x, size)[px], karp_rabin(y, size)[py]
        common = np.intersect1d(hx, hy)
        if not len(common):
            return []
        starts = defaultdict(list)
        for h, p in zip(hy[m := np.isin(hy, common)].tolist(), py[m].tolist()):
            starts[h].append(p)
        found = []
        for h, p in zip(hx[m := np.isin(hx, common)].tolist(), px[m].tolist()):
            found += [(p, q) for q in starts[h] if np.array_equal(x[p : p + size], y[q : q + size])]
        return found

    longest = min(len(x), len(y))
    while True:
        low, high = min_match, longest + 1  # a match of low words may exist, none of high words does
        if low >= high or not (best := matches(low)):
            return tiles
        while high - low > 1:
            mid = min(low * 2, (low + high) // 2)
            if got := matches(mid):
                low, best = mid, got
            else:
                high = mid
        longest = low
        for p, q in sorted(best):
            if not taken_x[p : p + low].any() and not taken_y[q : q + low].any():
                taken_x[p : p + low] = taken_y[q : q + low] = True
                tiles.append((p, q, low))


class _Block:
    """A benchmark block ready for lookups."""

    def __init__(self, items: Sequence[tuple[int | None, list[bytes]]], min_match: int):
        self.min_match = min_match
        self.ids = [k for k, _ in items]
        self.words = {row: w for row, (_, w) in enumerate(items) if w}
        self.vocabulary: dict[bytes, int] = {}
        seeds: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for k, words in self.words.items():
            size = min(min_match, len(words))
            codes = self.codes(words)
            for h in np.unique(karp_rabin(codes, size)).tolist():
                seeds[size][h].add(k)
        self.seeds = {n: {h: sorted(v) for h, v in by.items()} for n, by in seeds.items()}
        self.sorted = {n: np.array(sorted(by), np.uint64) for n, by in self.seeds.items()}

    def codes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))

    def items_of(self, codes: np.ndarray) -> set[int]:
        """Rows of the items that share a seed."""
        out: set[int] = set()
        for size, known in self.sorted.items():
            h = karp_rabin(codes, size)
            if len(h):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                for hit in np.unique(h[known[at] == h]).tolist():
                    out.update(self.seeds[size][hit])
        return out


_FOUND = ("coverage", "item_id", "n_tiles")


def _judged(docs: DataFrame, items: list[tuple[int | None, list[bytes]]], min_match: int, columns: Sequence[str]) -> DataFrame:
    """Updates the best item of rows by that of one block; returns ``columns`` and what was found."""
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def work():
        block = _Block(sent.value, min_match)
        wanted = list({w for words in block.words.values() for w in words})
        memo = dict(zip(wanted, block.codes(wanted).tolist()))
        shortest = min((min(min_match, len(w)) for w in block.words.values()), default=0)

        def best_of(text: bytes | None, top: tuple) -> tuple:
            words = folded_words(text)
            if not block.words or len(words) < shortest:
                return top
            # a word outside the benchmark gets code 0: no seed holds it
            codes = np.array([memo.get(w, 0) for w in words], np.uint64)
            for row in sorted(block.items_of(codes)):
                item, k = block.words[row], block.ids[row]
                tiles = tile(item, words, min(min_match, len(item)))
                share = sum(t[2] for t in tiles) / len(item)
                if share > top[0] or share == top[0] > 0 and (k is None, k) < (top[1] is None, top[1]):
                    top = (share, k, len(tiles))
            return top

        def one(batch: pa.RecordBatch) -> dict:
            texts = batch.column("text")
            before = zip(*(batch.column(c).to_pylist() for c in _FOUND))
            tops = [best_of(t, b) for t, b in zip(texts.cast(pa.binary()).to_pylist(), before)]
            return {c: batch.column(c) for c in columns} | dict(zip(_FOUND, zip(*tops)))

        return one

    schema = T.StructType([docs.schema[c] for c in (*columns, *_FOUND)])
    return per_slice(docs, work, schema)


def _best_items(
    docs: DataFrame, columns: Sequence[str], benchmark: DataFrame, min_match: int, threshold: float, block_words: int
) -> DataFrame:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    most_words = F.coalesce(F.octet_length("text"), F.lit(0)) / 2 + 1  # each word but the last has a separator
    blocks = max(1, math.ceil((items.agg(F.sum(most_words)).first()[0] or 0) / block_words))
    none = {"coverage": F.lit(0.0), "item_id": F.lit(None).cast("long"), "n_tiles": F.lit(0).cast("long")}
    rows = docs.select(*columns, *[c for c in ("text",) if c not in columns], *[v.alias(k) for k, v in none.items()])
    for k in range(blocks):  # one in practice; a larger benchmark is a query set taken in blocks
        mine = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        block = [(r.item_id, folded_words(r.text)) for r in mine.orderBy("item_id", "text").toLocalIterator()]
        carried = columns if k == blocks - 1 or "text" in columns else (*columns, "text")
        rows = _judged(rows, block, min_match, carried)
    return rows.withColumn("contaminated", F.col("coverage") >= threshold)


def contamination(
    docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """One row per document: doc_id, item_id (best covered, null: none), coverage, n_tiles, contaminated."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _best_items(read, ("doc_id",), benchmark, min_match, threshold, block_words)


def clean_documents(
    docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """The documents that are not contaminated, as they are. Column names that start with ``_gst_`` are reserved."""
    inner = {f"_gst_{i}": c for i, c in enumerate(docs.columns) if c != "text"}
    read = docs.select("text", *[F.col(c).alias(k) for k, c in inner.items()])
    found = _best_items(read, read.columns, benchmark, min_match, threshold, block_words).where(~F.col("contaminated"))
    back = {c: k for k, c in inner.items()}
    return found.select(*[F.col(back.get(c, c)).alias(c) for c in docs.columns])


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
