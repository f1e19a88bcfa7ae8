"""Substring deduplication with prefix-partitioned suffix trees (operator 2).

A window is ``WINDOW`` consecutive words of one document. A word goes when it lies in a window whose words also start
in a document with a smaller id. A suffix tree over all texts would show such windows as internal nodes at depth ``WINDOW`` or below; it is
built in parts that fit a task:

0. *Copies.* A text of at least a window that is equal to one with a smaller id loses every word. Such copies take no further part:
   whatever they share, the first of them shares with a smaller id.
1. *Suffixes in play.* Of the ``PREFIX``-word runs inside a window the one with the smallest hash is the window's anchor; equal
   windows have equal anchors. An anchor run is the prefix of the suffixes of its windows. Documents send the hashes of their anchors only; a prefix
   that stands in one document only (most do) belongs to no repeat and is dropped, before any text has moved.
2. *Groups by prefix length.* A prefix with at most ``GROUP`` windows is one group: the stretches of text under its windows
   go to one task, ``GROUP * WINDOW`` words at most. Windows are counted, not documents, so a few long repetitive texts do not pass for a small group. A more frequent prefix is lengthened to the whole window: then a subtree is a single node, its smallest document is a
   minimum that Spark takes before the shuffle, and a passage that stands in a third of all documents is never gathered.
3. *Subtrees.* A task takes whole groups and refines the ranks of all their suffixes by doubling the compared depth
   (1, 2, 4, ... words) up to ``WINDOW``: the classes of one rank are the nodes of that depth. A node at depth ``WINDOW`` with several documents
   is a repeat; all its suffixes but those of its smallest document are marked, and neighbouring marks form maximal repeats.
4. *Removal.* Marked stretches return to their documents, which drop those words.

Words are kept as they are. Null texts have no words: n_words 0 and the digest of no bytes. Texts shorter than a window
lose nothing. Rows with a null id lose nothing and cost no other row a word. Equal ids are not smaller than each other, so rows that
repeat an id keep what they share, and each row is judged by its own text. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.plans.durable import keep

from .tables import per_slice, table
from .words import words_of, windows

WINDOW = 50
PREFIX = 16
GROUP = 40_000  # windows
SLICE_BYTES = 1 << 20  # of text at a time, where every window may become a row
BATCH_WORDS = 1_000_000
ALL_WORDS = 1 << 62


def anchors(codes: np.ndarray, starts: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``prefix`` words, first words of all windows, and the place of the anchor of each window."""
    runs = windows(codes, prefix).view(np.int64)
    sizes = np.maximum(np.diff(starts) - window + 1, 0)
    first = np.repeat(starts[:-1] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    if not len(first):
        return runs, first, first
    span = window - prefix + 1
    best = np.arange(len(runs))
    reach = 1
    while reach < span:  # place of the leftmost minimum of ``reach`` runs from each place
        step = min(reach, span - reach)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(runs[a] <= runs[b], a, b)
        reach += step
    return runs, first, best[first]


def anchor_table(docs: DataFrame, window: int, prefix: int) -> DataFrame:
    """doc_id, text_hash, check and the distinct anchor hashes of every document that has a window, with the number of their windows."""

    def work():
        def one(batch: pa.RecordBatch) -> dict:
            words = words_of(batch.column("text"))
            runs, first, at = anchors(words.codes, words.starts, window, prefix)
            bounds = np.searchsorted(first, words.starts)
            marks = runs[at]
            found = [np.unique(marks[a:b], return_counts=True) for a, b in zip(bounds, bounds[1:])]
            marked = {"prefixes": [p for p, _ in found], "windows": [n for _, n in found]}
            return {c: batch.column(c) for c in ("doc_id", "text_hash", "check")} | marked

        return one

    schema = "doc_id long, text_hash long, check long, prefixes array<long>, windows array<long>"
    return per_slice(docs.select("doc_id", "text_hash", "check", "text"), work, schema).where(F.size("prefixes") > 0)


def stretches(docs: DataFrame, window: int, prefix: int) -> DataFrame:
    """The text under the windows of wanted prefixes.

    A row of a group has a ``stretch``: the words of ``n`` windows from word ``first`` on, joined by spaces. A row of a
    lengthened prefix stands for ``n`` windows from ``first`` on that have the same words: ``whole`` is their hash and ``stretch`` is null."""

    def work():
        def one(batch: pa.RecordBatch) -> dict:
            words = words_of(batch.column("text"))
            runs, first, at = anchors(words.codes, words.starts, window, prefix)
            whole = windows(words.codes, window).view(np.int64)
            bounds = np.searchsorted(first, words.starts)
            parts: dict[str, list[np.ndarray]] = {k: [np.zeros(0, np.int64)] for k in ("prefix", "whole", "row", "first", "n", "single")}
            held_text: list[bytes | None] = []
            texts = batch.column("text").cast(pa.binary())

            def add(row: int, spots: np.ndarray, new: np.ndarray, **columns: np.ndarray) -> np.ndarray:
                """One row for each run of ``spots``; ``new`` marks where a run begins."""
                heads = np.flatnonzero(np.concatenate([[True], new]))
                sizes = np.diff(np.append(heads, len(spots)))
                for k, v in (columns | {"n": None, "row": None}).items():
                    parts[k].append(sizes if k == "n" else np.full(len(heads), row) if k == "row" else v[spots[heads]])
                return heads

            for i, wanted in enumerate(batch.column("wanted")):
                a, b = bounds[i], bounds[i + 1]
                prefixes, frequent = (c.to_numpy(zero_copy_only=False) for c in wanted.values.flatten())
                order = np.argsort(prefixes)
                prefixes, frequent = prefixes[order], frequent[order].astype(bool)
                mine, deep = runs[at[a:b]], whole[first[a:b]]
                spot = np.minimum(np.searchsorted(prefixes, mine), len(prefixes) - 1)
                hit = prefixes[spot] == mine
                starts = first[a:b] - words.starts[i]
                often = np.flatnonzero(hit & frequent[spot])
                if len(often):
                    new = (np.diff(often) != 1) | (np.diff(deep[often]) != 0) | (np.diff(mine[often]) != 0)
                    heads = add(i, often, new, prefix=mine, whole=deep, first=starts, single=np.ones(len(mine), np.int64))
                    held_text += [None] * len(heads)
                rare = np.flatnonzero(hit & ~frequent[spot])
                if len(rare):
                    new = (np.diff(rare) != 1) | (np.diff(at[a:b][rare]) != 0)
                    heads = add(i, rare, new, prefix=mine, whole=deep, first=starts, single=np.zeros(len(mine), np.int64))
                    held = texts[i].as_py().split()
                    ends = np.append(rare[heads[1:] - 1], rare[-1])
                    held_text += [b" ".join(held[p : q + window]) for p, q in zip(starts[rare[heads]].tolist(), starts[ends].tolist())]
            out = {k: np.concatenate(v) for k, v in parts.items()}
            rows = pa.array(out["row"])
            return {
                "prefix": out["prefix"], "whole": pa.array(out["whole"], pa.int64(), mask=out["single"] == 0), "first": out["first"], "n": out["n"],
                "doc_id": batch.column("doc_id").take(rows), "text_hash": batch.column("text_hash").take(rows), "stretch": held_text,
            }

        return one

    schema = "prefix long, whole long, doc_id long, text_hash long, first long, n int, stretch binary"
    return per_slice(docs, work, schema, limit=SLICE_BYTES)


def node_ranks(codes: np.ndarray, depth: int) -> np.ndarray:
    """The node at ``depth`` under which the suffix of each place lies (as a number); places near the end have none."""
    _, rank = np.unique(codes, return_inverse=True)
    reach = 1
    while reach < depth:
        step = min(reach, depth - reach)
        n = len(rank) - step
        if n <= 0:
            return np.zeros(0, np.int64)
        _, rank = np.unique(rank[:n].astype(np.int64) * (int(rank.max()) + 1) + rank[step:], return_inverse=True)
        reach += step
    return rank


def marked_windows(codes: np.ndarray, starts: np.ndarray, n: np.ndarray, docs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretch and offset of the windows that also start in a document with a smaller id."""
    rank = node_ranks(codes, window)
    stretch = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(stretch)) - np.repeat(np.cumsum(n) - n, n)
    node = rank[starts[:-1][stretch] + offset]
    least = np.full(int(node.max(initial=0)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, node, docs[stretch])
    hit = docs[stretch] > least[node]
    return stretch[hit], offset[hit]


def subtree_repeats(groups: DataFrame, window: int, batch_words: int = BATCH_WORDS) -> DataFrame:
    """(doc_id, text_hash, first, last): stretches of words to remove, from groups that each lie in one task, side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            words = words_of_binary(table.column("stretch"))
            column = {c: table.column(c).to_numpy() for c in ("doc_id", "text_hash", "first", "n")}
            stretch, offset = marked_windows(words.codes, words.starts, column["n"], column["doc_id"], window)
            begin = column["first"][stretch] + offset
            new = np.concatenate([[True], (np.diff(stretch) != 0) | (np.diff(begin) > window)]) if len(stretch) else np.zeros(0, bool)
            at = np.flatnonzero(new)
            ends = np.append(at[1:], len(begin)) - 1 if len(at) else at
            arrays = [column["doc_id"][stretch[at]], column["text_hash"][stretch[at]], begin[at], begin[ends] + window]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in arrays], names=["doc_id", "text_hash", "first", "last"])

        def words_of_binary(column: pa.ChunkedArray):
            return words_of(pa.chunked_array(column.chunks, pa.binary()).combine_chunks().cast(pa.string()))

        bytes_held = 0
        for batch in batches:
            held.append(batch)
            bytes_held += batch.nbytes
            if bytes_held < 8 * batch_words:
                continue
            whole = pa.Table.from_batches(held)
            prefix = whole.column("prefix").to_numpy()
            cut = int(np.searchsorted(-(prefix[::-1] == prefix[-1]).astype(int), 0))  # rows of the last, open group
            done = len(prefix) - cut
            if done:
                yield close(whole.slice(0, done))
            held = whole.slice(done).to_batches()
            bytes_held = sum(b.nbytes for b in held)
        if held and sum(b.num_rows for b in held):
            yield close(pa.Table.from_batches(held))

    dealt = groups.repartition("prefix").sortWithinPartitions("prefix")
    return dealt.mapInArrow(run, "doc_id long, text_hash long, first long, last long")


def repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """doc_id, text_hash and the stretches ``spans`` (first, last) of words to remove, of documents that have any."""
    known = docs.where("doc_id is not null and text is not null").withColumn("check", F.crc32(F.col("text").cast("binary")))
    held = keep(anchor_table(known, window, prefix), "anchors")
    same = ["text_hash", "check"]
    twins = held.groupBy(*same).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).where("least <> last")
    copies = keep(
        held.select("doc_id", *same).join(twins, same).where("doc_id > least").select("doc_id", "text_hash").distinct(), "copies"
    )
    marks = held.join(copies, ["doc_id", "text_hash"], "left_anti").select(
        "doc_id", "text_hash", F.explode(F.arrays_zip(F.col("prefixes").alias("prefix"), F.col("windows").alias("windows"))).alias("m")
    ).select("doc_id", "text_hash", "m.prefix", "m.windows")
    shared = (
        marks.groupBy("prefix")
        .agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last"), F.sum("windows").alias("places"))
        .where("least <> last")
        .select("prefix", (F.col("places") > group).alias("frequent"))
    )
    wanted = (
        marks.join(shared, "prefix")
        .groupBy("doc_id", "text_hash")  # at most the anchors of one document
        .agg(F.collect_list(F.struct("prefix", "frequent")).alias("wanted"))
    )
    wanted = keep(wanted, "wanted")
    texts = known.select("doc_id", "text_hash", "text").join(wanted, ["doc_id", "text_hash"])
    rows = keep(stretches(texts, window, prefix), "stretches")
    found = subtree_repeats(rows.where("stretch is not null"), window)
    single = rows.where("stretch is null").select("prefix", "whole", "doc_id", "text_hash", "first", "n")
    least = single.groupBy("prefix", "whole").agg(F.min("doc_id").alias("least"))
    deep = (
        single.join(least, ["prefix", "whole"]).where("doc_id > least")
        .select("doc_id", "text_hash", "first", (F.col("first") + F.col("n") - 1 + window).alias("last"))
    )
    everything = copies.select("doc_id", "text_hash", F.lit(0).cast("long").alias("first"), F.lit(ALL_WORDS).alias("last"))
    return (
        found.unionByName(deep).unionByName(everything)
        .groupBy("doc_id", "text_hash")  # at most the windows of one document
        .agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    )


def without_repeats(
    docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP, texts: bool = False
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, on request, the kept words as ``kept_text``."""
    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash")
    )
    spans = keep(repeats(read, window, prefix, group), "spans")
    joined = read.join(spans, ["doc_id", "text_hash"], "left").select("doc_id", "text", "spans")

    def work():
        def one(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept_text": []}
            for text, mine in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist()):
                held = (text or b"").split()
                n = len(held)
                if mine:
                    gone = np.zeros(n + 1, np.int64)
                    np.add.at(gone, [s["first"] for s in mine], 1)
                    np.add.at(gone, [min(s["last"], n) for s in mine], -1)
                    held = [held[i] for i in np.flatnonzero(np.cumsum(gone)[:n] == 0)]
                kept = b" ".join(held)
                out["n_words"].append(n)
                out["n_removed"].append(n - len(held))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if texts:
                    out["kept_text"].append(kept.decode())
            return out | {"doc_id": batch.column("doc_id")}

        return one

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if texts else "")
    return per_slice(joined, work, schema)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
