"""Prefixes and signatures of word sets, and the pairs of one cell judged by signature or by words.

Words are known by 64-bit hashes here, which only ever adds candidates; ``dice_cell`` looks at the words themselves.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COUNTERS = 1 << 18  # of words by hash; words that share one are taken to be as common as all of them
FOLDED_LONGS = 12  # of the signature that travels with every word of a prefix
SIGNATURE_BYTES = 256  # of the signature that meets each candidate once
JUDGED = 1 << 16  # pairs whose signatures are compared at a time
SEPARATOR = "\u0001"


def _bits(hashes: np.ndarray, of: np.ndarray, rows: int, size: int) -> np.ndarray:
    """One row of ``size`` bits each: every hash sets a bit."""
    marked = np.zeros(rows * size, bool)
    marked[of * size + ((hashes >> np.uint64(20)) % np.uint64(size)).astype(np.int64)] = True
    return np.packbits(marked.reshape(rows, size), axis=1, bitorder="little")


def prefixes(levels: np.ndarray, threshold: float, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (..., words, h), words as one text and their hashes, become rows (..., words, n, prefix, f0, f1, ..., sig, home).

    ``words`` is packed. ``prefix``: the words one of which any partner must share, as halves of their hashes, rarest first by ``levels`` (of counters) and
    hash, the same order in all sets. ``home`` is the smallest hash: sets that are alike often have the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("h")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            hashes = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            of = np.repeat(np.arange(len(sizes)), sizes)
            starts = np.cumsum(sizes) - sizes
            order = np.lexsort((hashes, levels[(hashes % np.uint64(COUNTERS)).astype(np.int64)], of))
            # overlap needed with the smallest partner allowed: ceil(t/(2-t) * n); the prefix is the rest + 1
            need = np.ceil(threshold / (2 - threshold) * sizes - 1e-9).astype(np.int64)
            first = np.clip(sizes - need + 1, 0, sizes)
            taken = np.arange(len(order)) - np.repeat(starts, sizes) < np.repeat(first, sizes)
            prefix = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(first)).astype(np.int32)), pa.array((hashes[order][taken] >> np.uint64(32)).astype(np.uint32).view(np.int32)))
            folded = _bits(hashes, of, len(sizes), 64 * FOLDED_LONGS).view(np.int64)
            sig = _bits(hashes, of, len(sizes), 8 * SIGNATURE_BYTES)
            home = np.minimum.reduceat(hashes, starts).view(np.int64)
            made = {
                "n": pa.array(sizes.astype(np.int32)), "prefix": prefix, "home": pa.array(home),
                "words": pa.array([zlib.compress(w.encode(), 1) for w in batch.column("words").to_pylist()], pa.binary()),
                "sig": pa.array([r.tobytes() for r in sig], pa.binary()), **{f"f{k}": pa.array(np.ascontiguousarray(folded[:, k])) for k in range(FOLDED_LONGS)},
            }
            yield pa.RecordBatch.from_arrays([made[f.name].cast(f.type) if f.name in made else batch.column(f.name) for f in schema], schema=schema)

    return run


def _met(asked: pa.Table, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return tuple(pc.index_in(asked.column(c), ids).to_numpy() for c in ("a", "b"))


def judge_cell(asked: pa.Table, shown: pa.Table, threshold: float) -> pa.Table:
    """The pairs (a, b) that may reach the threshold, with the groups (ga, gb) of both: words that only one side has set the bits that differ."""
    ids = shown.column("id").combine_chunks()
    a, b = _met(asked, ids)
    pairs = np.unique(a.astype(np.int64) * len(ids) + b)
    a, b = pairs // len(ids), pairs % len(ids)
    bits = np.frombuffer(b"".join(shown.column("sig").to_pylist()), np.uint64).reshape(len(ids), -1)
    n, group = (shown.column(c).to_numpy().astype(np.int64) for c in ("n", "grp"))
    good = np.zeros(len(a), bool)
    for at in range(0, len(a), JUDGED):
        x, y = a[at : at + JUDGED], b[at : at + JUDGED]
        differ = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
        good[at : at + JUDGED] = n[x] + n[y] - differ >= threshold * (n[x] + n[y]) - 1e-9
    a, b = a[good], b[good]
    return pa.table({"a": ids.take(pa.array(a)), "b": ids.take(pa.array(b)), "ga": group[a], "gb": group[b]})


def dice_cell(asked: pa.Table, shown: pa.Table, threshold: float) -> pa.Table:
    """The pairs (a, b, dice) that reach the threshold, from the words of both."""
    ids = shown.column("id").combine_chunks()
    a, b = _met(asked, ids)
    lists = pc.split_pattern(pa.array([zlib.decompress(w).decode() for w in shown.column("words").to_pylist()], pa.large_string()), SEPARATOR)
    code = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    held = np.zeros(int(code.max()) + 1 if len(code) else 0, bool)
    order = np.lexsort((b, a))
    dice = np.zeros(len(order))
    heads = np.flatnonzero(np.append(True, a[order][1:] != a[order][:-1])) if len(order) else np.zeros(0, np.int64)
    for lo, hi in zip(heads, np.append(heads[1:], len(order))):
        one = a[order[lo]]
        mine = code[starts[one] : starts[one] + sizes[one]]
        held[mine] = True
        for at in order[lo:hi]:
            two = b[at]
            dice[at] = 2.0 * np.count_nonzero(held[code[starts[two] : starts[two] + sizes[two]]]) / (sizes[one] + sizes[two])
        held[mine] = False
    good = dice >= threshold
    return asked.select(["a", "b"]).filter(pa.array(good)).append_column("dice", pa.array(dice[good]))
