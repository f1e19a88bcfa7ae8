"""Words, word hashes and rolling hashes of whole texts, batch-wise in numpy.

A word is a run of characters outside space and ``\\t\\n\\v\\f\\r``; every other byte, also of a longer UTF-8
sequence, is part of a word, so UTF-8 bytes can be cut without decoding. Null texts have no words.
Batches are cut into slices of at most ``SLICE_BYTES`` (a longer single text is a slice of its own), which
bounds the memory of a task whatever the length of its batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 4 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class Words(NamedTuple):
    """Hashes of the words of a slice, one after the other; document i holds ``codes[starts[i]:starts[i + 1]]``."""

    codes: np.ndarray  # uint64
    starts: np.ndarray  # int64, one more than documents

    def counts(self) -> np.ndarray:
        return np.diff(self.starts)


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch whose texts have at most ``limit`` bytes together."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    first, n = 0, batch.num_rows
    while first < n:
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(first, last - first)
        first = last


def hash_strings(values: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(v) for v in values.cast(pa.binary()).to_pylist()), np.uint64, len(values))


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    """Word hashes of every text; ``lower`` folds A-Z first."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if lower:
        # only A-Z: ascii_lower leaves every other character as it is
        texts = pc.ascii_lower(texts)
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    bounds = parts.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    before = np.concatenate([[0], np.cumsum(full)])
    coded = pc.dictionary_encode(flat)
    codes = hash_strings(coded.dictionary)[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)
    return Words(codes[full], before[bounds])


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * _MIX
        return h ^ (h >> np.uint64(31))


def windows(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position; entry i covers ``codes[i:i + size]``, so windows that
    reach from one document into the next are included and left to the caller to drop."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    # doubling: the hash of 2m words joins the hashes of two halves, any size is a sum of powers of two
    with np.errstate(over="ignore"):
        out, done, power, span = None, 0, codes, 1
        rest = size
        while rest:
            if rest & 1:
                piece = power[done : done + n]
                out = mix(piece) if out is None else mix(out * _MULTIPLIER + piece)
                done += span
            rest >>= 1
            if rest:
                power = mix(power[: len(power) - span] * _MULTIPLIER + mix(power[span:]))
                span *= 2
    return out


def whole(starts: np.ndarray, total: int, size: int) -> np.ndarray:
    """Mask over window starts: true where the window lies inside one document."""
    n = max(total - size + 1, 0)
    inside = np.ones(n + size, bool)
    for ahead in range(1, size):
        at = starts[1:] - ahead
        inside[at[at >= 0]] = False
    # a short document ends several windows of the one before it; the marks above already cover those
    return inside[:n]
