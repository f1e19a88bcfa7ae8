"""Words of whole texts by byte classes, batch-wise in numpy.

Every byte is part of a word, a gap between words, or a wall that also ends a piece of the text. Only ASCII bytes may be gaps or walls, so
UTF-8 can be cut without decoding; A-Z are folded. Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

WORD, GAP, WALL = 0, 1, 2
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32


class Cut(NamedTuple):
    """The words of a slice, one after the other."""

    codes: np.ndarray  # int64, place of a word in ``words``
    words: pa.Array  # distinct words, binary
    text: np.ndarray  # int64, row of the text
    piece: np.ndarray  # int64, never falls; equal for the words of one piece


def byte_classes(gaps: bytes, walls: bytes = b"") -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(gaps)] = GAP
    out[list(walls)] = WALL
    return out


def raw_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their offsets; nulls are empty."""
    filled = texts.cast(pa.string()).fill_null("").cast(pa.large_binary())
    _, ends, data = filled.buffers()
    offsets = np.frombuffer(ends, np.int64)[filled.offset : filled.offset + len(filled) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def cut_words(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> Cut:
    kind = classes[data]
    inside = kind == WORD
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a text begins or ends here
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    text = np.searchsorted(offsets, starts, side="right") - 1
    piece = text + np.cumsum(kind == WALL)[starts] if len(data) else text
    places = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    flat = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(_FOLD[data[inside]]))]
    )
    coded = flat.dictionary_encode()
    return Cut(coded.indices.to_numpy().astype(np.int64), coded.dictionary, text, piece)


def bounded(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The texts as they are, or, if a single one is longer than ``limit``, parts of it that end behind walls."""
    if len(offsets) != 2 or len(data) <= limit:
        yield data, offsets
        return
    first = 0
    while first < len(data):
        last = min(first + limit, len(data))
        while last < len(data):
            walls = np.flatnonzero(classes[data[first:last]] == WALL)
            if len(walls):
                last = first + int(walls[-1]) + 1
                break
            last = min(last + limit, len(data))  # a piece longer than the limit stays whole
        yield data[first:last], np.array([0, last - first], np.int64)
        first = last
