"""Token counts by section (operator 6).

A document is encoded once as a whole; cutting it first would change the tokens at the cuts. The byte lengths of its tokens give
their character spans, and an interval join in order assigns them to sections. A token that crosses a boundary
goes to one section by a stated rule, so that the counts of the sections of a document add up to its tokens:

* ``start``: the section of its first character,
* ``end``: the section of its last character,
* ``largest``: the section with most of its bytes, the earlier one of equals.

Sections are half-open character spans, in order and without overlap; by default the lines of a text, each with its newline.
Tokens in no section are counted under section -1. Null and empty texts have no sections and give no rows; an empty section
gives a row with zero tokens. Equal rows give equal rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import RANKS_FILE, read_ranks
from .tables import per_slice, table

Spans = list[tuple[int, int]]
RULES = ("start", "end", "largest")
OUTSIDE = -1


def line_spans(text: str) -> Spans:
    out, at = [], 0
    while at < len(text):
        end = text.find("\n", at) + 1 or len(text)
        out.append((at, end))
        at = end
    return out


def assign(first: np.ndarray, last: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of every token ``[first, last)`` (``OUTSIDE`` if none) and whether it crosses a boundary."""
    if not len(starts):
        return np.full(len(first), OUTSIDE), np.zeros(len(first), bool)

    def section_at(place: np.ndarray) -> np.ndarray:
        k = np.searchsorted(starts, place, side="right") - 1
        return np.where((k >= 0) & (place < ends[np.maximum(k, 0)]), k, OUTSIDE)

    head, tail = section_at(first), section_at(last - 1)
    inside = np.searchsorted(starts, last, side="left") - np.searchsorted(starts, first, side="right")
    crosses = (head != tail) | (inside > 0)
    if rule == "start":
        return head, crosses
    if rule == "end":
        return tail, crosses
    out = head.copy()
    for i in np.flatnonzero(crosses):
        k = np.arange(max(np.searchsorted(starts, first[i], side="right") - 1, 0), np.searchsorted(starts, last[i], side="left"))
        shared = np.minimum(ends[k], last[i]) - np.maximum(starts[k], first[i])
        out[i] = k[shared.argmax()] if len(k) and shared.max() > 0 else OUTSIDE
    return out, crosses


def token_sections(
    docs: DataFrame, spans_of: Callable[[str], Spans] = line_spans, rule: str = "start", file: str | None = None
) -> DataFrame:
    """doc_id, section, start, end, n_tokens, n_crossing (of these tokens, those that cross a boundary)."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def work():
        import public_tokenizers
        import tiktoken

        ranks = read_ranks(file or public_tokenizers.path(RANKS_FILE))
        codec = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, rank in ranks.items():
            sizes[rank] = len(piece)

        def one(batch: pa.RecordBatch) -> dict:
            parts: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if not text:
                    continue
                spans = np.array(spans_of(text), np.int64).reshape(-1, 2)
                last = np.cumsum(sizes[codec.encode_to_numpy(text, disallowed_special=()).astype(np.int64)])
                places = spans
                raw = text.encode()
                if len(raw) != len(text):  # character positions as byte positions
                    lead = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
                    places = np.append(lead, len(raw))[spans]
                got, crosses = assign(np.concatenate([[0], last[:-1]]), last, places[:, 0], places[:, 1], rule)
                n = np.bincount(got + 1, minlength=len(spans) + 1)
                cut = np.bincount(got[crosses] + 1, minlength=len(spans) + 1)
                skip = 0 if n[0] else 1
                sections = np.arange(skip - 1, len(spans))
                bounds = np.vstack([[OUTSIDE, OUTSIDE], spans])[skip:]
                parts.append(([doc_id] * len(sections), sections, bounds[:, 0], bounds[:, 1], n[skip:], cut[skip:]))
            names = ("doc_id", "section", "start", "end", "n_tokens", "n_crossing")
            if not parts:
                return {k: [] for k in names}
            ids, *rest = zip(*parts)
            return {"doc_id": [i for part in ids for i in part]} | {k: np.concatenate(v) for k, v in zip(names[1:], rest)}

        return one

    schema = "doc_id long, section long, start long, end long, n_tokens long, n_crossing long"
    return per_slice(docs.select(F.col("doc_id").cast("long"), "text"), work, schema)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_sections(table(spark, sf_dir, "documents"))
