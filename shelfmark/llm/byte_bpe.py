"""Byte-level BPE encoding and decoding by tree reduction (operator 4).

An element of the monoid is a span of a text with the ids of its encoding. A text is halved until a span has at
most ``leaf`` characters; a leaf is encoded as it is. Two neighbours are joined by re-encoding a window around
their common border. The window grows until it ends, on both sides, at a *settled cut*: a letter or digit
followed by a space or newline. No match of the pattern holds such a pair inside, and the pattern looks neither
back nor further than such a character ahead, so ``ids(text) == ids(text[:cut]) + ids(text[cut:])`` and every id outside the
window stays. A span without such a cut is re-encoded whole, which is the same rule with the widest window.
Decoding concatenates the bytes of halves up the same tree.

Null text counts as empty; an empty text has no ids, and its digests are those of zero bytes. Repeated rows are
encoded each; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import per_slice, table

RANKS_FILE = "byte_bpe_50k.tiktoken"
LEAF_CHARS = 256
FIRST_WINDOW = 16
Encode = Callable[[str], list[int]]


def read_ranks(file: str) -> dict[bytes, int]:
    with open(file, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def leaf_encoder(file: str | None = None) -> tuple[Encode, list[bytes]]:
    """The encoder of leaves and windows, and the bytes of every id."""
    import public_tokenizers
    import tiktoken

    ranks = read_ranks(file or public_tokenizers.path(RANKS_FILE))
    codec = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    spelled = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        spelled[rank] = piece
    return codec.encode_ordinary, spelled


def _settled(text: str, at: int) -> bool:
    return at > 0 and text[at] in " \n" and text[at - 1].isalnum()


def _cut_before(text: str, first: int, border: int) -> int:
    """The last settled cut inside ``(first, border)``, sought in growing windows; ``first`` if there is none."""
    reach = FIRST_WINDOW
    end = border
    while end > first + 1:
        low = max(first + 1, border - reach)
        at = end
        while (at := max(text.rfind(" ", low, at), text.rfind("\n", low, at))) >= low:
            if _settled(text, at):
                return at
        end, reach = low, reach * 4
    return first


def _cut_after(text: str, border: int, last: int) -> int:
    """The first settled cut inside ``(border, last)``; ``last`` if there is none."""
    reach, low = FIRST_WINDOW, border + 1
    while low < last:
        high = min(last, border + reach)
        for at in range(low, high):
            if _settled(text, at):
                return at
        low, reach = max(low, high), reach * 4
    return last


def join(text: str, first: int, border: int, last: int, left: list[int], right: list[int], encode: Encode) -> list[int]:
    """Ids of ``text[first:last]`` from those of its two parts."""
    if first == border or border == last:
        return left or right
    if _settled(text, border):
        return left + right
    start, end = _cut_before(text, first, border), _cut_after(text, border, last)
    dropped = len(encode(text[start:border])) if start > first else len(left)
    skipped = len(encode(text[border:end])) if end < last else len(right)
    return left[: len(left) - dropped] + encode(text[start:end]) + right[skipped:]


def encode_tree(text: str, encode: Encode, leaf: int = LEAF_CHARS, first: int = 0, last: int | None = None) -> list[int]:
    last = len(text) if last is None else last
    if last - first <= leaf:
        return encode(text[first:last])
    border = (first + last) // 2
    left, right = encode_tree(text, encode, leaf, first, border), encode_tree(text, encode, leaf, border, last)
    return join(text, first, border, last, left, right, encode)


def decode_tree(ids: Sequence[int], spelled: list[bytes], leaf: int = 4 * LEAF_CHARS) -> bytes:
    if len(ids) <= leaf:
        return b"".join([spelled[i] for i in ids])
    half = len(ids) // 2
    return decode_tree(ids[:half], spelled, leaf) + decode_tree(ids[half:], spelled, leaf)


def encoded(docs: DataFrame, file: str | None = None, leaf: int = LEAF_CHARS, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, on request, the ids themselves."""

    def work():
        encode, spelled = leaf_encoder(file)
        names = [str(i) for i in range(len(spelled))]

        def one(batch: pa.RecordBatch) -> dict:
            texts = batch.column("text").to_pylist()
            counts, digests, decoded, lists = [], [], [], []
            for text in texts:
                got = encode_tree(text or "", encode, leaf)
                counts.append(len(got))
                digests.append(hashlib.sha256(" ".join([names[i] for i in got]).encode()).hexdigest())
                decoded.append(hashlib.sha256(decode_tree(got, spelled)).hexdigest())
                if ids:
                    lists.append(got)
            out = {"doc_id": batch.column("doc_id"), "n_tokens": counts, "ids_sha256": digests, "decoded_sha256": decoded}
            return out | {"ids": lists} if ids else out

        return one

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")
    return per_slice(docs.select(F.col("doc_id").cast("long"), "text"), work, schema)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), ids=False)
