"""Language identification with script ranges and Viterbi labels (operator 10).

Every word (a run of letters, digits and signs between white space) has one score per language: the sum of the log
probabilities of its byte 1- to 3-grams, edges included. The script of a word narrows its candidates: a language in
whose training words that script is rarer than ``SCRIPT_SHARE`` cannot take the word. Viterbi over the words of a text with a switching penalty labels
spans of mixed-language text; the language with most letters-bearing bytes is the prediction, and its share of those bytes the
score. A text is known to have one label without the recursion when no stretch of its words gains more than
one penalty over the best language (a maximum-subarray bound), so only mixed texts are walked word by word.

The model is learned from a bounded sample, at most about ``TRAIN_DOCS`` texts of each language, chosen by hash of the document
id among rows with a language and crc32(doc_id) mod 4 other than 2. The language, source and id of a row are no inputs of its prediction.

Null texts and texts without a letter give ``und`` with score 0, and so does everything when no row has a language. Null
ids are never learned from and are not held out. Ties go to the language that sorts first. Equal texts get equal results.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import per_slice, table
from .words import mix

TRAIN_DOCS = 2_000
BUCKETS = 1 << 14
ORDERS = 3
SWITCH = 12.0
SCRIPT_SHARE = 0.01
FORBIDDEN = 30.0
UNKNOWN = "und"
SLICE_BYTES = 8 << 20
# First code points of script ranges and the script that starts there (0: none in particular).
SCRIPT_STARTS = (
    (0x0000, 1), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0780, 0), (0x0900, 7), (0x0980, 8),
    (0x0E00, 9), (0x0E80, 0), (0x10A0, 10), (0x1100, 11), (0x1200, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3040, 12),
    (0x3100, 0), (0x3400, 13), (0xA000, 0), (0xAC00, 11), (0xD7B0, 0), (0xF900, 13), (0xFB00, 0),
)
SCRIPTS = 14


class Model(NamedTuple):
    langs: list[str]
    logs: np.ndarray  # ORDERS, BUCKETS, languages
    allowed: np.ndarray  # SCRIPTS, languages


class Vocabulary(NamedTuple):
    """Distinct words of a slice: their bytes with an edge byte around each, first positions, letters, script."""

    data: np.ndarray
    first: np.ndarray
    letters: np.ndarray
    script: np.ndarray


def split(texts: pa.Array) -> tuple[Vocabulary, np.ndarray, np.ndarray]:
    """Distinct words, the word number at every position and the first position of every text."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    flat = parts.flatten()
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    bounds = parts.offsets.to_numpy().astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(full)])[bounds - bounds[0]]
    coded = pc.dictionary_encode(flat)
    words = coded.dictionary.to_pylist()
    raw = (" " + " ".join(words) + " ").encode()
    data = np.frombuffer(raw, np.uint8)
    edges = np.flatnonzero(data == 32)
    letter = np.zeros(256, bool)
    letter[97:123] = True
    ahead = np.concatenate([[0], np.cumsum(letter[data])])
    high = np.concatenate([[0], np.cumsum(data >= 128)])
    letters = ahead[edges[1:]] > ahead[edges[:-1]]
    script = np.where(letters, 1, 0)
    limits = np.array([s for s, _ in SCRIPT_STARTS])
    kinds = np.array([k for _, k in SCRIPT_STARTS])
    for i in np.flatnonzero(high[edges[1:]] > high[edges[:-1]]).tolist():
        c = next((c for c in words[i] if c.isalpha()), None)
        if c is not None:
            letters[i] = True
            script[i] = kinds[np.searchsorted(limits, ord(c), side="right") - 1]
    return Vocabulary(data, edges, letters, script), coded.indices.to_numpy()[full], starts


def ngram_buckets(data: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each byte; n-grams may begin or end in an edge byte."""
    n = len(data) - order + 1
    h = np.full(max(n, 0), order, np.uint64)
    for k in range(order):
        h = h << np.uint64(8) | data[k : k + len(h)].astype(np.uint64)
    return (mix(h) % np.uint64(BUCKETS)).astype(np.int64)


def _inside(v: Vocabulary, order: int, n: int) -> np.ndarray:
    """Word of the n-gram at each of the first n bytes, -1 where it reaches over the far edge."""
    owner = np.cumsum(v.data == 32)[:n] - 1
    last = np.append(v.first[1:], len(v.data))[np.minimum(owner, len(v.first) - 1)]
    return np.where((np.arange(n) + order - 1 <= last) & (owner < len(v.first) - 1), owner, -1)


def word_scores(v: Vocabulary, model: Model) -> np.ndarray:
    out = np.zeros((len(v.letters), len(model.langs)))
    for order in range(1, ORDERS + 1):
        bucket = ngram_buckets(v.data, order)
        owner = _inside(v, order, len(bucket))
        use = owner >= 0
        logs = model.logs[order - 1][bucket[use]]
        for k in range(len(model.langs)):
            out[:, k] += np.bincount(owner[use], logs[:, k], minlength=len(out))[: len(out)]
    out[~model.allowed[v.script]] -= FORBIDDEN
    out[~v.letters] = 0.0
    return out


def viterbi(scores: np.ndarray, starts: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """Language of every word; ``scores`` are those of the words of all texts, one text after the other."""
    sizes = np.diff(starts)
    out = np.zeros(len(scores), np.int16)
    totals = np.add.reduceat(np.vstack([scores, np.zeros((1, scores.shape[1]))]), np.minimum(starts[:-1], len(scores)))
    totals[sizes == 0] = 0
    top = totals.argmax(axis=1)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    out[:] = top[owner]
    if scores.shape[1] == 1 or not len(scores):
        return out
    # most that any stretch of words can gain over the best language
    other = scores.copy()
    other[np.arange(len(scores)), out] = -np.inf
    gain = other.max(axis=1) - scores[np.arange(len(scores)), out]
    total = np.cumsum(gain)
    apart = 2 * np.abs(total).max() + 1  # earlier texts lie higher than all of a later one
    line = np.concatenate([[0.0], total])
    before = line[:-1] - owner * apart
    best = (total - owner * apart) - np.minimum.accumulate(before)
    mixed = np.zeros(len(sizes), bool)
    mixed[owner[best > penalty]] = True
    todo = np.flatnonzero(mixed)
    if len(todo):
        todo = todo[np.argsort(-sizes[todo], kind="stable")]
        at, size = starts[:-1][todo], sizes[todo]
        langs = scores.shape[1]
        value = np.zeros((len(todo), langs))
        came = np.zeros((size.sum(), langs), np.int16)  # language of the word before, by text and step
        base = np.concatenate([[0], np.cumsum(size)[:-1]])
        own = np.arange(langs)
        steps = int(size[0])
        live = np.searchsorted(-size, -np.arange(steps), side="left")  # texts longer than t
        for t in range(steps):
            n = live[t]
            v = value[:n]
            lead = v.argmax(axis=1)
            jump = v[np.arange(n), lead] - penalty
            moved = v < jump[:, None]
            came[base[:n] + t] = np.where(moved, lead[:, None], own)
            value[:n] = np.where(moved, jump[:, None], v) + scores[at[:n] + t]
        state = np.zeros(len(todo), np.int64)
        for t in range(steps - 1, -1, -1):
            n = live[t]
            ends = slice(live[t + 1] if t + 1 < steps else 0, n)
            state[ends] = value[ends].argmax(axis=1)
            out[at[:n] + t] = state[:n]
            state[:n] = came[base[:n] + t, state[:n]]
    return out


def _counts(docs: DataFrame) -> DataFrame:
    """(lang, order, bucket, n) of the n-grams of letter-bearing words; order 0 counts words by script."""

    def work():
        def one(batch: pa.RecordBatch) -> dict:
            v, words, starts = split(batch.column("text"))
            langs = np.array(batch.column("lang").to_pylist(), object)
            out: dict[str, list] = {"lang": [], "order": [], "bucket": [], "n": []}
            at = np.repeat(np.arange(len(langs)), np.diff(starts))
            for lang in dict.fromkeys(langs.tolist()):
                n = np.bincount(words[langs[at] == lang], minlength=len(v.letters)) * v.letters
                tallies = [np.bincount(v.script, n, SCRIPTS)]
                for order in range(1, ORDERS + 1):
                    bucket = ngram_buckets(v.data, order)
                    owner = _inside(v, order, len(bucket))
                    use = owner >= 0
                    tallies.append(np.bincount(bucket[use], n[owner[use]], BUCKETS))
                for order, tally in enumerate(tallies):
                    b = np.flatnonzero(tally)
                    out["lang"] += [lang] * len(b)
                    out["order"] += [order] * len(b)
                    out["bucket"] += b.tolist()
                    out["n"] += tally[b].astype(np.int64).tolist()
            return out

        return one

    counted = per_slice(docs.select("text", "lang"), work, "lang string, order int, bucket int, n long")
    return counted.groupBy("lang", "order", "bucket").agg(F.sum("n").alias("n"))


def _remainder() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model | None:
    """The model, of a size that depends on the number of languages only; None without labelled texts."""
    usable = docs.select("doc_id", "text", "lang").where(
        (_remainder() != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    sizes = {r.lang: r["count"] for r in usable.groupBy("lang").count().collect()}  # one row per language
    if not sizes:
        return None
    every = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, max(1, n // train_docs))]), F.col("lang"))
    rows = _counts(usable.where(F.pmod(F.xxhash64("doc_id"), every) == 0)).toPandas()
    langs = sorted(set(rows["lang"]))
    if not langs:
        return None
    tallies = np.zeros((ORDERS, BUCKETS, len(langs)))
    scripts = np.zeros((SCRIPTS, len(langs)))
    which = rows["lang"].map({k: i for i, k in enumerate(langs)}).to_numpy()
    order, bucket, n = (rows[c].to_numpy() for c in ("order", "bucket", "n"))
    words = order == 0
    scripts[bucket[words], which[words]] = n[words]
    tallies[order[~words] - 1, bucket[~words], which[~words]] = n[~words]
    logs = np.log((tallies + 0.5) / (tallies.sum(axis=1, keepdims=True) + 0.5 * BUCKETS))
    allowed = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1)
    allowed[~allowed.any(axis=1)] = True  # a script of no language tells nothing
    return Model(langs, logs, allowed)


def spans_text(labels: np.ndarray, langs: list[str]) -> str:
    """``lang:first:end`` of the spans of a text, in words, comma-joined."""
    if not len(labels):
        return ""
    cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
    return ",".join(f"{langs[labels[a]]}:{a}:{b}" for a, b in zip(cuts, cuts[1:]))


def language_spans(docs: DataFrame, model: Model | None, penalty: float = SWITCH) -> DataFrame:
    """doc_id, held_out, lang_pred, score and the labelled spans of every document."""

    def work():
        known = model or Model([UNKNOWN], np.zeros((ORDERS, BUCKETS, 1)), np.ones((SCRIPTS, 1), bool))

        def one(batch: pa.RecordBatch) -> dict:
            v, words, starts = split(batch.column("text"))
            labels = viterbi(word_scores(v, known)[words], starts, penalty)
            sizes = (np.diff(v.first) - 1) * v.letters
            weights = np.zeros((batch.num_rows, len(known.langs)))
            np.add.at(weights, (np.repeat(np.arange(batch.num_rows), np.diff(starts)), labels), sizes[words])
            total = weights.sum(axis=1)
            top = weights.argmax(axis=1)
            sure = (total > 0) & (known.langs[0] != UNKNOWN or len(known.langs) > 1)
            return {
                "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                "lang_pred": [known.langs[t] if s else UNKNOWN for t, s in zip(top, sure)],
                "score": np.where(sure, weights.max(axis=1) / np.maximum(total, 1), 0.0),
                "spans": [spans_text(labels[a:b], known.langs) if s else "" for a, b, s in zip(starts, starts[1:], sure)],
            }

        return one

    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(_remainder() == 2, F.lit(False)).alias("held_out")
    )
    schema = "doc_id long, held_out boolean, lang_pred string, score double, spans string"
    return per_slice(read, work, schema, limit=SLICE_BYTES)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_spans(docs, train(docs)).drop("spans")
