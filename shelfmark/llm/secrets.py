"""Secret scans with a character CNN (operator 9).

Candidates are all matches of the three base rules and every run of at least ``MIN_TOKEN`` token characters that holds a
digit or an inner capital. Base matches are findings by definition. Every other candidate and its surrounding
text goes through a character CNN; those at or above its threshold are findings of kind ``cnn``. A candidate of any length is
judged whole, with the text before and behind it.

The network is trained on all labelled findings of all documents. Base matches are positives and other candidates negatives,
but for candidates equal to the value of a base match in any document, which are neither. Half of the rows of either label are shown masked, without
surroundings and, for positives, without the key word, so that the form of the value counts. A quarter is held out, with all rows of a value on one side:
it calibrates the probabilities, and the threshold is the largest that keeps ``RECALL`` of its positives, all of them masked. So
recall is measured on what the network is asked about, values that no base rule can see.
Findings are dealt to shards of about ``SHARD_FINDINGS``. In every round each shard trains the network on all its rows, and the networks are averaged by
rows; with one shard this is plain training. The threshold is taken by rank from the probabilities of all held-out positives. The driver sees networks, never findings.
A training row shows at most ``SHOWN_CHARS`` characters, both ends of a longer one; judging knows no such bound.
A label with fewer than ``LEAST_FINDINGS`` different values is filled up with the prior model's rows: ``PRIOR_FINDINGS`` values drawn with a fixed seed, as positives
from the forms of the base rules, as negatives from plain numbers, dates, numbered names and joined words (``prior_findings``). Only
documents without any candidate give no network: there is nothing to judge.

Null and empty texts have no findings. Candidates never overlap base matches; equal rows get equal results. Positions
are code points, ends are exclusive.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import random
import re
import string
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.plans.durable import keep
from shelfmark.plans.skew import SortKey, number_rows

from .char_cnn import CharCNN, coded, recall_place, window
from .tables import per_slice, table

# The base rules.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "cnn")

MIN_TOKEN = 16
SHARD_FINDINGS = 6_000
ROUNDS = 12
SHOWN_CHARS = 1_024
LEAST_FINDINGS = 20
PRIOR_FINDINGS = 400
RECALL = 0.95
MASK = "[secret]"
_TOKEN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}")
_MIXED = re.compile(r"[0-9]|[a-z0-9][A-Z]")
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")


def _members(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_HEX_BYTES = _members(b"0123456789abcdef")
_TOKEN_BYTES = _members(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base findings, in order of start and kind."""
    spans = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if len(m[0]) >= MIN_HEX]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def bare_values(text: str) -> list[tuple[int, int]]:
    """(start, end) of the value of every base finding, without the key word of an assignment."""
    spans = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    spans += [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    spans += [m.span() for m in HEX.finditer(text) if len(m[0]) >= MIN_HEX]
    return sorted(set(spans))


def other_candidates(text: str, base: Sequence[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """(start, end) of the other candidates, none of which overlaps one of ``base`` (in order of start)."""
    starts = [s for s, _, _ in base]
    reach = [0, *itertools.accumulate((e for _, e, _ in base), max)]  # how far the first n base matches go
    found = [(m.start(), m.end()) for m in _TOKEN.finditer(text) if _MIXED.search(m[0])]
    return [(a, b) for a, b in found if reach[bisect.bisect_left(starts, b)] <= a]


def _long_runs(member: np.ndarray, data: np.ndarray, starts: np.ndarray, least: int) -> np.ndarray:
    """Positions where a run of at least ``least`` member bytes begins; runs end with their document."""
    inside = np.empty(len(data) + 1, bool)
    inside[:-1] = member[data]
    inside[-1] = False
    if not len(data):
        return np.zeros(0, np.int64)
    opens = inside[:-1] & ~np.concatenate([[False], inside[:-2]])
    cuts = starts[(starts > 0) & (starts < len(data))]
    opens[cuts] = inside[cuts]
    closes = inside[:-1] & ~inside[1:]
    before = cuts - 1
    closes[before] = inside[before]
    a, b = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return a[b - a >= least]


def suspects(texts: pa.Array) -> np.ndarray:
    """Numbers of the texts that can hold a candidate; found over all bytes at once, without decoding."""
    raw = texts.cast(pa.binary()).fill_null(b"")
    offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    held = raw.buffers()[2]
    view = memoryview(held)[offsets[0] : offsets[-1]] if held is not None else memoryview(b"")
    starts = offsets - offsets[0]
    data = np.frombuffer(view, np.uint8)
    at = [_long_runs(_HEX_BYTES, data, starts, MIN_HEX), _long_runs(_TOKEN_BYTES, data, starts, MIN_TOKEN)]
    lowered = bytes(view).lower()
    for word in (*_KEYWORDS, b"akia"):
        here, hits = -1, []
        while (here := lowered.find(word, here + 1)) >= 0:
            hits.append(here)
        at.append(np.array(hits, np.int64))
    return np.unique(np.searchsorted(starts, np.concatenate(at), side="right") - 1)


def value_hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "big", signed=True)


def both_ends(shown: str, most: int = SHOWN_CHARS) -> str:
    return shown if len(shown) <= most else shown[: most // 2] + shown[len(shown) - (most - most // 2) :]


def labelled_findings(docs: DataFrame) -> DataFrame:
    """(window, bare, value, label) of the candidates of all documents; window: of the whole match, bare: of the masked value, value: its hash."""
    mine = docs.select("text")

    def work():
        def one(batch: pa.RecordBatch) -> dict:
            texts = batch.column("text")
            out: dict[str, list] = {"window": [], "bare": [], "value": [], "label": []}
            for i in suspects(texts).tolist():
                text = texts[i].as_py()
                base = base_spans(text)
                whole = {b: a for a, b, _ in reversed(base)}  # a match ends with its value; the first one holds the key word
                found = [(1, whole[b], a, b) for a, b in bare_values(text)] + [(0, a, a, b) for a, b in other_candidates(text, base)]
                for label, first, a, b in found:
                    out["window"].append(both_ends(window(text, first, b)))
                    out["bare"].append(both_ends(window(text, a, b, context=False)))
                    out["value"].append(value_hash(text[a:b]))
                    out["label"].append(label)
            return out

        return one

    return per_slice(mine, work, "window string, bare string, value long, label int")


def prior_findings(label: int, n: int = PRIOR_FINDINGS, seed: int = 0) -> list[Row]:
    """Rows of ``labelled_findings`` for a label of which the documents hold too little; the same ones in every run."""
    rng = random.Random(2 * seed + label)
    some = lambda chars, low, high: "".join(rng.choice(chars) for _ in range(rng.randint(low, high)))
    lower, digits = string.ascii_lowercase, string.digits
    word = lambda: some(lower, 3, 9)
    alnum = string.ascii_letters + digits
    positives = (
        lambda: f"{rng.choice(['password', 'passwd', 'secret', 'token', 'api_key'])}{rng.choice(['=', ': ', ' = '])}{some(alnum, 16, 40)}",
        lambda: "AKIA" + some(string.ascii_uppercase + digits, 16, 16),
        lambda: some("0123456789abcdef", MIN_HEX, 64),
    )
    negatives = (
        lambda: some(digits, MIN_TOKEN, 19),
        lambda: f"{rng.randint(1990, 2030)}-{some(digits, 2, 2)}-{some(digits, 2, 2)}-{word()}-{word()}",
        lambda: "-".join([word(), word(), word(), some(digits, 1, 6)]),
        lambda: "/".join([word(), word(), word(), word() + some(digits, 1, 3)]),
        lambda: word() + "".join(w.capitalize() for w in (word(), word(), word())),
    )
    rows = []
    while len(rows) < n:
        form = (positives if label else negatives)[len(rows) % (len(positives) if label else len(negatives))]().ljust(MIN_TOKEN, "0")
        head, tail = (" ".join(word() for _ in range(6)) for _ in range(2))
        text, first, end = f"{head} {form} {tail}", len(head) + 1, len(head) + 1 + len(form)
        a = bare_values(text)[0][0] if label else first
        bare = window(text, a, end, context=False)
        rows.append(Row(window=window(text, first, end), bare=bare, value=value_hash(text[a:end]), label=label))
    return rows


def training_set(found: DataFrame, filled: Sequence[int], shards: int) -> DataFrame:
    """(shard, label, place, shown, held) of all findings and the prior rows of the labels in ``filled``, by the rule of ``training_rows``."""
    rows = found.select("label", "window", "bare", "value", F.lit(0).alias("prior"))
    for y in filled:
        drawn = [(y, r.window, r.bare, r.value, i + 1) for i, r in enumerate(prior_findings(y))]
        rows = rows.unionByName(found.sparkSession.createDataFrame(drawn, rows.schema))
    placed = number_rows(rows, ["label"], ["prior", F.xxhash64("window"), "window", "bare", "value"], "place")
    ranks = number_rows(rows.select("label", "value").distinct(), ["label"], ["value"], "rank").select("label", "value", "rank")
    held, place = F.col("rank") % 4 == 0, F.col("place") - 1
    shown = F.when((place % 2 == 1) | (held & (F.col("label") == 1)), F.col("bare")).otherwise(F.col("window"))
    shard = F.floor(place / 2) % shards  # neighbours differ in how they are shown
    return placed.join(ranks, ["label", "value"]).select(shard.alias("shard"), "label", place.alias("place"), shown.alias("shown"), held.alias("held"))


def _per_shard(data: DataFrame, work) -> list[tuple[int, np.ndarray]]:
    """(rows, vector) of every shard; ``work(shard, x, y)`` gives the vector. Rows of a shard stand in order, positives first."""

    def one(part: pa.Table) -> pa.Table:
        part = part.sort_by([("label", "descending"), ("place", "ascending")])
        vector = work(part.column("shard")[0].as_py(), coded(part.column("shown").to_pylist()), part.column("label").to_numpy().astype(float))
        return pa.table({"shard": part.column("shard")[:1], "n": pa.array([part.num_rows], pa.int64()), "vector": pa.array([vector.tolist()])})

    rows = data.groupBy("shard").applyInArrow(one, "shard long, n long, vector array<double>").collect()
    return [(r.n, np.array(r.vector)) for r in sorted(rows, key=lambda r: r.shard)]


def _averaged(parts: Sequence[tuple[int, np.ndarray]]) -> np.ndarray:
    if len(parts) == 1:
        return parts[0][1]
    return np.average([v for _, v in parts], axis=0, weights=[n for n, _ in parts])


def train(docs: DataFrame, shard_findings: int = SHARD_FINDINGS, recall: float = RECALL) -> tuple[CharCNN, float] | None:
    """The network and its threshold, from all labelled findings; None if no document has a candidate."""
    found = keep(labelled_findings(docs).distinct(), "labelled")
    secret = found.where("label = 1")
    clean = found.where("label = 0").join(secret.select("value").distinct(), "value", "left_anti").select(found.columns)
    used = keep(secret.unionByName(clean), "findings")
    values = {r.label: r.n for r in used.groupBy("label").agg(F.countDistinct("value").alias("n")).collect()}
    if not values:
        return None
    filled = [y for y in (1, 0) if values.get(y, 0) < LEAST_FINDINGS]
    shards = -(-used.count() // shard_findings)
    data = keep(training_set(used, filled, shards), "training")
    sizes = {(r.held, r.label): r["count"] for r in data.groupBy("held", "label").count().collect()}
    share = sizes[False, 1] / (sizes[False, 1] + sizes[False, 0])
    net = CharCNN()
    learnt, kept_back = data.where("not held"), data.where("held")
    each = ROUNDS if shards == 1 else 1  # rounds between two averages

    for turn in range(0, ROUNDS, each):

        def fitted(shard: int, x, y: np.ndarray, net=net, turn=turn) -> np.ndarray:
            if shards > 1:
                net.rng = np.random.default_rng([turn, shard])
            net.fit(x, y, np.where(y == 1, 0.5 / share, 0.5 / (1 - share)), rounds=each)
            return np.append(net.state(), net.step)

        mean = _averaged(_per_shard(learnt, fitted))
        net.restore(mean[:-1], max(1, round(mean[-1])))

    def calibrated(shard: int, x, y: np.ndarray) -> np.ndarray:
        net.calibrate(x, y)
        return np.array([net.scale, net.offset])

    net.scale, net.offset = _averaged(_per_shard(kept_back, calibrated)).tolist()
    need = recall_place(sizes.get((True, 1), 0), recall)
    if not need:
        return net, float("inf")

    def judged(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"place": batch.column("place"), "p": pa.array(net.probability(coded(batch.column("shown").to_pylist())), pa.float64())})

    probable = kept_back.where("label = 1").select("place", "shown").mapInArrow(judged, "place long, p double")
    ranked = number_rows(probable, [], [SortKey(F.col("p"), "desc"), "place"], "rank")
    return net, ranked.where(F.col("rank") == need).first().p


def training_rows(rows: Sequence[Sequence[Row]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coded windows, labels and which are held out: a quarter of the values of either label; positives among them are masked.

    The plain statement, for lists in order, of what ``training_set`` does with tables.
    """
    shown, labels, held = [], [], []
    for part in rows:
        values = {v: i for i, v in enumerate(sorted({r.value for r in part}))}  # in order of hash
        for i, r in enumerate(part):
            out = values[r.value] % 4 == 3
            shown.append(r.bare if i % 2 or out and r.label == 1 else r.window)
            labels.append(r.label)
            held.append(out)
    return coded(shown), np.array(labels, float), np.array(held)


def _scan(docs: DataFrame, model: tuple[CharCNN, float] | None, schema: str | T.StructType, row) -> DataFrame:
    """Maps every document to the columns ``row(batch, spans)`` gives; spans: findings of each text."""

    def work():
        trained = model  # a few thousand numbers, sent with the function

        def one(batch: pa.RecordBatch) -> dict:
            texts = batch.column("text")
            spans: list[list[tuple[int, int, str]]] = [[] for _ in range(len(texts))]
            open_spans, windows = [], []
            for i in suspects(texts).tolist():
                text = texts[i].as_py()
                spans[i] = base_spans(text)
                for a, b in other_candidates(text, spans[i]) if trained else ():
                    open_spans.append((i, a, b))
                    windows.append(window(text, a, b))
            if windows:
                net, threshold = trained
                for (i, a, b), p in zip(open_spans, net.probability(coded(windows)).tolist()):
                    if p >= threshold:
                        spans[i].append((a, b, "cnn"))
            return row(batch, [sorted(s, key=lambda t: (t[0], KINDS.index(t[2]))) for s in spans])

        return one

    return per_slice(docs, work, schema)


def _digest_form(spans: Sequence[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def secret_spans(docs: DataFrame, model: tuple[CharCNN, float] | None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""

    def row(batch: pa.RecordBatch, spans: list) -> dict:
        out: dict = {"doc_id": batch.column("doc_id")}
        for kind in KINDS[:3]:
            out[f"n_{kind}"] = [sum(k == kind for _, _, k in s) for s in spans]
        base = [_digest_form([t for t in s if t[2] != "cnn"]) for s in spans]
        out["base_sha256"] = [hashlib.sha256(b.encode()).hexdigest() for b in base]
        return out | {"spans": [_digest_form(s) for s in spans]}

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return _scan(docs.select(F.col("doc_id").cast("long"), "text"), model, schema, row)


def redact(text: str, spans: Sequence[tuple[int, int, str]], mask: str = MASK) -> str:
    """``text`` with every finding replaced; overlapping findings become one mask."""
    out, at = [], 0
    for a, b, _ in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mask]
        at = b
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, model: tuple[CharCNN, float] | None, n_chars: str = "n_chars") -> DataFrame:
    """The documents with findings masked in ``text``; ``n_chars``, where present, is counted again for changed texts."""

    def row(batch: pa.RecordBatch, spans: list) -> dict:
        out = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        changed = [i for i, s in enumerate(spans) if s]
        if changed:
            texts = out["text"].to_pylist()
            for i in changed:
                texts[i] = redact(texts[i], spans[i])
            out["text"] = texts
            if n_chars in out:
                counts = out[n_chars].to_pylist()
                for i in changed:
                    counts[i] = len(texts[i])
                out[n_chars] = counts
        return out

    return _scan(docs, model, docs.schema, row)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_spans(docs, train(docs))
