"""Phrase collocation mining by multikey three-way quicksort of suffix pointers (operator 11).

Texts are folded (A-Z) and cut into pieces and words. A suffix is a word and what follows it in its piece, ``MAX_WORDS`` words at most. Equal
suffixes of a slice are summed at once, so copies and hot phrases cost a row per slice.

Routing: a suffix has a 64-bit route of 16 bits for each of its words (the first also for the language), so all suffixes that begin with
the same words are neighbours. The routes are cut into ranges of about ``RANGE_WORDS`` suffixes at splitters drawn from a bounded sample of documents
(``SAMPLE_DOCS``; it decides balance, never results). A rare word lies in one range; a hot word is cut by its second, third and fourth word,
so no group is gathered. Suffixes travel as blocks of word numbers with the words they use, one per slice, range and language.

Counting: in a range, suffix pointers are sorted by three-way partitions on the language, the first, second, third and fourth word. The rows equal to
the pivot are the occurrences of a prefix: their sum is its count, and they go on to the next word. Partitions with a sum below ``MIN_COUNT`` are
abandoned unless a prefix in them may go on in another range, by the splitters; such counts are given out whatever they are and
summed by Spark. Segments of up to ``SMALL`` pointers are sorted at once.

Scores, cuts and the removal of phrases inside longer ones are joins and sums over the frequent phrases in exact decimals.

Null texts are empty; null languages are ``und``; ids are not read, so rows that repeat or lack one count each. Ties go by phrase in byte order. An
empty table, or one without frequent phrases, gives no rows. Other columns are not read. A piece is never cut, however long it is; a longer
text is worked off in parts that end between pieces.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from shelfmark.plans.durable import keep
from shelfmark.plans.skew import top_n

from .byte_words import Cut, bounded, byte_classes, cut_words, raw_texts
from .tables import table
from .words import hash_strings, mix, slices

MAX_WORDS = 4
MIN_COUNT = 30
INSIDE_PERCENT = 80
SCALE = 2_000_000
TOP = 2000
SLICE_BYTES = 4 << 20
RANGE_WORDS = 1_000_000
MAX_RANGES = 1 << 18
SAMPLE_DOCS = (4096, 65536)  # a thousandth of the documents, within these
SAMPLE_STEP = 4
SMALL = 2048
_GAPS, _WALLS = b" \t", b".,;:!?\n\x0b\x0c\r"
_BITS = 16
_BLOCKS = pa.schema([
    ("range", pa.int32()), ("lang", pa.string()), ("n_words", pa.int32()), ("words", pa.binary()), ("width", pa.int32()),
    ("codes", pa.binary()), ("counts", pa.binary()),
])
_FOUND = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])


class Suffixes:
    """Distinct suffixes: ``keys[0]`` numbers languages, ``keys[1:]`` words from 1 (0: the piece has ended), with counts and routes."""

    def __init__(self, keys: list[np.ndarray], counts: np.ndarray, words: pa.Array, langs: list[str]):
        self.keys, self.counts, self.words, self.langs = keys, counts, words, langs
        marks = np.concatenate([np.zeros(1, np.uint64), hash_strings(words)])
        first = hash_strings(pa.array(langs, pa.string()))
        with np.errstate(over="ignore"):
            lead = mix(first[keys[0]] + marks[keys[1]])
        self.routes = lead >> np.uint64(64 - _BITS)
        for k in keys[2:]:
            self.routes = self.routes << np.uint64(_BITS) | marks[k] >> np.uint64(64 - _BITS)


def suffixes(cut: Cut, langs: list[str]) -> Suffixes:
    """Distinct suffixes of a slice in order; ``langs`` holds the language of every text."""
    names = list(dict.fromkeys(langs))
    number = {v: i for i, v in enumerate(names)}
    lang = np.array([number[v] for v in langs], np.int64)[cut.text] if len(cut.text) else cut.text
    n, base = len(cut.codes), len(cut.words) + 1
    keys = [lang]
    for ahead in range(MAX_WORDS):
        word = np.zeros(n, np.int64)
        if n > ahead:
            same = cut.piece[ahead:] == cut.piece[: n - ahead]
            word[: n - ahead] = np.where(same, cut.codes[ahead:] + 1, 0)
        keys.append(word)
    high, low = (keys[0] * base + keys[1]) * base + keys[2], keys[3] * base + keys[4]
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    new = np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])]) if n else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return Suffixes([k[order[at]].astype(np.int32) for k in keys], np.diff(np.append(at, n)), cut.words, names)


def _slice_suffixes(batch: pa.RecordBatch):
    classes = byte_classes(_GAPS, _WALLS)
    for part in slices(batch, limit=SLICE_BYTES):
        langs = part.column("lang").to_pylist()
        for data, offsets in bounded(*raw_texts(part.column("text")), classes, SLICE_BYTES):
            found = suffixes(cut_words(data, offsets, classes), langs)
            if len(found.counts):
                yield found


def _blocks(found: Suffixes, splitters: np.ndarray) -> pa.RecordBatch:
    """One row per range and language of a slice."""
    where = np.searchsorted(splitters, found.routes, side="right")
    order = np.lexsort((found.keys[0], where))  # stable: suffixes of a block stay in order
    where, lang = where[order], found.keys[0][order]
    starts = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (lang[1:] != lang[:-1])]))
    rows = []
    for a, b in zip(starts, np.append(starts[1:], len(order))):
        mine = order[a:b]
        flat = np.concatenate([k[mine] for k in found.keys[1:]])
        used, local = np.unique(flat, return_inverse=True)
        if used[0] != 0:
            local, used = local + 1, np.concatenate([[0], used])
        words = found.words.take(pa.array(used[1:] - 1))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.binary())), b" ")
        counts = found.counts[mine]
        width = max(np.min_scalar_type(len(used)).itemsize, 2)
        rows.append((
            int(where[a]), found.langs[lang[a]], len(words), joined[0].as_py(), width,
            local.astype(f"u{width}").tobytes(), counts.astype(np.min_scalar_type(counts.max())).tobytes(),
        ))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _BLOCKS)], schema=_BLOCKS)


def _gathered(blocks: pa.Table) -> Suffixes:
    """The suffixes of all blocks of a range, numbered by common words."""
    gaps = byte_classes(b" ")
    packed = blocks.column("words").combine_chunks().cast(pa.large_binary())
    data = np.frombuffer(b" ".join(packed.to_pylist()), np.uint8)
    every = cut_words(data, np.array([0, len(data)], np.int64), gaps)
    number = np.concatenate([[0], every.codes + 1])  # below 2**31, as a range is a small part of the corpus
    sizes = blocks.column("n_words").to_numpy()
    before = np.concatenate([[0], np.cumsum(sizes)])
    langs = blocks.column("lang").combine_chunks().dictionary_encode()
    keys: list[list[np.ndarray]] = [[] for _ in range(MAX_WORDS + 1)]
    counts = []
    columns = [blocks.column(c).to_pylist() for c in ("width", "codes", "counts")]
    for i, (width, codes, sums) in enumerate(zip(*columns)):
        local = np.frombuffer(codes, f"u{width}").astype(np.int64).reshape(MAX_WORDS, -1)
        n = local.shape[1]
        keys[0].append(np.full(n, langs.indices[i].as_py(), np.int32))
        for k in range(MAX_WORDS):
            keys[k + 1].append(np.where(local[k] > 0, number[np.where(local[k] > 0, local[k] + before[i], 0)], 0).astype(np.int32))
        counts.append(np.frombuffer(sums, f"u{len(sums) // n}").astype(np.int64))
    return Suffixes([np.concatenate(k) for k in keys], np.concatenate(counts), every.words, langs.dictionary.to_pylist())


def multikey_counts(
    keys: list[np.ndarray], counts: np.ndarray, least: int, unsure: Callable[[int, np.ndarray], np.ndarray], small: int = SMALL
) -> list[tuple[int, int, int]]:
    """Prefixes as (a row that holds it, its number of keys, its count).

    Pointers are partitioned into below, equal to and above a pivot key; equal ones hold a prefix. ``unsure(depth, rows)`` marks rows whose
    prefix of ``depth`` keys may have more occurrences elsewhere: those are given whatever their count. Key 0 behind the first key ends a suffix.
    """
    out: list[tuple[int, int, int]] = []
    todo = [(np.arange(len(counts)), 0)] if len(counts) else []

    def equal(rows: np.ndarray, depth: int, total: int) -> None:
        if depth and keys[depth][rows[0]] == 0:
            return
        if total >= least or unsure(depth + 1, rows[:1])[0]:
            out.append((int(rows[0]), depth + 1, total))
            if depth + 1 < len(keys):
                todo.append((rows, depth + 1))

    while todo:
        rows, depth = todo.pop()
        at = keys[depth][rows]
        if len(rows) <= small:
            order = np.argsort(at, kind="stable")
            rows, at = rows[order], at[order]
            ends = np.append(np.flatnonzero(at[1:] != at[:-1]) + 1, len(rows))
            starts = np.append(0, ends[:-1])
            sums = np.add.reduceat(counts[rows], starts)
            wanted = (sums >= least) | unsure(depth + 1, rows[starts])
            for a, b, total in zip(starts[wanted], ends[wanted], sums[wanted].tolist()):
                equal(rows[a:b], depth, total)
            continue
        pivot = np.sort(at[[0, len(at) // 2, -1]])[1]
        same = at == pivot
        equal(rows[same], depth, int(counts[rows[same]].sum()))
        for part in (rows[at < pivot], rows[at > pivot]):
            if len(part) and (int(counts[part].sum()) >= least or unsure(depth + 1, part).any()):
                todo.append((part, depth))
    return out


def _range_counts(blocks: pa.Table, splitters: np.ndarray, least: int) -> pa.Table:
    found = _gathered(blocks)
    here = blocks.column("range")[0].as_py()
    low = splitters[here - 1] if here else np.uint64(0)
    high = splitters[here] - np.uint64(1) if here < len(splitters) else ~np.uint64(0)  # routes at a splitter belong to the range behind it

    def unsure(depth: int, rows: np.ndarray) -> np.ndarray:
        if depth == 1:
            return np.ones(len(rows), bool)  # a language has suffixes everywhere
        free = np.uint64(_BITS * (MAX_WORDS + 1 - depth))
        first = found.routes[rows] >> free << free
        return (first < low) | (first | (np.uint64(1) << free) - np.uint64(1) > high)

    words = found.words
    rows = []
    for row, depth, total in multikey_counts(found.keys, found.counts, least, unsure):
        phrase = b" ".join(words[int(found.keys[k][row]) - 1].as_py() for k in range(1, depth))
        rows.append((found.langs[found.keys[0][row]], depth - 1, phrase.decode(), total))
    columns = list(zip(*rows)) or [()] * len(_FOUND)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND)], schema=_FOUND)


def splitters_of(read: DataFrame, range_words: int) -> np.ndarray:
    """Routes at which ranges of about ``range_words`` suffixes begin, from a bounded sample of documents."""
    n = read.count()
    share = min(1.0, min(max(n / 1000, SAMPLE_DOCS[0]), SAMPLE_DOCS[1]) / max(n, 1))

    def routes(batches):
        for batch in batches:
            for found in _slice_suffixes(batch):
                every = np.repeat(found.routes, found.counts)[::SAMPLE_STEP]
                yield pa.RecordBatch.from_pydict({"route": pa.array(every.view(np.int64))})

    some = read if share == 1 else read.sample(fraction=share, seed=11)
    drawn = np.sort(some.mapInArrow(routes, "route long").toArrow().column("route").to_numpy().view(np.uint64))
    ranges = min(int(len(drawn) * SAMPLE_STEP / share / range_words) + 1, MAX_RANGES)
    return np.unique(drawn[(np.arange(1, ranges) * len(drawn)) // ranges]) if ranges > 1 else np.zeros(0, np.uint64)


def phrase_counts(docs: DataFrame, least: int = MIN_COUNT, range_words: int = RANGE_WORDS) -> DataFrame:
    """lang, k, phrase, f: every phrase of k words with f >= ``least`` occurrences, and with k = 0 all words of the language."""
    read = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    splitters = splitters_of(read, range_words)

    def blocks(batches):
        for batch in batches:
            for found in _slice_suffixes(batch):
                yield _blocks(found, splitters)

    def counted(group: pa.Table) -> pa.Table:
        return _range_counts(group, splitters, least)

    partial = read.mapInArrow(blocks, from_arrow_schema(_BLOCKS)).groupBy("range").applyInArrow(counted, from_arrow_schema(_FOUND))
    summed = partial.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f"))
    return keep(summed.where((F.col("k") == 0) | (F.col("f") >= least)), "phrases")


def _wide(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("decimal(19,0)")


def scored(counts: DataFrame, scale: int = SCALE, inside_percent: int = INSIDE_PERCENT) -> DataFrame:
    """lang, phrase, a, l, r, score of the phrases of two and more words that no longer one explains."""
    phrases = counts.where(F.col("k") >= 2).select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    span = lambda first, size: F.array_join(F.slice("words", first, size), " ")
    cuts = phrases.select("lang", "phrase", "k", "a", "words", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", span(F.lit(1), F.col("cut")).alias("head"), span(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("tail"))
    part = lambda name, f: counts.where(F.col("k").between(1, MAX_WORDS - 1)).select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    both = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    exact = both.withColumns({"top": _wide(F.lit(scale)) * _wide("a"), "bottom": _wide("l") + _wide("r")})
    lowest = exact.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr("top div bottom").alias("score"), "cut", "l", "r")).alias("low"))
    longer = phrases.where(F.col("k") >= 3).select("lang", "a", "words", "k", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"))
    longer = longer.select("lang", "a", "words", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("first"))
    inner = longer.groupBy("lang", span(F.col("first"), F.col("size")).alias("phrase")).agg(F.max("a").alias("most"))
    alone = F.col("most").isNull() | (_wide("most") * 100 < _wide("a") * inside_percent)
    return lowest.join(inner, ["lang", "phrase"], "left").where(alone).select("lang", "phrase", "a", "low.l", "low.r", "low.score")


def collocations(docs: DataFrame, least: int = MIN_COUNT, top: int = TOP, range_words: int = RANGE_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language."""
    counts = phrase_counts(docs, least, range_words)
    best = top_n(scored(counts), ["lang"], [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], top, "rank")
    total = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    long = [F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")]
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *long)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = f"""
with pieces as (
  select row_number() over () as p, lang, piece from (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece
    from documents)
), tokens as (
  select p, lang, unnest(w) as a, unnest(generate_series(1, len(w))) as i
  from (select p, lang, [x for x in regexp_split_to_array(piece, '[ \\t]+') if x <> ''] as w from pieces)
), runs as (
  select lang, a, lead(a, 1) over s as b, lead(a, 2) over s as c, lead(a, 3) over s as d
  from tokens window s as (partition by p order by i)
), grams as (
  select lang, 1 as k, a as phrase, count(*) as f from runs group by all having count(*) >= {MIN_COUNT}
  union all select lang, 2, a || ' ' || b, count(*) as f from runs where b is not null group by all having count(*) >= {MIN_COUNT}
  union all select lang, 3, a || ' ' || b || ' ' || c, count(*) as f from runs where c is not null group by all having count(*) >= {MIN_COUNT}
  union all select lang, 4, a || ' ' || b || ' ' || c || ' ' || d, count(*) as f from runs where d is not null group by all having count(*) >= {MIN_COUNT}
), totals as (
  select lang, count(*) as n from tokens group by lang
), phrases as (
  select lang, k, phrase, f as a, string_split(phrase, ' ') as w from grams where k >= 2
), cuts as (
  select p.lang, p.phrase, p.a, c.cut, x.f as l, y.f as r, (cast({SCALE} as hugeint) * p.a) // (x.f + y.f) as score
  from phrases p join (values (1), (2), (3)) as c(cut) on c.cut < p.k
  join grams x on x.lang = p.lang and x.phrase = array_to_string(p.w[1 : c.cut], ' ')
  join grams y on y.lang = p.lang and y.phrase = array_to_string(p.w[c.cut + 1 : p.k], ' ')
), lowest as (
  select * from (select *, row_number() over (partition by lang, phrase order by score, cut) as o from cuts) where o = 1
), parts as (
  select p.lang, array_to_string(p.w[s.i : s.i + s.size - 1], ' ') as phrase, max(p.a) as most
  from phrases p join (values (1, 2), (2, 2), (3, 2), (1, 3), (2, 3)) as s(i, size) on s.size < p.k and s.i + s.size - 1 <= p.k
  group by all
), ranked as (
  select lowest.*, row_number() over (partition by lowest.lang order by score desc, a desc, lowest.phrase) as rank
  from lowest left join parts on parts.lang = lowest.lang and parts.phrase = lowest.phrase
  where most is null or 100 * cast(most as hugeint) < {INSIDE_PERCENT} * cast(a as hugeint)
)
select ranked.lang, cast(rank as bigint) as rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r,
       cast(n as bigint) as n, cast(score as bigint) as score
from ranked join totals on totals.lang = ranked.lang where rank <= {TOP}
"""
