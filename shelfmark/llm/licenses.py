"""License scans by template markup (operator 7).

A template is the wording of a license with two kinds of marked regions: ``[[words]]`` may be left out and
``{{n}}`` stands for any one to ``n`` words (a name, a year, an address). A template is compiled into an automaton over
words; a text carries the license when the automaton accepts a run of its words, that is when all mandatory words
stand there exactly and in order. Automata start at the anchor, the longest word of the leading mandatory run,
so only texts that hold an anchor are walked.

``license_texts`` holds templates of two kinds. Whole texts and file headers give ``text_labels``: the opening of a license
followed by other conditions is none. One-sentence notices ("licensed under the ...") give ``notice_labels``, unless one of the three
words before denies it; naming a license without placing a work under it is no notice. ``labels`` joins both with the base labels.

Words are runs of letters a-z (A-Z folded), digits and all characters beyond ASCII. Null text counts as empty:
zero words, no places, no labels, score 0. Repeated rows are judged each. ``score`` is the best share of a
template's mandatory words matched in order from its start (a denied notice counts nothing), 1 where a template is accepted or a base phrase stands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import DENIALS, NOTICES, TEXTS
from .tables import per_slice, table

# The phrases of the base count.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
_TO_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_MARKUP = re.compile(r"\[\[(.*?)\]\]|\{\{(\d+)\}\}|((?:(?!\[\[|\{\{).)+)", re.DOTALL)
_DENIED = frozenset(w.encode() for w in DENIALS)
DENIAL_REACH = 3


def word_list(text: str | bytes | None) -> list[bytes]:
    return (text.encode() if isinstance(text, str) else text or b"").translate(_TO_WORDS).split()


class Automaton(NamedTuple):
    """State i waits for ``words[i]`` (None: any word); ``skips[i]`` are states reached from i without a word."""

    label: str
    words: tuple
    skips: tuple
    mandatory: tuple  # mandatory words passed before each state
    anchor: bytes
    anchor_at: int


def compile_template(label: str, markup: str) -> Automaton:
    words: list[bytes | None] = []
    skips: list[list[int]] = []
    passed: list[int] = []
    lead: list[bytes] = []  # the mandatory run the template starts with
    leading, must = True, 0

    def state(word: bytes | None) -> None:
        words.append(word)
        skips.append([])
        passed.append(must)

    for optional, gap, fixed in _MARKUP.findall(markup):
        first = len(words)
        if fixed:
            for word in word_list(fixed):
                state(word)
                must += 1
                if leading:
                    lead.append(word)
            continue
        leading = False
        if optional:
            for word in word_list(optional):
                state(word)
            skips[first].append(len(words))
        else:
            for i in range(int(gap)):
                state(None)
                if i:  # the first word of a gap is needed, the others may be missing
                    skips[-1].append(first + int(gap))
    anchor = max(lead, key=len)
    return Automaton(label, tuple(words), tuple(map(tuple, skips)), (*passed, must), anchor, lead.index(anchor))


def walk(machine: Automaton, words: Sequence[bytes], at: int) -> tuple[bool, float]:
    """Whether the automaton accepts a run of words that starts at ``at``, and the mandatory share it reached."""
    end = len(machine.words)

    def closed(states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            s = todo.pop()
            for t in machine.skips[s] if s < end else ():
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    states, reached = closed({0}), 0
    while states and end not in states and at < len(words):
        word = words[at]
        states = closed({s + 1 for s in states if s < end and machine.words[s] in (None, word)})
        reached = max([reached, *(machine.mandatory[s] for s in states)])
        at += 1
    return end in states, reached / machine.mandatory[-1]


def places(words: Sequence[bytes], phrase: Sequence[bytes], anchor: int) -> Iterator[int]:
    """Starts of a phrase, found by its word number ``anchor``."""
    at = anchor - 1
    while True:
        try:
            at = words.index(phrase[anchor], at + 1)
        except ValueError:
            return
        if words[at - anchor : at - anchor + len(phrase)] == phrase:
            yield at - anchor


def license_rows(
    docs: DataFrame, texts: Sequence[tuple[str, str]] = TEXTS, notices: Sequence[tuple[str, str]] = NOTICES
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, text_labels, notice_labels of every document."""

    kinds = (
        "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "text_labels string, notice_labels string"
    )
    names = [kind.split()[0] for kind in kinds.split(", ")]

    def work():
        machines = [(compile_template(*t), False) for t in texts] + [(compile_template(*t), True) for t in notices]
        base = [(p.encode().split(), label) for p, label in BASE_PHRASES.items()]
        base = [(p, label, p.index(max(p, key=len)) if b"nc" not in p else p.index(b"nc")) for p, label in base]
        anchors = {m.anchor for m, _ in machines} | {p[k] for p, _, k in base}

        def one(batch: pa.RecordBatch) -> dict:
            rows = []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                flat = (text or b"").translate(_TO_WORDS)
                words = flat.split()
                starts, based, score = [], set(), 0.0
                named: tuple[set, set] = (set(), set())
                held = {a for a in anchors if a in flat}
                if held:
                    for phrase, label, k in base:
                        if phrase[k] in held and (here := list(places(words, phrase, k))):
                            starts += here
                            based.add(label)
                            score = 1.0
                    for m, notice in machines:
                        if m.anchor not in held:
                            continue
                        for at in places(words, [m.anchor], 0):
                            at -= m.anchor_at
                            if at < 0 or notice and not _DENIED.isdisjoint(words[max(0, at - DENIAL_REACH) : at]):
                                continue
                            taken, share = walk(m, words, at)
                            score = max(score, share)
                            if taken:
                                named[notice].add(m.label)
                groups = (based, based | named[0] | named[1], *named)
                of_base, of_all, of_texts, of_notices = (",".join(sorted(g)) for g in groups)
                rows.append(
                    (
                        len(words), len(starts), min(starts, default=None), max(starts, default=None),
                        of_base, of_all, score, of_texts, of_notices,
                    )
                )
            columns = zip(*rows) if rows else [()] * len(names)
            return {"doc_id": batch.column("doc_id")} | dict(zip(names, map(list, columns)))

        return one

    return per_slice(docs.select(F.col("doc_id").cast("long"), "text"), work, f"doc_id long, {kinds}")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rows(table(spark, sf_dir, "documents"))
