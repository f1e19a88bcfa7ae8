"""Text columns: every helper takes and returns Spark ``Column`` objects and stays on the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv

MARKS = r"[̀-ͯ]"


def let(fn: Callable[..., Column], *cols: Column) -> Column:
    """``fn`` of columns that are evaluated once each, however often ``fn`` refers to them.

    A column used several times in an expression is repeated in the plan; filters evaluate every copy.
    Binding it as the element of a one-element array keeps the plan small and the work single.
    """
    bound = F.array(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cols)]))
    return F.transform(bound, lambda s: fn(*[s[f"c{i}"] for i in range(len(cols))]))[0]


@lru_cache(maxsize=1)
def _compat_tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """One-to-one folds for ``translate`` and the short list of expansions, from the Unicode rule.

    A character is folded to its compatibility decomposition without combining marks, in all planes. Hangul
    syllables are left alone: they decompose one by one, so equality does not change.
    """
    src, dst, longer = [], [], []
    for cp in (*range(0xA0, 0xAC00), *range(0xF900, 0x30000)):
        ch = chr(cp)
        if 0x300 <= cp <= 0x36F:
            continue
        plain = "".join(c for c in unicodedata.normalize("NFKD", ch) if not "̀" <= c <= "ͯ")
        if plain == ch or not plain:
            continue
        if len(plain) == 1:
            src.append(ch)
            dst.append(plain)
        else:
            longer.append((ch, plain))
    return "".join(src), "".join(dst), tuple(longer)


def _ranges(points: list[int]) -> str:
    """Character class of few ranges that holds the points, and beyond the Latin blocks what lies closely between them."""
    runs: list[list[int]] = []
    for p in sorted(points):
        if runs and p - runs[-1][1] <= (64 if p > 0x2000 else 1):
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]"


def holds(c: Column, *marks: str) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(m) for m in marks])


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def fold(c: Column) -> Column:
    """Accent-free text. ASCII rows skip the translation altogether."""
    src, dst, longer = _compat_tables()
    wide = F.regexp_replace(F.translate(c, src, dst), MARKS, "")
    # characters that become several are looked up one by one, in the few rows that hold one
    expanding = _ranges([ord(ch) for ch, _ in longer])
    spelled = F.str_to_map(F.lit("\x01".join(f"{ch}\x02{plain}" for ch, plain in longer)), F.lit("\x01"), F.lit("\x02"))
    letters = F.regexp_extract_all(wide, F.lit("(?s)."), F.lit(0))
    expanded = F.array_join(F.transform(letters, lambda ch: F.when(ch.rlike(expanding), F.coalesce(F.try_element_at(spelled, ch), ch)).otherwise(ch)), "")
    return (
        F.when(is_ascii(c), c)
        .when(c.rlike(expanding), expanded)
        .otherwise(wide)
    )


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def clean_title(c: Column) -> Column:
    """Drop upload decorations, everything after a pipe, and doubled blanks."""

    def decorated(x: Column) -> Column:
        x = F.regexp_replace(x, fv.UPLOAD_NOISE, "")
        x = F.regexp_replace(x, r"\s*[|｜]\s*.*\z", "")
        x = F.regexp_replace(x, r"\s{2,}", " ")
        return F.regexp_replace(x, r"\s+([)\]])", "$1")

    # without brackets and pipes only blanks can change
    cleaned = lambda x: F.when(holds(x, "(", "[", ")", "]", "|", "｜"), decorated(x)).otherwise(F.regexp_replace(x, r"\s{2,}", " "))
    return F.trim(let(cleaned, c))


def normalize(c: Column) -> Column:
    """Comparable form: no accents, case, guest credits or punctuation; null becomes ''."""

    def full(text: Column) -> Column:
        x = F.lower(fold(text))
        x = F.regexp_replace(x, fv.GUEST_CREDIT, "")
        x = F.regexp_replace(x, r"\s(?:feat|ft)\.?\s.*\z", "")
        x = F.replace(x, F.lit("&"), F.lit(" and "))
        return F.regexp_replace(x, r"[^\p{L}\p{N}]+", " ")

    # ASCII text without the letters of a guest credit and without an ampersand only loses its punctuation
    form = lambda x, low: F.when(is_ascii(x) & ~holds(low, "ft", "feat", "with", "&"), F.regexp_replace(low, "[^a-z0-9]+", " ")).otherwise(full(x))
    text = F.coalesce(c, F.lit(""))
    return F.trim(let(form, text, F.lower(text)))


def words_of(norm: Column) -> Column:
    """Distinct words of an already normalised column; '' gives an empty array."""
    return F.array_remove(F.array_distinct(F.split(norm, " ")), "")


def tokens(c: Column) -> Column:
    return words_of(normalize(c))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of two distinct-word arrays, 0 when either side is empty."""


    def share(x: Column, y: Column) -> Column:
        shared = F.size(F.array_intersect(x, y)).cast("double")
        return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(
            2.0 * shared / (F.size(x) + F.size(y))
        )

    return let(share, a, b)


def similarity(a: Column, b: Column) -> Column:
    return dice(tokens(a), tokens(b))


def coverage(needle: Column, hay: Column) -> Column:
    """Share of the needle's words found in the hay array."""
    share = lambda n, h: F.when(F.size(n) == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(n, h)).cast("double") / F.size(n)
    )
    return let(share, needle, hay)


def primary_artist(c: Column) -> Column:
    several = lambda x, low: F.when(holds(low, ",", ";", "/", "&", "x", "and", "feat", "ft"), F.regexp_replace(x, fv.ARTIST_SEPARATOR, "")).otherwise(x)
    text = F.coalesce(c, F.lit(""))
    return normalize(let(several, text, F.lower(text)))


def key_title(title: Column) -> Column:
    x = normalize(clean_title(F.coalesce(title, F.lit(""))))
    x = F.regexp_replace(x, fv.MATCH_KEY_DROPS, "")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def match_key(artist: Column, title: Column) -> Column:
    """``primary artist|bare title``; null when either side is empty."""
    joined = lambda a, t: F.when((a != "") & (t != ""), F.concat(a, F.lit("|"), t))
    return let(joined, primary_artist(artist), key_title(title))


def split_title(raw: Column, channel: Column) -> tuple[Column, Column]:
    """(artist, title) guessed from an upload title and its channel."""
    dash = r"^(.+?)\s+[-–—]\s+(.+)\z"

    def guess(title: Column, ch: Column) -> Column:
        topic = ch.rlike(r"^.* - Topic\z")
        uploader = F.trim(F.regexp_replace(ch, r"(?i)VEVO\z", ""))
        left = F.trim(F.regexp_extract(title, dash, 1))
        right = F.trim(F.regexp_extract(title, dash, 2))
        own_channel = lambda who, a, b: (who != "") & (b == who) & (a != who)
        swap = let(own_channel, normalize(uploader), normalize(left), normalize(right))
        unquoted = lambda c: F.regexp_replace(c, r"^[\"“](.*)[\"”]\z", "$1")
        pair = lambda a, t: F.struct(a.alias("artist"), t.alias("title"))
        return (
            F.when(topic, pair(F.regexp_extract(ch, r"^(.*) - Topic\z", 1), title))
            .when(title.rlike(dash) & swap, pair(right, unquoted(left)))
            .when(title.rlike(dash), pair(left, unquoted(right)))
            .otherwise(pair(F.coalesce(blank_to_null(uploader), F.lit("Unknown Artist")), title))
        )

    found = let(guess, clean_title(raw), F.coalesce(channel, F.lit("")))
    return found["artist"], found["title"]


def plain_title(c: Column) -> Column:
    """Title without guest credits or upload decorations; the original when nothing is left."""
    x = F.regexp_replace(clean_title(c), r"(?i)\s*[(\[]\s*(?:feat|ft|with)\b\.?[^)\]]*[)\]]", "")
    x = F.trim(F.regexp_replace(x, r"(?i)\s+(?:feat|ft)\b\.?\s.*\z", ""))
    return F.coalesce(blank_to_null(x), c)


def base_album(c: Column) -> Column:
    """Album without trailing bracketed editions; null stays null."""
    x = F.trim(F.regexp_replace(c, r"(?:\s*[(\[][^)\]]*[)\]])+\s*\z", ""))
    return F.when(c != "", F.coalesce(blank_to_null(x), c))


def ascii_punctuation(c: Column) -> Column:
    x = F.translate(c, "‐‑‘’′“”″", "--'''\"\"\"")
    return F.replace(x, F.lit("…"), F.lit("..."))


def new_markers(cand_norm: Column, target_norm: Column) -> Column:
    """How many version markers the candidate carries that the target does not."""
    padded = [F.concat(F.lit(" "), x, F.lit(" ")) for x in (cand_norm, target_norm)]

    def count(cand: Column, target: Column) -> Column:
        hits = [(cand.contains(f" {m} ") & ~target.contains(f" {m} ")).cast("int") for m in fv.VARIANT_MARKERS]
        return F.when(~cand.rlike(f" (?:{'|'.join(fv.VARIANT_MARKERS)}) "), 0).otherwise(reduce(lambda a, b: a + b, hits))

    return let(count, *padded)


def markers(norm: Column) -> Column:
    """The version markers that a normalised column holds as whole words, each once."""

    def found(text: Column) -> Column:
        each = F.array_compact(F.array(*[F.when(text.contains(f" {m} "), m) for m in fv.VARIANT_MARKERS]))
        return F.when(text.rlike(f" (?:{'|'.join(fv.VARIANT_MARKERS)}) "), each).otherwise(F.array().cast("array<string>"))

    return let(found, F.concat(F.lit(" "), norm, F.lit(" ")))


def capitalize_first(c: Column) -> Column:
    """Upper-case the first letter, leaving what precedes it."""
    lead = F.regexp_extract(c, r"^(\P{L}*)", 1)
    at = F.length(lead) + 1
    return F.concat(lead, F.upper(F.substr(c, at, F.lit(1))), F.substr(c, at + 1))


CASE_PIECES = r"\s+|[/-]|[)\]]?[^\s()\[\]/-]*[(\[]|[)\]][^\s()\[\]/-]*|[^\s()\[\]/-]+"


def title_case(c: Column) -> Column:
    """Title case: small words low except at the ends, acronyms and Roman numerals kept."""
    pieces = F.regexp_extract_all(c, F.lit(CASE_PIECES), F.lit(0))
    numbered = F.transform(pieces, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    wordy = F.filter(numbered, lambda p: p["w"].rlike(r"\S") & ~p["w"].rlike(r"^[(\[\])/-]$"))
    first, last = wordy[0]["i"], F.element_at(wordy, -1)["i"]

    def cased(p):
        w, low = p["w"], F.lower(p["w"])
        bare = F.regexp_replace(low, r"[.,!?:'\"]+\z", "")
        inside = (p["i"] != first) & (p["i"] != last)
        return (
            F.when(~w.rlike(r"\p{L}"), w)
            .when(w.rlike(fv.ACRONYM), w)
            .when(w.rlike(fv.ROMAN_NUMERAL), F.upper(w))
            .when(inside & bare.isin(*fv.SMALL_WORDS), low)
            .otherwise(capitalize_first(low))
        )

    return F.when(F.size(wordy) == 0, c).otherwise(F.array_join(F.transform(numbered, cased), ""))


def change_case(c: Column, mode: str) -> Column:
    if mode == "upper":
        return F.upper(c)
    if mode == "lower":
        return F.lower(c)
    if mode == "sentence":
        low = F.lower(c)
        return F.when(low.rlike(r"\p{L}"), capitalize_first(low)).otherwise(low)
    if mode == "title":
        return title_case(c)
    raise ValueError(f"unknown case mode {mode!r}")


def numbered_runs(c: Column) -> Column:
    """Digit runs without leading zeros and behind their length, so that text order is number order."""

    def number(p: Column) -> Column:
        bare = F.regexp_replace(p, r"^0+(\d)", "$1")
        return F.concat(F.lpad(F.length(bare).cast("string"), 9, "0"), bare)

    pieces = F.regexp_extract_all(c, F.lit(r"\d+|\D+"), F.lit(0))
    coded = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^\d"), number(p)).otherwise(p)), "")
    return F.when(c.rlike(r"\d"), coded).otherwise(c)


def natural_key(c: Column) -> Column:
    """Binary-sortable text: base letters, digit runs of any length compared as numbers."""
    return numbered_runs(F.lower(fold(c)))


def collated_key(c: Column) -> Column:
    """As ``natural_key`` but ordered by the Unicode root collation, punctuation included."""
    return F.collate(numbered_runs(c), "UNICODE_CI_AI")
