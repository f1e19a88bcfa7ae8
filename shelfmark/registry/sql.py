"""SQL text pieces for the equivalent queries (DuckDB dialect)."""

from __future__ import annotations

from ..functions import fixed_values as fv

NOISE = fv.UPLOAD_NOISE
MARKERS = fv.VARIANT_MARKERS
LIVE = fv.LIVE_TITLE


def clean(e: str) -> str:
    x = f"regexp_replace({e}, '{NOISE}', '', 'g')"
    x = rf"regexp_replace({x}, '\s*[|｜]\s*.*$', '')"
    x = rf"regexp_replace({x}, '\s{{2,}}', ' ', 'g')"
    return rf"trim(regexp_replace({x}, '\s+([)\]])', '\1', 'g'))"


def norm(e: str) -> str:
    x = f"lower(strip_accents(coalesce({e}, '')))"
    x = rf"regexp_replace({x}, '\((?:feat|ft|with)\.?[^)]*\)|\[(?:feat|ft|with)\.?[^\]]*\]', '', 'g')"
    x = rf"regexp_replace({x}, '\s(?:feat|ft)\.?\s.*$', '')"
    return rf"trim(regexp_replace(replace({x}, '&', ' and '), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def words(normed: str) -> str:
    return f"list_distinct(list_filter(string_split({normed}, ' '), lambda x: x <> ''))"


def dice(a: str, b: str) -> str:
    return (
        f"(case when len({a}) = 0 or len({b}) = 0 then 0e0 "
        f"else 2e0 * len(list_intersect({a}, {b})) / (len({a}) + len({b})) end)"
    )


def coverage(needle: str, hay: str) -> str:
    return f"(case when len({needle}) = 0 then 0e0 else 1e0 * len(list_intersect({needle}, {hay})) / len({needle}) end)"


def primary(e: str) -> str:
    return norm(rf"regexp_replace(coalesce({e}, ''), '(?is)\s*(?:,|;|/|&|\sx\s|\sand\s|\b(?:feat|ft)\b\.?).*', '')")


def key_title(e: str) -> str:
    drops = r"\b(?:remaster(?:ed)?|\d{4} remaster(?:ed)?|mono|stereo|radio edit|single version|album version)\b"
    x = f"regexp_replace({norm(clean(f'coalesce({e}, {chr(39) * 2})'))}, '{drops}', '', 'g')"
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def match_key(artist: str, title: str) -> str:
    p, k = primary(artist), key_title(title)
    return f"(case when {p} <> '' and {k} <> '' then {p} || '|' || {k} end)"


def markers(cand: str, target: str) -> str:
    """Version markers in the normalised candidate that the normalised target lacks."""
    names = ", ".join(f"'{m}'" for m in MARKERS)
    return (
        f"len(list_filter([{names}], lambda m: contains(' ' || {cand} || ' ', ' ' || m || ' ') "
        f"and not contains(' ' || {target} || ' ', ' ' || m || ' ')))"
    )


def split_title(raw: str, channel: str) -> tuple[str, str]:
    """(artist, title) of an upload title."""
    t, ch = clean(raw), f"coalesce({channel}, '')"
    up = f"trim(regexp_replace({ch}, '(?i)VEVO$', ''))"
    dash = r"^(.+?)\s+[-–—]\s+(.+)$"
    left, right = f"trim(regexp_extract({t}, '{dash}', 1))", f"trim(regexp_extract({t}, '{dash}', 2))"
    who = norm(up)
    swap = f"({who} <> '' and {norm(right)} = {who} and {norm(left)} <> {who})"
    song = rf"""regexp_replace(case when {swap} then {left} else {right} end, '^["“](.*)["”]$', '\1')"""
    topic, dashed = f"regexp_matches({ch}, '^.* - Topic$')", f"regexp_matches({t}, '{dash}')"
    artist = (
        f"case when {topic} then regexp_extract({ch}, '^(.*) - Topic$', 1) "
        f"when {dashed} then case when {swap} then {right} else {left} end "
        f"when {up} <> '' then {up} else 'Unknown Artist' end"
    )
    return artist, f"case when {topic} then {t} when {dashed} then {song} else {t} end"


def natural(e: str) -> str:
    """Digit runs become their length without leading zeros, then their digits; a null stays null."""
    bare = r"regexp_replace(p, '^0+(\d)', '\1')"
    number = f"lpad(cast(length({bare}) as varchar), 9, '0') || {bare}"
    pieces = rf"regexp_extract_all(lower(strip_accents({e})), '\d+|\D+')"
    return rf"case when {e} is not null then array_to_string([case when regexp_matches(p, '^\d') then {number} else p end for p in {pieces}], '') end"


def truthy(e: str) -> str:
    text = f"cast({e} as varchar)"
    return f"coalesce(case typeof({e}) when 'VARCHAR' then {text} <> '' else {text} not in ('0', '0.0', 'false') end, false)"


def with_(ctes: dict[str, str], select: str, recursive: bool = False) -> str:
    head = "with recursive " if recursive else "with "
    return head + ",\n".join(f"{k} as ({v})" for k, v in ctes.items()) + "\n" + select
