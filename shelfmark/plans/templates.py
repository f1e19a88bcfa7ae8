"""Path templates and filename patterns compiled once into column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.numbers import truthy

PLACEHOLDER = re.compile(r"\{([a-z|: A-Za-z0-9_-]+)\}")


def field_value(expr: str, fields: dict[str, Column]) -> Column:
    """Value of ``{a|b:02}``: first non-empty field, or the literal that is no field; '' otherwise."""
    names, _, pad = expr.partition(":")
    picks: list[Column] = []
    for name in (n.strip() for n in names.split("|")):
        low = name.lower()
        if low in fields:
            text = fields[low].cast("string")
            if pad:
                width = F.greatest(F.length(text), F.lit(len(pad)))
                text = F.when(text.rlike(r"^\d+\z"), F.lpad(text, width, F.lit("0"))).otherwise(text)
            picks.append(F.when(truthy(fields[low]), text))
        elif low not in fv.TEMPLATE_FIELDS or name != low:
            picks.append(F.lit(name))
            break
    return F.coalesce(*picks, F.lit("")) if picks else F.lit("")


def _filled(text: str, fields: dict[str, Column], safe: bool) -> tuple[Column, list[Column]]:
    """Concatenation of a template piece and the values inside it."""
    out, values, at = [], [], 0
    for m in PLACEHOLDER.finditer(text):
        if m.start() > at:
            out.append(F.lit(text[at : m.start()]))
        value = field_value(m.group(1), fields)
        values.append(value)
        out.append(F.regexp_replace(value, r"[/\\]", "_") if safe else value)
        at = m.end()
    if at < len(text):
        out.append(F.lit(text[at:]))
    return (F.concat(*out) if out else F.lit("")), values


def safe_segment(c: Column) -> Column:
    """One path segment fit for any file system; '' becomes '_'."""
    x = F.regexp_replace(c, r"[\x00-\x1f]", "")
    x = F.regexp_replace(x, fv.FORBIDDEN_IN_SEGMENT, "_")
    x = F.regexp_replace(x, r"\s+", " ")
    x = F.regexp_replace(x, r"^[.\s]+|[.\s]+\z", "")
    x = F.substr(x, F.lit(1), F.lit(fv.SEGMENT_LIMIT))
    return F.coalesce(F.when(x != "", x), F.lit("_"))


def path_column(template: str, fields: dict[str, Column]) -> Column:
    """Path for a template: ``[...]`` goes when a field in it is empty, ``/`` separates folders, and
    values can never add a separator."""
    pieces: list[Column] = []
    for n, piece in enumerate(re.split(r"\[([^\]]*)\]", template)):
        if n % 2:
            body, values = _filled(piece, fields, safe=True)
            complete = F.lit(True)
            for v in values:
                complete = complete & (v != "")
            pieces.append(F.when(complete, body).otherwise(F.lit("")))
        else:
            pieces.append(_filled(piece, fields, safe=True)[0])
    whole = F.concat(*pieces)
    segments = F.filter(F.transform(F.split(whole, "/"), lambda s: F.trim(s)), lambda s: s != "")
    return F.array_join(F.transform(segments, safe_segment), "/")


def compile_filename_pattern(pattern: str) -> tuple[str, list[tuple[str, int]]]:
    """Regex for a pattern like ``%track% - %title%`` and (column, group) for each field it fills."""
    out, groups, count = ["(?i)^"], [], 0
    for part in re.split(r"(?i)(%[a-z]+%|\{[a-z]+\})", pattern):
        name = part[1:-1].lower() if re.fullmatch(r"(?i)%[a-z]+%|\{[a-z]+\}", part) else None
        if name is None:
            out.append(re.sub(r"(?:\\?\s)+", lambda _: r"\s*", re.sub(r"[.*+?^${}()|\[\]\\]", r"\\\g<0>", part)))
        elif name in fv.FILENAME_FIELDS:
            count += 1
            column = fv.FILENAME_FIELDS[name]
            out.append(r"(\d+)" if column in fv.NUMERIC_COLUMNS else "(.+?)")
            if column:
                groups.append((column, count))
        else:
            out.append(part)
    return "".join([*out, r"\z"]), groups
