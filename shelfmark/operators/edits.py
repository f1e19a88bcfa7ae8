"""Bulk text edits, filename parsing, path planning and applying staged changes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import text as T
from ..functions.numbers import MAX_INT
from ..plans.skew import spread_join
from ..plans.templates import compile_filename_pattern, path_column
from .ordering import resolve_path_collisions


def literal(text: str) -> str:
    """Replacement text without any special meaning."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def java_replacement(text: str, groups: int) -> str:
    """A replacement where only ``$&`` (the match), ``$n`` (an existing group) and ``$$`` (a dollar) are special."""

    def piece(m: re.Match) -> str:
        token = m[0]
        if token == "$$":
            return "\\$"
        if token == "$&":
            return "$0"
        digits = token[1:]
        for n in (digits[:2], digits[:1]):
            if n and 0 < int(n) <= groups:
                return f"${int(n)}" + digits[len(n) :]
        return literal(token)

    return "".join(piece(m) if m[0][0] == "$" and len(m[0]) > 1 else literal(m[0]) for m in re.finditer(r"\$\$|\$&|\$\d{1,2}|.", text, re.S))


def replace_text(c: Column, find: str, replacement: str, regex: bool = False, case_sensitive: bool = True) -> Column:
    """Literal or regex replacement. A literal replacement never refers to groups."""
    if not find:
        return c
    pattern = find if regex else re.escape(find)
    target = java_replacement(replacement, re.compile(pattern).groups) if regex else literal(replacement)
    return F.regexp_replace(c, pattern if case_sensitive else f"(?i){pattern}", target)


def edit_column(c: Column, spec: dict) -> Column:
    """``spec['kind']`` is replace, case or trim."""
    if spec["kind"] == "replace":
        return replace_text(c, spec["find"], spec["replace"], spec.get("regex", False), spec.get("case_sensitive", True))
    if spec["kind"] == "case":
        return T.change_case(c, spec["mode"])
    if spec["kind"] == "trim":
        return F.trim(F.regexp_replace(c, r"\s+", " "))
    raise ValueError(f"unknown edit {spec['kind']!r}")


def bulk_transform(df: DataFrame, cols: list[str], spec: dict) -> DataFrame:
    """(id, field, before, after) for the cells an edit changes."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cells = F.array(
        *[F.struct(F.lit(c).alias("field"), text(c).alias("before"), edit_column(text(c), spec).alias("after")) for c in cols]
    )
    return (
        df.select("id", F.explode(cells).alias("c"))
        .select("id", "c.field", "c.before", "c.after")
        .where(F.col("before") != F.col("after"))
    )


def file_stem(path: Column, use_folder: bool) -> Column:
    """File name without extension; with ``use_folder`` the last three segments joined by ' - '."""
    parts = F.split(F.regexp_replace(path, r"\.[^.]+\z", ""), "/")
    if use_folder:
        return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), F.lit(3)), " - ")
    return F.element_at(parts, -1)


def parse_filenames(df: DataFrame, pattern: str, use_folder: bool = False, path: str = "rel_path") -> DataFrame:
    """Adds ``parsed`` (does the name fit) and a ``p_`` column per field of the pattern."""
    regex, groups = compile_filename_pattern(pattern)
    name = df.withColumn("_name", file_stem(F.col(path), use_folder))
    fits = F.col("_name").rlike(regex)
    fields = {f"p_{c}": F.when(fits, F.trim(F.regexp_extract("_name", regex, g))) for c, g in groups}
    return name.withColumns({"parsed": fits, **fields}).drop("_name")


def template_fields() -> dict[str, Column]:
    return {
        "title": F.col("title"), "artist": F.col("artist"),
        "albumartist": F.coalesce("album_artist", "artist"), "album": F.col("album"), "year": F.col("year"),
        "track": F.col("track_number"), "disc": F.col("disc_number"), "genre": F.col("genre"),
    }


def render_paths(df: DataFrame, template: str = fv.DEFAULT_PATH_TEMPLATE, fields: dict[str, Column] | None = None) -> DataFrame:
    return df.withColumn("rendered", path_column(template, fields or template_fields()))


def plan_reorganize(lib: DataFrame, template: str = fv.DEFAULT_PATH_TEMPLATE, beside: DataFrame | None = None) -> DataFrame:
    """(id, from_path, to_path, changed): target paths from a template, collisions resolved. A change
    of case only leaves the file where it is. ``beside``: the whole catalog where ``lib`` is a part of it."""
    rendered = render_paths(lib, template).withColumn("_to", F.concat("rendered", F.lit("."), "format"))
    plan = rendered.select(
        "id", F.col("rel_path").alias("from_path"), F.col("_to").alias("to_path"),
        (F.lower("_to") != F.lower("rel_path")).alias("changed"),
    )
    return resolve_path_collisions(plan, (lib if beside is None else beside).select(F.col("rel_path").alias("path")))


def _coerced(field: str, raw: Column, original: Column) -> Column:
    """Staged text as the field stores it; an invalid number falls back to the original."""
    if field not in fv.NUMERIC_COLUMNS:
        return raw
    number = F.trim(raw).try_cast("double")
    return (
        F.when(F.trim(F.coalesce(raw, F.lit(""))) == "", F.lit(None).cast("string"))
        .when((number > 0) & (number < MAX_INT), F.floor(number + 0.5).cast("bigint").cast("string"))
        .otherwise(original.cast("string"))
    )


def overlay_edits(base: DataFrame, edits: DataFrame, fields: list[str]) -> DataFrame:
    """Staged values over base values. ``edits``: id, patch map<string,string> (absent = leave, null =
    clear). Adds ``v_`` columns and ``dirty`` (names of fields that really differ)."""
    joined = spread_join(base, edits.select("id", "patch"), ["id"], "left")
    values, dirty = {}, []
    for f in fields:
        own = F.col(f).cast("string")
        staged = _coerced(f, F.try_element_at("patch", F.lit(f)), F.col(f))
        has = F.coalesce(F.map_contains_key("patch", f), F.lit(False))
        differs = has & (F.coalesce(staged, F.lit("")) != F.coalesce(own, F.lit("")))
        values[f"v_{f}"] = F.when(differs, staged).otherwise(own)
        dirty.append(F.when(differs, f))
    return joined.withColumns({**values, "dirty": F.array_join(F.array_compact(F.array(*dirty)), ",")}).drop("patch")


def _no_number(raw: Column) -> Column:
    """True for not-a-number and for numbers that no field can hold; text that is no number clears the field instead."""
    n = F.trim(raw).try_cast("double")
    return F.coalesce(F.isnan(n) | (F.abs(n) >= MAX_INT), F.lit(False))


def apply_edits(
    lib: DataFrame, edits: DataFrame, images: DataFrame | None = None, template: str | None = None
) -> dict[str, DataFrame]:
    """Apply patches (absent = leave, null or '' = clear, value = set) to the catalog.

    Patches hold tags, ``lyrics``, recording, release and artist ids (taken as they are) and ``artwork_url``. ``images`` (url, ok) says which
    artwork could be fetched, each address once. Returns the new library, one retag log row per edited file, and errors: edits whose file is
    unknown or whose artwork could not be fetched (neither is applied) and numbers that no field can hold (such a field keeps its value). With a
    path ``template``, ``moves`` is the re-filing plan of the edited files.
    """
    url = F.try_element_at("patch", F.lit("artwork_url"))
    asked = edits.select("id", "patch", T.blank_to_null(url).alias("_url"))
    found = lib.select("id", "rel_path")
    if images is None:
        fetched = asked.withColumn("_ok", F.col("_url").isNull())
    else:
        have = images.where("ok").select(F.col("url").alias("_url")).distinct().withColumn("_have", F.lit(True))
        fetched = spread_join(asked, have, ["_url"], "left", part_by=["id"]).withColumn("_ok", F.col("_url").isNull() | F.coalesce("_have", F.lit(False)))
    good = fetched.where("_ok").select("id", "patch", "_url")
    joined = lib.join(good, "id", "left")
    known = [c for c in (*fv.EDITABLE_COLUMNS, *fv.VERBATIM_COLUMNS) if c in lib.columns]
    out = {}
    for c in known:
        raw = F.try_element_at("patch", F.lit(c))
        if c in fv.NUMERIC_COLUMNS:
            n = F.trim(raw).try_cast("double")
            bad = _no_number(raw)
            value = F.when(bad, F.col(c)).otherwise(F.when((n > 0) & ~bad, F.floor(n + 0.5)).try_cast(lib.schema[c].dataType))
        elif c in fv.VERBATIM_COLUMNS:
            value = F.when(raw != "", raw)
        elif c in ("artist", "genre"):
            joiner = ", " if c == "artist" else "; "
            parts = F.filter(F.split(F.trim(raw), r"\s*;\s*"), lambda x: x != "")
            value = T.blank_to_null(F.array_join(parts, joiner))
        else:
            value = T.blank_to_null(F.trim(raw))
        has = F.coalesce(F.map_contains_key("patch", c), F.lit(False))
        out[c] = F.when(has, value).otherwise(F.col(c))
    if "has_artwork" in lib.columns:
        out["has_artwork"] = F.col("has_artwork") | F.col("_url").isNotNull()
    if "has_lyrics" in lib.columns:
        sung = F.coalesce(F.trim(F.try_element_at("patch", F.lit("lyrics"))) != "", F.lit(False))
        out["has_lyrics"] = F.when(F.map_contains_key("patch", "lyrics"), sung).otherwise(F.col("has_lyrics"))
    library = joined.withColumns(out).select(lib.columns)
    touched = good.join(found, "id")
    log = touched.select(
        F.lit("retag").alias("kind"), F.col("rel_path").alias("from_path"), F.col("rel_path").alias("to_path"),
        F.col("patch").alias("detail"), "id",
    )
    unknown = edits.join(found.select("id"), "id", "left_anti").select("id", F.lit("file not found").alias("error"))
    unfetched = fetched.where("not _ok").join(found.select("id"), "id", "left_semi").select("id", F.lit(fv.NO_ARTWORK).alias("error"))
    numbers = [c for c in known if c in fv.NUMERIC_COLUMNS]
    wrong = F.array_compact(
        F.array(*[F.when(_no_number(F.try_element_at("patch", F.lit(c))), F.lit(f"{c} is no number")) for c in numbers], F.lit(None).cast("string"))
    )
    odd = touched.select("id", F.explode(wrong).alias("error"))
    result = {"library": library, "log": log, "errors": unknown.unionByName(unfetched).unionByName(odd)}
    if template is not None:
        saved = library.join(touched.select("id").distinct(), "id", "left_semi")
        result["moves"] = plan_reorganize(saved, template, library)
    return result
