"""Numeric columns shared by scoring and series operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


MAX_INT = 2147483647


def half_up(c: Column) -> Column:
    """Round .5 toward +infinity."""
    return F.floor(c + 0.5)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def positive_int(c: Column) -> Column:
    """Whole number above zero, else null."""
    n = c.try_cast("double")
    return F.when((n > 0) & (n < MAX_INT), half_up(n).cast("int"))  # NaN and infinity are not below the limit


def truthy(c: Column) -> Column:
    """Present and, by its type, no empty text, no zero and not false. Null is absent; the text "0" is present."""
    shown = c.cast("string")
    number = shown.try_cast("double")
    empty = F.when(F.typeof(c) == "string", shown == "").otherwise(
        F.coalesce((number == 0) | F.isnan(number), F.lit(False)) | (shown == "false")
    )
    return F.coalesce(~empty, F.lit(False))


def first_truthy(*cols: Column) -> Column:
    return F.coalesce(*[F.when(truthy(c), c) for c in cols])


def duration_gap_sec(target_ms: Column, cand_sec: Column) -> Column:
    """Seconds between two lengths; null when either is missing or 0."""
    return F.when((target_ms > 0) & (cand_sec > 0), F.abs(target_ms / 1000.0 - cand_sec))


def duration_score(gap_sec: Column) -> Column:
    """1 up to 2 s apart, falling linearly to 0 at 30 s; null without a gap."""
    return (
        F.when(gap_sec <= 2, F.lit(1.0))
        .when(gap_sec >= 30, F.lit(0.0))
        .otherwise(1.0 - (gap_sec - 2.0) / 28.0)
    )


def unpack_frames(c: Column) -> Column:
    """Base64 of little-endian unsigned 32-bit values -> array<bigint>."""
    raw = F.unbase64(c)
    count = F.floor(F.octet_length(raw) / 4).cast("int")
    at = F.sequence(F.lit(0), count - 1)
    return F.when(
        count > 0,
        F.transform(
            at, lambda i: F.conv(F.hex(F.reverse(F.substr(raw, i * 4 + 1, F.lit(4)))), 16, 10).cast("bigint")
        ),
    ).otherwise(F.array().cast("array<bigint>"))
