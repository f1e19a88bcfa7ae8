"""Joins, top-n and numbering that hold when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import keep

class SortKey(NamedTuple):
    """A sort expression and its direction, as ``number_rows`` takes it."""

    value: Column
    direction: str = "asc_nulls_first"

    def on(self, column: Column) -> Column:
        return getattr(column, self.direction)()


# A key is split once it has more rows than one task should take.
ROWS_PER_TASK = "shelfmark.rowsPerTask"
DEFAULT_ROWS_PER_TASK = 500_000
# Only the largest keys are ever split: any other key has at most 1/1024 of all rows.
MAX_HOT_KEYS = 1024
# Rows of a key at the limit that are counted on average where a share of all rows is.
COUNTED_OF_HOT = 4096


def rows_per_task(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(ROWS_PER_TASK, str(DEFAULT_ROWS_PER_TASK)))


def hot_keys(counts: DataFrame, keys: Sequence[str], n: str, limit: int) -> DataFrame:
    """The at most ``MAX_HOT_KEYS`` keys above ``limit`` rows, with the number of parts they need."""
    return (
        counts.where(F.col(n) > limit)
        .orderBy(F.col(n).desc(), *keys)
        .limit(MAX_HOT_KEYS)
        .select(*keys, F.ceil(F.col(n) / limit).cast("int").alias("_parts"))
    )


def spread_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    counts: DataFrame | None = None,
    n: str = "n",
    part_by: Sequence[str] | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Equi join whose hot keys are spread over several tasks.

    ``counts`` holds rows of ``big`` per key (``keys`` + ``n``); without it they are counted, which
    combines on the map side. Rows of a hot key in ``big`` get a part number from ``part_by``
    (default: the whole row); the matching rows of ``small`` are repeated once per part. Every other
    key keeps a single part, so nothing else grows. ``how`` may be inner, left, left_semi or left_anti.
    The list of hot keys is at most ``MAX_HOT_KEYS`` rows, hence the broadcast. When ``big`` is known to
    have no more than ``rows`` rows and they fit one task, no key can be hot and a plain join is made.
    """
    keys = list(keys)
    if rows is not None and rows <= rows_per_task(big):
        return big.join(small, keys, how)
    if counts is None:
        counts = big.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    hot = F.broadcast(hot_keys(counts, keys, n, rows_per_task(big)))
    part_cols = [F.col(c) for c in (part_by or big.columns)]
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    row = F.xxhash64(*part_cols)
    keyless = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])  # never matches: any part will do
    part = (
        F.when(parts > 1, F.pmod(row, parts)).when(keyless, F.pmod(row, F.lit(MAX_HOT_KEYS))).otherwise(0).cast("int")
    )
    left = (
        big.join(hot, keys, "left")
        .withColumn("_part", part)
        .drop("_parts")
    )
    right = (
        small.join(hot, keys, "left")
        .withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
        .drop("_parts")
    )
    return left.join(right, [*keys, "_part"], how).drop("_part")


def top_n(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, rank: str | None = None
) -> DataFrame:
    """First ``n`` rows per key. The rank filter lets Spark cut every map task's rows to ``n`` per key
    before the shuffle (WindowGroupLimit), so a hot key sends little and is never gathered whole."""
    name = rank or "_rank"
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def line_up(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column | SortKey]) -> DataFrame:
    """Rows range-partitioned and sorted by key and order, with ``_num_at`` (rising) and ``_num_task`` (the task a row lies in).

    A hot key spans many tasks, whose rows follow each other. ``order`` must be total. The table is written: places must not change
    when a task is repeated.
    """
    marks = [f"_num_o{i}" for i in range(len(order))]
    lined = df
    sort_cols = [F.col(k) for k in keys]
    for mark, o in zip(marks, order):
        key = o if isinstance(o, SortKey) else SortKey(F.col(o) if isinstance(o, str) else o)
        lined = lined.withColumn(mark, key.value)
        sort_cols.append(key.on(F.col(mark)))
    lined = (
        lined.repartitionByRange(*sort_cols)
        .sortWithinPartitions(*sort_cols)
        .withColumn("_num_at", F.monotonically_increasing_id())
        .drop(*marks)
    )
    return keep(lined, "numbered").withColumn("_num_task", F.shiftright("_num_at", 33))


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column | SortKey],
    position: str = "position",
    total: str | None = None,
) -> DataFrame:
    """Number rows 1..n inside each key (or over the table when ``keys`` is empty). ``order`` must be total.

    A plain window pulls a whole key into one task, which holds for all but hot keys. The table is written once, and of its
    keys a small share of rows is counted to find the hot ones; their rows are lined up over tasks (``_number_lined``). Which way
    a key goes does not change its numbers. Rows equal in ``order`` keep the order they came in.
    """
    keys = list(keys)
    if not keys:
        return _number_lined(df, keys, order, position, total)
    rows = keep(df.withColumn("_num_in", F.monotonically_increasing_id()), "to-number")
    order = [*order, "_num_in"]
    limit = rows_per_task(df)
    share = min(1.0, COUNTED_OF_HOT / limit)
    counts = rows.select(*keys).sample(share).groupBy(*keys).agg(F.count(F.lit(1)).alias("_num_n"))
    found = hot_keys(counts, keys, "_num_n", max(1, int(limit * share))).drop("_parts").collect()  # at most MAX_HOT_KEYS
    if not found:
        return _number_windowed(rows, keys, order, position, total).drop("_num_in")
    names = [f"_hot_{k}" for k in keys]
    hot = F.broadcast(df.sparkSession.createDataFrame(found, rows.select(*keys).schema).toDF(*names))
    on = [rows[k].eqNullSafe(hot[h]) for k, h in zip(keys, names)]
    few = _number_windowed(rows.join(hot, on, "left_anti"), keys, order, position, total)
    return few.unionByName(_number_lined(rows.join(hot, on, "left_semi"), keys, order, position, total)).drop("_num_in")


def _number_windowed(df: DataFrame, keys: list[str], order: Sequence[str | Column | SortKey], position: str, total: str | None) -> DataFrame:
    by_key = Window.partitionBy(*keys)
    sorts = [o if isinstance(o, SortKey) else SortKey(F.col(o) if isinstance(o, str) else o) for o in order]
    place = F.row_number().over(by_key.orderBy(*[k.on(k.value) for k in sorts])).cast("long")
    if total:
        df = df.withColumn(total, F.count(F.lit(1)).over(by_key))
    return df.withColumn(position, place)


def _number_lined(df: DataFrame, keys: list[str], order: Sequence[str | Column | SortKey], position: str, total: str | None) -> DataFrame:
    """Rows are lined up over tasks, and a table with one row per (key, task) supplies the offsets."""
    lined = line_up(df, keys, order)
    runs = lined.groupBy(*keys, "_num_task").agg(F.min("_num_at").alias("_num_first"), F.count(F.lit(1)).alias("_num_n"))
    by_key = Window.partitionBy(*keys)  # one row per task and key, never per input row
    before = by_key.orderBy("_num_task").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_num_before", F.coalesce(F.sum("_num_n").over(before), F.lit(0)))
    if total:
        runs = runs.withColumn(total, F.sum("_num_n").over(by_key))
    on = [lined[c].eqNullSafe(runs[c]) for c in [*keys, "_num_task"]]
    joined = lined.join(runs, on, "inner").drop(*[runs[c] for c in [*keys, "_num_task"]])
    return joined.withColumn(position, F.col("_num_at") - F.col("_num_first") + F.col("_num_before") + 1).drop(
        "_num_at", "_num_task", "_num_first", "_num_n", "_num_before"
    )


def carry_last(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column | SortKey], value: Column, name: str, inclusive: bool = False
) -> DataFrame:
    """Adds the last non-null ``value`` before each row (or up to it) within its key.

    A scan in two passes over lined-up rows: inside a task a window finds the value; rows before the first value of
    their task take the one carried over its boundary, from a table with one row per key and task. One key may hold all rows. Null keys are a key.
    """
    keys = list(keys)
    lined = line_up(df.withColumn("_value", value), keys, order)
    spot = F.when(F.col("_value").isNotNull(), F.col("_num_at"))
    ends = lined.groupBy(*keys, "_num_task").agg(F.max_by("_value", spot).alias("_end"))
    past = Window.partitionBy(*keys).orderBy("_num_task").rowsBetween(Window.unboundedPreceding, -1)  # a row per task and key
    carried = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(past)).where("_carry is not null")
    carried = carried.select("_carry", *[F.col(c).alias(f"_of_{c}") for c in [*keys, "_num_task"]])
    here = Window.partitionBy(*keys, "_num_task").orderBy("_num_at").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    seen = lined.withColumn("_here", F.last("_value", ignorenulls=True).over(here))
    on = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*keys, "_num_task"]]
    return (
        seen.join(carried, on, "left")
        .withColumn(name, F.coalesce("_here", "_carry"))
        .drop("_value", "_here", "_carry", "_num_at", "_num_task", *[f"_of_{c}" for c in [*keys, "_num_task"]])
    )
