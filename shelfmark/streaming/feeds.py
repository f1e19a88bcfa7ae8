"""Jobs over the change feed. Feed columns: event_id, ts, key, status, speed, removed."""

from __future__ import annotations

import heapq
import itertools
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import fixed_values as fv
from ..plans.durable import discard, keep
from ..plans.skew import SortKey, carry_last, number_rows, spread_join, top_n
from ..plans.versions import key_bucket, time_bucket
from .run import SnapshotTable, latest_by, use_rocksdb

# stream processors travel to the executors by value: the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE_COLUMNS = ["event_id", "ts", "key", "status", "speed", "removed"]


# ---- files -------------------------------------------------------------------------------------


def stream_file_monitor(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """New files of a folder as rows (path, size, mtime_ms)."""
    reader = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", "true")
    )
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder).select(
        "path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms")
    )


# ---- live state --------------------------------------------------------------------------------

LIFETIME = "1 hour"


def stream_latest_state(feed: DataFrame, lifetime: str = LIFETIME) -> DataFrame:
    """Newest state per key and ``lifetime`` of event time (update mode). Removed keys are filtered by ``live_rows``.

    State ends with its slice of time: once the watermark has passed it, no row of it can arrive, and it is dropped. A key that is
    heard of again starts anew, and the table the updates go to keeps the newest row. Rows combine before the shuffle.
    """
    slices = feed.withWatermark("ts", "10 minutes").select(STATE_COLUMNS).withColumn("_life", F.window("ts", lifetime))
    return latest_by(slices, ["_life", "key"], ["ts", "event_id"]).drop("_life")


def stream_latest_state_batch(feed: DataFrame) -> DataFrame:
    return live_rows(latest_by(feed.select(STATE_COLUMNS), ["key"], ["ts", "event_id"]))


def live_rows(latest: DataFrame) -> DataFrame:
    return latest.where(~F.col("removed")).drop("removed")


def merge_latest(known: DataFrame | None, updates: DataFrame) -> DataFrame:
    """Next version of the state table. Tombstones stay in it until their key is written again."""
    both = updates if known is None else known.unionByName(updates)
    return latest_by(both, ["key"], ["ts", "event_id"])


def follow_latest_state(feed: DataFrame, folder: str | None = None) -> DataFrame:
    """The live table after everything that has arrived. Runs with the same ``folder`` go on from each other."""
    table = SnapshotTable(feed.sparkSession, "latest", merge_latest, folder, key_bucket("key"))
    return live_rows(table.follow(stream_latest_state(feed)))


def stream_status_counts_batch(latest: DataFrame) -> DataFrame:
    """Keys per state and the speed of those downloading."""
    speed = F.sum(F.when(F.col("status") == "downloading", F.col("speed")).otherwise(0.0))
    return latest.groupBy("status").agg(F.count(F.lit(1)).alias("keys"), speed.alias("speed"))


def stream_status_counts(feed: DataFrame, folder: str | None = None) -> DataFrame:
    return stream_status_counts_batch(follow_latest_state(feed, folder))


# ---- windows -----------------------------------------------------------------------------------


def stream_speed_history(feed: DataFrame, tick: str = "1 second", slide: str | None = None) -> DataFrame:
    """Total speed per tick of rows that are downloading."""
    w = F.window("ts", tick, slide) if slide else F.window("ts", tick)
    return (
        feed.withWatermark("ts", "1 minute")
        .where("status = 'downloading'")
        .groupBy(w.alias("w"))
        .agg(F.sum("speed").alias("speed"), F.max("speed").alias("top"))
        .select(F.col("w.start").alias("tick"), F.col("w.end").alias("tick_end"), "speed", "top")
    )


def replace_rows(keys: list[str]):
    """Merge step of a keyed table whose updates replace the row of their key."""

    def merge(known: DataFrame | None, batch: DataFrame) -> DataFrame:
        rest = [c for c in batch.columns if c not in keys]
        both = batch.withColumn("_new", F.lit(1))
        both = both if known is None else known.withColumn("_new", F.lit(0)).unionByName(both)
        return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_new").alias("_row")).select(*keys, "_row.*")

    return merge


TICKS_BUCKET, DAYS_BUCKET = 30 * 86_400, 3_650 * 86_400  # seconds of time whose rows are rewritten together


def follow_speed_history(feed: DataFrame, folder: str | None = None, tick: str = "1 second", slide: str | None = None) -> DataFrame:
    """Every tick so far, the open ones too: update mode into a table keyed by tick. State ends with the watermark."""
    table = SnapshotTable(feed.sparkSession, "speed", replace_rows(["tick", "tick_end"]), folder, time_bucket("tick", TICKS_BUCKET))
    return table.follow(stream_speed_history(feed, tick, slide))


def last_ticks(history: DataFrame, n: int = 120) -> DataFrame:
    return history.orderBy(F.col("tick").desc()).limit(n)


def stream_debounce(feed: DataFrame, quiet: str = "30 seconds") -> DataFrame:
    """One trigger per burst, ``quiet`` after its last event."""
    s = F.session_window("ts", quiet)
    return (
        feed.withWatermark("ts", "1 minute")
        .groupBy("key", s.alias("s"))
        .agg(F.count(F.lit(1)).alias("events"))
        .select("key", F.col("s.end").alias("fires_at"), "events")
    )


def stream_done_per_day(feed: DataFrame) -> DataFrame:
    return (
        feed.withWatermark("ts", "1 hour")
        .where("status = 'done'")
        .groupBy(F.window("ts", "1 day").alias("w"))
        .agg(F.count(F.lit(1)).alias("done"))
        .select(F.col("w.start").alias("day"), F.col("w.end").alias("day_end"), "done")
    )


def follow_done_per_day(feed: DataFrame, folder: str | None = None) -> DataFrame:
    """Done rows of every day including today: update mode into a table keyed by day."""
    table = SnapshotTable(feed.sparkSession, "per-day", replace_rows(["day", "day_end"]), folder, time_bucket("day", DAYS_BUCKET))
    return table.follow(stream_done_per_day(feed))


# ---- windows opened by their first event -------------------------------------------------------

# fixed values: size and wording of a digest
DIGEST_LINES = 25
DIGEST_CARDS = 10
DIGEST_MORE = "\n…and {} more"

DIGEST_SCHEMA = "key bigint, opened_at timestamp, done int, total double, collapsed boolean, lines string"
ACCEPTED_SCHEMA = "key bigint, event_id bigint, ts timestamp"


def digest_text(lines: list[str], done: int) -> str:
    """First lines of a digest, then how many more."""
    more = done - min(done, DIGEST_LINES)
    return "\n".join(lines[:DIGEST_LINES]) + (DIGEST_MORE.format(more) if more else "")


def _micros(ts: pd.Series) -> np.ndarray:
    return ts.to_numpy("datetime64[us]").astype(np.int64)


def _ceil_ms(us: int) -> int:
    return -(-us // 1000)


class CompletionDigest(StatefulProcessor):
    """Collects completions from the first one on and reports them together ``seconds`` later.

    Arrivals wait in list state until the watermark has passed them, so they are counted in the order of events, however they fall into
    batches. A timer at the end of the earliest window that can close settles what the watermark has passed: settled arrivals are a sum and the first lines
    of the open window, which the timer reports and forgets once it is over.
    """

    def __init__(self, seconds: int = 15):
        self.gap = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us bigint, event_id bigint, line string, size double")
        self.open = handle.getValueState("open", "opened_us bigint, done int, total double, lines array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            us = _micros(pdf["ts"])
            self.waiting.appendList(list(zip(us.tolist(), pdf["event_id"].tolist(), pdf["line"].tolist(), pdf["size"].astype(float).tolist())))
            first = int(us.min()) if first is None else min(first, int(us.min()))
        if first is not None:
            self._close_at(first)  # no window opened by these rows ends before
        return iter(())

    def _close_at(self, opened_us: int) -> None:
        self.handle.registerTimer(_ceil_ms(opened_us + self.gap))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        settled = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(self.waiting.get(), key=lambda r: (r[0], r[1])) if self.waiting.exists() else []
        us = np.array([r[0] for r in waiting], np.int64)
        n = int(np.searchsorted(us, settled, side="right"))
        window = self.open.get() if self.open.exists() else None
        had = window is not None
        closed, at = [], 0
        while True:
            if window is not None:
                end = min(int(np.searchsorted(us, window[0] + self.gap)), n)
                mine = waiting[at:end]
                lines = [*window[3], *(r[2] for r in mine[: DIGEST_LINES - len(window[3])])]
                window = (window[0], window[1] + len(mine), window[2] + sum(r[3] for r in mine), lines)
                at = end
                if window[0] + self.gap > settled:
                    break
                closed.append(window)
            window = None
            if at == n:
                break
            window = (int(us[at]), 0, 0.0, [])
        if n:
            self.waiting.clear()
            if waiting[n:]:
                self.waiting.put(waiting[n:])
        if window is not None:
            self.open.update(window)
            self._close_at(window[0])
        else:
            if had:
                self.open.clear()
            if waiting[n:]:
                self._close_at(waiting[n][0])
        if closed:
            opened, done, total, lines = zip(*closed)
            yield pd.DataFrame({
                "key": key[0], "opened_at": pd.to_datetime(list(opened), unit="us"), "done": done, "total": total,
                "collapsed": [d > DIGEST_CARDS for d in done], "lines": [digest_text(t, d) for t, d in zip(lines, done)],
            })

    def close(self) -> None:
        pass


def stream_completion_digest(done: DataFrame, seconds: int = 15) -> DataFrame:
    """Digests of completions (key, event_id, ts, line, size), append mode with event-time timers."""
    use_rocksdb(done.sparkSession)
    return (
        done.withWatermark("ts", "1 minute")
        .select("key", "event_id", "ts", "line", "size")
        .groupBy("key")
        .transformWithStateInPandas(CompletionDigest(seconds), DIGEST_SCHEMA, "Append", "EventTime")
    )


class AcceptOnce(StatefulProcessor):
    """Lets one event of a key through, then none until ``seconds`` after the accepted one.

    Accepted events are found by jumps over the sorted times, one for each. A timer forgets a key once the watermark is ``seconds`` past its
    accepted event: every later row would be let through anyway.
    """

    def __init__(self, seconds: int = 600):
        self.gap = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.accepted = handle.getValueState("accepted", "us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times, ids = [], []
        for pdf in rows:
            times.append(_micros(pdf["ts"]))
            ids.append(pdf["event_id"].to_numpy())
        us, event = np.concatenate(times), np.concatenate(ids)
        order = np.lexsort((event, us))
        us, event = us[order], event[order]
        before = self.accepted.get()[0] if self.accepted.exists() else None
        last, taken = before, []
        at = 0 if last is None else int(np.searchsorted(us, last + self.gap))
        while at < len(us):
            taken.append(at)
            last = int(us[at])
            at = int(np.searchsorted(us, last + self.gap))
        if taken:
            if before is not None:
                self.handle.deleteTimer(_ceil_ms(before + self.gap))
            self.accepted.update((last,))
            self.handle.registerTimer(_ceil_ms(last + self.gap))
            yield pd.DataFrame({"key": key[0], "event_id": event[taken], "ts": pd.to_datetime(us[taken], unit="us")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.accepted.exists() and _ceil_ms(self.accepted.get()[0] + self.gap) <= expiredTimerInfo.getExpiryTimeInMs():
            self.accepted.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_dedupe_recent(feed: DataFrame, seconds: int = 600) -> DataFrame:
    """Events that are answered; repeats of a key within ``seconds`` of the answered one are dropped."""
    use_rocksdb(feed.sparkSession)
    return (
        feed.withWatermark("ts", "10 minutes")
        .select("key", "event_id", "ts")
        .groupBy("key")
        .transformWithStateInPandas(AcceptOnce(seconds), ACCEPTED_SCHEMA, "Append", "EventTime")
    )


_BURST = ["key", "_burst"]


def _openers(bursts: DataFrame, gap_us: int) -> DataFrame:
    """(key, _burst, spot): the events that open a window, in bursts that may hold several.

    Each event points to the first one at or after the end of a window it would open; the openers are what the first event of
    a burst reaches. Pointers double until none is left: round k reaches 2**k windows on, so rounds grow with the logarithm of the windows of one burst.
    ``bursts``: key, _burst (its first event), spot: struct(ts, event_id).
    """
    span = bursts.groupBy(*_BURST).agg(F.max("spot.ts").alias("_end"))
    several = span.where(F.unix_micros("_end") - F.unix_micros(F.col("_burst.ts")) >= gap_us).select(*_BURST)
    some = keep(bursts.join(several, _BURST, "left_semi").select(*_BURST, "spot").distinct(), "bursts")
    # on the line of time an event asks for the first one behind its window; read backwards, that is the last one seen
    line = lambda at, kind: some.select(*_BURST, "spot", at.alias("at"), F.lit(kind).alias("kind"))
    at = F.unix_micros("spot.ts")
    both = line(at, 1).unionByName(line(at + gap_us, 0))
    back = [SortKey(F.col(c), "desc_nulls_last") for c in ("at", "kind", "spot")]
    seen = carry_last(both, _BURST, back, F.when(F.col("kind") == 1, F.col("spot")), "to")
    hop = keep(seen.where("kind = 0 and to is not null").select(*_BURST, F.col("spot").alias("at"), "to"), "hops")
    found = keep(some.where("spot = _burst").select(*_BURST, "spot"), "openers")
    while not hop.isEmpty():
        on = hop.select(*_BURST, F.col("at").alias("spot"), "to")
        reached = found.join(on, [*_BURST, "spot"]).select(*_BURST, F.col("to").alias("spot"))
        further = hop.select(*_BURST, "at", F.col("to").alias("spot")).join(on, [*_BURST, "spot"]).select(*_BURST, "at", "to")
        old = (found, hop)
        found, hop = keep(found.unionByName(reached).distinct(), "openers"), keep(further, "hops")
        for done in old:
            discard(done)
    return found


def opening_events(df: DataFrame, seconds: int) -> DataFrame:
    """Batch twin of both: adds ``opened_at``, the event that opened the window each row falls in.

    An event at least ``seconds`` after its predecessor always opens a window, so a key's timeline falls into independent
    bursts; inside a burst the openers are found by doubled pointers. Every step is a scan over range-partitioned rows: one key
    or burst may hold them all.
    """
    df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    order = ["ts", "event_id"]
    gap_us = seconds * 1_000_000
    spot = F.struct("ts", "event_id")
    prior = carry_last(df, ["key"], order, F.col("ts"), "_prior")
    long_gap = F.col("_prior").isNull() | (F.unix_micros("ts") - F.unix_micros("_prior") >= gap_us)
    first = carry_last(prior, ["key"], order, F.when(long_gap, spot), "_burst", inclusive=True).drop("_prior")
    opened = _openers(first.select(*_BURST, spot.alias("spot")), gap_us)
    marked = first.withColumn("spot", spot).join(opened.select("key", "spot", F.lit(True).alias("_opens")), ["key", "spot"], "left")
    opens = F.coalesce("_opens", F.lit(False)) | (F.col("spot") == F.col("_burst"))
    return carry_last(marked, ["key"], order, F.when(opens, F.col("ts")), "opened_at", inclusive=True).drop("_burst", "spot", "_opens")


def _more_text(more: Column) -> list[Column]:
    head, tail = DIGEST_MORE.split("{}")
    return [F.lit(head), more.cast("string"), F.lit(tail)]


def stream_completion_digest_batch(done: DataFrame, seconds: int = 15) -> DataFrame:
    windows = opening_events(done.select("key", "event_id", "ts", "line", "size"), seconds)
    sums = windows.groupBy("key", "opened_at").agg(F.count(F.lit(1)).cast("int").alias("done"), F.sum("size").alias("total"))
    first = top_n(windows, ["key", "opened_at"], [F.col("ts"), F.col("event_id")], DIGEST_LINES, "_n")
    text = first.groupBy("key", "opened_at").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "line"))), lambda x: x["line"]), "\n").alias("_text")
    )
    more = F.col("done") - DIGEST_LINES
    return sums.join(text, ["key", "opened_at"]).select(
        "key", "opened_at", "done", "total", (F.col("done") > DIGEST_CARDS).alias("collapsed"),
        F.when(more > 0, F.concat("_text", *_more_text(more))).otherwise(F.col("_text")).alias("lines"),
    )


def stream_dedupe_recent_batch(feed: DataFrame, seconds: int = 600) -> DataFrame:
    windows = opening_events(feed.select("key", "event_id", "ts"), seconds)
    return top_n(windows, ["key", "opened_at"], [F.col("ts"), F.col("event_id")]).select("key", "event_id", "ts")


# ---- identities and logs -----------------------------------------------------------------------


def first_identity(known: DataFrame | None, batch: DataFrame) -> DataFrame:
    """First value seen per album key (album_key, ts, event_id, value)."""
    both = batch if known is None else known.unionByName(batch)
    rest = F.struct("ts", "event_id", "value")
    return both.groupBy("album_key").agg(F.min_by(rest, F.struct("ts", "event_id")).alias("f")).select("album_key", "f.*")


def stream_first_identity(feed: DataFrame, catalog_keys: DataFrame, lifetime: str = LIFETIME) -> DataFrame:
    """First value per album key and ``lifetime`` of event time until the catalog knows the key (update mode).

    State ends with its slice of time, as in ``stream_latest_state``; the table the updates go to keeps the first value of all.
    """
    unknown = feed.join(catalog_keys.select("album_key").distinct(), "album_key", "left_anti")
    rest = F.struct("ts", "event_id", "value")
    return (
        unknown.withWatermark("ts", "10 minutes")
        .groupBy(F.window("ts", lifetime).alias("_life"), "album_key")
        .agg(F.min_by(rest, F.struct("ts", "event_id")).alias("f"))
        .select("album_key", "f.*")
    )


def follow_first_identity(feed: DataFrame, catalog_keys: DataFrame, folder: str | None = None) -> DataFrame:
    table = SnapshotTable(feed.sparkSession, "identity", first_identity, folder, key_bucket("album_key"))
    return table.follow(stream_first_identity(feed, catalog_keys))


def merge_tail(lines: int, keys: int):
    """Merge step of ``stream_tail``: newest lines per key, newest keys."""

    def merge(known: DataFrame | None, batch: DataFrame) -> DataFrame:
        both = batch if known is None else known.unionByName(batch)
        newest = both.groupBy("key").agg(F.max(F.struct("ts", "event_id")).alias("_at"))
        recent = newest.orderBy(F.col("_at").desc(), "key").limit(keys).select("key")  # at most `keys` rows
        tail = top_n(both, ["key"], [F.col("ts").desc(), F.col("event_id").desc()], lines)
        return tail.join(F.broadcast(recent), "key", "left_semi")

    return merge


def stream_tail(feed: DataFrame, lines: int = 400, keys: int = 50, folder: str | None = None) -> DataFrame:
    """Last ``lines`` rows of the ``keys`` most recent keys. Every batch is cut to that size before it
    meets the kept table, so a busy key never travels whole."""
    table = SnapshotTable(feed.sparkSession, "tail", merge_tail(lines, keys), folder)
    return table.follow(feed.select("key", "event_id", "ts", "line"), "append")


# ---- listings and queue ------------------------------------------------------------------------


def merge_listing(existing: DataFrame | None, arrived: DataFrame) -> DataFrame:
    """Merge arriving listings into item history.

    Items: source_id, external_id, title, album, duration_ms, position, present. ``arrived`` adds
    ``partial`` and ``truncated`` per listing. The first occurrence of an id wins; missing attributes
    keep their old value; partial listings keep known positions and number new ones after the last;
    rows absent from a full listing lose ``present``.
    """
    cols = ["source_id", "external_id", "title", "album", "duration_ms", "position", "present"]
    first = top_n(arrived, ["source_id", "external_id"], [F.col("position")])
    if existing is None:
        existing = arrived.select("source_id", "external_id", "title", "album", "duration_ms", "position", F.lit(True).alias("present")).limit(0)
    # place of each distinct item in its listing, needed to number partial ones
    counted = number_rows(first, ["source_id"], ["position", "external_id"], "_seen")
    top = existing.groupBy("source_id").agg(F.max("position").alias("_top"))
    heads = arrived.groupBy("source_id").agg(
        F.bool_or("partial").alias("_partial"), F.bool_or(F.col("partial") | F.col("truncated")).alias("_open_end")
    )
    new = spread_join(counted, top, ["source_id"], "left").select(
        "source_id", "external_id", *[F.col(c).alias(f"_n_{c}") for c in ("title", "album", "duration_ms", "position")],
        "partial", (F.coalesce(F.col("_top"), F.lit(0)) + F.col("_seen")).alias("_next"), F.lit(True).alias("_listed"),
    )
    both = existing.join(new, ["source_id", "external_id"], "full_outer")
    both = spread_join(both, heads, ["source_id"], "left")
    listed = F.coalesce(F.col("_listed"), F.lit(False))
    position = F.when(~listed, F.col("position")).when(F.col("partial"), F.coalesce("position", "_next")).otherwise(F.col("_n_position"))
    gone = ~listed & ~F.coalesce(F.col("_open_end"), F.lit(True))
    return both.select(
        "source_id", "external_id",
        F.when(listed, F.col("_n_title")).otherwise(F.col("title")).alias("title"),
        F.coalesce("_n_album", "album").alias("album"), F.coalesce("_n_duration_ms", "duration_ms").alias("duration_ms"),
        position.alias("position"), (listed | (F.col("present") & ~gone)).alias("present"),
    ).select(cols)


def _bases(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Highest position of a source just before each listing that numbers new items.

    Spans (source_id, since, until, top, gives) come source by source, in order of ``since``: positions ``top`` held from listing ``since``
    until listing ``until`` changes them (the largest number: to the end); where ``gives``, ``top`` counts from the base of listing ``since`` itself.
    One row per pair of listings, never per item; one source at a time is held.
    """
    spans = (row for part in parts for row in zip(*(part[c].tolist() for c in ("source_id", "since", "until", "top", "gives"))))
    out: list[tuple] = []
    for source, rows in itertools.groupby(spans, key=lambda row: row[0]):
        held = list(rows)
        line: list[tuple[int, int]] = []  # negative position, until
        bases: dict[int, int] = {}
        at = 0
        for listing in sorted({since for _, since, _, _, gives in held if gives}):
            while at < len(held) and held[at][1] < listing:
                _, since, until, top, gives = held[at]
                heapq.heappush(line, (-(top + (bases[since] if gives else 0)), until))
                at += 1
            while line and line[0][1] < listing:
                heapq.heappop(line)
            bases[listing] = -line[0][0] if line else 0
        out += [(source, listing, base) for listing, base in bases.items()]
        if len(out) >= 10_000:
            yield pd.DataFrame(out, columns=["source_id", "_round", "_base"])
            out = []
    if out:
        yield pd.DataFrame(out, columns=["source_id", "_round", "_base"])


def merge_listings(existing: DataFrame | None, arrived: DataFrame, when: str = "listed_at") -> DataFrame:
    """Merge any number of listings per source, told apart by the column ``when``, each source's in order of time.

    The result is that of ``merge_listing`` for one listing after the other, in one pass: each item is a sum of its occurrences (title of the last, last
    known album and length, last position a full listing gave, last time seen), and a source of its listings (last complete one). Only the
    numbers of items that are new in partial listings depend on earlier listings as a whole: they count from the highest position held just then, which
    ``_bases`` finds from one row per pair of listings between which some position was held. So the plan is the same for any number of listings,
    and it does not matter how they fall into batches as long as those keep the order. Of rows that repeat an item in a listing the
    first by position counts (then by title, album and length). Sources without listings in ``arrived`` pass through.
    """
    item = ["source_id", "external_id"]
    values = ["title", "album", "duration_ms"]
    rounds = keep(number_rows(arrived.select("source_id", when).distinct(), ["source_id"], [when], "_round"), "rounds")
    placed = spread_join(arrived, rounds, ["source_id", when])
    once = top_n(placed, [*item, "_round"], [F.col("position"), *[F.col(c) for c in values]])
    listed = number_rows(once, ["source_id", "_round"], ["position", "external_id"], "_seen").select(
        *item, "_round", "_seen", "partial", *values, F.col("position").cast("long").alias("position"), F.lit(True).alias("present")
    )
    if existing is not None:
        known = existing.select(*item, F.lit(0).cast("long").alias("_round"), F.lit(0).cast("long").alias("_seen"), F.lit(False).alias("partial"), *values, F.col("position").cast("long").alias("position"), "present")
        listed = known.unionByName(listed)
    of_item = Window.partitionBy(*item).orderBy("_round")  # at most a row per listing of its source
    earlier, later = of_item.rowsBetween(Window.unboundedPreceding, -1), of_item.rowsBetween(1, Window.unboundedFollowing)
    full = ~F.col("partial")
    facts = listed.withColumns({
        "_set": F.last(F.when(full, F.struct("_round", "position")), ignorenulls=True).over(earlier),
        "_part": F.max(F.when(F.col("partial"), F.col("_round"))).over(earlier),
        "_until": F.first(F.when(full, F.col("_round")), ignorenulls=True).over(later),
    })
    unplaced = F.col("_set.position").isNull() & (F.col("_part").isNull() | (F.col("_part") < F.coalesce("_set._round", F.lit(-1))))
    facts = keep(facts.withColumn("_gives", F.col("partial") & unplaced).drop("_set", "_part"), "occurrences")
    spans = lambda rows, top, gives: rows.groupBy("source_id", F.col("_round").alias("since"), F.col("_until").alias("until")).agg(
        F.max(top).alias("top")).withColumn("gives", F.lit(gives))
    given = spans(facts.where("_gives"), "_seen", True)
    held = spans(facts.where("not partial and position is not null"), "position", False)
    held = held.join(given.select("source_id").distinct(), "source_id", "left_semi")
    source_type = arrived.schema["source_id"].dataType.simpleString()
    # one task reads many sources; those without an id meet no item below
    lined = held.unionByName(given).where("source_id is not null").withColumn("until", F.coalesce("until", F.lit(sys.maxsize)))
    lined = lined.select("source_id", "since", "until", "top", "gives").repartition("source_id").sortWithinPartitions("source_id", "since")
    bases = lined.mapInPandas(_bases, f"source_id {source_type}, _round long, _base long")
    at = lambda flag: F.when(flag, F.col("_round"))
    folded = facts.groupBy(*item).agg(
        F.max_by("title", "_round").alias("title"), *[F.max_by(c, at(F.col(c).isNotNull())).alias(c) for c in ("album", "duration_ms")],
        F.max_by(F.struct("_round", "position"), at(full)).alias("_set"), F.max_by(F.struct("_round", "_seen"), at(F.col("_gives"))).alias("_new"),
        F.max(at(F.col("_round") > 0)).alias("_listed"), F.bool_or(F.when(F.col("_round") == 0, F.col("present"))).alias("_was"),
    )
    numbered = F.col("_new").isNotNull() & (F.col("_new._round") > F.coalesce("_set._round", F.lit(-1)))
    folded = folded.withColumn("_round", F.when(numbered, F.col("_new._round")))
    ends = arrived.groupBy("source_id", when).agg(F.bool_or(F.col("partial") | F.col("truncated")).alias("_open_end"))
    complete = ends.where("not _open_end").join(rounds, ["source_id", when]).groupBy("source_id").agg(F.max("_round").alias("_complete"))
    out = spread_join(spread_join(folded, bases, ["source_id", "_round"], "left"), complete, ["source_id"], "left")
    seen_since = F.coalesce(F.col("_complete") <= F.col("_listed"), F.col("_complete").isNull())
    return out.select(
        *item, *values, F.when(numbered, F.col("_base") + F.col("_new._seen")).otherwise(F.col("_set.position")).alias("position"),
        F.when(F.col("_listed").isNotNull(), seen_since).otherwise(F.col("_was") & F.col("_complete").isNull()).alias("present"),
    )


def removed_items(existing: DataFrame, listing: DataFrame, headers: DataFrame) -> DataFrame:
    """Known items absent from their source's listing; nothing for partial or truncated listings.
    ``headers``: source_id, partial, truncated."""
    complete = headers.where("not partial and not truncated").select("source_id")
    gone = existing.join(listing.select("source_id", "external_id"), ["source_id", "external_id"], "left_anti")
    return spread_join(gone, complete, ["source_id"], "left_semi")


def merge_headers(sources: DataFrame, listings: DataFrame, counts: DataFrame, now: Column) -> DataFrame:
    """Source headers after a sync. ``listings``: source_id, name, partial, truncated, failed.
    ``counts``: source_id, fresh, seen. A failure only sets the error and an earlier retry."""
    j = sources.join(listings.withColumnsRenamed({"name": "_name", "truncated": "_trunc"}), "source_id", "left").join(counts, "source_id", "left")
    tried = F.col("failed").isNotNull()
    failed = F.coalesce(F.col("failed"), F.lit(False))
    ok = tried & ~failed
    every = F.when(F.col("interval_minutes") > 0, F.col("interval_minutes"))
    wait = F.when(failed & every.isNotNull(), F.least(every, F.lit(60))).otherwise(every)
    partial = F.coalesce(F.col("partial"), F.lit(False))
    fresh, seen = F.coalesce(F.col("fresh"), F.lit(0)), F.coalesce(F.col("seen"), F.lit(0))
    return j.select(
        "source_id",
        F.when(ok & (F.col("_name") != ""), F.col("_name")).otherwise(F.col("name")).alias("name"),
        "interval_minutes",
        F.when(ok & ~partial, F.col("_trunc")).otherwise(F.col("truncated")).alias("truncated"),
        F.when(ok & partial, F.col("item_count") + fresh).when(ok, seen).otherwise(F.col("item_count")).alias("item_count"),
        F.when(tried, F.timestamp_add("MINUTE", wait.cast("int"), now)).otherwise(F.col("next_check_at")).alias("next_check_at"),
        failed.alias("failed"),
    )


def stream_listing_merge(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Listings as they arrive, merged into the item history. A column ``listed_at`` tells the listings of a source
    apart; without one, what arrives of a source at once is one listing."""
    merge = merge_listings if "listed_at" in stream.columns else merge_listing
    return SnapshotTable(stream.sparkSession, "items", merge, folder, key_bucket("source_id")).follow(stream, "append")


def retry_schedule(attempts: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Outcome of a failed attempt: queued with a retry time, or failed. Works on tables and streams.
    ``attempts``: id, attempt, permanent, failed_at."""
    again = ~F.col("permanent") & (F.col("attempt") < max_attempts)
    delay = F.least(F.lit(1800.0), 30 * F.pow(F.lit(2.0), F.col("attempt") - 1)).cast("int")
    return attempts.withColumns(
        {
            "next_status": F.when(again, "queued").otherwise("failed"),
            "retry_at": F.when(again, F.timestamp_add("SECOND", delay, F.col("failed_at"))),
        }
    )


def next_retry(scheduled: DataFrame) -> DataFrame:
    return scheduled.where("next_status = 'queued'").agg(F.min("retry_at").alias("next_retry"))


def enqueue_missing(
    items: DataFrame, base: Column, explicit: DataFrame | None = None, top: bool = False, floor: Column | None = None
) -> DataFrame:
    """Items to queue with running positions.

    Present, not ignored, new or cancelled items; with ``explicit`` (source_id, external_id) exactly
    those, though never done, queued or active ones. Positions run from ``base``; with ``top`` they end
    below ``floor``, the lowest position in the queue.
    """
    state = F.col("state")
    if explicit is None:
        wanted = items.where(F.col("present") & ~F.col("ignored") & state.isin("new", "cancelled"))
    else:
        wanted = items.join(explicit, ["source_id", "external_id"], "left_semi")
    wanted = wanted.where(~state.isin("done", "queued", *fv.ACTIVE_STATUSES))
    counted = number_rows(wanted, [], ["source_id", "position", "external_id"], "_n")
    if not top:
        return counted.withColumn("queue_position", base + F.col("_n") - 1).drop("_n")
    many = counted.agg(F.count(F.lit(1)).alias("_rows")).withColumn("_k", F.lit(1))
    return (
        counted.withColumn("_k", F.lit(1))
        .join(F.broadcast(many), "_k")  # a single row
        .withColumn("queue_position", floor - F.col("_rows") - 1 + F.col("_n") - 1)
        .drop("_n", "_k", "_rows")
    )
