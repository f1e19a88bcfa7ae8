"""Joins: existence, best state, range, division, nearest and as-of lookups, snapshot differences."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from ..functions import fixed_values as fv
from ..functions.numbers import truthy
from ..plans.durable import discard, keep
from ..plans.skew import carry_last, hot_keys, number_rows, rows_per_task, spread_join, top_n
from .word_cells import LOWEST, found_rows, packed_cell
from .word_sets import COUNTERS, FOLDED_LONGS, SEPARATOR, dice_cell, judge_cell, prefixes


def lookup_existing(items: DataFrame, lib: DataFrame) -> DataFrame:
    """Adds ``existing_id``: the catalog row with the same match key (smallest id), null when none."""
    hits = lib.where("match_key is not null").groupBy("match_key").agg(F.min("id").alias("existing_id"))
    return spread_join(items, hits, ["match_key"], "left")


def skip_already_done(jobs: DataFrame, tracks: DataFrame) -> DataFrame:
    """Jobs that remain: forced ones, and those sharing no external id with another done job.

    One equi lookup per id; an OR of the two would plan as a nested loop. Per id the smallest and the
    largest done job are enough to tell whether a job other than this one is done.
    """
    done = tracks.where("status = 'done'")
    todo = jobs
    for c in ("id_a", "id_b"):
        seen = (
            done.where(F.col(c).isNotNull())
            .groupBy(c)
            .agg(F.min("id").alias(f"_lo_{c}"), F.max("id").alias(f"_hi_{c}"))
        )
        todo = spread_join(todo, seen, [c], "left")
    other = F.lit(False)
    for c in ("id_a", "id_b"):
        other = other | F.coalesce((F.col(f"_lo_{c}") != F.col("id")) | (F.col(f"_hi_{c}") != F.col("id")), F.lit(False))
    return todo.where(F.coalesce(F.col("force"), F.lit(False)) | ~other).select(jobs.columns)


def state_rank(status: Column) -> Column:
    rank = F.when(status.isin(*fv.ACTIVE_STATUSES), fv.ACTIVE_RANK)
    for name, n in fv.STATE_RANK.items():
        rank = rank.when(status == name, n)
    return rank.otherwise(0)


def resolve_item_states(items: DataFrame, tracks: DataFrame, lib: DataFrame | None = None) -> DataFrame:
    """Adds ``state`` and ``track_id``: best job state per external id, else library, else new."""
    ranked = tracks.where("external_id is not null").withColumn("_rank", state_rank(F.col("status")))
    best = top_n(ranked, ["external_id"], [F.col("_rank").desc(), F.col("track_id")]).select(
        "external_id", "track_id", F.col("status").alias("_job")
    )
    out = items.join(best, "external_id", "left")
    open_ended = F.col("_job").isNull() | F.col("_job").isin("failed", "cancelled", "skipped")
    if lib is not None:
        keys = lib.where("match_key is not null").select("match_key").distinct().withColumn("_known", F.lit(True))
        out = spread_join(out, keys, ["match_key"], "left")
        in_lib = open_ended & F.coalesce(F.col("_known"), F.lit(False))
    else:
        in_lib = F.lit(False)
    state = F.when(in_lib, "library").otherwise(F.coalesce(F.col("_job"), F.lit("new")))
    return out.withColumn("state", state).drop("_job", "_known")


def link_files_to_tracks(files: DataFrame, tracks: DataFrame) -> DataFrame:
    """Attach the job that wrote each path; the highest job id when several did."""
    by_path = tracks.where("file_path is not null").groupBy(F.col("file_path").alias("path")).agg(F.max("track_id").alias("track_id"))
    return files.join(by_path, "path", "left")


def snapshot_diff(prev: DataFrame, cur: DataFrame, full: bool = False) -> DataFrame:
    """(path, change): new, changed, unchanged or gone; ``full`` marks every present row as changed."""
    p = prev.select("path", F.col("size").alias("_ps"), F.col("mtime").alias("_pm"), F.lit(True).alias("_in_prev"))
    c = cur.select("path", F.col("size").alias("_cs"), F.col("mtime").alias("_cm"), F.lit(True).alias("_in_cur"))
    same = F.col("_ps").eqNullSafe(F.col("_cs")) & F.col("_pm").eqNullSafe(F.col("_cm"))
    change = (
        F.when(F.col("_in_cur").isNull(), "gone")
        .when(F.col("_in_prev").isNull(), "new")
        .when(F.lit(full) | ~same, "changed")
        .otherwise("unchanged")
    )
    return p.join(c, "path", "full_outer").select("path", change.alias("change"))


def duration_neighbours(df: DataFrame, window_ms: int, key: str = "id", within: tuple[str, ...] = ()) -> DataFrame:
    """Rows in order of duration (inside ``within``) with ``rank``, the rank ``last`` of the longest row at most ``window_ms`` longer, and ``rows``.

    The rows after a row up to ``last`` are its neighbours: a table of one row per recording in place of one per pair. Window ends are lined up
    with the rows themselves; as adding a constant keeps the order, the end of the row of rank r is the r-th end, so the rows before it
    are its place less r. Both numberings span tasks, whatever a band or key holds.
    """
    by = list(within)
    timed = df.where(F.col("duration_ms") > 0).select(*by, F.col(key).alias("id"), "duration_ms")
    ranked = number_rows(timed, by, ["duration_ms", "id"], "rank", total="rows")
    at = lambda kind, value: ranked.select(*by, "id", "rank", "rows", "duration_ms", F.lit(kind).alias("kind"), value.cast("double").alias("at"))
    both = at(0, F.col("duration_ms")).unionByName(at(1, F.col("duration_ms") + F.lit(window_ms)))
    ends = number_rows(both, by, ["at", "kind", "rank"], "place").where("kind = 1")
    return ends.select(*by, "id", "duration_ms", "rank", (F.col("place") - F.col("rank")).alias("last"), "rows")


BLOCK_ROWS = 1024  # neighbours that meet in one key of the pair join
PAIRS_PER_TASK = 2_000_000
MAX_PAIR_TASKS = 20_000


def _pairs_of(ranges: DataFrame, first: Column, last: Column, by: list[str]) -> DataFrame:
    """(a, b, gap_ms) of each row and the rows whose ranks lie in its range; every pair arises once, from the shorter row.

    A row travels once to each block of ranks that its range meets, where the block's rows are one row of arrays in order of rank; pairs are spelled out
    behind the join, of the places that lie in the range only: they are never shuffled, compared or sorted.
    """
    some = ranges.withColumns({"_first": first, "_last": last}).where("_first <= _last")
    block = lambda c: F.floor(F.col(c) / BLOCK_ROWS)
    left = some.select(*by, F.col("id").alias("_x"), F.col("duration_ms").alias("_dx"), "_first", "_last", F.explode(F.sequence(block("_first"), block("_last"))).alias("block"))
    right = ranges.select(*by, block("rank").alias("block"), F.struct("rank", "id", "duration_ms").alias("row"))
    pairs = some.agg(F.sum(F.col("_last") - F.col("_first") + 1)).first()[0] or 0
    tasks = max(1, min(-(-int(pairs) // PAIRS_PER_TASK), MAX_PAIR_TASKS))  # by pairs, of which shuffled bytes say nothing
    rows = right.repartition(tasks, *by, "block").groupBy(*by, "block").agg(F.sort_array(F.collect_list("row")).alias("_rows"))
    rows = rows.select(*by, "block", F.col("_rows.rank")[0].alias("_base"), F.col("_rows.id").alias("_ids"), F.col("_rows.duration_ms").alias("_times"))
    met = left.repartition(tasks, *by, "block").join(rows, [*by, "block"])
    place = lambda c: (c - F.col("_base")).cast("int")
    met = met.withColumns({"_from": place(F.greatest("_first", "_base")), "_to": place(F.least(F.col("_last"), F.col("_base") + F.size("_ids") - 1))}).where("_from <= _to")
    met = met.select("_x", "_dx", "_ids", "_times", F.explode(F.sequence("_from", "_to")).alias("_at"))
    met = met.select("_x", "_dx", F.get("_ids", F.col("_at")).alias("_y"), F.get("_times", F.col("_at")).alias("_dy"))
    return met.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"), (F.col("_dy") - F.col("_dx")).cast("bigint").alias("gap_ms"))


def duration_window_pairs(df: DataFrame, window_ms: int = fv.DURATION_WINDOW_MS, key: str = "id") -> DataFrame:
    """Unordered pairs (a, b) whose durations differ by at most ``window_ms``, from ranges of neighbours."""
    near = keep(duration_neighbours(df, window_ms, key), "neighbours")
    return _pairs_of(near, F.col("rank") + 1, F.col("last"), [])


def same_key_far_pairs(df: DataFrame, window_ms: int = fv.DURATION_WINDOW_MS, key: str = "id") -> DataFrame:
    """Pairs that share a match key but differ by more than the window: the rows of the key beyond the neighbours."""
    near = keep(duration_neighbours(df.where("match_key is not null"), window_ms, key, ("match_key",)), "neighbours")
    return _pairs_of(near, F.col("last") + 1, F.col("rows"), ["match_key"]).select("a", "b", "gap_ms")


def upgrade_candidates(files: DataFrame, tracks: DataFrame) -> DataFrame:
    """Adds ``outcome``: why a file cannot be upgraded, or 'candidate'."""
    pending = (
        tracks.where(~F.col("status").isin(*fv.FINISHED_STATUSES) & F.col("upgrade_of").isNotNull())
        .select(F.col("upgrade_of").alias("id"))
        .distinct()
        .withColumn("_open", F.lit(True))
    )
    outcome = (
        F.when(F.coalesce(F.col("lossless"), F.lit(False)), "already lossless")
        .when(F.col("_open"), "already queued")
        .when(~truthy(F.col("title")) | ~truthy(F.col("artist")), "needs title and artist")
        .otherwise("candidate")
    )
    return files.join(pending, "id", "left").withColumn("outcome", outcome).drop("_open")


def file_detail(lib: DataFrame, tracks: DataFrame, heavy: tuple[str, ...] = fv.DERIVED_COLUMNS) -> DataFrame:
    """A file with the job that produced it, without the heavy derived columns."""
    jobs = tracks.select("track_id", F.col("status").alias("job_status"), F.col("finished_at").alias("job_finished_at"))
    return lib.drop(*heavy).join(jobs, "track_id", "left")


def produced_files(tracks: DataFrame, lib: DataFrame) -> DataFrame:
    return tracks.select("track_id").join(lib.select("track_id", F.col("id").alias("file_id")), "track_id")


def redirect_references(tracks: DataFrame, moves: DataFrame) -> DataFrame:
    """Point ``file_path`` at the new path (or survivor) of whatever moved or went."""
    to = moves.select(F.col("from_path").alias("file_path"), "to_path")
    return (
        spread_join(tracks, to, ["file_path"], "left")
        .withColumn("file_path", F.coalesce("to_path", "file_path"))
        .select(tracks.columns)
    )


BLOCK_DOCS = 4096  # documents of a cell, more where there would be more than MOST_BLOCKS blocks, but never beyond WIDEST_BLOCK
MOST_BLOCKS = 64
WIDEST_BLOCK = 1 << 16  # places take two bytes
CELL_QUERIES = 1_000_000


def word_postings(docs: DataFrame, vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block, word, places) of the words in ``vocabulary``, places in order, and (block, ids): the documents of each block by place.

    Documents are cut into words once. Places are counted from ``LOWEST``.
    """
    numbers = number_rows(docs.select("doc_id"), [], ["doc_id"], "number", total="rows").select("doc_id", "number", "rows")
    wide = F.least(F.greatest(F.lit(BLOCK_DOCS), F.ceil(F.col("rows") / MOST_BLOCKS)), F.lit(WIDEST_BLOCK))
    block, place = F.floor((F.col("number") - 1) / wide), (F.pmod(F.col("number") - 1, wide) + LOWEST).cast("smallint")
    numbers = keep(numbers.select("doc_id", block.alias("block"), place.alias("place")), "numbers")
    # the outer form infers no filter on the words, which would cut every document once more; a null word joins nothing
    posted = docs.select("doc_id", F.explode_outer("words").alias("word")).join(vocabulary, "word", "left_semi").join(numbers, "doc_id")
    places = posted.groupBy("block", "word").agg(F.sort_array(F.collect_set("place")).alias("places"))  # at most a block's documents
    listed = numbers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "doc_id"))).getField("doc_id").alias("ids"))
    return keep(places, "postings"), listed


def all_words_search(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id) where the document holds every word of the query.

    Documents fall into blocks, at most ``MOST_BLOCKS`` as long as these are not too wide. A query travels to the blocks of its rarest word only, and
    meets there the places of all words; rows found are never shuffled, and are given out bit by bit, so a cell may find any number. Queries are cut into
    parts of about ``CELL_QUERIES``, to which a block's postings are repeated. Queries without words or with an unknown word find nothing. ``queries`` carries ``query_id, words``; ``docs`` carries ``doc_id, words`` (distinct words).
    """
    wanted = keep(queries.select("query_id", F.explode("words").alias("word")), "wanted")
    postings, listed = word_postings(docs, wanted.select("word").distinct())
    freq = postings.groupBy("word").agg(F.sum(F.size("places")).alias("n"))
    known = wanted.join(freq, "word", "left").where("query_id is not null").groupBy("query_id").agg(
        F.collect_set("word").alias("words"), F.bool_and(F.col("n").isNotNull()).alias("all"), F.min(F.struct("n", "word")).alias("rarest")
    )
    needs = keep(known.where("all").select("query_id", "words", F.col("rarest.word").alias("word")), "needs")
    parts = -(-needs.count() // CELL_QUERIES) or 1
    blocks = spread_join(needs, postings.select("word", "block"), ["word"], part_by=["query_id"])
    asked = blocks.select("query_id", "words", (F.col("block") * parts + F.pmod(F.xxhash64("query_id"), F.lit(parts))).alias("cell"))
    ids = listed.select("block", F.lit(None).cast("string").alias("word"), F.lit(None).cast("array<smallint>").alias("places"), "ids")
    posted = postings.withColumn("ids", F.lit(None).cast(listed.schema["ids"].dataType)).unionByName(ids)
    cells = F.explode(F.sequence(F.col("block") * parts, F.col("block") * parts + parts - 1)).alias("cell")
    out = StructType([queries.select("query_id").schema[0], docs.select("doc_id").schema[0]])
    cell = StructType([StructField("asked", BinaryType()), StructField("posted", BinaryType())])

    def packed(asked_here: pa.Table, posted_here: pa.Table) -> pa.Table:
        if not asked_here.num_rows:
            return to_arrow_schema(cell).empty_table()
        return packed_cell(asked_here, posted_here)

    tasks = max(1, (listed.agg(F.max("block")).first()[0] or 0) + 1) * parts  # by cells: the bytes of a cell say nothing about its rows found
    spread = lambda df: df.repartition(tasks, "cell").groupBy("cell")
    met = spread(asked).cogroup(spread(posted.select("word", "places", "ids", cells))).applyInArrow(packed, cell)
    return met.mapInArrow(found_rows(to_arrow_schema(out)), out)


def nearest_within_tolerance(
    queries: DataFrame, records: DataFrame, tolerance: float = 10.0, prefer: str = "synced"
) -> DataFrame:
    """Best record per query.

    ``queries``: q, signature, wanted. ``records``: q, rec, signature, have, plain, synced,
    instrumental. The record with the query's signature wins; else the closest length among records
    with text, unless it is off by more than ``tolerance``; without a wanted length the first record.
    An instrumental record gives nothing. ``text_kind`` says which text is used.
    """
    other = "plain" if prefer == "synced" else "synced"
    text = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    pairs = spread_join(records, queries.withColumnRenamed("signature", "_sig"), ["q"])
    exact = F.col("wanted").isNotNull() & (F.col("signature") == F.col("_sig"))
    gap = F.abs(F.coalesce(F.col("have"), F.lit(0)) - F.col("wanted"))
    usable = pairs.withColumns({"_exact": F.coalesce(exact, F.lit(False)), "_gap": gap}).where(
        F.col("_exact") | text("plain") | text("synced")
    )
    best = top_n(usable, ["q"], [F.col("_exact").desc(), F.col("_gap").asc_nulls_first(), F.col("rec")])
    kept = best.where(
        (F.col("_exact") | F.col("wanted").isNull() | (F.col("_gap") <= tolerance))
        & ~F.coalesce(F.col("instrumental"), F.lit(False))
        & (text("plain") | text("synced"))
    )
    return kept.select("q", "rec", F.when(text(prefer), prefer).otherwise(other).alias("text_kind"))


def last_success_preference(attempts: DataFrame, deliveries: DataFrame) -> DataFrame:
    """As-of lookup: for each attempt the source that last delivered its album key strictly before it.

    ``attempts``: attempt_id, album_key, ts. ``deliveries``: delivery_id, album_key, ts, source. Attempts
    sort before deliveries of the same instant, so only strictly earlier ones count.
    """
    both = attempts.select(
        "album_key", "ts", F.lit(0).alias("_kind"), F.col("attempt_id").alias("_id"), F.lit(None).cast("string").alias("_src")
    ).unionByName(
        deliveries.select(
            "album_key", "ts", F.lit(1).alias("_kind"), F.col("delivery_id").alias("_id"), F.col("source").cast("string").alias("_src")
        )
    )
    seen = carry_last(both, ["album_key"], ["ts", "_kind", "_id"], F.col("_src"), "preferred")
    return seen.where("_kind = 0").select(F.col("_id").alias("attempt_id"), "album_key", "ts", "preferred")


def exclude_dismissed(groups: DataFrame, members: DataFrame, dismissals: DataFrame) -> DataFrame:
    """Groups whose exact member set was not dismissed.

    ``dismissals`` holds comma-joined lists of member ids as ``group_key``, or a row (group_key, id) for each id of
    a list, which lets a list have any length. Sets are compared by counting: a dismissal hits a group when all its ids are members and it
    names as many as the group has. Nothing is concatenated, and a list given as text travels as a hash, not with each of its ids.
    """
    if "id" in dismissals.columns:
        named = dismissals.select("group_key", F.col("id").cast("string").alias("_id")).distinct()
    else:
        named = dismissals.select(F.sha2("group_key", 256).alias("group_key"), F.explode(F.split("group_key", ",")).alias("_id")).distinct()
    sizes = named.groupBy("group_key").agg(F.count(F.lit(1)).alias("_named"))
    found = (
        named.join(members.select(F.col("id").cast("string").alias("_id"), "component"), "_id")
        .groupBy("group_key", "component")
        .agg(F.count(F.lit(1)).alias("_found"))
        .join(sizes, "group_key")
        .where("_found = _named")
    )
    hit = found.join(groups.select("component", "files"), "component").where("_found = files")
    return groups.join(hit.select("component").distinct(), "component", "left_anti")


SIGNATURES_PER_GROUP = 131_072
WORDS_PER_GROUP = 2_000_000
MEMBERS_PER_BLOCK = 256  # of a class of equal word sets that meet those of another block in one row


def _cells(asked: DataFrame, shown: DataFrame, keys: list[str], tasks: int, judge: Callable[[pa.Table, pa.Table, float], pa.Table], threshold: float, out: StructType) -> DataFrame:
    """``judge`` over the pairs of each cell and what they need; as many partitions as cells, for bytes say nothing about the work in them."""
    arrow = to_arrow_schema(out)

    def judged(asked_here: pa.Table, shown_here: pa.Table) -> pa.Table:
        if not asked_here.num_rows:
            return arrow.empty_table()
        return judge(asked_here, shown_here, threshold).cast(arrow)

    spread = lambda df, on: df.repartition(max(2, min(tasks, MAX_PAIR_TASKS)), *on).groupBy(*on)
    there = shown.withColumnsRenamed({k: f"_{k}" for k in keys})  # ``shown`` may come from ``asked``
    return spread(asked, keys).cogroup(spread(there, [f"_{k}" for k in keys])).applyInArrow(judged, out)


def _word_classes(sized: DataFrame, members: DataFrame, threshold: float) -> tuple[DataFrame, bool]:
    """One row per word set: class, id, c (a number), n, packed words, prefix, folded and full signature, home and grp, the group in which its words are
    shown; and whether some word may be hot.

    Hashes of words are counted in a fixed number of counters, so that no word travels for the sake of its frequency; the order of words is the same
    in all sets whatever the counters say. Rows that are copies are taken out by their numbers, which are few where copies are few.
    """
    hashes = F.transform("w", lambda x: F.xxhash64(x))
    slots = sized.select(F.explode(F.transform(hashes, lambda h: h.bitwiseAND(COUNTERS - 1).cast("int"))).alias("slot"))
    levels, most = np.zeros(COUNTERS, np.uint8), 0
    for slot, n in slots.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).collect():  # one row per counter
        levels[slot], most = int(8 * math.log2(n)), max(most, n)
    heads = members.groupBy("_class").agg(F.min(F.struct("id", "row")).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = spread_join(members, heads.select("_class", F.col("head.row").alias("first")), ["_class"], counts=heads.select("_class", "n")).where("row <> first")
    given = sized.join(keep(copies.select("row"), "copies"), "row", "left_anti")
    given = given.select("_class", "id", F.array_join("w", SEPARATOR).alias("words"), hashes.alias("h"))
    longs = [StructField(f"f{k}", LongType()) for k in range(FOLDED_LONGS)]
    made = StructType([
        given.schema["_class"], given.schema["id"], StructField("words", BinaryType()), StructField("n", IntegerType()),
        StructField("prefix", ArrayType(IntegerType())), *longs, StructField("sig", BinaryType()), StructField("home", LongType()),
    ])
    sets = given.mapInArrow(prefixes(levels, threshold, to_arrow_schema(made)), made)
    sets = keep(sets.withColumn("c", F.monotonically_increasing_id()), "classes")
    total = sets.agg(F.sum("n")).first()[0] or 0
    groups = max(1, -(-total // WORDS_PER_GROUP))
    hot = F.broadcast(hot_keys(sets.groupBy("home").agg(F.sum("n").alias("size")), ["home"], "size", WORDS_PER_GROUP))
    part = F.pmod(F.xxhash64("c"), F.coalesce("_parts", F.lit(1)))
    sets = sets.join(hot, "home", "left").withColumn("grp", F.pmod(F.xxhash64("home", part), F.lit(groups)).cast("int")).drop("_parts")
    return sets, most > rows_per_task(sized)


def _similar_classes(sets: DataFrame, some_hot: bool, threshold: float) -> DataFrame:
    """(a, b, dice): each pair of class numbers whose word sets reach ``threshold``, once."""
    rows, total = sets.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    folded = [f"f{k}" for k in range(FOLDED_LONGS)]
    # with the two words before it, as one number: a pair that shares one of them is found there already
    spelled = F.transform("prefix", lambda x, i: F.struct(x.alias("word"), F.shiftleft(F.coalesce(F.get("prefix", i - 1), F.lit(0)).cast("long"), 32).bitwiseOR(
        F.coalesce(F.get("prefix", i - 2), F.lit(0)).cast("long").bitwiseAND(0xFFFFFFFF)).alias("before")))
    ranked = sets.select("c", "n", *folded, F.posexplode(spelled).alias("at", "x")).select("x.word", "c", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("n") - F.col("at")).alias("counts"), "x.before", *folded)
    given = {"c": "", "counts": "n", "before": "p"}
    side = lambda x: ranked.select("word", *[F.col(c).alias(f"{name}{x}") for c, name in given.items()], *[F.col(f"f{k}").alias(f"{x}{k}") for k in range(FOLDED_LONGS)])
    # without a hot word both sides are one exchange
    met = spread_join(side("b"), side("a"), ["word"], part_by=["b"]) if some_hot else side("b").join(side("a"), "word")
    high, low = (lambda c: F.shiftright(c, 32)), (lambda c: F.col(c).bitwiseAND(0xFFFFFFFF))
    at = lambda x: high(f"n{x}") - low(f"n{x}")
    wanted = threshold * (high("na") + high("nb")) - 1e-9  # twice the overlap that reaches the threshold
    differ = reduce(lambda u, v: u + v, [F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in range(FOLDED_LONGS)])
    earlier = {1: lambda c: high(c).bitwiseAND(0xFFFFFFFF), 2: low}
    seen = reduce(lambda u, v: u | v, [(at("a") >= i) & (at("b") >= j) & (x("pa") == y("pb")) for i, x in earlier.items() for j, y in earlier.items()])
    cand = met.where((F.col("a") < F.col("b")) & ~seen & (2.0 * F.least(low("na"), low("nb")) >= wanted) & (high("na") + high("nb") - differ >= wanted)).select("a", "b")
    # full signatures: each class travels once to every cell of its row and column of a grid, where pairs found by several words become one
    groups = max(1, -(-rows // SIGNATURES_PER_GROUP))
    group = lambda c: F.pmod(F.xxhash64(c), F.lit(groups))
    cells = F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda i: F.array(group("c") * groups + i, i * groups + group("c")))
    shown = sets.select(F.col("c").alias("id"), "sig", "n", "grp", F.explode(F.array_distinct(F.flatten(cells))).alias("cell"))
    ab = [StructField("a", LongType()), StructField("b", LongType())]
    left = _cells(
        cand.withColumn("cell", group("a") * groups + group("b")), shown, ["cell"], groups * groups, judge_cell, threshold,
        StructType([*ab, StructField("ga", IntegerType()), StructField("gb", IntegerType())]),
    )
    # words: a class travels only to cells that hold a pair of it; sets that are alike mostly share their group
    ends = F.explode(F.array("a", "b")).alias("id")
    needed = left.select("ga", "gb", ends).distinct().join(sets.select(F.col("c").alias("id"), "words"), "id")
    word_groups = max(1, -(-total // WORDS_PER_GROUP))
    return _cells(left, needed, ["ga", "gb"], word_groups * 2, dice_cell, threshold, StructType([*ab, StructField("dice", DoubleType())]))


def _every_pair(links: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b, dice) of the rows of linked classes, and of the rows of one class, whose ids differ; pairs arise behind the last join.

    ``links``: a, b, dice of class numbers. ``members``: c, id. Members fall by hash into blocks, which are what meets; a class of any size is spread.
    """
    sizes = keep(members.groupBy("c").agg(F.count(F.lit(1)).alias("n")), "sizes")
    links = keep(links.unionByName(sizes.where("n > 1").select(F.col("c").alias("a"), F.col("c").alias("b"), F.lit(1.0).alias("dice"))), "links")
    size = lambda x: sizes.select(F.col("c").alias(x), F.col("n").alias(f"n{x}"), F.ceil(F.col("n") / MEMBERS_PER_BLOCK).alias(f"m{x}"))
    met = links.join(size("a"), "a").join(size("b"), "b")
    pairs = met.agg(F.sum(F.col("na") * F.col("nb"))).first()[0] or 0
    tasks = max(1, min(-(-int(pairs) // PAIRS_PER_TASK), MAX_PAIR_TASKS))
    blocked = spread_join(members, size("c"), ["c"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("mc")))
    blocked = blocked.groupBy("c", "block").agg(F.collect_list("id").alias("ids"))  # rows of one id lie in one block
    side = lambda x: blocked.select(F.col("c").alias(x), F.col("block").alias(f"_{x}"), F.col("ids").alias(f"ids_{x}"))
    grid = met.withColumn("_a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ma") - 1))).withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("mb") - 1)))
    grid = grid.where("a <> b or _a <= _b").select("a", "b", "_a", "_b", "dice").join(side("a"), ["a", "_a"])
    both = grid.repartition(tasks, "b", "_b").join(side("b").repartition(tasks, "b", "_b"), ["b", "_b"])
    shown = both.select((F.expr("a = b and _a = _b")).alias("same"), "dice", F.explode("ids_a").alias("x"), "ids_b").select("same", "dice", "x", F.explode("ids_b").alias("y"))
    return shown.where("x < y or (x > y and not same)").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "dice")


def token_similarity_join(df: DataFrame, threshold: float, key: str = "id", words: str = "words", every_pair: bool = False) -> DataFrame:
    """Links (a, b, dice) between rows whose word sets reach ``threshold``; with ``every_pair`` all pairs of such rows, the smaller id first.

    Rows with the same word set form one class, of which one row is compared. As links, each copy is linked to the class's smallest id with
    dice 1, and classes by their smallest ids, so a heap of copies costs one link per row; ``every_pair`` pairs all rows of a class, and of two classes.
    Between classes, a pair can only reach the threshold if it shares one of the rarest words of both: sets are joined on that prefix alone.
    Where the first shared word stands bounds what the rest of both sets can add, and bits in which fixed-width signatures differ are words that
    only one side has: pairs that fail either bound, the second by folded signatures, are dropped in the join on the prefix, so that only the rest
    is shuffled, as pairs of numbers; full signatures, then words, meet them in cells and travel once to a cell. All bounds are exact, so no link is
    lost. Rows without an id are in no pair.
    """
    sized = df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.array_sort(F.array_compact(words)).alias("w")).where(F.size("w") > 0)
    sized = sized.withColumns({"_class": F.unhex(F.sha2(F.array_join("w", SEPARATOR), 256)), "row": F.monotonically_increasing_id()})
    sized = keep(sized, "words")  # texts are cut into words once
    members = keep(sized.select("_class", "id", "row"), "members")
    sets, some_hot = _word_classes(sized, members, threshold)
    discard(sized)
    similar = _similar_classes(sets, some_hot, threshold)
    members = members.drop("row")
    counts = members.groupBy("_class").agg(F.count(F.lit(1)).alias("n"))
    if every_pair:
        numbered = spread_join(members, sets.select("_class", "c"), ["_class"], counts=counts).select("c", "id")
        return _every_pair(similar, keep(numbered, "numbered"))
    heads = sets.select("c", F.col("id").alias("head"))  # the smallest id of the class
    copies = (
        spread_join(members, sets.select("_class", F.col("id").alias("head")), ["_class"], counts=counts)
        .where("id > head")
        .select(F.col("head").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("dice"))
    )
    linked = similar.join(heads.select(F.col("c").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("c").alias("b"), F.col("head").alias("y")), "b")
    linked = linked.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "dice")
    return copies.unionByName(linked)
