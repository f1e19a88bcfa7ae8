"""Duplicate evidence as edges, components, groups and their resolution."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions import fixed_values as fv
from ..functions.numbers import truthy
from ..plans.durable import discard, keep
from ..plans.skew import spread_join, top_n
from .alignment import score_cell
from .lookups import duration_window_pairs, exclude_dismissed, redirect_references, same_key_far_pairs
from .ordering import first_non_null_merge, keeper_columns, keeper_order, resolve_path_collisions


def _star_edges(df: DataFrame, key: str) -> DataFrame:
    """(src, dst): every member of a key linked to the key's smallest id. One edge per row."""
    heads = df.groupBy(key).agg(F.min("id").alias("src"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return (
        spread_join(df.select(key, F.col("id").alias("dst")), heads.drop("n"), [key], counts=heads.select(key, "n"))
        .where("dst <> src")
        .select("src", "dst")
    )


def exact_edges(df: DataFrame) -> DataFrame:
    """Same content hash; rows whose hash is missing or marked 'error' are left out."""
    return _star_edges(df.where("audio_hash is not null and audio_hash not in ('', 'error')"), "audio_hash")


def metadata_edges(df: DataFrame) -> DataFrame:
    """Same match key, whatever the length."""
    return _star_edges(df.where("match_key is not null"), "match_key")


# ---- acoustic ----------------------------------------------------------------------------------


def prints_of(frames: DataFrame) -> DataFrame:
    """(id, frames array, length): the ordered frames of each row; one print per row of the catalog."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "frame"))), lambda x: x["frame"])
    return frames.groupBy("id").agg(ordered.alias("frames")).withColumn("length", F.size("frames"))


FRAMES_PER_GROUP = 1_000_000
PRINTS_PER_GROUP = 2048


def acoustic_similarity(
    pairs: DataFrame, prints: DataFrame, threshold: float | None = fv.ACOUSTIC_THRESHOLD
) -> DataFrame:
    """(a, b, offset, similarity) of candidate pairs, linked ones only unless ``threshold`` is None.

    Shared keys vote for the shift of b against a; the shift with most votes (the smallest on ties, 0
    without votes) is scored by bit errors, and its two neighbours too when it is close at all. Prints
    are met twice, so they are written once. Pairs without a print on either side give nothing.
    """
    return _align_and_score(pairs, keep(prints.select("id", "frames", "length"), "prints"), threshold)


def _align_and_score(pairs: DataFrame, prints: DataFrame, threshold: float | None) -> DataFrame:
    """``acoustic_similarity`` over prints that are already written.

    Prints fall by hash into groups of about ``FRAMES_PER_GROUP`` frames and ``PRINTS_PER_GROUP`` prints at most, and pairs into the cells of the grid of groups. A pair travels
    alone, once; a print travels to the cells of its row and column of the grid; both sides meet in ``score_cell``.
    """
    frames, rows = prints.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()
    groups = max(1, -(-int(frames) // FRAMES_PER_GROUP), -(-rows // PRINTS_PER_GROUP))
    group = lambda c: F.pmod(F.xxhash64(c), F.lit(groups))
    asked = pairs.select("a", "b", (group("a") * groups + group("b")).alias("cell"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda i: F.array(group("id") * groups + i, i * groups + group("id")))
    shown = prints.select("id", "frames", F.explode(F.array_distinct(F.flatten(cells))).alias("cell"))
    kinds = {f.name: f.dataType for f in pairs.select("a", "b").schema}
    out = StructType([*[StructField(c, k) for c, k in kinds.items()], StructField("offset", IntegerType()), StructField("similarity", DoubleType())])
    arrow = to_arrow_schema(out)

    def scored(asked_here: pa.Table, shown_here: pa.Table) -> pa.Table:
        found, shifts, alike = score_cell(asked_here, shown_here)
        return pa.Table.from_arrays([found.column("a"), found.column("b"), pa.array(shifts, pa.int32()), pa.array(alike)], schema=arrow)

    # as many partitions as cells: the bytes of a cell say nothing about the work in it
    spread = lambda df: df.repartition(groups * groups, "cell").groupBy("cell")
    found = spread(asked.where("a is not null and b is not null")).cogroup(spread(shown)).applyInArrow(scored, out)
    return found if threshold is None else found.where(F.col("similarity") >= threshold)


def distinct_recordings(lib: DataFrame, prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Collapse rows that sound, last and are named alike before any pair is formed.

    Returns the representatives (id, duration_ms, match_key) and star edges (src, dst, similarity) from
    each to its copies: equal prints score 1 when long enough to compare, else nothing.
    """
    sound = F.sha2(F.array_join(F.transform("frames", lambda f: f.cast("string")), ","), 256)
    heard = lib.where("duration_ms > 0").select("id", "duration_ms", "match_key").join(
        prints.where("length > 0").select("id", "length", sound.alias("_sound")), "id"
    ).withColumn("_same", F.sha2(F.concat_ws("|", "_sound", F.col("duration_ms").cast("string"), F.coalesce("match_key", F.lit("\u0000"))), 256))
    heads = heard.groupBy("_same").agg(
        F.min("id").alias("src"), F.count(F.lit(1)).alias("n"), F.first("duration_ms").alias("duration_ms"), F.first("match_key").alias("match_key")
    )
    copies = (
        spread_join(heard.select("_same", "length", F.col("id").alias("dst")), heads.where("n > 1").select("_same", "src"), ["_same"], counts=heads.select("_same", "n"))
        .where((F.col("dst") != F.col("src")) & (F.col("length") >= fv.MIN_OVERLAP))
        .select("src", "dst", F.lit(1.0).alias("similarity"))
    )
    return heads.select(F.col("src").alias("id"), "duration_ms", "match_key"), copies


def acoustic_edges(
    lib: DataFrame, frames: DataFrame, window_ms: int = fv.DURATION_WINDOW_MS, threshold: float = fv.ACOUSTIC_THRESHOLD
) -> DataFrame:
    """(src, dst, similarity) between rows that sound alike: within the window, or of one key beyond it."""
    prints = keep(prints_of(frames), "prints")
    reps, copies = distinct_recordings(lib, prints)
    pairs = duration_window_pairs(reps, window_ms).unionByName(same_key_far_pairs(reps, window_ms))
    found = _align_and_score(pairs, prints, threshold)
    return found.select(F.col("a").alias("src"), F.col("b").alias("dst"), "similarity").unionByName(copies)


# ---- graph -------------------------------------------------------------------------------------


def edge_union(exact: DataFrame, metadata: DataFrame, acoustic: DataFrame | None = None) -> DataFrame:
    """One row per undirected pair (smaller id first) with its reasons and best similarity."""
    none = F.lit(None).cast("double")
    tagged = exact.select("src", "dst", F.lit("exact").alias("reason"), none.alias("similarity")).unionByName(
        metadata.select("src", "dst", F.lit("metadata").alias("reason"), none.alias("similarity"))
    )
    if acoustic is not None:
        tagged = tagged.unionByName(acoustic.select("src", "dst", F.lit("acoustic").alias("reason"), "similarity"))
    is_ = lambda r: F.bool_or(F.col("reason") == r).alias(r)
    return tagged.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(
        is_("exact"), is_("acoustic"), is_("metadata"), F.max("similarity").alias("similarity")
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node that has an edge; the component is its smallest id.

    Alternating large-star and small-star rounds (Kiveris et al. 2014). Minima combine before the
    shuffle, hub nodes are spread over tasks, and each round is written to the checkpoint folder, so
    lineage stays short and a lost executor costs one round. Ends when every tree is a star.
    """
    work = keep(
        edges.select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).where("lo <> hi").distinct(),
        "components",
    )
    while not _only_stars(work):  # a round that finds no star moves at least one link to a smaller node
        rows = work.count()  # read from the written files' footers
        nxt = keep(_small_star(_large_star(work, rows), rows), "components")
        discard(work)
        work = nxt
    return work.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(
        work.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct()
    )


def _large_star(e: DataFrame, rows: int) -> DataFrame:
    """Link each node's larger neighbours to the smallest node around it."""
    sides = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(
        e.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    )
    least = sides.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    least = least.select("u", F.least("u", "m").alias("m"), "n")
    return (
        spread_join(sides, least.drop("n"), ["u"], counts=least.select("u", "n"), rows=2 * rows)
        .where("v > u")
        .select(F.col("m").alias("lo"), F.col("v").alias("hi"))
        .distinct()
    )


def _small_star(e: DataFrame, rows: int) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them."""
    least = e.groupBy("hi").agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = (
        spread_join(e, least.drop("n"), ["hi"], counts=least.select("hi", "n"), rows=2 * rows)
        .where("lo <> m")
        .select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
    )
    return moved.unionByName(least.select(F.col("m").alias("lo"), "hi")).distinct()


def _only_stars(e: DataFrame) -> bool:
    """True when no node is both a centre and a leaf, and every leaf has one centre."""
    ends = e.select(F.col("lo").alias("node"), F.lit(0).alias("up")).unionByName(
        e.select(F.col("hi").alias("node"), F.lit(1).alias("up"))
    )
    roles = ends.groupBy("node").agg(F.min("up").alias("lowest"), F.sum("up").alias("ups"))
    return roles.where("ups > 1 or (lowest = 0 and ups > 0)").isEmpty()


def duplicate_members(lib: DataFrame, components: DataFrame) -> DataFrame:
    """Catalog rows of every group with quality, completeness and copy-name columns."""
    return keeper_columns(lib.join(components, "id"))


def duplicate_groups(
    lib: DataFrame, edges: DataFrame, components: DataFrame, dismissals: DataFrame | None = None
) -> DataFrame:
    """One row per group: size, reasons, best similarity, keeper, bytes and reclaimable bytes."""
    members = duplicate_members(lib, components).withColumn("_order", keeper_order())
    groups = members.groupBy("component").agg(
        F.count(F.lit(1)).alias("files"),
        F.min(F.struct("_order", "size")).alias("_best"),
        F.sum("size").alias("bytes"),
        F.min_by("artist", "id").alias("first_artist"),
    )
    # an edge's larger end is never a component's smallest id, so it has exactly one row to meet
    label = components.where("id <> component").withColumnRenamed("id", "dst")
    why = edges.join(label, "dst").groupBy("component").agg(
        *[F.bool_or(r).alias(r) for r in ("exact", "acoustic", "metadata")], F.max("similarity").alias("similarity")
    )
    reasons = F.array_join(F.array_compact(F.array(*[F.when(F.col(r), r) for r in ("exact", "acoustic", "metadata")])), ",")
    out = groups.join(why, "component").select(
        "component", "files", reasons.alias("reasons"), "exact", "acoustic", "metadata", "similarity",
        F.col("_best._order.id").alias("keeper_id"), "bytes", (F.col("bytes") - F.col("_best.size")).alias("reclaimable"), "first_artist",
    )
    return out if dismissals is None else exclude_dismissed(out, components, dismissals)


def find_duplicates(
    lib: DataFrame,
    frames: DataFrame | None = None,
    dismissals: DataFrame | None = None,
    window_ms: int = fv.DURATION_WINDOW_MS,
    threshold: float = fv.ACOUSTIC_THRESHOLD,
) -> DataFrame:
    """The whole search: three kinds of evidence, one graph, groups with keepers."""
    sound = acoustic_edges(lib, frames, window_ms, threshold) if frames is not None else None
    edges = keep(edge_union(exact_edges(lib), metadata_edges(lib), sound), "edges")
    return duplicate_groups(lib, edges, connected_components(edges), dismissals)


def duplicate_summary(groups: DataFrame) -> DataFrame:
    """Groups per reason, all groups, and reclaimable bytes; a group counts once per reason."""
    return groups.agg(
        *[F.count_if(r).alias(f"{r}_groups") for r in ("exact", "acoustic", "metadata")],
        F.count(F.lit(1)).alias("groups"),
        F.coalesce(F.sum("reclaimable"), F.lit(0)).alias("reclaimable"),
    )


# ---- resolution --------------------------------------------------------------------------------


_GIVEN = ("artwork", "lyrics")


def _donors(chosen: DataFrame) -> DataFrame:
    """(id, artwork_from, lyrics_from) of keepers that are given something; sums per group, so a group may have any size."""
    figures = []
    for c in _GIVEN:
        has = F.coalesce(F.col(f"has_{c}"), F.lit(False)) if f"has_{c}" in chosen.columns else F.lit(False)
        figures += [F.bool_or(F.col("is_keeper") & has).alias(f"_own_{c}"), F.min(F.when(~F.col("is_keeper") & has, F.col("id"))).alias(f"_{c}")]
    per = chosen.groupBy("component").agg(F.max(F.when(F.col("is_keeper"), F.col("id"))).alias("id"), *figures)
    given = per.select("id", *[F.when(~F.col(f"_own_{c}"), F.col(f"_{c}")).alias(f"{c}_from") for c in _GIVEN])
    return given.where(F.col("id").isNotNull() & F.coalesce(*[F.col(f"{c}_from") for c in _GIVEN]).isNotNull())


def resolve_duplicates(
    lib: DataFrame, decisions: DataFrame, day: str, quarantine: str = "quarantine", tracks: DataFrame | None = None, log: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Apply decisions (component, id, keep) to the catalog.

    Returns the merged library, the quarantined rows with their dated path, the log rows and, when
    ``tracks`` is given, the job history pointing at the survivors. Paths already used in the
    quarantine log are avoided. ``donors`` names, for each keeper without artwork or lyrics, the removed row with the smallest id that has them; the
    keeper counts as having them from then on.
    """
    chosen = lib.join(decisions.select("id", "component", F.col("keep").alias("is_keeper")), "id")
    merged = first_non_null_merge(chosen).withColumnRenamed("keeper_id", "id").drop("component")
    filled = [c for c in merged.columns if c != "id"]
    patched = lib.join(merged.select("id", *[F.col(c).alias(f"_{c}") for c in filled]), "id", "left")
    # an empty value of the keeper is filled; anything else stays as it is
    patched = patched.withColumns(
        {c: F.when(truthy(F.col(c)), F.col(c)).otherwise(F.coalesce(f"_{c}", c)) for c in filled}
    ).select(lib.columns)
    gone = chosen.where("not is_keeper")
    donors = _donors(chosen)
    taken = donors.select("id", *[F.col(f"{c}_from").isNotNull().alias(f"_{c}") for c in _GIVEN])
    patched = patched.join(taken, "id", "left").withColumns(
        {f"has_{c}": F.col(f"has_{c}") | F.coalesce(f"_{c}", F.lit(False)) for c in _GIVEN if f"has_{c}" in lib.columns}
    ).select(lib.columns)
    library = patched.join(gone.select("id"), "id", "left_anti")
    plan = gone.select("id", F.col("rel_path").alias("from_path"), F.concat(F.lit(f"{quarantine}/{day}/"), "rel_path").alias("to_path"), F.lit(True).alias("changed"))
    used = (log.select(F.col("to_path").alias("path")) if log is not None else plan.select(F.col("to_path").alias("path")).limit(0))
    moved = resolve_path_collisions(plan, used).drop("changed")
    entries = moved.join(gone.select("id", "title", "artist", "size"), "id").select(
        F.lit("quarantine").alias("kind"), "from_path", "to_path",
        F.create_map(
            F.lit("id"), F.col("id").cast("string"), F.lit("title"), F.col("title"),
            F.lit("artist"), F.col("artist"), F.lit("size"), F.col("size").cast("string"),
        ).alias("detail"),
    )
    out = {"library": library, "quarantine": moved, "log": entries, "donors": donors}
    if tracks is not None:
        survivor = chosen.where("is_keeper").select("component", F.col("rel_path").alias("to_path"))
        moves = spread_join(
            gone.select("component", "id", F.col("rel_path").alias("from_path")), survivor, ["component"]
        ).select("from_path", "to_path")
        out["tracks"] = redirect_references(tracks, moves)
    return out


def quarantine_view(log: DataFrame) -> DataFrame:
    """Quarantine entries whose file is still there: the last word on that path, neither restored nor
    deleted since. Newest first."""
    q = log.where("kind = 'quarantine'").select("op_id", "from_path", "to_path", "at", "detail")
    last = top_n(q, ["to_path"], [F.col("op_id").desc()])
    left = log.where("kind in ('restore', 'delete')").groupBy(F.col("from_path").alias("to_path")).agg(F.max("op_id").alias("_left"))
    return (
        last.join(left, "to_path", "left")
        .where("_left is null or _left < op_id")
        .select("op_id", "from_path", "to_path", "at", "detail")
        .orderBy(F.col("at").desc(), F.col("op_id").desc())
    )


def _steps(path: Column) -> Column:
    """Names along a path, with ``.`` and ``..`` resolved."""
    none = F.array().cast("array<string>")
    return F.aggregate(
        F.split(path, "/"), none,
        lambda acc, s: F.when(s.isin("", "."), acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(
            F.concat(acc, F.array(s))
        ),
    )


def purge(log: DataFrame, ids: DataFrame, quarantine: str = "quarantine") -> DataFrame:
    """Log rows that delete quarantined files for good, one per path, for the quarantine entries ``ids`` (op_id).

    Only files that are still there go, and only paths that lie below the quarantine folder once ``..`` is resolved; whatever else is
    asked for is left alone.
    """
    asked = log.where("kind = 'quarantine'").join(ids.select("op_id").distinct(), "op_id", "left_semi").select("to_path").distinct()
    there = quarantine_view(log).select("to_path").distinct()
    root = [s for s in quarantine.split("/") if s not in ("", ".")]
    steps = _steps(F.col("to_path"))
    inside = (F.size(steps) > len(root)) & (F.array_join(F.slice(steps, 1, len(root)), "/") == "/".join(root))
    found = asked.join(there, "to_path", "left_semi").where(inside)
    return found.select(F.lit("delete").alias("kind"), F.col("to_path").alias("from_path"), F.lit(None).cast("string").alias("to_path"))


def restore(log: DataFrame, ids: DataFrame, existing: DataFrame) -> DataFrame:
    """Log rows that bring quarantined entries back: to their old path, or the next free one."""
    back = quarantine_view(log).join(ids.select("op_id"), "op_id", "left_semi")
    plan = back.select(F.col("op_id").alias("id"), F.col("to_path").alias("from_path"), F.col("from_path").alias("to_path"), F.lit(True).alias("changed"))
    return resolve_path_collisions(plan, existing).select(F.lit("restore").alias("kind"), "from_path", "to_path")
