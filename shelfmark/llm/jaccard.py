"""N-gram Jaccard join by token-combination prefixes (operator 3).

Documents are sets of word shingles; two link when their Jaccard similarity reaches ``percent``. Nothing is
dropped on the way to the exact comparison that could link:

1. *Classes.* Documents with equal sets form one class, represented by its smallest id; copies cost one star link each.
2. *Extended prefixes.* Shingles are ordered by hash. Two linked sets share at least ``k`` of the first
   ``n - ceil(percent * n) + k`` shingles of each; ``k`` is a twentieth of the set (at least 1). Prefix shingles that stand in
   one class only are dropped, and so are documents left with fewer shared ones than any link needs.
3. *Combinations.* The shared prefix shingles are put in order of frequency and cut once more by the same argument. Rare ones
   (at most ``RARE`` rows) are indexed alone. Frequent ones are dealt by hash into ``G`` token classes and indexed in
   pairs of the same class: the second prefix is longer by ``G``, so linked sets share ``G + 1`` of it, which are a rare one or, by
   the pigeonhole principle, two of a token class. ``G`` is a power of two below the guaranteed overlap of the smaller set; a document
   is indexed for every size its partners can have. Sets so small that only one shared shingle is sure index all alone.
4. *Verification.* Documents that share an index entry share the smallest document of that entry, its leader. Texts go to their leaders'
   groups, large groups are cut into blocks and every pair of blocks is one task-sized unit, and an inverted index over
   the full sets of a unit gives exact intersections. A unit returns only links that join two of its components: no pairs are
   written and the links of a unit are fewer than its documents.
5. *Components* of these links and the copies' stars.

Each document goes to few groups (one per distinct leader), so volumes grow with the input. Comparing different texts
of one family inside a unit is quadratic in the family, spread over its block pairs; equal sets never count.

Null and empty texts and texts without words have an empty set and link with nothing: component_id is their own id. A text with fewer words than a
shingle is one shingle. Rows with a null id get a null component. Rows that repeat an id are one node and each keep
their own n_shingles. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.plans.durable import keep

from .components import components
from .tables import per_slice, table
from .words import mix, windows, words_of

SIZE = 4
PERCENT = 85
RARE = 64
K_SHARE = 20
UNIT_SHINGLES = 500_000


def sets_of(texts: pa.Array, size: int = SIZE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (int64) of every text."""
    words = words_of(texts, lower=True)
    hashes = windows(words.codes, size).view(np.int64)
    out = []
    for first, last in zip(words.starts[:-1].tolist(), words.starts[1:].tolist()):
        if last - first >= size:
            out.append(np.unique(hashes[first : last - size + 1]))
        elif last > first:
            short = windows(words.codes[first:last], last - first)
            out.append(mix(short + np.uint64(last - first)).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of n shares at least with any set it links with."""
    return -(-percent * n // 100)


def sure_shared(n: int) -> int:
    """k: shared shingles that the extended prefixes of two linked sets, the smaller of size n, surely have."""
    return max(1, n // K_SHARE)


def prefix_size(n: int, percent: int) -> int:
    return min(n, n - least_overlap(n, percent) + sure_shared(n))


def token_classes(n: int, percent: int) -> int:
    """G for a smaller set of size n; 0 where all prefix shingles are indexed alone."""
    sure = sure_shared(least_overlap(n, percent))
    return 1 << (sure - 1).bit_length() - 1 if sure > 1 else 0


def class_counts(n: int, percent: int) -> set[int]:
    """The values of G for all sizes the smaller set of a linked pair can have, the other being of size n."""
    return {token_classes(m, percent) for m in range(least_overlap(n, percent), n + 1)}


def index_keys(n: int, tokens: np.ndarray, counts: np.ndarray, percent: int, rare: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the tokens indexed alone, and the keys of indexed pairs; tokens are in order of (count, token)."""
    sure = sure_shared(least_overlap(n, percent))
    if len(tokens) < sure:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    alone: set[int] = set()
    pairs: set[int] = set()
    for g in class_counts(n, percent):
        take = min(len(tokens), len(tokens) - sure + 1 + g)
        if not g:
            alone.update(range(take))
            continue
        alone.update(np.flatnonzero(counts[:take] <= rare).tolist())
        frequent = tokens[:take][counts[:take] > rare]
        for one in np.unique(frequent & (g - 1)):
            mine = np.sort(frequent[frequent & (g - 1) == one]).view(np.uint64)
            i, j = np.triu_indices(len(mine), 1)
            with np.errstate(over="ignore"):
                pairs.update(mix(mix(mine[i] + np.uint64(g)) * np.uint64(3) + mine[j]).view(np.int64).tolist())
    return np.array(sorted(alone), np.int64), np.array(sorted(pairs), np.int64)


def shapes(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n, the identity of the set and its extended prefix."""

    def work():
        def one(batch: pa.RecordBatch) -> dict:
            found = sets_of(batch.column("text"), size)
            digests = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in found]
            signed = lambda v: v - (1 << 64) if v >> 63 else v
            return {
                "doc_id": batch.column("doc_id"), "n": [len(s) for s in found],
                "hi": [signed(d >> 64) for d in digests], "lo": [signed(d & (1 << 64) - 1) for d in digests],
                "prefix": [s[: prefix_size(len(s), percent)] for s in found],
            }

        return one

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return per_slice(read, work, "doc_id long, n long, hi long, lo long, prefix array<long>")


def _index(shared: DataFrame, percent: int, rare: int) -> DataFrame:
    """(doc_id, n, leader, key): a leader for tokens indexed alone, a key for pairs whose leader is still to be found."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            ids, sizes = batch.column("doc_id").to_pylist(), batch.column("n").to_pylist()
            for doc, n, held in zip(ids, sizes, batch.column("held")):
                flat = held.values.flatten()
                counts, tokens, leaders = (c.to_numpy(zero_copy_only=False) for c in flat)
                order = np.lexsort((tokens, counts))
                alone, pairs = index_keys(n, tokens[order], counts[order], percent, rare)
                out += [(doc, n, x, None) for x in np.unique(leaders[order][alone]).tolist()]
                out += [(doc, n, None, k) for k in pairs.tolist()]
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], names=["doc_id", "n", "leader", "key"]
            )

    return shared.mapInArrow(work, "doc_id long, n long, leader long, key long")


def candidate_groups(filled: DataFrame, copies: DataFrame, percent: int = PERCENT, rare: int = RARE) -> DataFrame:
    """(doc_id, n, leader): two linked documents of different classes have a leader in common. ``copies`` are left out."""
    tokens = filled.select("doc_id", "n", "hi", F.explode("prefix").alias("token"))
    shared = (
        tokens.groupBy("token")
        .agg(
            F.min("doc_id").alias("leader"), F.count(F.lit(1)).alias("rows"),
            F.min("hi").alias("least"), F.max("hi").alias("most"),  # half of the identity of a set; copies agree in it
        )
        .where("least <> most").drop("least", "most")
    )
    held = (
        tokens.join(shared, "token")
        .groupBy("doc_id", "n", "hi")  # at most the prefix of one document
        .agg(F.collect_set(F.struct("rows", "token", "leader")).alias("held"))
        .join(copies.select("doc_id", "n", "hi"), ["doc_id", "n", "hi"], "left_anti")
        .select("doc_id", "n", "held")
    )
    index = keep(_index(held, percent, rare), "index")
    pairs = index.where("key is not null").select("doc_id", "n", "key")
    first = pairs.groupBy("key").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last")).where("leader <> last")
    both = index.where("leader is not null").select("doc_id", "n", "leader").unionByName(
        pairs.join(first.select("key", "leader"), "key").select("doc_id", "n", "leader")
    )
    return both.distinct()


def links_in(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that span the components of a unit. ``side`` 0 and 1: only pairs across sides count; all 0: all pairs."""
    across = bool(side.any())
    if len(sets) < 2 or across and side.all():
        return []
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    count = np.diff(np.append(first, len(flat)))
    token = np.repeat(np.arange(len(first)), count)
    several = count[token] > 1
    by_doc = np.argsort(owner[several], kind="stable")
    mine = token[several][by_doc]
    bounds = np.searchsorted(owner[several][by_doc], np.arange(len(sets) + 1))
    parent = np.arange(len(sets))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    found = []
    for x in range(len(sets)):
        t = mine[bounds[x] : bounds[x + 1]]
        if not len(t):
            continue
        n = count[t]
        ends = np.cumsum(n)
        inter = np.bincount(owner[np.repeat(first[t] - (ends - n), n) + np.arange(ends[-1])], minlength=len(sets))
        if across:
            if not side[x]:
                continue
            inter[side == 1] = 0
        else:
            inter[x:] = 0
        union = sizes + sizes[x] - inter
        for y in np.flatnonzero((inter > 0) & (100 * inter >= percent * union)).tolist():
            a, b = root(x), root(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
                found.append((int(ids[x]), int(ids[y])))
    return found


def verified_links(groups: DataFrame, docs: DataFrame, size: int, percent: int, unit: int = UNIT_SHINGLES) -> DataFrame:
    """(a, b): links that connect what is connected, from the exact comparison inside every leader's group."""
    sizes = groups.groupBy("leader").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles")).where("docs > 1")
    blocks = F.ceil(F.col("shingles") / unit).cast("int")
    members = groups.join(sizes.select("leader", blocks.alias("blocks")), "leader").select(
        "doc_id", "n", "leader", "blocks", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("mine")
    )
    members = keep(members, "members")
    wanted = keep(members.select("doc_id").distinct(), "wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted.hint("shuffle_hash"), "doc_id", "left_semi")
    # block pair (i, j) with i <= j holds blocks i and j; a document of block m goes to all pairs with m
    units = members.join(texts, "doc_id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select(
        "leader", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "doc_id", "text"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sides, held = None, [], [], []

        def close() -> pa.RecordBatch:
            sets = sets_of(pa.array(held, pa.string()), size)
            found = links_in(np.array(ids, np.int64), sets, np.array(sides, np.int64), percent)
            a, b = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("leader", "i", "j", "mine", "doc_id")]
            texts = batch.column("text")
            for r, (leader, i, j, mine, doc) in enumerate(zip(*columns)):
                if (leader, i, j) != key:
                    if len(ids) > 1:
                        yield close()
                    key, ids, sides, held = (leader, i, j), [], [], []
                ids.append(doc)
                sides.append(int(mine != i))
                held.append(texts[r].as_py())
        if len(ids) > 1:
            yield close()

    # as many partitions as the session deals by, whatever the adaptive planner thinks of their bytes: units are work, not bytes
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = units.repartition(parts, "leader", "i", "j").sortWithinPartitions("leader", "i", "j", "doc_id")
    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, size: int = SIZE, percent: int = PERCENT, rare: int = RARE, unit: int = UNIT_SHINGLES
) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    known = keep(shapes(docs, size, percent), "shapes")
    filled = known.where("n > 0 and doc_id is not null")
    classes = filled.groupBy("n", "hi", "lo").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))
    several = keep(classes.where("rep <> last").drop("last"), "classes")
    copies = keep(
        filled.select("doc_id", "n", "hi", "lo").join(several, ["n", "hi", "lo"]).where("doc_id <> rep").distinct(), "copies"
    )
    groups = candidate_groups(filled, copies, percent, rare)
    links = verified_links(groups, docs, size, percent, unit)
    stars = copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    reached = keep(components(links.unionByName(stars)), "components")
    return known.select("doc_id", F.col("n").alias("n_shingles")).join(
        reached.withColumnRenamed("node", "doc_id"), "doc_id", "left"
    ).select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
