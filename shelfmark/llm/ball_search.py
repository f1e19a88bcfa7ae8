"""Ranked lexical search by exact sparse ball-tree inner-product search (operator 13).

A document is a sparse vector of integer impacts, ``(10**9 * tf) div (1000 * tf + 12 * m)`` for each term, a query the integer weights of its terms
times their repeats; the score is their inner product. Only terms of the queries are kept, so vectors are small; they are
written once, after which one sum gives the document count, the total length and the document frequencies that the weights need.

Vectors are dealt in the order of their rarest query terms (rarest among the queries), so documents that share a passage are neighbours. A task cuts its
vectors into chunks of ``CHUNK_DOCS`` documents or ``CHUNK_TERMS`` terms and builds a ball tree over each: a node has the centroid of
its documents and a radius that holds all of them; it is split in half along the line between two far documents until ``LEAF_DOCS`` are left. Equal
documents are halved by place, so copies never stop the build.

A query takes nodes best first by ``q . c + |q| * r``, an upper bound of every score below the node, and stops when the best bound is under the
score that is needed: that of the last of its best documents so far, or of a floor known before. Bounds are made safe: each sum
is raised by its largest rounding error, the radius by the error of the distances, so no document is lost. Coordinates are scaled by the
root of the weights, which changes no product and makes the bounds tighter. At leaves, scores are exact 64-bit integers.

The floors are the last of the best documents of a bounded sample (``SAMPLE_DOCS`` expected), by score and id: never before the true ones, so they
only spare work, also where thousands of copies have one score. Every task returns at most ``top`` documents for each query, the best of which are taken by rank filters.

Queries are taken in blocks of at most ``BLOCK_BYTES`` of text; a larger query set is worked off block by block, documents being cut into terms once for each (one
larger query is a block of its own). Null texts and texts without terms are no documents and no queries. Each row of either table counts, also where
it repeats an id; results of rows with equal ids stand beside each other. Null ids are returned, last among equal scores. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfmark.plans.durable import keep
from shelfmark.plans.skew import top_n

from .byte_words import byte_classes, cut_words, raw_texts
from .tables import per_slice, table

TOP = 20
BLOCK_BYTES = 8 << 20
CHUNK_DOCS = 8192
CHUNK_TERMS = 2_000_000
LEAF_DOCS = 64
SAMPLE_DOCS = 8192
SAMPLE_TASKS = 6  # each returns its best for every query, so a bounded sample takes few
_GAPS = bytes(b for b in range(128) if not chr(b).isalnum())
_VECTOR = "doc_id long, n long, terms array<int>, tfs array<int>"
_HIT = "query int, item_id long, doc_id long, score long"
_ULP = 2.0**-52
NO_ID = np.iinfo(np.int64).max  # a null id comes last


class Query(NamedTuple):
    item_id: int | None
    terms: np.ndarray  # int32, numbers in the vocabulary of the block
    repeats: np.ndarray  # int64


class Block(NamedTuple):
    vocabulary: list[bytes]
    queries: list[Query]


def terms_of(text: str | None) -> list[bytes]:
    data, offsets = raw_texts(pa.array([text], pa.string()))
    cut = cut_words(data, offsets, byte_classes(_GAPS))
    return cut.words.take(pa.array(cut.codes)).to_pylist()


def block_of(items: list[tuple[int | None, str | None]]) -> Block:
    """Terms that few queries hold come first in the vocabulary."""
    counted = [(k, Counter(terms_of(text))) for k, text in items]
    held = Counter(t for _, c in counted for t in c)
    vocabulary = sorted(held, key=lambda t: (held[t], t))
    number = {t: i for i, t in enumerate(vocabulary)}
    queries = [
        Query(k, np.array([number[t] for t in c], np.int32), np.array(list(c.values()), np.int64)) for k, c in counted if c
    ]
    return Block(vocabulary, queries)


def blocks_of(items: DataFrame, block_bytes: int) -> Iterator[Block]:
    read = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = read.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):  # one in practice; a larger query set is taken block by block
        rows = (read if n == 1 else read.where(part == k)).orderBy("item_id", "text").toLocalIterator()
        yield block_of([(r.item_id, r.text) for r in rows])


def vectors(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n (all terms), terms (numbers in the vocabulary, rising) and tfs of the documents with a term."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def work():
        classes, known = byte_classes(_GAPS), pa.array(sent.value, pa.large_binary())

        def one(batch: pa.RecordBatch) -> dict:
            cut = cut_words(*raw_texts(batch.column("text")), classes)
            n = np.bincount(cut.text, minlength=batch.num_rows)
            number = pc.index_in(cut.words, value_set=known).fill_null(-1).to_numpy().astype(np.int64)
            term = number[cut.codes]
            inside = term >= 0
            base = max(len(known), 1)
            both, tfs = np.unique(cut.text[inside] * base + term[inside], return_counts=True)
            ends = np.searchsorted(both, np.arange(batch.num_rows + 1, dtype=np.int64) * base).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.int32))) for v in (both % base, tfs)]
            return {"doc_id": batch.column("doc_id"), "n": n, "terms": lists[0], "tfs": lists[1]}

        return one

    return keep(per_slice(read, work, _VECTOR).where("n > 0"), "vectors")


class Rows(NamedTuple):
    """Sparse rows: row i has ``terms[starts[i]:starts[i + 1]]``."""

    starts: np.ndarray
    terms: np.ndarray
    values: np.ndarray

    def take(self, rows: np.ndarray) -> Rows:
        sizes = (self.starts[1:] - self.starts[:-1])[rows]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.repeat(self.starts[rows] - starts[:-1], sizes) + np.arange(starts[-1])
        return Rows(starts, self.terms[flat], self.values[flat])

    def sums(self, products: np.ndarray) -> np.ndarray:
        return np.add.reduceat(products, self.starts[:-1])  # no row is empty


class Node(NamedTuple):
    terms: np.ndarray
    center: np.ndarray
    radius: float
    children: tuple[int, ...]
    first: int  # documents of the node, in the order of the tree
    last: int


class Tree(NamedTuple):
    nodes: list[Node]  # the first one is the root
    rows: Rows  # exact impacts in the order of the tree
    order: np.ndarray  # rows of the chunk


def raised(value: float, n: int) -> float:
    """At least the exact sum of ``n`` products of numbers >= 0 whose rounded sum is ``value``."""
    return value * (1.0 + (n + 16) * _ULP)


def build(rows: Rows, roots: np.ndarray, leaf_docs: int = LEAF_DOCS) -> Tree:
    """Ball tree over impacts; ``roots`` are the square roots of the weights by term."""
    used, local = np.unique(rows.terms, return_inverse=True)
    scaled = Rows(rows.starts, local, rows.values * roots[rows.terms])
    width, n = len(used), len(rows.starts) - 1
    squares = scaled.sums(scaled.values**2)
    order = np.arange(n)
    nodes: list[Node | None] = [None]
    todo = [(0, 0, n)]
    while todo:
        at, first, last = todo.pop()
        mine = order[first:last]
        part = scaled.take(mine)
        center = np.bincount(part.terms, part.values, width) / (last - first)
        far = squares[mine] - 2 * part.sums(part.values * center[part.terms]) + (center @ center)
        longest = int(np.diff(part.starts).max())
        slack = 8 * (longest + width + 16) * _ULP * (squares[mine] + center @ center)  # differences of near equals lose digits
        radius = raised(math.sqrt(float(np.max(np.maximum(far, 0) + slack))), 16)
        children: tuple[int, ...] = ()
        if last - first > leaf_docs:
            dense = np.zeros(width)
            one = scaled.take(mine[[int(np.argmax(far))]])
            dense[one.terms] = one.values
            to_one = part.sums(part.values * dense[part.terms])
            other = scaled.take(mine[[int(np.argmax(squares[mine] - 2 * to_one))]])
            dense[other.terms] -= other.values
            order[first:last] = mine[np.argsort(part.sums(part.values * dense[part.terms]), kind="stable")]
            middle = (first + last) // 2
            children = (len(nodes), len(nodes) + 1)
            nodes += [None, None]
            todo += [(children[0], first, middle), (children[1], middle, last)]
        some = np.flatnonzero(center)
        nodes[at] = Node(used[some], center[some], radius, children, first, last)
    return Tree(nodes, rows.take(order), order)


def search(
    tree: Tree, ids: np.ndarray, exact: np.ndarray, scaled: np.ndarray, norm: float, floor: tuple[int, int], top: int
) -> list[tuple[int, int]]:
    """The best documents of a query as (score, place in ``ids``), best first, none behind the document ``floor`` (score, id)."""

    def bound(k: int) -> float:
        node = tree.nodes[k]
        products = scaled[node.terms] * node.center
        return raised(float(products.sum()), len(products)) + raised(norm * node.radius, 16)

    best_scores, best_at = np.zeros(0, np.int64), np.zeros(0, np.int64)
    need, need_id = floor if floor[0] > 0 else (1, NO_ID)
    queue = [(-bound(0), 0)]
    while queue:
        upper, k = heapq.heappop(queue)
        if -upper * (1 + 4 * _ULP) < math.nextafter(float(need), 0):
            break
        node = tree.nodes[k]
        if node.children:
            for child in node.children:
                heapq.heappush(queue, (-bound(child), child))
            continue
        a, b = tree.rows.starts[node.first], tree.rows.starts[node.last]
        scores = np.add.reduceat(exact[tree.rows.terms[a:b]] * tree.rows.values[a:b], tree.rows.starts[node.first : node.last] - a)
        good = np.flatnonzero((scores > need) | ((scores == need) & (ids[tree.order[node.first : node.last]] <= need_id)))
        if len(good):
            best_scores = np.concatenate([best_scores, scores[good]])
            best_at = np.concatenate([best_at, tree.order[node.first + good]])
            keepers = np.lexsort((ids[best_at], -best_scores))[:top]
            best_scores, best_at = best_scores[keepers], best_at[keepers]
            if len(best_at) == top:
                need, need_id = int(best_scores[-1]), int(ids[best_at[-1]])
    return list(zip(best_scores.tolist(), best_at.tolist()))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, docs, terms = [], 0, 0
    for batch in batches:
        sizes = pc.list_value_length(batch.column("terms")).to_numpy()
        first = 0
        while first < batch.num_rows:
            ahead = np.cumsum(sizes[first:])
            fit = int(np.searchsorted(ahead, CHUNK_TERMS - terms, side="right"))
            take = min(max(fit, 0 if held else 1), CHUNK_DOCS - docs, batch.num_rows - first)
            if take:
                held.append(batch.slice(first, take))
                docs, terms, first = docs + take, terms + int(ahead[take - 1]), first + take
            if first < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, docs, terms = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def dealt(some: DataFrame) -> DataFrame:
    """Vectors in an order in which documents with the same rare terms are neighbours; the id splits terms that many documents share."""
    route = [F.get("terms", F.lit(i)) for i in range(3)] + [F.col("doc_id")]
    return some.where(F.size("terms") > 0).repartitionByRange(*route).sortWithinPartitions(*route)


def hits(some: DataFrame, block: Block, weights: np.ndarray, n_docs: int, n_terms: int, floors: list[tuple[int, int]], top: int) -> DataFrame:
    """query (place in the block), item_id, doc_id, score: at most ``top`` for each query and chunk, never less than the best."""
    spark = some.sparkSession
    sent = spark.sparkContext.broadcast((block.queries, weights, floors))
    schema = to_arrow_schema(T.StructType.fromDDL(_HIT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights, floors = sent.value
        roots = np.sqrt(weights.astype(np.float64))
        exact, scaled = np.zeros(len(weights), np.int64), np.zeros(len(weights))
        for chunk in _chunks(batches):
            columns = [chunk.column(c).combine_chunks() for c in ("terms", "tfs")]
            lengths = pc.list_value_length(columns[0]).to_numpy()
            terms, tfs = (c.flatten().to_numpy().astype(np.int64) for c in columns)
            n = chunk.column("n").to_numpy()
            m = np.repeat(100 - 25 + (25 * n * n_docs) // n_terms, lengths)
            impacts = (1_000_000_000 * tfs) // (1000 * tfs + 12 * m)
            owner = np.repeat(np.arange(len(n)), lengths)
            counts = weights[terms] > 0  # a term of weight 0 adds nothing
            left, starts = np.unique(owner[counts], return_index=True)
            if not len(left):
                continue
            given = chunk.column("doc_id").take(pa.array(left)).combine_chunks()
            ids = given.fill_null(NO_ID).to_numpy()
            tree = build(Rows(np.append(starts, int(counts.sum())), terms[counts], impacts[counts]), roots)
            found: list[tuple[int, int | None, int, int]] = []
            for k, query in enumerate(queries):
                exact[query.terms] = weights[query.terms] * query.repeats
                scaled[query.terms] = roots[query.terms] * query.repeats
                norm = raised(math.sqrt(raised(float((scaled[query.terms] ** 2).sum()), len(query.terms))), 16)
                found += [(k, query.item_id, at, score) for score, at in search(tree, ids, exact, scaled, norm, floors[k], top)]
                exact[query.terms] = 0
                scaled[query.terms] = 0
            for a in range(0, len(found), 50_000):
                ks, items, at, scores = zip(*found[a : a + 50_000])
                columns = [ks, items, given.take(pa.array(at)), scores]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, tuple) else c for c, f in zip(columns, schema)], schema=schema)

    return some.where(F.size("terms") > 0).mapInArrow(run, _HIT)


def _best(found: DataFrame, top: int) -> DataFrame:
    return top_n(found, ["query"], [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], top, "rank")


def search_block(docs: DataFrame, block: Block, top: int) -> DataFrame:
    some = vectors(docs, block.vocabulary)
    n_docs, n_terms = some.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = some.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()  # at most a row for each term of the block
    df = np.zeros(len(block.vocabulary), np.int64)
    df[held.column("term").to_numpy()] = held.column("df").to_numpy()
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    floors = [(0, NO_ID)] * len(block.queries)
    if n_docs > 2 * SAMPLE_DOCS:
        sample = keep(some.sample(fraction=SAMPLE_DOCS / n_docs, seed=13), "sample").coalesce(SAMPLE_TASKS)
        last = _best(hits(sample, block, weights, n_docs, n_terms, floors, top), top).where(F.col("rank") == top)
        for r in last.select("query", "score", "doc_id").toLocalIterator():  # at most a row for each query of the block
            floors[r["query"]] = (r.score, NO_ID if r.doc_id is None else r.doc_id)
    return _best(hits(dealt(some), block, weights, n_docs, n_terms, floors, top), top).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of every item with a score above 0."""
    return reduce(DataFrame.unionByName, [search_block(docs, block, top) for block in blocks_of(items, block_bytes)])


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_CUT = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
)
OP13_SQL = f"""
with docs as (
  select row_number() over () as r, doc_id, {_CUT} as t from documents
), items as (
  select row_number() over () as q, item_id, {_CUT} as t from benchmark
), asked as (
  select q, item_id, term, count(*) as repeats from (select q, item_id, unnest(t) as term from items) group by all
), found as (
  select r, term, count(*) as tf from (select r, unnest(t) as term from docs) where term in (select term from asked) group by all
), total as (
  select count(*) as n_docs, cast(sum(len(t)) as bigint) as n_terms from docs where len(t) > 0
), weights as (
  select term, cast(floor(1000 * ln(cast(2 * n_docs + 2 as double) / cast(2 * count(*) + 1 as double))) as bigint) as w
  from found, total group by term, n_docs
), impacts as (
  select r, term, w, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * len(t) * n_docs) // n_terms))) as impact
  from found join docs using (r) join weights using (term), total
), scores as (
  select q, item_id, r, cast(sum(repeats * w * impact) as bigint) as score from asked join impacts using (term) group by all
)
select item_id, cast(rank as integer) as rank, doc_id, score from (
  select item_id, doc_id, score, row_number() over (partition by q order by score desc, doc_id nulls last) as rank
  from scores join docs using (r) where score > 0
) where rank <= {TOP}
"""
