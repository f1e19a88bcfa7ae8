"""Line dedup across documents (operator 12), in DataFrame functions only.

Texts are exploded into lines with their places. A line is compared by its key: white space (``\\x20``, ``\\t`` to ``\\r``) stripped at
both ends, A-Z folded. Keys of at least ``min_chars`` code points are hashed twice to 64 bits each; the distinct documents of a hash pair are counted,
and a pair found in ``min_docs`` or more documents is shared. Shared lines go from every document but the one with the
largest id that holds them, which keeps all of its own; the other lines of a text are put together again by place.

Null and empty texts are one empty line, which is too short to be shared. Lines repeated inside a document count once and go or stay
together. Rows that repeat a doc_id are one document when lines are counted and are cut each for itself; rows with a null id hold no document, so they
neither make a line shared nor keep one. Equal rows are cut alike. An empty table gives no rows. Other columns pass through and
may have any name that does not start with ``_line_``.

Only hashes, ids and places travel to the count: a distinct count sums per (line, document) before it sums per line, so a hot line is never gathered,
and the adaptive planner splits it where places are looked up. Texts travel once, to meet the places they lose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.plans.durable import keep

from .line_rules import let
from .tables import table

MIN_CHARS = 40
MIN_DOCS = 5
_SPACES = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def whole_text(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def line_key(line: Column) -> Column:
    """The line as it is compared; a line of ASCII alone is folded by the faster ``lower``, which is the same there."""
    bare = F.btrim(line, F.lit(_SPACES))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def long_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per line whose key is long enough: document (id, hash of its text), place and the two hashes of the key."""
    doc = docs.select(F.col("_line_doc"), F.col("_line_same"), F.posexplode(F.split("_line_text", "\n", -1)).alias("place", "line"))
    # a key has at most the characters of its line, so short lines need no key
    keys = doc.where(F.char_length("line") >= min_chars).withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    return keys.select(
        F.col("_line_doc").alias("doc"), F.col("_line_same").alias("same"), "place",
        F.xxhash64("key").alias("a"), F.xxhash64(F.lit("line"), "key").alias("b"),
    )


def shared_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """a, b, last: the hashes found in ``min_docs`` or more documents and the largest document of each."""
    once = lines.where(F.col("doc").isNotNull()).groupBy("a", "b", "doc").agg(F.lit(1).alias("one"))
    held = once.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("last"))
    return held.where(F.col("n_docs") >= min_docs).select("a", "b", "last")


def deduplicated(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """The rows of ``docs`` with shared lines taken out of ``text``, and ``_line_total`` and ``_line_dropped``."""
    marked = docs.withColumns({"_line_doc": F.col("doc_id").cast("long"), "_line_text": whole_text(F.col("text"))})
    marked = marked.withColumn("_line_same", F.xxhash64("_line_text"))
    lines = keep(long_lines(marked, min_chars), "lines")
    shared = keep(shared_lines(lines, min_docs), "shared")
    lost = lines.join(shared, ["a", "b"]).where(~F.col("doc").eqNullSafe(F.col("last")))
    places = lost.groupBy("doc", "same").agg(F.collect_set("place").alias("places"))
    places = places.select(F.col("doc").alias("_line_of"), F.col("same").alias("_line_at"), F.col("places").alias("_line_lost"))
    on = marked["_line_doc"].eqNullSafe(places["_line_of"]) & (marked["_line_same"] == places["_line_at"])

    def rebuilt(cut: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), F.col("_line_lost"))
        joined = F.array_join(F.transform(stay, lambda i: F.get(cut, i)), "\n")
        left = F.when(F.col("_line_lost").isNull(), F.col("text")).otherwise(joined)
        return F.struct(F.size(cut).cast("long").alias("total"), left.alias("left"))

    # inside a lambda, the lines of a text are cut once
    met = marked.join(places, on, "left").withColumn("_line_new", let(F.split("_line_text", "\n", -1), rebuilt))
    return met.select(
        *[F.col("_line_new.left").alias("text") if c == "text" else met[c] for c in docs.columns],
        F.col("_line_new.total").alias("_line_total"), F.coalesce(F.size("_line_lost"), F.lit(0)).cast("long").alias("_line_dropped"),
    )


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicated(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("_line_total").alias("n_lines"), F.col("_line_dropped").alias("n_dropped"),
        F.sha2(whole_text(F.col("text")), 256).alias("kept_sha256"),
    )


OP12_SQL = f"""
with read as (
  select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as cut from documents
), placed as (
  select r, doc_id, unnest(cut) as line, unnest(generate_series(1, len(cut))) as place from read
), keyed as (
  select r, doc_id, line, place,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') as key from placed
), shared as (
  select key, max(doc_id) as last from keyed where length(key) >= {MIN_CHARS} group by key having count(distinct doc_id) >= {MIN_DOCS}
), judged as (
  select r, line, place, shared.key is not null and keyed.doc_id is distinct from last as gone
  from keyed left join shared on keyed.key = shared.key
), counted as (
  select r, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
         coalesce(string_agg(line, chr(10) order by place) filter (where not gone), '') as kept
  from judged group by r
)
select doc_id, n_lines, n_dropped, sha256(kept) as kept_sha256 from counted join read using (r)
"""
