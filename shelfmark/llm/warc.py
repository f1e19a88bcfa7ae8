"""WARC archives and merged capture histories (operator 8).

Pages become WARC records: of pages with equal payloads of at least ``MIN_REVISIT_BYTES`` the one with the
smallest page_id is stored as response and the others as revisits of it; shorter payloads are always responses.
Archives are written by Spark's own writer (one gzip member stream per file, any file system Spark reaches, task
commits survive lost executors) and read back record by record along their Content-Length.

The index is built by an external merge. Every archive is one capture run: its records are sorted by URL key, timestamp and page
before it is written. The captures of all runs, without payloads, are written to a table once. Runs are cut at common range borders, so
that a task holds the slices of all runs between two borders, and are merged there by a loser tree; the tasks in order give the
globally ordered capture history. The number of ranges follows the number of captures, so a slice has about ``RANGE_ROWS`` captures
at any size. A URL with very many captures is cut by timestamp and page like any other range.

Null html is an empty payload, a null url an empty one. Null page ids take no part in the choice of the response unless no
other page has the payload. Repeated page ids: each row gets a record; rows with the smallest page_id of their payload are
all responses. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.plans.durable import keep, new_folder

from .tables import table

MIN_REVISIT_BYTES = 100
RANGE_ROWS = 100_000
CAPTURED = "2024-01-01T00:00:00Z"
VERSION = "WARC/1.1"
_ID = "urn:page:"


def with_roles(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to (null: this row is the response)."""
    read = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    ).withColumns(
        {
            "payload_bytes": F.octet_length("payload").cast("long"),
            "payload_digest": F.sha2(F.col("payload").cast("binary"), 256),
        }
    )
    # only payloads that occur again need a row here: one per distinct repeated payload, summed on the map side
    first = (
        read.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .select("payload_digest", "_first")
    )
    first = keep(first, "responses")  # a written table has a known size: Spark broadcasts it only if it is small
    known = (F.col("payload_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return read.join(first, "payload_digest", "left").select(
        *read.columns, F.when(known, F.col("_first")).alias("refers_to")
    )


def _uri() -> Column:
    """The url as a header can hold it."""
    return F.regexp_replace("url", "[\r\n]", " ")


def record_text(captured: Column) -> Column:
    """One WARC record of a row of ``with_roles`` but for its last newline, which the writer sets; a revisit carries its digest and length but no payload."""
    revisit = F.col("refers_to").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    return F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit(f"<{_ID}"), page, F.lit(">"))),
        line("WARC-Target-URI", _uri()),
        line("WARC-Date", captured),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(
            revisit,
            F.concat(
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                line("WARC-Refers-To", F.concat(F.lit(f"<{_ID}"), F.col("refers_to").cast("string"), F.lit(">"))),
                line("X-Payload-Length", F.col("payload_bytes").cast("string")),
            ),
        ).otherwise(F.lit("")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"), body, F.lit("\r\n\r"),
    )


def write_archives(pages: DataFrame, captured: Column | None = None) -> str:
    """Writes the archives, each a run of captures in order, and returns their folder."""
    folder = new_folder(pages.sparkSession, "warc")
    when = F.lit(CAPTURED) if captured is None else captured
    runs = with_roles(pages).sortWithinPartitions(url_key(_uri()), when, "page_id")
    runs.select(record_text(when).alias("value")).write.option("lineSep", "\n").option(
        "compression", "gzip"
    ).text(folder)
    return folder


_HEADER = re.compile(rb"([A-Za-z-]+): ([^\r\n]*)\r\n")
_RECORD_SCHEMA = (
    "archive string, position long, page_id long, url string, captured string, record_type string, "
    "payload_bytes long, payload_digest string, refers_to long, payload binary"
)


def _fields(head: bytes) -> dict[bytes, bytes]:
    return dict(_HEADER.findall(head))


def _number(value: bytes) -> int | None:
    tail = value.rstrip(b">").rpartition(b":")[2]
    return None if tail == b"none" else int(tail)


def read_archives(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """The records of all archives in ``folder``; length and digest of a response are taken from its payload.

    Files are read as lines by Spark; a task puts the lines of a file together again and follows the lengths in
    the headers, so a payload that itself looks like a record does no harm. It holds one record at a time."""
    import hashlib

    lines = (
        spark.read.option("lineSep", "\n").text(folder)
        .select(F.col("_metadata.file_path").alias("archive"), F.col("value").cast("binary").alias("value"))
    )
    keep = payloads

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _RECORD_SCHEMA.split(", ")]
        rows: list[tuple] = []
        state: dict = {"archive": None, "head": [], "body": None, "left": 0, "fields": {}, "at": 0}

        def finish() -> None:
            # what was gathered is the payload and the blank line that closes the record
            body = b"".join(state["body"])[: state["size"]]
            fields = state["fields"]
            revisit = fields[b"WARC-Type"] == b"revisit"
            rows.append(
                (
                    state["archive"], state["at"], _number(fields[b"WARC-Record-ID"]),
                    fields[b"WARC-Target-URI"].decode(), fields[b"WARC-Date"].decode(), fields[b"WARC-Type"].decode(),
                    int(fields[b"X-Payload-Length"]) if revisit else len(body),
                    fields[b"WARC-Payload-Digest"].partition(b":")[2].decode()
                    if revisit else hashlib.sha256(body).hexdigest(),
                    _number(fields[b"WARC-Refers-To"]) if revisit else None,
                    body if keep else None,
                )
            )
            state.update(head=[], body=None, at=state["at"] + 1)

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * len(names)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)
            rows.clear()
            return batch

        for batch in batches:
            files, values = batch.column("archive").to_pylist(), batch.column("value").to_pylist()
            for file, value in zip(files, values):
                if file != state["archive"]:
                    state.update(archive=file, head=[], body=None, at=0)
                value += b"\n"
                if state["body"] is None:
                    state["head"].append(value)
                    if value == b"\r\n":
                        state["fields"] = _fields(b"".join(state["head"]))
                        size = int(state["fields"][b"Content-Length"])
                        state.update(size=size, left=size + 4, body=[])
                else:
                    state["body"].append(value)
                    state["left"] -= len(value)
                    if state["left"] <= 0:
                        finish()
            if rows:
                yield out()

    # a gzip file is one split, so the lines of an archive reach one task in order
    return lines.mapInArrow(records, _RECORD_SCHEMA)


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels reversed and comma-joined, then path and query; scheme, www and fragment go."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(url), "^[a-z][a-z0-9+.-]*://", ""), "#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, "^([^/?]*)", 1), "^www[0-9]*\\.", ""), ":[0-9]*$", "")
    rest = F.regexp_extract(bare, "^[^/?]*(.*)$", 1)
    return F.concat(F.concat_ws(",", F.reverse(F.split(host, "\\."))), F.lit(")"), rest)


class LoserTree:
    """Merges sorted runs; each inner node holds the loser of its match, so the next row costs one path of matches."""

    def __init__(self, runs: Sequence[Iterator], key: Callable):
        self.runs, self.key = [iter(r) for r in runs], key
        self.size = len(self.runs)
        self.heads = [self._pull(i) for i in range(self.size)]
        self.losers = [-1] * max(self.size, 1)
        for leaf in range(self.size):
            self._seat(leaf)

    def _pull(self, i: int):
        row = next(self.runs[i], None)
        return None if row is None else (self.key(row), i, row)

    def _beats(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[a] is not None
        return self.heads[a][:2] < self.heads[b][:2]

    def _seat(self, leaf: int) -> None:
        """First matches: a run waits at the first empty node on its way up."""
        winner, node = leaf, (leaf + self.size) // 2
        while node:
            if self.losers[node] == -1:
                self.losers[node] = winner
                return
            if self._beats(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        if not self.size:
            return
        winner = self.losers[0]
        while self.heads[winner] is not None:
            yield self.heads[winner][2]
            self.heads[winner] = self._pull(winner)
            node = (winner + self.size) // 2
            while node:
                if self._beats(self.losers[node], winner):
                    self.losers[node], winner = winner, self.losers[node]
                node //= 2


def capture_index(records: DataFrame) -> DataFrame:
    """url_key, captured, page_id, record_type, payload_digest, payload_bytes, refers_to, archive, position in global order."""
    columns = ["url_key", "captured", "page_id", "record_type", "payload_digest", "payload_bytes", "refers_to", "archive", "position"]
    # archives are read once: the borders of the ranges, their number and the merge come from this table
    captures = keep(records.withColumn("url_key", url_key(F.col("url"))).select(*columns), "captures")
    usual = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(usual, -(-captures.count() // RANGE_ROWS))
    order = ("url_key", "captured", "page_id", "archive", "position")
    # the slices of all runs between two borders; inside a task each run is in order
    cut = captures.repartitionByRange(ranges, *order).sortWithinPartitions("archive", *order)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held)
        urls, times, pages, files, at = (whole.column(c).to_pylist() for c in order)
        borders = [0, *(i for i in range(1, len(files)) if files[i] != files[i - 1]), len(files)]
        runs = [iter(range(a, b)) for a, b in zip(borders, borders[1:])]

        def place(i: int):
            return urls[i], times[i], pages[i] is not None, pages[i] or 0, files[i], at[i]

        merged = pa.array(list(LoserTree(runs, place)), pa.int64())
        yield from whole.take(merged).combine_chunks().to_batches()

    return cut.mapInArrow(merge, cut.schema)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = write_archives(table(spark, sf_dir, "pages"))
    return capture_index(read_archives(spark, folder)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


OP8_SQL = """
with read as (
  select page_id, coalesce(url, '') as url, encode(coalesce(html, '')) as payload from pages
), sized as (
  select page_id, octet_length(payload) as payload_bytes, sha256(payload) as payload_digest from read
), firsts as (
  select payload_digest, min(page_id) as first_id from sized where payload_bytes >= 100 group by payload_digest
)
select s.page_id, cast(s.payload_bytes as bigint) as payload_bytes, s.payload_digest,
       case when s.payload_bytes >= 100 and s.page_id <> f.first_id then 'revisit' else 'response' end as record_type,
       case when s.payload_bytes >= 100 and s.page_id <> f.first_id then f.first_id end as refers_to
from sized s left join firsts f on s.payload_digest = f.payload_digest and s.payload_bytes >= 100
"""
