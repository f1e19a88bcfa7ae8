"""Quality rules with cross-document line frequency (operator 1), in DataFrame functions only.

Base rules look at one document. The method looks across documents: a line is normalised (lower case, digits to 0, white space
collapsed) and hashed; per host, the distinct documents with that line are counted; a line is boilerplate when its count
exceeds both limits, ``MIN_DOCS`` and the share ``MAX_SHARE`` of the documents of its host. Boilerplate lines are removed, and a document
left with less than ``MIN_LEFT`` of its words is depleted and rejected.

Exact copies are no evidence of boilerplate: they would condemn every line of a document that was merely copied, and with it the one copy that should
stay. So documents of a host with the same normalised lines, in any order, are one document, both in the count of a line and in that of the host.
Documents that differ in any line are different ones, however much of them is shared: a page that is boilerplate but for one line counts in full.
``OP1_SQL`` counts the same documents by their sorted lines.

Null and empty texts have no words, fail the base rules (fewer than ``MIN_WORDS`` words) and are not kept. A null host is a host of its
own. Every row is judged; repeated ones count as one document. An empty table gives no rows. Other columns are not read.

Lines are counted with a map-side sum per (host, line, document) and then per (host, line), so neither a hot host nor a hot line
is gathered. The lines above the limits are written as a table; Spark sends it to the tasks only if it is small and otherwise joins by shuffle with split skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.plans.durable import keep

from .tables import table

MIN_WORDS = 50
MAX_REPEAT = 0.5
MIN_DOCS = 20
MAX_SHARE = 0.02
MIN_LEFT = 0.5
_SPACES = "[ \\t-\\r]+"
_WORD = "[^ \\t-\\r]"
_NO_SYMBOLS = "[^#*$%&|<>]+"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where a lambda inside reads it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACES), lambda w: w != "")


def repeat_words(tokens: Column) -> Column:
    """Words covered by 3-word windows that stand twice or more in the text.

    Windows are hashed; only texts with equal hashes go on to sort (hash, place) pairs, where equal neighbours mark the
    repeated places; a place covers three words or as many as lie before the next one."""

    def sorted_places(hashes: Column) -> Column:
        return F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))

    def repeated(pairs: Column) -> Column:
        n = F.size(pairs)
        marked = F.filter(
            pairs,
            lambda p, k: ((k > 0) & (F.get(pairs, k - 1)["h"] == p["h"])) | ((k < n - 1) & (F.get(pairs, k + 1)["h"] == p["h"])),
        )
        return F.array_sort(F.transform(marked, lambda p: p["i"]))

    def covered(at: Column) -> Column:
        return F.aggregate(
            at,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
            lambda acc, i: F.struct(
                (acc["n"] + i + 3 - F.greatest(acc["end"], i)).alias("n"), (i + 3).alias("end")
            ),
            lambda acc: acc["n"],
        )

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            let(let(sorted_places(hashes), repeated), covered)
        )

    windows = let(
        tokens,
        lambda w: F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        ),
    )
    return let(windows, count)


def base_rules(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to rows with ``text``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    full = F.filter(F.split(text, "\n"), lambda s: s.rlike(_WORD))
    # one struct keeps the words of a text from being split anew for each figure
    counted = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("repeat")))
    lines = let(full, lambda s: F.size(s) - F.size(F.array_distinct(s)))
    out = docs.withColumn("_counted", counted).select(
        *docs.columns,
        F.col("_counted.n").alias("n_words"),
        F.length(F.regexp_replace(text, _SPACES, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, _NO_SYMBOLS, "")).cast("long").alias("n_symbols"),
        lines.cast("long").alias("n_dup_lines"),
        F.col("_counted.repeat").alias("n_repeat_words"),
    )
    return out.withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MAX_REPEAT) * F.col("n_words")),
    )


def normalised(text: Column) -> Column:
    """A text as its lines are compared: lower case, digits alike, single spaces, no space at the ends of lines."""
    spaced = F.regexp_replace(F.regexp_replace(F.lower(text), "[ \\t\\x0b\\f\\r]+", " "), "[0-9]", "0")
    return F.regexp_replace(spaced, " ?\n ?", "\n")


def compared_lines(text: Column) -> Column:
    """The normalised lines of a text that hold a word."""
    cut = F.split(normalised(F.coalesce(text, F.lit(""))), "\n")
    return F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: s != "")


def row_key() -> Column:
    """Equal rows share a key; all figures of the method are sums over a key, so their ratios are those of one row."""
    return F.xxhash64(F.col("doc_id").cast("string"), F.col("text"), F.col("source").cast("string"))


def line_marks(docs: DataFrame) -> DataFrame:
    """key, host, same (a hash of all lines, equal for exact copies) and the lines of every document as structs (line hash, words)."""
    marks = F.transform(
        compared_lines(F.col("text")),
        lambda s: F.struct(
            F.xxhash64(s).alias("line"),
            (F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) + 1).cast("long").alias("words"),
        ),
    )
    same = F.xxhash64(F.array_sort(F.transform("lines", lambda m: m["line"])))
    return docs.select(
        row_key().alias("key"), F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("host"), marks.alias("lines")
    ).select("key", "host", same.alias("same"), "lines")


def boilerplate(marks: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """host, line, n_docs of the lines above both limits."""
    lines = marks.select("host", "same", F.explode("lines.line").alias("line"))
    once = lines.groupBy("host", "line", "same").agg(F.lit(1).alias("one"))
    counts = once.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > min_docs)
    hosts = marks.select("host", "same").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("n_host"))
    return counts.join(hosts, "host").where(F.col("n_docs") > max_share * F.col("n_host")).select("host", "line", "n_docs")


def depleted(
    docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT
) -> DataFrame:
    """Keys of the documents that are left with less than ``min_left`` of their words, each once."""
    marks = keep(line_marks(docs), "lines")  # texts are cut into lines once; figures below read hashes only
    common = keep(boilerplate(marks, min_docs, max_share), "boilerplate")
    lines = marks.select("key", "host", F.explode("lines").alias("m")).select("key", "host", "m.line", "m.words")
    lost = lines.join(common.select("host", "line"), ["host", "line"]).groupBy("key").agg(F.sum("words").alias("lost"))
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda a, m: a + m["words"])
    sizes = marks.groupBy("key").agg(F.sum(total).alias("words"))
    out = lost.join(sizes, "key").where(F.col("words") - F.col("lost") < min_left * F.col("words")).select("key")
    return keep(out, "depleted")


def cleaned(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """The documents with boilerplate lines taken out of ``text``."""
    keyed = docs.withColumn("_key", row_key())
    marks = keep(line_marks(docs), "lines")
    common = keep(boilerplate(marks, min_docs, max_share), "boilerplate").select("host", "line")
    lines = marks.select("key", "host", F.explode("lines.line").alias("line"))
    gone = lines.join(common, ["host", "line"]).groupBy("key").agg(F.collect_set("line").alias("_gone"))
    raw = F.split("text", "\n")
    left = F.filter(
        F.arrays_zip(raw.alias("raw"), F.transform(F.split(normalised(F.col("text")), "\n"), lambda s: F.xxhash64(F.trim(s))).alias("mark")),
        lambda z: ~F.array_contains("_gone", z["mark"]),
    )
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda z: z["raw"]), "\n"))
    return keyed.join(gone.withColumnRenamed("key", "_key"), "_key", "left").withColumn("text", text).select(*docs.columns)


def quality(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    read = docs.select("doc_id", "text", "source")
    figures = base_rules(read.withColumn("_key", row_key())).drop("text", "source")
    gone = depleted(read, **limits).select(F.col("key").alias("_key"), F.lit(True).alias("_gone"))
    return figures.join(gone, "_key", "left").select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", (~F.col("base_failed") & F.col("_gone").isNull()).alias("kept"),
    )


def kept_documents(docs: DataFrame, **limits) -> DataFrame:
    """The documents that pass, as they are; only rejected keys travel, texts stay where they are read."""
    gone = depleted(docs, **limits).withColumnRenamed("key", "_key")
    judged = base_rules(docs.select(*docs.columns, row_key().alias("_key"))).where(~F.col("base_failed"))
    return judged.join(gone, "_key", "left_anti").select(*docs.columns)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


OP1_SQL = f"""
with read as (
  select row_number() over () as r, doc_id, coalesce(source, chr(1)) as host, coalesce(text, '') as text from documents
), tokens as (
  select r, [x for x in regexp_split_to_array(text, '[ \\t-\\r]+') if x <> ''] as w from read
), grams as (
  select r, i, w[i] as a, w[i + 1] as b, w[i + 2] as c
  from (select r, w, unnest(generate_series(1, len(w) - 2)) as i from tokens where len(w) > 2)
), places as (
  select r, i from (select r, i, count(*) over (partition by r, a, b, c) as n from grams) where n > 1
), covered as (
  select r, count(distinct i + k) as n_repeat_words from places, (values (0), (1), (2)) as s(k) group by r
), plain as (
  select r, [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^ \\t-\\r]')] as full_lines from read
), figures as (
  select read.r, doc_id, host, len(w) as n_words, length(regexp_replace(text, '[ \\t-\\r]+', '', 'g')) as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as n_symbols,
         len(full_lines) - len(list_distinct(full_lines)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
  from read join tokens using (r) join plain using (r) left join covered using (r)
), lined as (
  select r, host, unnest(string_split(
    regexp_replace(regexp_replace(lower(text), '[ \\t\\x0b\\f\\r]+', ' ', 'g'), '[0-9]', '0', 'g'), chr(10))) as line
  from read
), lines as (
  select r, host, trim(line) as line, length(trim(line)) - length(replace(trim(line), ' ', '')) + 1 as words
  from lined where trim(line) <> ''
), sames as (
  select r, string_agg(line, chr(10) order by line) as same from lines group by r
), counts as (
  select host, line, count(distinct same) as n_docs from lines join sames using (r) group by host, line
), hosts as (
  select host, count(distinct coalesce(same, '')) as n_host from read left join sames using (r) group by host
), common as (
  select host, line from counts join hosts using (host)
  where n_docs > {MIN_DOCS} and n_docs > {MAX_SHARE} * n_host
), lost as (
  select r, sum(words) as words, sum(case when common.line is not null then words else 0 end) as gone
  from lines left join common on lines.host = common.host and lines.line = common.line group by r
)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars,
       cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
       cast(n_repeat_words as bigint) as n_repeat_words, failed as base_failed,
       not failed and not coalesce(lost.words - lost.gone < {MIN_LEFT} * lost.words, false) as kept
from (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {int(100 * MAX_REPEAT)} * n_words as failed from figures) f
left join lost using (r)
"""
