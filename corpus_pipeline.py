"""Training-data pipeline: quality rules, near duplicates, decontamination, secrets, tokens.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All stages but the last return the columns of documents:

1. quality rules drop documents that fail the base rules or are left depleted without boilerplate lines;
2. the n-gram Jaccard join keeps one document of each group, the one with the smallest id; near copies share 80 % of their five-word shingles;
3. decontamination drops documents that cover too much of a benchmark item;
4. secret scans mask every finding in the text and count its characters again;
5. byte-level BPE returns doc_id, n_tokens, ids_sha256 and decoded_sha256 of what is left.

Rows with a null id are no near duplicates and stay; of rows that repeat an id the near-duplicate stage keeps the first by
text, language, source and length. Empty tables pass through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.byte_bpe import encoded
from shelfmark.llm.gst import clean_documents
from shelfmark.llm.jaccard import near_duplicates
from shelfmark.llm.line_rules import kept_documents
from shelfmark.llm.secrets import redacted, train
from shelfmark.llm.tables import table
from shelfmark.plans.durable import keep
from shelfmark.plans.skew import top_n

NEAR_WORDS = 5
NEAR_PERCENT = 80
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept_documents(docs.select(*COLUMNS))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    # only the ids of documents that go travel; a row that is alone in its group needs no partner
    groups = keep(near_duplicates(docs, size=NEAR_WORDS, percent=NEAR_PERCENT), "groups")
    gone = keep(groups.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    left = docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    repeated = keep(groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    once = top_n(left.join(repeated, "doc_id", "left_semi"), ["doc_id"], [F.col(c) for c in COLUMNS[1:]]).select(*COLUMNS)
    return left.join(repeated, "doc_id", "left_anti").select(*COLUMNS).unionByName(once)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    return redacted(docs, train(docs))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encoded(docs, ids=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("byte_bpe", byte_bpe),
]

# the network of the secret scans and the tokenizer have no SQL form; the stages are tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
