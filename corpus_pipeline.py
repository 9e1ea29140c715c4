"""The corpus pipeline: quality filter, exact and near deduplication, decontamination, tokenising.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written before the next one reads it. Each works on
all rows that its predecessor kept; all but the last return the columns of ``documents``.

Defined results: a null or empty text scores what the classifier gives it, equals other empty ones, has no near copy, holds no item and has no tokens; very long
texts go through whole; of rows with the same key and text one stays, whichever it is of them; extra columns stay until the last stage, whatever their names; empty
tables of documents, labels or items give what each stage defines, and no documents no rows. Scores at the threshold stay.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.llm import bpe, decontam, exact, near, quality
from scriptloom.llm.common import fold, read, settle, text_of

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality").filter(fold(5) != 0)
    return quality.keep_good(docs, quality.fit(docs, labels))


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact.without_copies(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    return near.one_of_each(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, word for word or re-parameterised, go."""
    return decontam.without_leaks(docs, read(spark, sf_dir, "benchmark").select("item_id", "text"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with the digests of ids and decoded bytes."""
    rows = docs.select("doc_id", text_of().alias("text"))
    coded = bpe.round_trip(rows, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", no_copies),
    ("n-gram Jaccard join", no_near_copies),
    ("benchmark decontamination", no_benchmark),
    ("byte-level BPE", tokens),
]

#: The classifier can't be put in SQL; tests/llm holds the whole run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
