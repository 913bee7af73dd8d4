"""From raw documents to tokens: drop bad documents, near-duplicates, repeated passages and
benchmark leaks, then encode what is left.

Each stage takes (spark, docs, sf_dir) and works on what the one before kept; all but the
last return the columns of documents. `run` writes each stage as Parquet on shared storage
and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright.llm import decontamination, pieces, quality_classifier, simhash, suffix_dedup
from martwright.llm.queries import BATCH, ship, small_batches  # noqa: F401
from martwright.llm.shared import saved, table



def _prepared(spark: SparkSession) -> None:
    """The package is on the executors, and the session's Arrow batches are small."""
    ship(spark)
    small_batches(spark)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5 go; null and empty texts are scored like
    any other and every row of a repeated doc_id by its own text."""
    _prepared(spark)
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of SimHash fingerprints stays, the smallest doc_id, null
    last: 3-word shingles, at most 2 of 64 bits apart. Texts without words are one group."""
    _prepared(spark)
    return simhash.keep_one(docs, width=3, tau=2)


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that occur elsewhere are cut out; documents stay, even
    if nothing is left of their text."""
    _prepared(spark)
    return suffix_dedup.without_repeats(docs, depth=50, unit="words")


def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words of a benchmark item, or a shorter item, go."""
    _prepared(spark)
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the ids of the pieces: one row for each document, repeated
    ones too, none for null and empty texts."""
    _prepared(spark)
    rows = pieces.encode(docs, pieces.load())
    return rows.select("doc_id", "lang", "source", F.size("ids").alias("n_tokens"), "ids")


STAGES = [
    ("quality", good_quality),
    ("near_dedup", one_of_each),
    ("repeats", no_repeats),
    ("decontamination", no_leaks),
    ("pieces", encoded),
]

#: Learned, hashed and byte-exact stages are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
