"""From raw documents to tokens, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; what it
returns is written as Parquet and read again as the next stage's ``docs``. All
stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import bpe, mixing, quality, simhash, substrings
from geoloom.llm.common import discard, staged, table, temporary


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` as the text now has them, where the column exists."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it is trained on the tables of ``sf_dir``."""
    return quality.keep_good(docs, quality.fitted(spark, sf_dir))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, resemblance 0.8."""
    return simhash.drop_near_duplicates(docs, width=5, similarity=0.8)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the spans of 35 words or more that the corpus repeats."""
    return _counted(substrings.remove_repeats(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return _counted(mixing.take(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, and digests of ids and decoded text."""
    return bpe.encoded(docs, bpe.default_path())


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("substrings", without_repeats),
    ("mixing", mixed),
    ("bpe", tokens),
]

#: Training, random rounding and merging have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with temporary():
            docs = staged(stage(spark, docs, sf_dir), name, kept=True)
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
