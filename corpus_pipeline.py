"""A corpus pipeline of five stages over ``documents``.

Each stage takes the rows its predecessor kept, is written to the shared folder as Parquet and
reread; all but the last return the columns of ``documents``. Of an empty table every stage
gives an empty one; further columns are passed on, whatever their names; repeated rows are
rows like others, of which the second stage keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import decontaminate, langid, mixing, nearcopies
from tidewell.llm.common import Table
from tidewell.llm.tokenstore import TokenStore


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told with some certainty; null and empty texts and the others go."""
    return langid.keep_identified(docs, langid.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: fingerprints and bands choose pairs, five-word shingles at 0.8 decide."""
    return nearcopies.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none and stay."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: each row as often as the mix takes it, three times at most; a null source is one."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of whole texts (null: empty), written to a content-addressed store and read back: a digest for each row."""
    return TokenStore.write(docs).read()


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_dedup),
    ("decontaminate", clean),
    ("mix_sources", mix),
    ("token_store", tokens),
]
ORACLE_SQL = None  # learning, retrieval and the mix's draws are beyond SQL; tests compare with plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = Table(stage(spark, docs, sf_dir), name).df
    return docs
