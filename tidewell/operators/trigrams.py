"""A stored table of trigrams, and the fuzzy source on it."""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..storage import Log, fingerprint, shared_dir

LEAST = 0.30


class Grams:
    """gram, id, size (distinct trigrams of the text), sorted by gram: a query reads the rows of its own trigrams."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.log = spark, path.rstrip("/"), Log(spark, path)

    def create(self, docs: DataFrame, key: str, text: Column) -> Grams:
        name = uuid.uuid4().hex
        # behind a generator, so that a text's trigrams are worked out once
        read = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.explode(F.array(T.trigrams(text))).alias("g"))
        sized = read.select("id", F.explode(F.array(F.struct(F.size("g").alias("size"), F.col("g").alias("grams")))).alias("s"))
        rows = sized.select("id", "s.size", F.explode("s.grams").alias("gram"))
        rows.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.parquet(f"{self.path}/{name}")
        self.log.commit(0, {"name": name, "schema": rows.schema.json()})
        return self

    def _shared(self, query: str) -> tuple[DataFrame, int]:
        """id, size, shared of texts with trigrams of the query; how many it has."""
        own = sorted({w[i : i + 3] for w in _words(self.spark, query) for w in [f"  {w} "] for i in range(len(w) - 2)})
        state = self.log.current()[1]
        table = self.spark.read.schema(StructType.fromJson(json.loads(state["schema"]))).parquet(f"{self.path}/{state['name']}")
        return table.where(F.col("gram").isin(own)).groupBy("id", "size").agg(F.count("*").alias("shared")), len(own)

    def similar(self, query: str, least: float = LEAST) -> DataFrame:
        """id, score of texts of trigram similarity ``least`` or more as a whole; the texts themselves are not read."""
        shared, m = self._shared(query)
        score = F.round(F.col("shared") / (m + F.col("size") - F.col("shared")), 6)
        return shared.select("id", score.alias("score")).where(F.col("score") >= least)

    def candidates(self, query: str, least: float = LEAST) -> DataFrame:
        """id of texts with as many of the query's trigrams as an extent of similarity ``least`` must have."""
        shared, m = self._shared(query)
        return shared.where(F.col("shared") >= max(1, math.ceil(least * m - 1e-9))).select("id")


def _words(spark: SparkSession, query: str) -> list[str]:
    """The query's words by the same rule as those of texts; a row of one value."""
    return spark.range(1).select(T.tokens(F.lit(query)).alias("w")).first().w


def stored(docs: DataFrame, key: str, text: Column, name: str = "grams") -> Grams:
    """The trigram table of a table in the application's shared folder: made once, again when the table's files change."""
    spark = docs.sparkSession
    made = Grams(spark, f"{shared_dir(spark)}/{name}-{fingerprint(docs)}")
    if made.log.current()[1] is None:
        made.create(docs, key, text)
    return made


def trigram(docs: DataFrame, key: str, text: Column, query: str, grams: Grams, least: float = LEAST) -> DataFrame:
    """Source, id, score: word similarity strictly above ``least``, queries of one word only; only candidates' texts are read."""
    if len(query.split()) != 1:
        return docs.select(F.lit("trigram").alias("source"), F.col(key).alias("id"), F.lit(0.0).alias("score")).limit(0)
    near = docs.join(grams.candidates(query, least).withColumnRenamed("id", key), key, "left_semi")
    scored = near.select(F.col(key).alias("id"), F.explode(F.array(T.word_similarity(F.lit(query), text, least))).alias("score"))
    return scored.select(F.lit("trigram").alias("source"), "id", F.round("score", 6).alias("score")).where(F.col("score") > least)
