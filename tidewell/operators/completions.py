"""Suggestions from stored tables (R19, O08): values by key, their trigrams, and the best of each prefix.

``values`` is sorted by key, so what continues a typed text is a few neighbouring pages; ``prefixes`` has for
each prefix of up to ``LONGEST`` signs its ``BEST`` values, so that a list to choose from is one row. Both
are changed file by file: added or removed values touch the lists of their own prefixes only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.stored import StoredTable
from ..storage import fingerprint, shared_dir
from .trigrams import LEAST, Grams

LONGEST, BEST, SALTS = 24, 12, 32
_ENTRY = "entry string, key string, nature string, value string"


def entries(values: DataFrame) -> DataFrame:
    """entry, key, nature, value of distinct values (nature, value); the entry begins with the key and is unique."""
    known = values.where("value IS NOT NULL").select("nature", "value").distinct().withColumn("key", T.search_key(F.col("value"))).where("key <> ''")
    return known.select(F.concat_ws("\u0001", "key", "nature", "value").alias("entry"), "key", "nature", "value")


def _lists(rows: DataFrame, best: int = BEST, only: DataFrame | None = None) -> DataFrame:
    """prefix, best: of each prefix (of ``only`` those) the shortest keys, then by value; a key once.

    A prefix of one sign may have a large share of all values: lists are cut in each of ``SALTS`` parts first.
    """
    each = rows.groupBy("key").agg(F.min(F.struct("value", "nature")).alias("v"))
    spread = each.select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("key"), F.lit(LONGEST))), lambda n: F.substr("key", F.lit(1), n))).alias("prefix"), F.length("key").alias("length"), "key", F.pmod(F.xxhash64("key"), F.lit(SALTS)).alias("salt"), "v.value", "v.nature")
    return _cut(spread if only is None else spread.join(only, "prefix", "left_semi"), best)


def _cut(spread: DataFrame, best: int) -> DataFrame:
    order = [F.asc("length"), F.asc("value"), F.asc("nature")]
    some = spread.withColumn("place", F.row_number().over(Window.partitionBy("prefix", "salt").orderBy(*order))).where(F.col("place") <= best)
    top = some.withColumn("place", F.row_number().over(Window.partitionBy("prefix").orderBy(*order))).where(F.col("place") <= best)
    listed = F.array_sort(F.collect_list(F.struct("place", "length", "key", "value", "nature")))
    return top.groupBy("prefix").agg(listed.alias("best"))


class Completions:
    """Tables below a path that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.values = StoredTable(spark, f"{self.path}/values", "entry")
        self.prefixes = StoredTable(spark, f"{self.path}/prefixes", "prefix")
        self.grams = Grams(spark, f"{self.path}/grams")

    def create(self, values: DataFrame) -> Completions:
        self.grams.create(entries(values).select("key").distinct(), "key", F.col("key"))
        self.values.create(entries(values))
        self.prefixes.create(_lists(self.values.read()))
        return self

    def suggestions(self, typed: str, least: float = LEAST) -> DataFrame:
        """nature, value, rank, score of all values that are equal, continue what is typed, or are like it: as ``retrieval.suggestions``.

        Reads the pages of the typed key's continuations and of its trigrams. What was added after ``create`` is found by its beginning.
        """
        own = typed.strip().lower()
        rows = self.values.read()
        begins = rows.where(F.col("entry").startswith(own))
        found = begins.select("key", "nature", "value", F.when(F.col("key") == own, 0).otherwise(2).alias("rank"), F.when(F.col("key") == own, 1.0).otherwise(0.70 + 0.25 * len(own) / F.length("key")).alias("score"))
        near = self.grams.similar(own, least).where((F.col("score") > least) & ~F.col("id").startswith(own)).select(F.col("id").alias("key"), "score")
        fuzzy = rows.join(near, "key").select("key", "nature", "value", F.lit(3).alias("rank"), "score")
        best = Window.partitionBy("key").orderBy("rank", F.desc("score"), "value", "nature")
        every = found.unionByName(fuzzy).withColumn("score", F.round("score", 6))
        return every.withColumn("place", F.row_number().over(best)).where("place = 1").select("nature", "value", "rank", "score")

    def complete(self, typed: str) -> DataFrame:
        """place, value, nature, key of the ``BEST`` values that begin so: one row is read; beyond ``LONGEST`` signs the values themselves are."""
        own = typed.strip().lower()
        if len(own) <= LONGEST:
            lists = self.prefixes.read().where(F.col("prefix") == own)
        else:
            rows = self.values.read().where(F.col("entry").startswith(own))
            each = rows.groupBy("key").agg(F.min(F.struct("value", "nature")).alias("v"))
            lists = _cut(each.select(F.lit(own).alias("prefix"), F.length("key").alias("length"), "key", F.lit(0).alias("salt"), "v.value", "v.nature"), BEST)
        return lists.select(F.inline("best")).select("place", "value", "nature", "key")

    def add(self, values: DataFrame) -> None:
        """New values; the lists of their prefixes are cut anew from what they held and what comes."""
        fresh = entries(values).join(self.values.read().select("entry"), "entry", "left_anti")
        lists = _lists(fresh)
        old = self.prefixes.read().join(lists.select("prefix"), "prefix", "left_semi").select("prefix", F.inline("best"))
        new = lists.select("prefix", F.inline("best"))
        both = old.unionByName(new).groupBy("prefix", "key").agg(F.min(F.struct("value", "nature")).alias("v"), F.first("length").alias("length"))
        changed = _cut(both.select("prefix", "length", "key", F.lit(0).alias("salt"), "v.value", "v.nature"), BEST)
        self.prefixes.upsert(changed)
        self.values.upsert(fresh)

    def remove(self, values: DataFrame) -> None:
        """Values go; the lists of their prefixes are made anew from the values that have these prefixes."""
        gone = entries(values)
        touched = _lists(gone).select("prefix")
        self.values.delete(gone.select("entry"))
        keys = self.values.read().select("key", "nature", "value")
        again = _lists(keys, only=touched)
        self.prefixes.delete(touched)
        self.prefixes.upsert(again)


def stored(values: DataFrame, name: str = "completions") -> Completions:
    """The tables of these values in the application's shared folder: made once, again when their files change."""
    spark = values.sparkSession
    made = Completions(spark, f"{shared_dir(spark)}/{name}-{fingerprint(values)}")
    if made.prefixes.log.current()[1] is None:
        made.create(values)
    return made
