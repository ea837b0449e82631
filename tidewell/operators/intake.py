"""Intake of files and records: zones, settings, list items, postings, reports, replays."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import strip_markup


def outside(df: DataFrame, path: str, zones: Sequence[str]) -> DataFrame:
    """Rows in none of the reserved zones; a zone is a whole folder, so ``/a`` does not reserve ``/ab``."""
    inside = [F.col(path).startswith(z.rstrip("/") + "/") | (F.col(path) == z.rstrip("/")) for z in zones]
    return df.where(~reduce(lambda a, b: a | b, inside, F.lit(False)))


def items_not_in_text(pages: DataFrame, key: str, html: Column, tag: str, within: Column) -> DataFrame:
    """S09 on markup: the texts of ``tag`` elements that do not stand in the text already, in order, once each."""
    found = F.regexp_extract_all(html, F.lit(f"(?is)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1))
    texts = F.array_distinct(F.filter(F.transform(found, strip_markup), lambda x: x != ""))
    return pages.select(key, F.posexplode(F.filter(texts, lambda x: ~F.contains(within, x))).alias("place", "item"))


def settings(df: DataFrame, key: str, text: Column, schema: str, checks: dict[str, Column]) -> DataFrame:
    """Settings read from JSON with the first check they fail; null where they are sound.

    ``checks`` are conditions over the columns of ``schema``, null counting as failed.
    """
    read = df.select(key, F.from_json(text, schema).alias("__s")).select(key, "__s.*")
    wrong = F.lit(None).cast("string")
    for name, holds in reversed(checks.items()):
        wrong = F.when(~F.coalesce(holds, F.lit(False)), name).otherwise(wrong)
    return read.withColumn("wrong", wrong)


def report_lines(df: DataFrame, columns: Sequence[str], separator: str = ";") -> DataFrame:
    """Rows as lines of a report; values that hold the separator or a quote are quoted."""

    def cell(c: str) -> Column:
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(F.contains(text, F.lit(separator)) | F.contains(text, F.lit('"')), quoted).otherwise(text)

    return df.select(F.concat_ws(separator, *map(cell, columns)).alias("line"))


def to_redo(attempts: DataFrame, key: str, at: str, failed: Column, corrected: DataFrame) -> DataFrame:
    """Imports to run again: their last attempt failed, or they were corrected after it."""
    last = attempts.groupBy(key).agg(F.max_by(failed, F.col(at)).alias("__failed"), F.max(at).alias("__at"))
    fixed = corrected.groupBy(key).agg(F.max(at).alias("__fixed"))
    joined = last.join(fixed, key, "left")
    why = F.when(F.col("__failed"), "failed").when(F.col("__fixed") > F.col("__at"), "corrected")
    return joined.select(key, why.alias("why")).where("why IS NOT NULL")


def deposits(folders: DataFrame, key: Column, done: DataFrame) -> DataFrame:
    """Folders with whether each is a replay: its idempotence key was deposited before, or by an earlier folder of these."""
    keyed = folders.withColumn("idempotence_key", key)
    first = keyed.groupBy("idempotence_key").agg(F.min("id").alias("__first"))
    old = done.select(F.col("idempotence_key").alias("idempotence_key"), F.lit(True).alias("__old")).distinct()
    joined = keyed.join(first, "idempotence_key").join(old, "idempotence_key", "left")
    return joined.select("id", F.when(F.col("__old"), "replayed").when(F.col("id") > F.col("__first"), "repeated").otherwise("new").alias("outcome"))


def once(deliveries: DataFrame, done: DataFrame, key: str, at: str) -> DataFrame:
    """Of tasks delivered at least once, those to handle now: not done before, by their first delivery."""
    return deliveries.join(done.select(key), key, "left_anti").groupBy(key).agg(F.min(at).alias(at))
