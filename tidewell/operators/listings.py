"""Listings, details and review queues."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .latest import page


def first_source(sources: Sequence[DataFrame], keys: Sequence[str], value: str) -> DataFrame:
    """Per key the value of the first source that has one, the smallest of it, and the source's number."""
    every = reduce(DataFrame.unionByName, [s.select(*keys, value, F.lit(n).alias("priority")) for n, s in enumerate(sources)])
    best = every.groupBy(*keys).agg(F.min(F.struct("priority", value)).alias("best"))
    return best.select(*keys, "best.priority", F.col(f"best.{value}").alias(value))


def to_review(rows: DataFrame, judged: DataFrame, key: str, confidence: str, n: int) -> DataFrame:
    """The ``n`` least confident rows that nobody has judged."""
    return page(rows.join(judged, key, "left_anti"), [F.asc_nulls_last(confidence), F.asc(key)], 0, n)


def detail(records: DataFrame, key: str, traces: DataFrame) -> DataFrame:
    """Records with the number and the ordered list of their field traces (key, field, value)."""
    told = F.transform(F.sort_array(F.collect_list(F.struct("field", "value"))), lambda x: F.concat_ws(":", x["field"].cast("string"), x["value"]))
    grouped = traces.groupBy(key).agg(F.count("*").alias("lines"), F.array_join(told, ",").alias("traces"))  # the fields of one record
    return records.join(grouped, key, "left")


def list_with_facet(rows: DataFrame, key: str, facet: str, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """Kind, label, n: the facet's counts, the total and the page's keys."""
    of = lambda kind, label, n: [F.lit(kind).alias("kind"), label.cast("string").alias("label"), n.cast("long").alias("n")]
    counts = rows.groupBy(facet).agg(F.count("*").alias("n"))
    shown = page(rows, order, offset, limit).select(*of("page", F.col(key), F.lit(1)))
    total = rows.agg(F.count("*").alias("n")).select(*of("total", F.lit("all"), F.col("n")))
    return counts.select(*of("status", F.col(facet), F.col("n"))).unionByName(total).unionByName(shown)


def counters(rows: DataFrame, axes: Sequence[str], filled: Mapping[str, str]) -> DataFrame:
    """Per value of each axis the rows and how many have each column, in one pass over grouping sets."""
    return rows.groupingSets([[a] for a in axes], *axes).agg(F.count("*").alias("n"), *[F.count(c).alias(name) for name, c in filled.items()])


def presence(values: Sequence[Column]) -> list[Column]:
    """Share of the values that are known, and the state it means."""
    filled = sum((F.when(v.isNotNull(), 1).otherwise(0) for v in values), F.lit(0))
    state = F.when(filled == len(values), "complete").when(filled == 0, "empty").otherwise("partial")
    return [F.round(filled / len(values), 3).alias("presence"), state.alias("state")]


def draft_template(pages: DataFrame, words: DataFrame, key: str, anchors: Sequence[tuple[str, str, bool]]) -> DataFrame:
    """Per page and field the first word that is its anchor: place and confidence, 0 where none is.

    ``words``: key, place, word; ``anchors``: (field, anchor, strong), a constant of the program, so columns.
    """
    hits = [F.min(F.when(F.lower("word") == anchor, F.col("place"))).alias(f"a{k}") for k, (_, anchor, _) in enumerate(anchors)]
    found = pages.select(key).join(words.groupBy(key).agg(*hits), key, "left")
    each = [
        F.struct(F.lit(name).alias("field"), F.col(f"a{k}").alias("place"), F.when(F.col(f"a{k}").isNull(), 0.0).otherwise(0.9 if strong else 0.6).alias("confidence"))
        for k, (name, _, strong) in enumerate(anchors)
    ]
    return found.select(key, F.inline(F.array(*each)))


def deposit_outcomes(files: DataFrame, folder: str, verdict: Column) -> DataFrame:
    """Per folder one outcome: waiting while a file has no verdict, deposited if all are good."""
    outcome = F.when(F.bool_or(verdict.isNull()), "waiting").when(F.bool_and(verdict == 1), "deposited").otherwise("refused")
    return files.groupBy(folder).agg(outcome.alias("outcome"), F.count("*").alias("files"))


def approval_queue(requests: DataFrame, key: str, status: str, at: str, now: Column, pending: str, days: int, limit: int) -> DataFrame:
    """Oldest requests first; pending ones older than ``days`` are told as expired."""
    state = F.when((F.col(status) == pending) & (F.date_diff(now, F.col(at)) > days), "expired").otherwise("kept")
    return page(requests, [F.asc(at), F.asc(key)], 0, limit).select(key, status, state.alias("state"))
