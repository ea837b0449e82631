"""Latest-per-key, ordering, paging and set operators (Q, O, U)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """Q02-Q06, Q09: the ``n`` first rows of each key in ``order``.

    ``row_number() <= n`` is planned as a group limit that also runs before the shuffle, so a
    hot key sends ``n`` rows a task.
    """
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("__rank") <= n).drop("__rank")


def best_trace(df: DataFrame, keys: Sequence[str], value: str, *merits: Column) -> DataFrame:
    """Q10: per key the value whose tuple of merits is largest; an aggregate, so combined before the shuffle."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*merits)).alias(value))


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """One page; planned as a top-k of offset + limit rows, never a full sort."""
    return df.orderBy(*order).offset(offset).limit(limit)


def has_more(total: int, offset: int, limit: int) -> bool:
    return offset + limit < total


def ordered_union(lists: Sequence[DataFrame], key: str, position: str) -> DataFrame:
    """Rankings one after the other; the first place of a key wins. Columns key, list_no, position."""
    parts = [df.select(key, F.lit(n).alias("list_no"), F.col(position).alias("position")) for n, df in enumerate(lists)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    best = every.groupBy(key).agg(F.min(F.struct("list_no", "position")).alias("at"))
    return best.select(key, "at.list_no", "at.position")


def sort_columns(choice: str, allowed: dict[str, Sequence[Column]], default: str) -> Sequence[Column]:
    """Orders by name from a white list; unknown names give the default."""
    return allowed.get(choice, allowed[default])


def by_given_order(df: DataFrame, key: str, ids: Sequence) -> DataFrame:
    """The rows of ``ids`` with their place in it (from 1)."""
    return df.where(F.col(key).isin(list(ids))).withColumn("place", F.array_position(F.array(*[F.lit(i) for i in ids]), F.col(key)))


def nearest(df: DataFrame, target: float, dims: Sequence[str]) -> Column:
    """Distance of the nearest of several dimensions to the target; null if all are null."""
    distances = [F.abs(F.col(d) - target) for d in dims]
    return F.least(*distances) if len(distances) > 1 else distances[0]
