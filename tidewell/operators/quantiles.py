"""Exact quantiles of groups of any size (A03, A28): no task holds a whole group.

Equal values are counted first, so ties cost one row. The distinct (group, value) rows are then dealt
by ranges of both, so a large group is spread over many tasks; how many rows of a group each range
holds, a row for each range and group, tells in which range a rank falls and where in it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import kept


def quantiles(df: DataFrame, keys: Sequence[str], value: Column, probabilities: Sequence[float], parts: int = 200) -> DataFrame:
    """The keys, n and q: the quantiles by linear interpolation between neighbours, as ``percentile`` gives them.

    Null values are left out; null keys are a group like others; without keys all rows are one group.
    """
    return _ranked(_dealt(df.select(*_given(keys), value.cast("double").alias("v"), F.lit(1).alias("m")), parts), keys, probabilities)


def _names(keys: Sequence[str]) -> list[str]:
    return [f"__k{i}" for i in range(len(keys))] or ["__k0"]


def _given(keys: Sequence[str]) -> list[Column]:
    return [F.col(k).alias(n) for k, n in zip(keys, _names(keys), strict=True)] if keys else [F.lit(0).alias("__k0")]


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    """The distinct (group, v) with m, how many rows they stand for, and the range (``part``) they are in."""
    names = [c for c in rows.columns if c not in ("v", "m")]
    counted = rows.where("v IS NOT NULL").groupBy(*names, "v").agg(F.sum("m").alias("m"))
    # the range's number is written with the row: it is data, whatever is run again
    return kept(counted.repartitionByRange(parts, *names, "v").withColumn("part", F.spark_partition_id()))


def _ranked(dealt: DataFrame, keys: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    names = _names(keys)
    totals = dealt.groupBy(*names, "part").agg(F.sum("m").alias("rows"))
    earlier = Window.partitionBy(*names).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*names)
    placed = totals.select(*names, "part", "rows", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"), F.sum("rows").over(whole).alias("n"))
    place = lambda p: F.lit(p) * (F.col("n") - 1)
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), r.cast("long").alias("rank")) for i, p in enumerate(probabilities) for r in (F.floor(place(p)), F.ceil(place(p)))])
    ranks = placed.select(*names, "part", "before", "n", "rows", F.inline(wanted)).where("rank >= before AND rank < before + rows")
    # only ranges in which a rank falls are numbered
    r = ranks.select(*[F.col(n).alias(f"r{n}") for n in names], F.col("part").alias("r_part"), "before", "n", "i", "rank")
    same = [F.col(n).eqNullSafe(F.col(f"r{n}")) for n in names] + [F.col("part") == F.col("r_part")]
    own = dealt.join(r.select(*[f"r{n}" for n in names], "r_part").distinct(), same, "left_semi")
    up_to = Window.partitionBy(*names, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = own.withColumn("upto", F.sum("m").over(up_to))
    hits = numbered.join(r, [*same, F.col("rank") - F.col("before") < F.col("upto"), F.col("rank") - F.col("before") >= F.col("upto") - F.col("m")])
    ends = hits.groupBy(*names, "n", "i").agg(F.min_by("v", "rank").alias("low"), F.max_by("v", "rank").alias("high"))
    told = ends.groupBy(*names, "n").agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct("low", "high")))).alias("ends"))  # as many as quantiles

    def between(i: int, p: float) -> Column:
        share = place(p) - F.floor(place(p))
        e = F.col("ends")[i]
        return (1 - share) * e["low"] + share * e["high"]

    return told.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=False)], "n", F.array(*[between(i, p) for i, p in enumerate(probabilities)]).alias("q"))


def robust_stats(df: DataFrame, keys: Sequence[str], value: str, parts: int = 200) -> DataFrame:
    """A28 for groups of any size: as ``confidence.robust_stats``.

    The medians meet the counted values range by range, not the rows group by group.
    """
    names = _names(keys)
    dealt = _dealt(df.select(*_given(keys), F.col(value).cast("double").alias("v"), F.lit(1).alias("m")), parts)
    first = kept(_ranked(dealt, keys, (0.0, 0.25, 0.5, 0.75, 1.0)))
    medians = first.select(*[c.alias(f"r{n}") for c, n in zip(_given(keys), names, strict=True)], F.col("q")[2].alias("median"))
    same = [F.col(n).eqNullSafe(F.col(f"r{n}")) for n in names]
    ranges = dealt.select(*names, "part").distinct().join(medians, same).select(*medians.columns, F.col("part").alias("r_part"))
    # not by broadcast: a table of few bytes may hold many rows; the side that is hashed has a row for each range and group
    spread = dealt.join(ranges.hint("shuffle_hash"), [*same, F.col("part") == F.col("r_part")]).select(*names, F.abs(F.col("v") - F.col("median")).alias("v"), "m")
    mad = _ranked(_dealt(spread, parts), keys, (0.5,)).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("q")[0].alias("mad"))
    q = lambda k: F.bround(F.col("q")[k], 3)
    return first.join(mad, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]).select(
        *keys, "n", q(2).alias("median"), q(1).alias("q1"), q(3).alias("q3"), F.bround(F.col("q")[3] - F.col("q")[1], 3).alias("iqr"),
        F.bround("mad", 3).alias("mad"), q(0).alias("least"), q(4).alias("most"),
    )
