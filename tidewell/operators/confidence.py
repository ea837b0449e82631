"""Robust statistics, reuse confidence and threshold calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_POPULATION, ALERT, HETEROGENEOUS, LEAST_VALUES = 5, 75.0, 0.075, 3


def robust_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """N, median, q1, q3, iqr, mad, least, most; quartiles by linear interpolation, rounded to 3.

    The median absolute deviation needs the unrounded median, so it is a second aggregate over
    the rows joined with their group's median; both shuffle on the same keys.
    """
    known = df.where(F.col(value).isNotNull())
    first = known.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile(value, F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("q"), F.min(value).alias("least"), F.max(value).alias("most"))
    spread = known.select(*keys, value).join(first.select(*keys, F.col("q")[1].alias("__median")), list(keys))
    mad = spread.groupBy(*keys).agg(F.percentile(F.abs(F.col(value) - F.col("__median")), 0.5).alias("mad"))
    q = lambda k: F.bround(F.col("q")[k], 3)
    return first.join(mad, list(keys)).select(
        *keys, "n", q(1).alias("median"), q(0).alias("q1"), q(2).alias("q3"), F.bround(F.col("q")[2] - F.col("q")[0], 3).alias("iqr"),
        F.bround("mad", 3).alias("mad"), F.bround("least", 3).alias("least"), F.bround("most", 3).alias("most"),
    )


def sigma(iqr: Column, mad: Column) -> Column:
    return F.when(iqr > 0, iqr / 1.349).when(mad > 0, mad * 1.4826).otherwise(0.0)


def value_score(value: Column, median: Column, iqr: Column, mad: Column) -> Column:
    """0 to 100: a Gaussian of the robust z; in a constant population, linear down to 10 % off."""
    gap, s = F.abs(value - median), sigma(iqr, mad)
    z = gap / F.nullif(s, F.lit(0.0))
    base = F.when(median == 0, 1.0).otherwise(F.abs(median))
    constant = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (1 - gap / base / 0.10) * 100))
    return F.bround(F.when(s > 0, F.exp(-0.5 * z * z) * 100).when(gap == 0, 100.0).otherwise(constant), 1)


def heterogeneous(median: Column, iqr: Column) -> Column:
    base = F.abs(median)
    return F.when(base == 0, iqr > 0).otherwise(iqr / F.nullif(base, F.lit(0.0)) > HETEROGENEOUS)


def reuse_confidence(rows: DataFrame, keys: Sequence[str], row_id: str, dims: Sequence[str]) -> DataFrame:
    """Every row against its population (rows of equal keys): score and verdict.

    A population of fewer than 5 or fewer than 2 scored dimensions is insufficient; half or
    more heterogeneous dimensions give no score; the score is the median over dimensions.
    """
    long = rows.select(*keys, row_id, F.inline(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("double").alias("value")) for d in dims])))
    stats = robust_stats(long, [*keys, "dim"], "value").where(F.col("n") >= LEAST_VALUES)
    judged = long.join(stats, [*keys, "dim"], "left")
    score = F.when(F.col("median").isNotNull() & F.col("value").isNotNull(), value_score(F.col("value"), F.col("median"), F.col("iqr"), F.col("mad")))
    mixed = F.col("median").isNotNull() & heterogeneous(F.col("median"), F.col("iqr"))
    per_row = judged.groupBy(*keys, row_id).agg(
        F.count_if(F.col("median").isNotNull()).alias("common"), F.count_if(mixed).alias("mixed"), F.count(score).alias("scored"), F.percentile(score, 0.5).alias("middle")
    )
    population = rows.groupBy(*keys).agg(F.count("*").alias("n_population"))
    verdict = (
        F.when(F.col("n_population") < LEAST_POPULATION, "insufficient")
        .when((F.col("common") > 0) & (2 * F.col("mixed") >= F.col("common")), "heterogeneous")
        .when(F.col("scored") < 2, "insufficient")
        .when(F.bround("middle", 1) >= ALERT, "compatible")
        .otherwise("to_examine")
    )
    return per_row.join(population, list(keys)).withColumn("verdict", verdict).select(
        *keys, row_id, "n_population", F.when(F.col("verdict").isin("compatible", "to_examine"), F.bround("middle", 1)).alias("score"), "verdict"
    )


def calibration_ladder(df: DataFrame, family: str, score: str, correct: Column, bounds: Sequence[float], least: int = 5) -> DataFrame:
    """Per family and bound, rows at or above it and their accuracy; null if fewer than ``least``."""
    known = df.where(F.col(score).isNotNull())
    counts = known.groupBy(family).agg(*[x for k, b in enumerate(bounds) for x in (F.count_if(F.col(score) >= b).alias(f"n{k}"), F.count_if((F.col(score) >= b) & correct).alias(f"c{k}"))])
    rungs = F.array(*[F.struct(F.lit(float(b)).alias("bound"), F.col(f"n{k}").alias("n"), F.col(f"c{k}").alias("n_correct")) for k, b in enumerate(bounds)])
    ratio = F.when(F.col("n") >= least, F.round(F.col("n_correct") / F.nullif(F.col("n"), F.lit(0)), 4))
    return counts.select(family, F.inline(rungs)).withColumn("accuracy", ratio)


def recommended_threshold(df: DataFrame, family: str, score: str, correct: Column, target: float, least: int = 5) -> DataFrame:
    """The lowest observed score above which at least ``least`` rows are right often enough.

    Scores are first counted by distinct value, so the running sums see each value once.
    """
    values = df.where(F.col(score).isNotNull()).groupBy(family, F.round(score, 6).alias("threshold")).agg(F.count("*").alias("n"), F.count_if(correct).alias("c"))
    above = Window.partitionBy(family).orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    running = values.select(family, "threshold", F.sum("n").over(above).alias("n"), F.sum("c").over(above).alias("c"))
    fits = (F.col("n") >= least) & (F.col("c") / F.col("n") >= target - 1e-9)
    return running.groupBy(family).agg(F.min(F.when(fits, F.col("threshold"))).alias("threshold"))


def target_gaps(rows: DataFrame, key: str, target, keys: Sequence[str], value: str) -> DataFrame:
    """One record against its population (the others of equal keys): their number, its gap to their median, whether they suffice for a score."""
    own = F.broadcast(rows.where(F.col(key) == target).select(*keys, F.col(value).alias("__v")).limit(1))  # one row
    others = rows.where(F.col(key) != target).join(own, list(keys))
    stats = others.groupBy(*keys).agg(F.count(value).alias("n"), F.percentile(value, 0.5).alias("m"), F.first("__v").alias("v"))
    return stats.select(*keys, "n", F.round(F.col("v") - F.col("m"), 3).alias("gap"), (F.col("n") >= LEAST_POPULATION).alias("scored"))


def calibration_proposal(df: DataFrame, family: str, score: str, correct: Column, sheet: str, target: float, least_sheets: int) -> DataFrame:
    """Per family the recommended threshold (A30) and whether enough sheets were observed to apply it."""
    sheets = df.groupBy(family).agg((F.countDistinct(sheet) >= least_sheets).alias("applicable"))
    return recommended_threshold(df, family, score, correct, target).join(sheets, family)
