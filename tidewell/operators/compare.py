"""Comparison of records over named dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpivot(df: DataFrame, keys: Sequence[str], dims: Sequence[str]) -> DataFrame:
    """One row for each key and dimension, nulls too."""
    return df.select(*keys, F.inline(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("double").alias("value")) for d in dims])))


def compare_pairs(pairs: DataFrame, records: DataFrame, key: str, dims: Sequence[str]) -> DataFrame:
    """Per pair (a, b) and dimension: both values, b - a, its percentage and the state."""
    long = unpivot(records, [key], dims)
    a = long.select(F.col(key).alias("a"), "dim", F.col("value").alias("value_a"))
    b = long.select(F.col(key).alias("b"), "dim", F.col("value").alias("value_b"))
    both = pairs.join(a, "a").join(b, ["b", "dim"])
    delta = F.col("value_b") - F.col("value_a")
    state = F.when(F.col("value_a").isNull() & F.col("value_b").isNull(), "missing").when(F.col("value_a").isNull(), "only_b").when(F.col("value_b").isNull(), "only_a").when(delta == 0, "equal").otherwise("different")
    percent = F.round(delta / F.nullif(F.abs("value_a"), F.lit(0.0)) * 100, 2)  # no percentage of zero
    return both.select("a", "b", "dim", "value_a", "value_b", F.round(delta, 3).alias("delta"), percent.alias("percent"), state.alias("state"))


def compare_many(records: DataFrame, group: str, key: str, reference: Column, dims: Sequence[str]) -> DataFrame:
    """Per group and dimension: range over members, whether all agree, largest gap to the reference in percent."""
    long = unpivot(records.withColumn("__reference", reference), [group, key, "__reference"], dims)
    base = long.where("__reference").groupBy(group, "dim").agg(F.max("value").alias("base"))
    joined = long.join(base, [group, "dim"], "left")
    gap = F.abs(F.col("value") - F.col("base")) / F.nullif(F.abs("base"), F.lit(0.0)) * 100
    return joined.groupBy(group, "dim").agg(
        F.count("value").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"),
        F.coalesce(F.min("value") == F.max("value"), F.lit(False)).alias("identical"), F.round(F.max(gap), 2).alias("max_gap"),
    )


def comparable(records: DataFrame, key: str, keys: Sequence[str], dims: Sequence[str], target) -> DataFrame:
    """Rows of the target's keys, by how many dimensions both have. One target row is looked up, no self-join of groups."""
    own = records.where(F.col(key) == target).limit(1).select(*[F.col(c).alias(f"__{c}") for c in [*keys, *dims]])
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]
    both = sum((F.when(F.col(d).isNotNull() & F.col(f"__{d}").isNotNull(), 1).otherwise(0) for d in dims), F.lit(0))
    return records.join(F.broadcast(own), F.expr("true") if not same else [*same]).where(F.col(key) != target).select(key, both.alias("common"))


def any_within(dims: Sequence[str], low: float, high: float) -> Column:
    """One of the dimensions lies in the range."""
    return F.exists(F.array(*[F.col(d).cast("double") for d in dims]), lambda x: F.coalesce(x.between(low, high), F.lit(False)))
