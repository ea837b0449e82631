"""Quantiles by ranges against Spark's own percentile."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import confidence, quantiles


@pytest.fixture(scope="module")
def df(spark):
    pick = random.Random(1)
    rows = [(pick.choice(["hot"] * 6 + ["b", None]), i % 2, pick.choice([None, 1.5, pick.gauss(0, 10), float(pick.randrange(4))])) for i in range(3000)]
    return spark.createDataFrame([*rows, ("one", 1, 7.0), ("none", 1, None)], "k string, j int, v double")


def told(df, keys):
    return {tuple(r[k] for k in keys): (r.n, [pytest.approx(x) for x in r.q]) for r in df.collect()}


@pytest.mark.parametrize("keys", [["k"], ["k", "j"], []])
def test_quantiles_equal_percentile(df, keys):
    ps = (0.0, 0.1, 0.5, 0.95, 1.0)
    known = df.where("v IS NOT NULL")
    want = known.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile("v", F.array(*map(F.lit, ps))).alias("q"))
    assert told(quantiles.quantiles(df, keys, F.col("v"), ps, parts=17), keys) == told(want, keys)


def test_a_large_group_is_in_many_ranges(df):
    plan = quantiles.quantiles(df.select("k", F.monotonically_increasing_id().alias("v")), ["k"], F.col("v"), (0.5,), parts=8)
    assert plan.where("k = 'hot'").first().q


def test_robust_stats_are_the_same(df):
    known = df.where("k IS NOT NULL")
    rows = lambda d: {r.k: [None if x is None else round(float(x), 3) for x in r[1:]] for r in d.collect()}
    assert rows(quantiles.robust_stats(known, ["k"], "v")) == rows(confidence.robust_stats(known, ["k"], "v"))
    assert quantiles.quantiles(df.limit(0), ["k"], F.col("v"), (0.5,)).count() == 0


def test_medians_meet_counted_values_by_range(spark, df, monkeypatch, tmp_path):
    df.write.parquet(f"{tmp_path}/given")
    given, written, kept = spark.read.parquet(f"{tmp_path}/given"), [], quantiles.kept
    monkeypatch.setattr(quantiles, "kept", lambda d: written.append(d) or kept(d))
    quantiles.robust_stats(given, ["k"], "v").count()
    rows_read = [any("/given/" in f for f in d.inputFiles()) for d in written]
    assert rows_read[0] and not any(rows_read[1:])  # the rows are read to be counted, and never sent to their group
