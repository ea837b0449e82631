"""Completion tables against plain Python, before and after changes."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import completions as Z
from tidewell.operators import retrieval as R
from tidewell.storage import shared_dir


@pytest.fixture(scope="module")
def rows():
    pick = random.Random(6)
    word = lambda: "".join(pick.choice("abcé") for _ in range(pick.randint(1, 5)))
    return [(pick.choice(["x", "y"]), f"{word()} {word()}".title()) for _ in range(150)] + [("x", "Same"), ("y", "same"), ("x", None), ("x", "  "), ("y", "a very long value that goes on and on"), ("x", "a very long value that goes on")]


def key_of(v):
    return " ".join(v.lower().replace("é", "e").split())


def brute(rows, typed):
    keys = {}
    for nature, value in rows:
        if value and key_of(value).startswith(typed):
            k = key_of(value)
            keys[k] = min(keys.get(k, (value, nature)), (value, nature))
    best = sorted((len(k), v, n, k) for k, (v, n) in keys.items())[: Z.BEST]
    return [(v, n, k) for _, v, n, k in best]


def table(spark, rows):
    return spark.createDataFrame(rows, "nature string, value string")


def test_lists_before_and_after_changes(spark, rows):
    made = Z.Completions(spark, f"{shared_dir(spark)}/completions-{random.random()}").create(table(spark, rows))
    read = lambda typed: [(r.value, r.nature, r.key) for r in made.complete(typed).orderBy("place").collect()]
    typed = ["a", "b", "ab", "same", "a very long value that goes on", "zz", "c"]
    assert [read(x) for x in typed] == [brute(rows, x) for x in typed]
    more = [("z", "Ab"), ("x", "A"), ("z", "Same"), ("w", "Zz top")]
    made.add(table(spark, more + rows[:3]))
    now = rows + more
    assert [read(x) for x in typed] == [brute(now, x) for x in typed]
    gone = {("x", "A"), ("z", "Same"), rows[0], rows[1], rows[2]}
    made.remove(table(spark, list(gone)))
    now = [r for r in now if r not in gone]
    assert [read(x) for x in typed] == [brute(now, x) for x in typed]
    plan = made.complete("ab")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(prefix,ab)" in plan


@pytest.mark.parametrize("typed", ["a", "ab c", "same", "samee"])
def test_suggestions_equal_the_scan(spark, rows, typed):
    made = Z.Completions(spark, f"{shared_dir(spark)}/completions-{random.random()}").create(table(spark, rows))
    told = lambda df: sorted(map(tuple, df.collect()))
    known = table(spark, [r for r in rows if r[1] and r[1].strip()])
    parts = [(n, known.where(F.col("nature") == n), "value") for n in ("x", "y")]
    assert told(made.suggestions(typed)) == told(R.suggestions(parts, typed))
