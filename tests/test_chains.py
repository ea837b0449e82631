"""Hash chains of a log: plain digests, and every kind of damage found."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidewell.operators import chains as C
from tidewell.storage import kept

COLUMNS = ["id", "who", "what"]


def sha(*parts):
    return hashlib.sha256("|".join(parts).encode()).hexdigest()


@pytest.fixture(scope="module")
def log(spark):
    rows = [(i, f"2024-01-0{1 + i % 3}", None if i % 7 == 0 else f"user {i % 5}", "a,1:b" if i % 2 else "") for i in range(200)]
    entries = spark.createDataFrame(rows, "id long, day string, who string, what string")
    return kept(C.sealed(entries, "id", ["id"], F.col("day"), COLUMNS, lanes=3, block=8))


def wrong(log, damaged):
    return {(r.id, r.state) for r in C.breaks(damaged, C.heads(log, 8), "id", COLUMNS, 8).collect()}


def test_digests_are_those_of_a_plain_loop(log):
    rows = sorted(log.collect(), key=lambda r: (r.period, r.lane, r.n))
    assert len(rows) == 200
    for k, r in enumerate(rows):
        told = ",".join("-" if v is None else f"{len(str(v))}:{v}" for v in (r.id, r.who, r.what))
        new = (r.n - 1) % 8 == 0
        assert r.previous == (sha(r.period, str(r.lane), str((r.n - 1) // 8)) if new else rows[k - 1].digest)
        assert r.digest == sha(r.previous, told)
    head = ""
    for h in C.heads(log, 8).orderBy("period").collect():
        head = sha(head, h.root)
        assert h.head == head and h.entries == sum(r.period == h.period for r in rows)


def test_a_sound_log_gives_nothing(log):
    assert wrong(log, log) == set()


def test_every_damage_is_found(log):
    # an entry changed, one missing inside a block, the last one of a lane missing, and two swapped
    assert (50, "altered") in wrong(log, log.withColumn("what", F.when(F.col("id") == 50, "x").otherwise(F.col("what"))))
    one = log.where("n = 3").orderBy("id").first()
    assert {s for _, s in wrong(log, log.where(F.col("id") != one.id))} == {"unlinked", "root"}
    last = log.groupBy("period", "lane").agg(F.max_by("id", "n").alias("id")).first().id
    assert wrong(log, log.where(F.col("id") != last)) == {(None, "root")}
    a, b = (r.id for r in log.where((F.col("period") == one.period) & (F.col("lane") == one.lane) & F.col("n").isin(2, 3)).orderBy("n").collect())
    swapped = log.withColumn("n", F.when(F.col("id") == a, 3).when(F.col("id") == b, 2).otherwise(F.col("n")))
    assert {(a, "unlinked"), (b, "unlinked")} <= wrong(log, swapped)
    # a whole period gone, and one made anew with other content
    assert (None, "root") in wrong(log, log.where("period <> '2024-01-02'"))
    anew = C.sealed(log.select("id", F.col("period").alias("day"), F.lit("other").alias("who"), "what"), "id", ["id"], F.col("day"), COLUMNS, lanes=3, block=8)
    assert {s for _, s in wrong(log, anew)} == {"root"}


def test_contents_do_not_run_together(spark):
    rows = spark.createDataFrame([("a,1:b", "c"), ("a", "b,1:c"), (None, "-"), ("-", None)], "x string, y string").select(C.canonical(["x", "y"]).alias("c"))
    assert len({r.c for r in rows.collect()}) == 4


def test_empty_log(spark):
    none = spark.createDataFrame([], "id long, day string, who string, what string")
    made = C.sealed(none, "id", ["id"], F.col("day"), COLUMNS)
    assert made.count() == 0 and C.heads(made).count() == 0
