"""Tables changed file by file: which files are rewritten, what readers see, who is refused."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidewell.sources.stored import StoredTable
from tidewell.storage import Conflict, shared_dir


@pytest.fixture
def table(spark):
    rows = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"), F.lit("old").alias("s"))
    return StoredTable(spark, f"{shared_dir(spark)}/table-{random.random()}", "k").create(rows, 100)


def told(df):
    return {r.k: (r.v, r.s) for r in df.collect()}


def digests(files):
    return {f: hashlib.sha256(open(f.removeprefix("file:").replace("///", "/"), "rb").read()).hexdigest() for f in files}


def test_other_files_stay_as_they_are(spark, table):
    before, first = table.files(), table.read()
    marks = digests(before)
    assert len(before) > 10
    changes = spark.createDataFrame([(k, -k, "new") for k in range(500, 520)] + [(5000, 1, "new")], "k long, v long, s string")
    assert table.upsert(changes, rows_a_file=100) == 2
    after = table.files()
    stay = set(before) & set(after)
    assert len(stay) >= len(before) - 2 and digests(stay) == {f: marks[f] for f in stay}
    want = {k: (2 * k, "old") for k in range(2000)} | {k: (-k, "new") for k in range(500, 520)} | {5000: (1, "new")}
    assert told(table.read()) == want
    # a reader from before sees its own version, and so does one who asks for it
    assert told(first) == told(table.read(1)) == {k: (2 * k, "old") for k in range(2000)}


def test_deletes_guards_and_nulls(spark, table):
    assert table.delete(spark.createDataFrame([(9_999,)], "k long")) == 1  # nothing to do
    table.delete(spark.createDataFrame([(3,), (4,), (1999,)], "k long"), rows_a_file=100)
    assert sorted(set(range(2000)) - set(told(table.read()))) == [3, 4, 1999]
    changes = spark.createDataFrame([(None, 1, "a"), (10, None, "b")], "k long, v long, s string")
    table.upsert(changes, guard=F.col("v") == 22, keep_old=True, rows_a_file=100)
    assert told(table.read())[None] == (1, "a") and told(table.read())[10] == (20, "b")
    table.upsert(spark.createDataFrame([(None, 2, "c"), (11, 0, "c")], "k long, v long, s string"), guard=F.col("v") == 22, rows_a_file=100)
    now = told(table.read())
    assert now[None] == (2, "c") and now[11] == (22, "old") and table.read().where("k IS NULL").count() == 1
    table.delete(spark.createDataFrame([(None,)], "k long"))
    assert None not in told(table.read())


def test_the_second_of_two_writers_is_refused(spark, table, monkeypatch):
    changes = spark.createDataFrame([(1, 0, "x")], "k long, v long, s string")
    slow = StoredTable(spark, table.path, "k")
    publish = slow._publish

    def late(version, manifest, schema):
        table.upsert(changes, rows_a_file=100)
        return publish(version, manifest, schema)

    monkeypatch.setattr(slow, "_publish", late)
    with pytest.raises(Conflict):
        slow.delete(spark.createDataFrame([(1,)], "k long"))
    assert told(table.read())[1] == (0, "x")


def test_vacuum_keeps_what_is_read(spark, table):
    for v in range(3):
        table.upsert(spark.createDataFrame([(7, v, "x")], "k long, v long, s string"), rows_a_file=100)
    want = told(table.read())
    assert table.vacuum(1) > 0 and told(table.read()) == want


def test_empty_table(spark):
    made = StoredTable(spark, f"{shared_dir(spark)}/table-{random.random()}", "k").create(spark.createDataFrame([], "k long, v long"))
    assert made.read().count() == 0
    made.upsert(spark.createDataFrame([(1, 2)], "k long, v long"))
    assert [tuple(r) for r in made.read().collect()] == [(1, 2)]


def test_many_files_take_few_ranges_and_no_listing_by_path(spark, monkeypatch):
    monkeypatch.setattr("tidewell.sources.stored.RANGES", 2, raising=False)
    rows = spark.range(2000).select(F.col("id").alias("k"), F.lit("old").alias("s"))
    made = StoredTable(spark, f"{shared_dir(spark)}/table-{random.random()}", "k").create(rows, 50)
    parts = {f.rsplit("/", 1)[1][:10] for f in made.files()}
    assert len(parts) == 2 and len(made.files()) >= 40 and made.manifest().agg(F.max("rows")).first()[0] <= 50
    assert len(made.read().inputFiles()) == len(made.files()) and "Location: InMemoryFileIndex(1 paths)" in made.read()._jdf.queryExecution().executedPlan().toString()
    made.upsert(spark.createDataFrame([(7, "new"), (5000, "new")], "k long, s string"), rows_a_file=50)
    made.delete(spark.createDataFrame([(8,)], "k long"), rows_a_file=50)
    assert {r.k: r.s for r in made.read().collect()} == {k: "new" if k in (7, 5000) else "old" for k in [*range(2000), 5000] if k != 8}
