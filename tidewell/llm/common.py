"""Shared pieces: tables in the cluster's shared folder, word rules, row order.

Conventions used by every operator here
---------------------------------------
* Inputs are plain DataFrames with at least the named columns. Operators that answer per
  document ignore further columns; stages that pass rows on keep them all, and name columns
  of their own by ``private``, so that no name can clash.
* A null text counts as the empty text unless an operator states otherwise.
* Intermediate tables go to the folder named by ``spark.checkpoint.dir``, which
  all executors and the driver share; a lost executor costs a re-read, no more.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RUNS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder of this application's intermediate tables, below ``spark.checkpoint.dir``.

    Where the setting is absent (tests, notebooks on one machine) a local folder is
    chosen; on a cluster its absence is an error, as local disks are not shared.
    """
    context = spark.sparkContext
    app = context.applicationId
    if app not in _RUNS:
        base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not base:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = "file:///tmp/checkpoints"
        _RUNS[app] = f"{base.rstrip('/')}/tables-{uuid.uuid4().hex}"
        atexit.register(_forget, spark, _RUNS[app])
    return _RUNS[app]


def _forget(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # the JVM may be gone already; the folder is unique, so nothing clashes
        pass


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Table:
    """A DataFrame written to the shared folder; ``df`` reads it, ``drop`` removes it."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex[:12]}"
        schema = df.schema
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(schema).parquet(self.path)

    def drop(self) -> None:
        delete(self.spark, self.path)


def bounded_batches(spark: SparkSession, rows: int = 10_000, data: str = "4m") -> None:
    """Arrow batches of so many rows and so many bytes at most: long texts stay within a worker's memory.

    Every operator asks for the same bounds, so what one sets holds for plans of another that run later.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", data)


def private(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many leading underscores as keep it apart from the columns of ``df`` (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def per_worker(key, make):
    """What ``make()`` gave the first time in this worker process: kept from task to task."""
    import sys
    import types

    store = sys.modules.setdefault("_tidewell_worker", types.ModuleType("_tidewell_worker"))
    kept = store.__dict__.setdefault("kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def words(text: str | None) -> list[bytes]:
    """Maximal runs of anything but space and 0x09-0x0D, as UTF-8 (``bytes.split`` cuts at exactly these)."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_count(column) -> F.Column:
    """The same rule as ``words``, counted inside the JVM."""
    return F.when(column.isNull(), F.lit(0)).otherwise(
        F.size(F.filter(F.split(column, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    ).cast("long")


def with_prefix_sum(df: DataFrame, order: list[str], value: str, out: str, name: str, range_as: str = "__range") -> Table:
    """Adds ``out``: the sum of ``value`` over all rows before this one in ``order``.

    Range-partitions by ``order`` and writes each row with its range number, so that the
    number is data and survives retries; a window then runs inside each range and the
    (few, one a range) totals are offset. No task sees more than one range. ``range_as`` keeps
    the range's number as a column.
    """
    from pyspark.sql import Window

    spark = df.sparkSession
    parts = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(parts, *[F.col(c).asc_nulls_first() for c in order])
    table = Table(ranged.withColumn("__range", F.spark_partition_id()), name)
    totals = table.df.groupBy("__range").agg(F.sum(value).alias("__total"))
    # one row for each range: at most ``parts`` rows, a constant of the session
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__range", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset"))
    inner = Window.partitionBy("__range").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    inner = inner.rowsBetween(Window.unboundedPreceding, -1)
    table.df = (
        table.df.join(F.broadcast(offsets), "__range")
        .withColumn(out, (F.coalesce(F.sum(value).over(inner), F.lit(0)) + F.col("__offset")).cast("long"))
        .withColumnRenamed("__range", range_as)
        .drop("__range", "__offset")
    )
    return table
