"""Queue semantics as state tables and streams.

Batch forms answer for a table of attempts; streaming forms read a folder of task files. Spark's
checkpoint gives at-least-once delivery, keys make the effects idempotent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

MOST_ATTEMPTS = 3


def retry_state(attempts: DataFrame, key: str, at: str, failed: Column, most: int = MOST_ATTEMPTS) -> DataFrame:
    """Per task its attempts and failures, the state and, if it waits, the delay of 2 ** failures seconds.

    The state follows the last attempt: done, waiting, or dead after ``most`` failures.
    """
    last = F.max_by(failed, F.col(at))
    state = attempts.groupBy(key).agg(F.count("*").alias("attempts"), F.count_if(failed).alias("failures"), last.alias("last_failed"))
    kind = F.when(~F.col("last_failed"), "done").when(F.col("failures") >= most, "dead").otherwise("waiting")
    return state.select(key, "attempts", "failures", kind.alias("state"), F.when(kind == "waiting", F.pow(F.lit(2.0), F.col("failures")).cast("long")).alias("delay_s"))


def orphans(jobs: DataFrame, queue: DataFrame, key: str, attempts: str, most: int = MOST_ATTEMPTS) -> DataFrame:
    """Jobs that are not in the queue: again, or failed if tried often enough."""
    return jobs.join(queue, key, "left_anti").select(key, F.when(F.col(attempts) >= most, "fail").otherwise("requeue").alias("action"))


def stale(jobs: DataFrame, beat: str, now: Column, seconds: int = 300) -> DataFrame:
    """Jobs whose last heartbeat is older than ``seconds``."""
    return jobs.where(F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(beat).cast("timestamp")) > seconds * 1_000_000)


def rate_limited(events: DataFrame, key: str, at: str, seconds: int = 60, most: int = 600) -> DataFrame:
    """Per event the events of its key in the ``seconds`` up to it, whether over the limit, and when the oldest leaves."""
    clock = F.unix_seconds(F.col(at).cast("timestamp"))
    span = max(3600, 60 * seconds)  # a key's events are cut into spans, each with the end of the one before it: no task sorts a whole key
    place = F.floor(F.col("__s") / span)
    late = F.when(F.pmod("__s", F.lit(span)) >= span - seconds, F.struct((place + 1).alias("__span"), F.lit(False).alias("__own")))
    spans = F.filter(F.array(F.struct(place.alias("__span"), F.lit(True).alias("__own")), late), lambda x: x.isNotNull())
    spread = events.withColumn("__s", clock).select("*", F.inline(spans))
    w = Window.partitionBy(key, "__span").orderBy("__s").rangeBetween(-seconds, 0)
    counted = spread.withColumn("in_window", F.count("*").over(w)).withColumn("__oldest", F.min("__s").over(w)).where("__own")
    wait = F.when(F.col("in_window") > most, F.col("__oldest") + seconds + 1 - F.col("__s")).otherwise(0)
    return counted.withColumn("limited", F.col("in_window") > most).withColumn("retry_after", wait.cast("long")).drop("__s", "__oldest", "__span", "__own")


def sessions(events: DataFrame, key: str, at: str, gap_minutes: int = 30) -> DataFrame:
    """Extension: sessions of a key, parted by silences of more than ``gap_minutes``."""
    order = Window.partitionBy(key).orderBy("__us", "event_id")
    rows = events.withColumn("__us", F.unix_micros(F.col(at).cast("timestamp")))
    fresh = F.coalesce(F.col("__us") - F.lag("__us").over(order) > gap_minutes * 60_000_000, F.lit(True))
    numbered = rows.withColumn("__new", fresh.cast("int")).withColumn("session", F.sum("__new").over(order))
    return numbered.groupBy(key, "session").agg(F.count("*").alias("events"), F.min(at).alias("started"), F.max(at).alias("ended"))


def lockout(attempts: DataFrame, user: str, at: str, failed: Column, now: Column, minutes: int = 15, most: int = 5) -> DataFrame:
    """Failures since the last success within the last ``minutes``, and the seconds a lock still lasts."""
    clock = F.unix_seconds(F.col(at).cast("timestamp"))
    end = F.unix_seconds(now.cast("timestamp"))
    last = attempts.groupBy(user).agg(F.max(F.when(~failed, clock)).alias("__ok"))
    recent = attempts.join(last, user).where(failed & (clock > F.coalesce("__ok", F.lit(-(2**62)))) & (clock > end - minutes * 60))
    state = recent.groupBy(user).agg(F.count("*").alias("failures"), F.max(clock).alias("__last"), F.max(end).alias("__end"))
    return state.select(user, "failures", F.when(F.col("failures") >= most, F.greatest(F.lit(0), F.col("__last") + minutes * 60 - F.col("__end"))).otherwise(0).cast("long").alias("locked_s"))


def retention(rows: DataFrame, at: str, now: Column, days: int, protected: DataFrame, key: str) -> DataFrame:
    """Rows older than ``days`` and not protected."""
    return rows.where(F.col(at) < now - F.make_interval(days=F.lit(days))).join(protected, key, "left_anti")


def task_stream(spark: SparkSession, folder: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """A folder into which task files are dropped."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(folder)


def process_once(tasks: DataFrame, key: str, handle: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Each task's result is appended once: keys done before are left out of every micro-batch.

    A batch that is replayed after a failure finds its keys already done, so delivery at least
    once has the effect of once.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        target = f"{out}/batch={number}"
        fresh = batch.dropDuplicates([key])
        try:
            done = spark.read.parquet(out).where(F.col("batch") != number).select(key)
            fresh = fresh.join(done, key, "left_anti")
        except Exception as e:  # nothing written yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        handle(fresh).write.mode("overwrite").parquet(target)

    return tasks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_stream(events: DataFrame, at: str, late: str = "1 day") -> DataFrame:
    """Events a day from a stream; days close when the watermark passes them."""
    return events.withWatermark(at, late).groupBy(F.window(at, "1 day")).agg(F.count("*").alias("n")).select("window.start", "n")
