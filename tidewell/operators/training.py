"""Training runs kept as data (M15): a model with its split, confusion matrix and metrics, and the best of all runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Conflict, Log, kept
from .ml import centroids, classify, stratified_split


def _mark(key: str, label: str) -> Column:
    """32 bits of a row; sums of them do not depend on order."""
    text = F.concat_ws(":", F.col(key).cast("string"), F.col(label).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


@dataclass
class Run:
    """``version`` names the rows of both sides, the share and the method: the same data give the same version."""

    version: str
    model: DataFrame
    confusion: DataFrame
    metrics: DataFrame


def train(df: DataFrame, key: str, label: str, vector: str, share: float = 0.3) -> Run:
    """The centroid classifier fitted on one side of the split and judged on the other; rows without a label or vector are left out.

    ``confusion``: label, predicted, n. ``metrics``: one row of version, n_train, n_held, accuracy, macro_recall (the mean over labels).
    """
    known = df.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).withColumn("__held", stratified_split(F.col(key), share))
    sides = known.agg(
        F.count_if(~F.col("__held")).alias("n_train"), F.count_if("__held").alias("n_held"),
        F.coalesce(F.sum(F.when(~F.col("__held"), _mark(key, label))), F.lit(0)).alias("a"), F.coalesce(F.sum(F.when(F.col("__held"), _mark(key, label))), F.lit(0)).alias("b"),
    )
    version = F.md5(F.concat_ws("/", F.lit("centroid"), F.lit(f"{round(share * 1000)}"), F.col("a").cast("string"), F.col("b").cast("string")))
    told = sides.select(version.alias("version"), "n_train", "n_held").first()
    model = kept(centroids(known.where(~F.col("__held")), label, vector))
    held = known.where("__held")
    answers = classify(held, key, vector, model).select(F.col(key).alias("__k"), "predicted")
    confusion = kept(held.join(answers, F.col(key) == F.col("__k")).groupBy(F.col(label).alias("label"), "predicted").agg(F.count("*").alias("n")))
    per_label = confusion.groupBy("label").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n"))), F.lit(0)).alias("right"))
    metrics = per_label.agg(F.round(F.sum("right") / F.sum("n"), 6).alias("accuracy"), F.round(F.avg(F.col("right") / F.col("n")), 6).alias("macro_recall"))
    metrics = metrics.select(F.lit(told.version).alias("version"), F.lit(told.n_train).alias("n_train"), F.lit(told.n_held).alias("n_held"), "accuracy", "macro_recall")
    return Run(told.version, model, confusion, metrics)


class Runs:
    """Runs below a path that all executors share; a version is kept once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.log = spark, path.rstrip("/"), Log(spark, path)

    def save(self, run: Run) -> bool:
        """Whether the version is new; models and matrices are written before the version is told of."""
        number, state = self.log.current()
        known = (state or {"runs": []})["runs"]
        if any(r["version"] == run.version for r in known):
            return False
        for name in ("model", "confusion"):
            getattr(run, name).write.mode("overwrite").parquet(f"{self.path}/{run.version}/{name}")
        try:
            self.log.commit(number, {"runs": [*known, run.metrics.first().asDict()]})
        except Conflict:
            return self.save(run)  # another run was kept meanwhile
        return True

    def best(self, metric: str = "accuracy") -> str | None:
        """The version of the highest metric; of equal ones the first kept."""
        runs = (self.log.current()[1] or {"runs": []})["runs"]
        return max(runs, key=lambda r: r[metric] if r[metric] is not None else -1.0)["version"] if runs else None

    def read(self, version: str, name: str = "model") -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{version}/{name}")
