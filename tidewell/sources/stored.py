"""A table of Parquet files that is changed file by file.

A manifest has a row for each file: its name, the least and greatest key, rows and rows without a key.
A change looks up which files its keys can be in by those ranges, reads only the key column of these to
know which hold one, rewrites these and leaves all others as they are. The new manifest is published by
the version log: readers see one version whole, and of two writers from one version one is refused.
Files of earlier versions stay for readers of theirs, until ``vacuum``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import Log, delete
from .merge import upsert

PIECES = 64  # ranges that the keys of a change are told by
ROWS = 1_000_000  # rows aimed at in a file
RANGES = 32  # up to so many files each is a range of its own; more are cut from ranges of
A_TASK = 250_000  # rows, as finding ranges brings the driver rows for each of them


class StoredTable:
    """A table below a path that all executors share; ``key`` is one column, whose nulls are equal to each other."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key, self.log = spark, path.rstrip("/"), key, Log(spark, path)

    def create(self, df: DataFrame, rows_a_file: int = ROWS) -> StoredTable:
        self._publish(0, self._write(df, rows_a_file), df.schema.json())
        return self

    # --- reading

    def _state(self, version: int | None) -> dict:
        current, state = self.log.current()
        if state is None:
            raise ValueError(f"no table at {self.path}")
        return state if version in (None, current) else self.log.at(version)

    def manifest(self, version: int | None = None) -> DataFrame:
        """file, low, high, rows, nulls."""
        state = self._state(version)
        return self.spark.read.schema(StructType.fromJson(json.loads(state["files"]))).parquet(f"{self.path}/{state['manifest']}")

    def files(self, version: int | None = None) -> list[str]:
        """Names of the version's files; as many as files, not rows."""
        return sorted(r.file for r in self.manifest(version).select("file").collect())

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.files(version))

    def _rows(self, files: list[str]) -> DataFrame:
        schema = StructType.fromJson(json.loads(self._state(None)["schema"]))
        if not files:
            return self.spark.createDataFrame([], schema)
        # a folder of which all files count is told by its name: paths told one by one are listed by as many tasks
        folders: dict[str, list[str]] = {}
        for f in files:
            folders.setdefault(f.rsplit("/", 1)[0], []).append(f)
        names = lambda paths: sorted(p.rsplit("/", 1)[1] for p in paths)
        whole = lambda d, own: len(own) > 1 and names(self.spark.read.schema(schema).parquet(d).inputFiles()) == names(own)
        return self.spark.read.schema(schema).parquet(*[p for d, own in folders.items() for p in ([d] if whole(d, own) else own)])

    # --- writing

    def _write(self, df: DataFrame, rows_a_file: int, rows: int | None = None) -> DataFrame:
        """The rows as new files in order of their key; their part of a manifest."""
        where = f"{self.path}/{uuid.uuid4().hex}"
        parts = max(1, -(-(df.count() if rows is None else rows) // rows_a_file))
        tasks = min(parts, max(RANGES, -(-parts * rows_a_file // A_TASK)))
        cut = {"maxRecordsPerFile": rows_a_file} if tasks < parts else {}
        df.repartitionByRange(tasks, self.key).sortWithinPartitions(self.key).write.options(**cut).parquet(where)
        key = F.col(self.key)
        rows_of = self.spark.read.schema(df.schema).parquet(where).select(key.alias("k"), F.col("_metadata.file_path").alias("file"))
        return rows_of.groupBy("file").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.count("*").alias("rows"), F.count_if(F.col("k").isNull()).alias("nulls"))

    def _publish(self, version: int, manifest: DataFrame, schema: str) -> int:
        name = f"manifest-{uuid.uuid4().hex}"
        manifest.coalesce(1).write.parquet(f"{self.path}/{name}")
        return self.log.commit(version, {"manifest": name, "files": manifest.schema.json(), "schema": schema})

    def touched(self, keys: DataFrame, version: int | None = None) -> list[str]:
        """Files that hold one of the keys (a DataFrame of the key column)."""
        keys = keys.select(F.col(self.key).alias("__k")).distinct()
        pieces = keys.repartitionByRange(PIECES, "__k").groupBy(F.spark_partition_id().alias("piece")).agg(F.min("__k").alias("from"), F.max("__k").alias("to"), F.count_if(F.col("__k").isNull()).alias("without"))
        meets = ((F.col("low") <= F.col("to")) & (F.col("high") >= F.col("from"))) | ((F.col("nulls") > 0) & (F.col("without") > 0))
        # ranges of files and of pieces, not rows: a row a file against PIECES rows
        near = [r.file for r in self.manifest(version).join(F.broadcast(pieces), meets).select("file").distinct().collect()]
        if not near:
            return []
        held = self._rows(near).select(F.col(self.key).alias("__own"), F.col("_metadata.file_path").alias("file"))
        return sorted(r.file for r in held.join(keys, F.col("__own").eqNullSafe(F.col("__k")), "left_semi").select("file").distinct().collect())

    def _replace(self, changes: DataFrame, change, rows_a_file: int, adds: bool) -> int:
        version, state = self.log.current()
        touched = self.touched(changes, version)
        if not touched and not adds:
            return version
        names = self.spark.createDataFrame([(f,) for f in touched], "file string")
        manifest = self.manifest(version)
        rows = manifest.join(names, "file", "left_semi").agg(F.sum("rows")).first()[0] or 0
        fresh = self._write(change(self._rows(touched)), rows_a_file, rows + (changes.count() if adds else 0))
        return self._publish(version, manifest.join(names, "file", "left_anti").select("file", "low", "high", "rows", "nulls").unionByName(fresh), state["schema"])

    def upsert(self, changes: DataFrame, guard: Column | None = None, keep_old: bool = False, rows_a_file: int = ROWS) -> int:
        """As ``merge.upsert``, in the files that hold a changed key; rows of new keys go with them. The new version."""
        return self._replace(changes, lambda rows: upsert(rows, changes, [self.key], guard, keep_old), rows_a_file, True)

    def delete(self, keys: DataFrame, rows_a_file: int = ROWS) -> int:
        """Rows of these keys go; a version is made only if a file holds one."""
        gone = keys.select(F.col(self.key).alias("__k")).distinct()
        return self._replace(keys, lambda rows: rows.join(gone, F.col(self.key).eqNullSafe(F.col("__k")), "left_anti"), rows_a_file, False)

    def vacuum(self, keep: int = 2) -> int:
        """Files of versions before the last ``keep`` that no later one has are removed; how many."""
        current, _ = self.log.current()
        if current <= keep:
            return 0
        live = {f for v in range(current - keep + 1, current + 1) for f in self.files(v)}
        dead = {f for v in range(1, current - keep + 1) for f in self.files(v)} - live
        for f in dead:
            delete(self.spark, f)
        return len(dead)
