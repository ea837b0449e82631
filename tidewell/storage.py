"""The cluster's shared folder, and small version logs in it.

A log names what a table consists of at each version. A version is a small file that is written whole
and then renamed to its number, which fails if the number is taken: of two writers that start from
one version the second gets ``Conflict``, and a reader sees one version or the next, never a mixture.
"""

from __future__ import annotations

import atexit
import json
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUNS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder of this application's intermediate tables, below ``spark.checkpoint.dir``; removed at exit.

    Where the setting is absent (tests, notebooks on one machine) a local folder is
    chosen; on a cluster its absence is an error, as local disks are not shared.
    """
    context = spark.sparkContext
    app = context.applicationId
    if app not in _RUNS:
        base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not base:
            if context.master.split("[")[0] != "local":
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


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    target = _path(spark, path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def delete(spark: SparkSession, path: str) -> None:
    files, target = _files(spark, path)
    files.delete(target, True)


def kept(df: DataFrame) -> DataFrame:
    """The rows written below the shared folder and read again: a lost executor costs a re-read, no more."""
    spark = df.sparkSession
    path, schema = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex[:12]}", df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def fingerprint(df: DataFrame) -> str:
    """Names, lengths and times of the files a table consists of: equal as long as the table is the same."""
    spark, told = df.sparkSession, []
    for name in sorted(df.inputFiles()):
        files, target = _files(spark, name)
        status = files.getFileStatus(target)
        told.append((name, status.getLen(), status.getModificationTime()))
    return uuid.uuid5(uuid.NAMESPACE_URL, json.dumps(told)).hex


class Conflict(RuntimeError):
    """Another writer has made the version that was to be made."""


class Log:
    """Numbered versions of a small state (what JSON can hold) below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, f"{path.rstrip('/')}/versions"

    def current(self) -> tuple[int, dict | None]:
        files, target = _files(self.spark, self.path)
        if not files.exists(target):
            return 0, None
        numbers = [int(n[:-5]) for n in (s.getPath().getName() for s in files.listStatus(target)) if n.endswith(".json") and n[0] != "."]
        return (max(numbers), self.at(max(numbers))) if numbers else (0, None)

    def at(self, version: int) -> dict:
        """The state of a version."""
        files, target = _files(self.spark, f"{self.path}/{version}.json")
        stream = files.open(target)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, before: int, state: dict) -> int:
        """Makes version ``before + 1``; raises ``Conflict`` if there is one."""
        files, _ = _files(self.spark, self.path)
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        draft, final = _path(self.spark, f"{self.path}/.{uuid.uuid4().hex}"), _path(self.spark, f"{self.path}/{before + 1}.json")
        stream = files.create(draft, False)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        how = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
        try:
            hadoop.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, final, how)
        except Exception as error:
            files.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"version {before + 1} of {self.path} is there already") from None
            raise
        return before + 1
