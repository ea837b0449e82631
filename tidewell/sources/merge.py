"""Writes as merges of DataFrames: upserts, reconciliation, diffs.

Plain Parquet has no MERGE, so a merge computes the new state of a table; ``swap`` writes it as
a new version beside the old one. On a table format with MERGE the same conditions apply.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], guard: Column | None = None, keep_old: bool = False) -> DataFrame:
    """Source rows replace target rows of equal keys (null-safe), others are added or kept.

    ``guard`` (over target columns) protects rows from being replaced. With ``keep_old`` a null
    of the source keeps the target's value. Equal keys in the source: the last by all columns.
    """
    columns = [c for c in target.columns if c not in keys]
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in columns])
    s = source.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n").withColumn("__new", F.lit(True))
    t = target.withColumn("__old", F.lit(True)).withColumn("__guard", guard if guard is not None else F.lit(False))
    both = t.alias("t").join(s.alias("s"), [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys], "full_outer")
    use_old = F.col("__new").isNull() | F.coalesce(F.col("__guard"), F.lit(False))
    out = [F.when(F.col("__old").isNull(), F.col(f"s.{k}")).otherwise(F.col(f"t.{k}")).alias(k) for k in keys]
    for c in columns:
        fresh = F.coalesce(f"s.{c}", f"t.{c}") if keep_old else F.col(f"s.{c}")
        out.append(F.when(use_old, F.col(f"t.{c}")).otherwise(fresh).alias(c))
    return both.select(*out).select(*target.columns)


def insert_missing(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of new keys are added, one a key."""
    return target.unionByName(source.dropDuplicates(list(keys)).join(target, list(keys), "left_anti").select(*target.columns))


def count_up(target: DataFrame, seen: DataFrame, keys: Sequence[str], counter: str = "occurrences") -> DataFrame:
    """Occurrences of keys added to a counter table."""
    fresh = seen.groupBy(*keys).agg(F.count("*").alias(counter))
    return target.select(*keys, counter).unionByName(fresh).groupBy(*keys).agg(F.sum(counter).alias(counter))


def reconcile(target: DataFrame, seen: DataFrame, key: str, protected: Sequence[str] = (), referenced: Sequence[DataFrame] = ()) -> DataFrame:
    """Rows to delete: not seen, in no protected prefix, referenced by no other table."""
    gone = target.join(seen, key, "left_anti")
    for prefix in protected:
        gone = gone.where(~F.col(key).startswith(prefix))
    for table in referenced:
        gone = gone.join(table, key, "left_anti")
    return gone


def snapshot_diff(live: DataFrame, backup: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with state lost, added or altered; equal rows are left out. Compares whole rows null-safely."""
    rest = [c for c in live.columns if c not in keys]
    a = live.select(*keys, F.struct(*rest).alias("a"))
    b = backup.select(*keys, F.struct(*rest).alias("b"))
    state = F.when(F.col("a").isNull(), "lost").when(F.col("b").isNull(), "added").when(~F.col("a").eqNullSafe(F.col("b")), "altered")
    return a.join(b, list(keys), "full_outer").select(*keys, state.alias("state")).where("state IS NOT NULL")


def idempotence_key(document: Column, record: Column, digest: Column, code: Column, content: Column) -> Column:
    """The first identity known, tagged with its kind."""
    tag = lambda name, c: F.when(c.isNotNull(), F.concat_ws(":", F.lit(name), c.cast("string")))
    return F.coalesce(tag("document", document), tag("record", record), tag("sha256", digest), tag("code", code), F.concat(F.lit("content:"), F.sha2(F.coalesce(content, F.lit("")), 256)))


def resolve_or_create(names: DataFrame, name: str, dimension: DataFrame, dim_name: str, dim_id: str) -> DataFrame:
    """The dimension with the missing names added; new ids come from the name's hash, so reruns agree."""
    fresh = names.select(F.col(name).alias(dim_name)).where(f"{dim_name} IS NOT NULL").distinct().join(dimension, dim_name, "left_anti")
    return dimension.select(dim_id, dim_name).unionByName(fresh.select(F.xxhash64(dim_name).cast(dimension.schema[dim_id].dataType).alias(dim_id), dim_name))


def explode_record(records: DataFrame, key: str, children: Sequence[str]) -> dict[str, DataFrame]:
    """A nested record as one DataFrame for each child array, with the parent's key and the rank."""
    return {c: records.select(key, F.posexplode(c).alias("rank", "item")).select(key, "rank", "item.*") for c in children}


def free_names(wanted: DataFrame, name: str, taken: DataFrame) -> DataFrame:
    """Names with -2, -3, ... where an earlier row or an existing name has them; stem and extension kept.

    The n-th row (by ``id``) that wants a name gets the n-th of name, name-2, name-3, ... that is
    neither taken nor itself wanted by other rows, so no given name meets another. Free numbers
    are counted, not tried: of the sorted taken numbers t1 < t2 < ..., those with ti - i < n lie
    before the n-th free one, which one running count over both tells.
    """
    stem, extension = F.regexp_replace(name, "(\\.[^./]+)$", ""), F.regexp_extract(name, "(\\.[^./]+)$", 1)
    told = F.regexp_extract(stem, "^(.+)-([1-9][0-9]*)$", 2)
    numbered = F.when((told != "") & (told != "1"), F.struct(F.concat(F.regexp_extract(stem, "^(.+)-([1-9][0-9]*)$", 1), extension).alias("of"), told.try_cast("long").alias("n")))
    there = taken.select(name).unionByName(wanted.select(name)).distinct()
    whole = taken.select(F.col(name).alias("of"), F.lit(1).cast("long").alias("n"))
    held = whole.unionByName(there.select(F.inline(F.array(numbered)))).where("of IS NOT NULL AND n IS NOT NULL").distinct()
    # free numbers below the i-th taken one: its number less i; rows and taken numbers of a name in one order by that
    nth = F.row_number().over(Window.partitionBy("of").orderBy("n"))
    known = held.join(wanted.select(F.col(name).alias("of")).distinct(), "of", "left_semi")  # of names that are wanted
    free = known.select(F.col("of").alias(name), (F.col("n") - nth).alias("__n"), F.lit(1).alias("__held"), F.lit(None).cast(wanted.schema["id"].dataType).alias("id"))
    rows = wanted.select(name, F.row_number().over(Window.partitionBy(name).orderBy("id")).cast("long").alias("__n"), F.lit(0).alias("__held"), "id")
    up_to = Window.partitionBy(name).orderBy("__n", "__held").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.unionByName(free).withColumn("__place", F.col("__n") + F.sum("__held").over(up_to)).where("__held = 0")
    place = F.col("__place")
    return placed.select("id", F.when(place == 1, F.col(name)).otherwise(F.concat(stem, F.lit("-"), place.cast("string"), extension)).alias(name))


def text_checksum(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows and a sum, whatever their order, of eight hex digits of each row's MD5: the same in any engine."""
    told = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    return df.agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(F.md5(told), 1, 8), 16, 10).cast("decimal(38,0)")).cast("long").alias("checksum"))


def checksum(df: DataFrame) -> DataFrame:
    """Rows and an order-free sum of row hashes, as a decimal so that it cannot overflow."""
    return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("checksum"))


def swap(df: DataFrame, path: str, version: int) -> str:
    """The new state as a version of its own; readers move when the pointer is written, after the data."""
    target = f"{path}/v{version}"
    df.write.parquet(target)
    df.sparkSession.createDataFrame([(version,)], "version int").coalesce(1).write.mode("append").parquet(f"{path}/_versions")
    return target


def current(spark, path: str) -> DataFrame:
    newest = spark.read.parquet(f"{path}/_versions").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{path}/v{newest}")
