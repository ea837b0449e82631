"""Decisions over small sets of candidates and proofs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def divergence(corrections: DataFrame, canonical: DataFrame, keys: Sequence[str], value: str, own: str) -> DataFrame:
    """Each correction against the canonical value of its field: coherent, divergent, or not propagable (no such field)."""
    joined = corrections.join(canonical, list(keys), "left")
    state = F.when(F.col(own).isNull(), "not_propagable").when(F.col(own) == F.col(value), "coherent").otherwise("divergent")
    return joined.select(*keys, state.alias("state"))


def unpivot_text(df: DataFrame, key: str, columns: dict[str, Column], value: str) -> DataFrame:
    """Key, field, value of several columns, as text."""
    return df.select(key, F.inline(F.array(*[F.struct(F.lit(name).alias("field"), c.cast("string").alias(value)) for name, c in columns.items()])))


def agreement(rows: DataFrame, population: str, key: str, role: str, value: str) -> DataFrame:
    """Per record the mean, over its roles, of the share of its population that has the same value in that role."""
    total = rows.groupBy(population, role).agg(F.count("*").alias("__total"))
    same = rows.groupBy(population, role, value).agg(F.count("*").alias("__same"))
    shares = rows.join(same, [population, role, value]).join(total, [population, role])
    return shares.groupBy(key).agg(F.round(F.avg(F.round(F.col("__same") / F.col("__total"), 3)), 5).alias("share"))


def canonical_choice(df: DataFrame, key: str, name: str, *preferred: Column) -> DataFrame:
    """Per key the name that comes first by what is preferred, then the shortest, then in order; and how many there are."""
    return df.groupBy(key).agg(F.min_by(name, F.struct(*preferred, F.length(name), name)).alias("canonical"), F.count("*").alias("n"))


def folder_plan(files: DataFrame, folder: str, file: str, *merits: Column) -> DataFrame:
    """Per folder how many files it has and the one to read as the sheet: the largest by its merits, then by name."""
    return files.groupBy(folder).agg(F.count("*").alias("files"), F.max_by(file, F.struct(*merits, file)).alias("chosen"))


def correspondence(df: DataFrame, key: str, form: str, rejected: DataFrame | None = None) -> DataFrame:
    """Kept, replaced, n: each spelling to replace by its key's majority (then the shortest, then the first).

    ``rejected``: kept, replaced, of pairs that somebody decided against.
    """
    forms = df.groupBy(key, form).agg(F.count("*").alias("n"))
    kept = forms.groupBy(key).agg(F.min_by(form, F.struct(-F.col("n"), F.length(form), form)).alias("kept"))
    out = forms.join(kept, key).where(F.col(form) != F.col("kept")).select("kept", F.col(form).alias("replaced"), "n")
    return out if rejected is None else out.join(rejected, ["kept", "replaced"], "left_anti")


def record_score(records: DataFrame, fields: DataFrame, on: str, key: str, confidence: str) -> DataFrame:
    """Mean confidence of a key's fields and how many are known; null where none is."""
    return records.join(fields, on, "left").groupBy(key).agg(F.round(F.avg(confidence), 6).alias("score"), F.count(confidence).alias("n"))


def usable_evidence(records: DataFrame, evidence: DataFrame, on: str, key: str) -> DataFrame:
    """Distinct records of each key for which there is evidence."""
    return records.join(evidence.select(on).distinct(), on, "left_semi").groupBy(key).agg(F.countDistinct(on).alias("usable"))


def batch_outcome(asked: DataFrame, state: DataFrame, key: str, checks: Sequence[tuple[str, Column]]) -> DataFrame:
    """Each asked key with the first reason against it, in order, unknown keys first; ``ok`` if there is none."""
    known = state.withColumn("__known", F.lit(True))
    outcome = F.when(F.col("__known").isNull(), "unknown")
    for reason, against in checks:
        outcome = outcome.when(F.coalesce(against, F.lit(False)), reason)
    return asked.join(known, key, "left").select(key, outcome.otherwise("ok").alias("outcome"))


def referential_listing(heads: DataFrame, members: DataFrame, on: Column, name: str, member: str) -> DataFrame:
    """Each head with its members' names in order, and how many rows stand for it (one if it has none)."""
    names = F.array_join(F.sort_array(F.collect_list(member)), ",")  # the aliases of one model
    return heads.join(members, on, "left").groupBy(name).agg(names.alias("names"), F.count("*").alias("n"))


def erased_axes(rows: DataFrame, key: str, axis: str, text: Column, labels: Sequence[str]) -> DataFrame:
    """Rows without the axis whose text names one of its labels (three letters or more), with the first label found."""
    label = F.lit(None).cast("string")
    for name in reversed([x for x in labels if len(x) >= 3]):
        label = F.when(F.contains(F.lower(text), F.lit(name)), name).otherwise(label)
    return rows.where(F.col(axis).isNull()).select(key, label.alias("label")).where("label IS NOT NULL")


def unproven(inventory: DataFrame, proofs: DataFrame, key: str) -> DataFrame:
    """Files for which there is no proof; a local copy may be purged only where this is empty."""
    return inventory.join(proofs.select(key), key, "left_anti").select(key)


def resume(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is left to do, by the keys of what was done."""
    return work.join(done.select(key), key, "left_anti")
