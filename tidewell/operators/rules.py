"""Coherence rules, routing and decisions as columns (X01-X14 but X12, X33)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def anomalies(df: DataFrame, key: str, rules: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """Key, code, severity of every rule a row breaks; rules are (code, severity, broken)."""
    found = F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, broken in rules])
    return df.select(key, F.inline(F.filter(found, lambda a: a.isNotNull())))


def out_of_range(value: str, low: float, high: float) -> Column:
    return (F.col(value) < low) | (F.col(value) > high)


def replace_own(stored: DataFrame, fresh: DataFrame, key: str, own: Sequence[str]) -> DataFrame:
    """Codes of other authors stay, own ones are those just found."""
    return stored.where(~F.col("code").isin(list(own))).unionByName(fresh).select(key, "code", "severity").distinct()


def disagreement(*references: Column) -> Column:
    """More than one distinct value among the known ones."""
    return F.size(F.array_distinct(F.filter(F.array(*references), lambda x: x.isNotNull()))) > 1


def routing(template: Column, blocking: Column, n_anomalies: Column, missing: Column, below: Column) -> Column:
    """Whole revision, targeted review or straight through; the first reason that holds decides."""
    return (
        F.when(template.isNull() | blocking, "full_revision")
        .when(n_anomalies > 0, "targeted_review")
        .when(missing >= 3, "full_revision")
        .when(below > 0, "targeted_review")
        .otherwise("straight_through")
    )


def auto_validation(score: Column, blocking: Column, least: float = 0.90) -> Column:
    """X11: strictly above the threshold and nothing that blocks."""
    return F.coalesce((score > least) & ~blocking, F.lit(False))


def detect_template(docs: DataFrame, key: str, text: Column, templates: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """The template of most anchors in the text; none found gives null. Templates are a constant, so columns."""
    counts = [F.struct((-sum((F.when(F.contains(text, F.lit(a)), 1).otherwise(0) for a in anchors), F.lit(0))).alias("worse"), F.lit(n).alias("place"), F.lit(name).alias("name")) for n, (name, anchors) in enumerate(templates)]
    best = F.array_min(F.array(*counts))
    return docs.select(key, F.when(best["worse"] < 0, best["name"]).alias("template"), (-best["worse"]).alias("anchors"))


def words_to_lines(words: DataFrame, page: str, tolerance: float = 2.5) -> DataFrame:
    """Words whose tops follow within the tolerance form a line; lines read from left to right.

    Unknown tops and places come last, as in SQL; a line of unknown texts only has none.
    """
    down = Window.partitionBy(page).orderBy(F.col("top").asc_nulls_last(), F.col("x0").asc_nulls_last())
    gap = F.coalesce(F.col("top") - F.lag("top").over(down), F.lit(0.0)) > tolerance
    lines = words.withColumn("line", F.sum(gap.cast("int")).over(down))
    read = F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct(F.col("x0").isNull().alias("unknown"), "x0", "text"))))
    joined = F.when(F.count("text") > 0, F.array_join(F.transform(read, lambda w: w["text"]), " "))
    return lines.groupBy(page, "line").agg(joined.alias("text"), F.min("top").alias("top"))


def labelled_values(lines: DataFrame, key: str, text: str, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """First value after each label (label, value pattern) with a confidence.

    1.0 where nothing else follows the value, 0.9 otherwise; labels not found give no row.
    """
    entries = []
    for name, value in rules:
        pattern = f"(?i)\\b{name}\\s*[:=]?\\s*({value})"
        found = F.nullif(F.regexp_extract(F.col(text), pattern, 1), F.lit(""))
        alone = F.col(text).rlike(f"(?im)\\b{name}\\s*[:=]?\\s*{value}\\s*$")
        entries.append(F.when(found.isNotNull(), F.struct(F.lit(name).alias("label"), found.alias("value"), F.when(alone, 1.0).otherwise(0.9).alias("confidence"))))
    return lines.select(key, F.inline(F.filter(F.array(*entries), lambda e: e.isNotNull())))


def unknown_labels(values: DataFrame, known: DataFrame) -> DataFrame:
    """What no rule knows is kept as it is."""
    return values.join(known.select("label"), "label", "left_anti")


def readings_agree(a: DataFrame, b: DataFrame, key: str, tolerance: float) -> DataFrame:
    """Two readings of labels: agree, differ, or only one of them has it."""
    both = a.select(key, "label", F.col("value").alias("value_a")).join(b.select(key, "label", F.col("value").alias("value_b")), [key, "label"], "full_outer")
    limit = F.greatest(F.lit(0.005), tolerance * F.abs("value_a"))
    state = F.when(F.col("value_a").isNull(), "only_b").when(F.col("value_b").isNull(), "only_a").when(F.abs(F.col("value_a") - F.col("value_b")) <= limit, "agree").otherwise("differ")
    return both.withColumn("state", state)


def linkage(exact: Column, alias: Column, sheet: Column, candidates: Column) -> Column:
    """An exact key or alias decides unless the sheet says otherwise; several candidates are ambiguous."""
    named = F.coalesce(exact, alias)
    return (
        F.when(named.isNotNull() & sheet.isNotNull() & (named != sheet), "ambiguous")
        .when(exact.isNotNull(), "exact").when(alias.isNotNull(), "alias").when(sheet.isNotNull(), "sheet")
        .when(candidates > 0, "ambiguous").otherwise("none")
    )


def learned_corrections(corrections: DataFrame, keys: Sequence[str], raw: str, corrected: str, n: int = 3) -> DataFrame:
    """The ``n`` most frequent corrections of each raw value."""
    counts = corrections.groupBy(*keys, raw, corrected).agg(F.count("*").alias("occurrences"))
    best = Window.partitionBy(*keys, raw).orderBy(F.desc("occurrences"), corrected)
    return counts.withColumn("place", F.row_number().over(best)).where(F.col("place") <= n)


def within_tolerance(expected: Column, got: Column, share: float) -> Column:
    """As near to the expected value as the larger of 0.005 and its share."""
    return F.abs(expected - got) <= F.greatest(F.lit(0.005), share * F.abs(expected))


def projection(traces: DataFrame, key: str, confidence: str, method: str, field: Column, odd: Column) -> DataFrame:
    """One record from its field traces: mean confidence, main method (most frequent, then first), completeness, plausibility."""
    stats = traces.groupBy(key).agg(F.round(F.avg(confidence), 6).alias("confidence"), F.count_if(odd).alias("odd"), F.countDistinct(field).alias("filled"))
    methods = traces.groupBy(key, method).agg(F.count("*").alias("n")).groupBy(key).agg(F.min_by(method, F.struct(-F.col("n"), method)).alias("main"))
    complete = F.when(F.col("filled") >= 4, "complete").when(F.col("filled") >= 2, "partial").otherwise("poor")
    plausible = F.when(F.col("odd") == 0, "plausible").otherwise("to_check")
    return stats.join(methods, key).select(key, "confidence", "main", complete.alias("completeness"), plausible.alias("plausibility"))
