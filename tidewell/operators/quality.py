"""Quality dashboard, cartography and journal aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share(part: Column, whole: Column) -> Column:
    """Null where the whole is 0, as every ratio of the dashboard."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def correction_rate(df: DataFrame, corrected: Column, *keys: str) -> DataFrame:
    """Rows, corrected rows and the share left as extracted, in all or per key."""
    total, fixed = F.count("*"), F.count_if(corrected)
    columns = [total.alias("total"), fixed.alias("corrected"), F.round(share(total - fixed, total), 6).alias("auto_rate")]
    return df.groupBy(*keys).agg(*columns) if keys else df.agg(*columns)


def duration_percentiles(df: DataFrame, seconds: Column, *keys: str) -> DataFrame:
    """Exact median and 95th percentile, mean, least and most."""
    return df.groupBy(*keys).agg(
        F.count(seconds).alias("n"), F.round(F.percentile(seconds, 0.5), 3).alias("p50"), F.round(F.percentile(seconds, 0.95), 3).alias("p95"),
        F.round(F.avg(seconds), 3).alias("mean"), F.min(seconds).alias("least"), F.max(seconds).alias("most"),
    )


def daily_usage(events: DataFrame, at: str, is_empty: Column, days: int, *keys: Column) -> DataFrame:
    """Per day (and key) of the last ``days`` before the newest event: events and share of empty ones.

    The newest time stands in for the clock, so that reruns agree.
    """
    newest = events.agg(F.max(at).alias("newest"))
    recent = events.crossJoin(F.broadcast(newest)).where(F.col(at) > F.col("newest") - F.make_interval(days=F.lit(days)))
    return recent.groupBy(F.to_date(at).alias("day"), *keys).agg(F.count("*").alias("n"), F.round(share(F.count_if(is_empty), F.count("*")), 6).alias("empty_share"))


def attribution(actions: DataFrame, users: DataFrame, user: str) -> tuple[DataFrame, DataFrame]:
    """Actions a user with the share of all, and the users without any."""
    counts = actions.groupBy(user).agg(F.count("*").alias("actions"))
    total = F.broadcast(actions.agg(F.count("*").alias("total")))
    return counts.crossJoin(total).select(user, "actions", F.round(share(F.col("actions"), F.col("total")), 6).alias("share")), users.join(actions, user, "left_anti")


def size_histogram(sizes: DataFrame, size: str, last: int = 10) -> DataFrame:
    """How many groups have 1, 2, ... rows, ``last`` and more together; empty buckets are shown as 0."""
    label = F.when(F.col(size) >= last, F.lit(f"{last}+")).otherwise(F.col(size).cast("string"))
    found = sizes.groupBy(label.alias("bucket")).agg(F.count("*").alias("groups"), F.sum(size).alias("members"))
    spark = sizes.sparkSession
    buckets = spark.createDataFrame([(str(k) if k < last else f"{last}+",) for k in range(1, last + 1)], "bucket string")
    return buckets.join(found, "bucket", "left").select("bucket", F.coalesce("groups", F.lit(0)).alias("groups"), F.coalesce("members", F.lit(0)).alias("members"))


def certain_variants(df: DataFrame, value: str, key: Column) -> DataFrame:
    """Keys written in more than one way; forms by count, then text; the first is the majority's."""
    forms = df.where(F.trim(F.coalesce(value, F.lit(""))) != "").groupBy(key.alias("key"), F.col(value).alias("form")).agg(F.count("*").alias("n"))
    entry = F.struct((-F.col("n")).alias("rank"), F.length("form").alias("length"), "form")
    grouped = forms.groupBy("key").agg(F.count("*").alias("n_forms"), F.sum("n").alias("total"), F.sort_array(F.collect_list(entry)).alias("forms"))
    return grouped.where("n_forms > 1").select("key", "n_forms", "total", F.col("forms")[0]["form"].alias("majority"), F.array_join(F.transform("forms", lambda f: f["form"]), "|").alias("spellings"))


def contained_variants(df: DataFrame, key: str, least: int = 4) -> DataFrame:
    """Pairs of keys of which the shorter stands as whole words in the longer.

    Every run of words of a key is looked up by equality, so no two keys are compared that do
    not match: the cost is the number of runs, not of pairs.
    """
    counts = df.where(F.col(key) != "").groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
    words = F.split("key", " ")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.transform(F.sequence(F.lit(1), F.size(words) - i + 1), lambda n: F.array_join(F.slice(words, i, n), " "))))
    spread = counts.select(F.col("key").alias("long_key"), F.col("n").alias("n_long"), F.explode(F.array_distinct(runs)).alias("short_key"))
    short = counts.where(F.length("key") >= least).select(F.col("key").alias("short_key"), F.col("n").alias("n_short"))
    return spread.where("short_key <> long_key").join(short, "short_key").select("short_key", "long_key", "n_short", "n_long")


def score_ladder(df: DataFrame, score: Column, thresholds: Sequence[float]) -> DataFrame:
    """Per threshold the rows at or above it and their share of known scores; unknown ones apart.

    All thresholds are counted in one aggregate and unpivoted, not by one scan each.
    """
    counts = df.agg(F.count(score).alias("known"), F.count_if(score.isNull()).alias("unknown"), *[F.count_if(score >= t).alias(f"t{k}") for k, t in enumerate(thresholds)])
    rungs = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{k}").alias("n")) for k, t in enumerate(thresholds)])
    return counts.select("known", "unknown", F.inline(rungs)).withColumn("share", F.round(share(F.col("n"), F.col("known")), 6))


def completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Filled share of each column, from one aggregate."""
    counts = df.agg(F.count("*").alias("total"), *[F.count(c).alias(c) for c in columns])
    entries = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("filled")) for c in columns])
    return counts.select("total", F.inline(entries)).withColumn("share", F.round(share(F.col("filled"), F.col("total")), 6))


def exact_duplicate_groups(df: DataFrame, key: str, member: str) -> DataFrame:
    """Keys with more than one member: how many and the smallest; lists stay out, groups may be of any size."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(member).alias("members"), F.min(member).alias("first")).where("members > 1")


def top_queries(journal: DataFrame, query: str, results: Column, at: str) -> DataFrame:
    """Per query its count, empty answers, last time and the details of its last empty answer."""
    empty = results == 0
    return journal.groupBy(query).agg(F.count("*").alias("n"), F.count_if(empty).alias("n_empty"), F.max(at).alias("last_at"))


def tiers(score: Column, full: float = 1.0) -> list[Column]:
    """Counts of the four confidence tiers of scores up to ``full``; unknown scores are in the lowest."""
    top, high, low = (round(x * full, 6) for x in (0.99, 0.90, 0.85))
    return [
        F.count_if(score >= top).alias("tier_1"), F.count_if((score >= high) & (score < top)).alias("tier_2"),
        F.count_if((score >= low) & (score < high)).alias("tier_3"), F.count_if(score.isNull() | (score < low)).alias("tier_4"),
    ]


def redundant_bytes(files: DataFrame, digest: str, size: str) -> DataFrame:
    """Equal size and hash: files that could go and their bytes."""
    groups = files.groupBy(digest, size).agg(F.count("*").alias("n")).where("n > 1")
    return groups.agg(F.count("*").alias("groups"), F.sum(F.col("n") - 1).alias("redundant_files"), F.sum((F.col("n") - 1) * F.col(size)).alias("redundant_bytes"))


def majority(df: DataFrame, keys: Sequence[str], form: str) -> DataFrame:
    """per key its most frequent form (then the shortest, then the first) and how many rows have any."""
    forms = df.where(F.col(form).isNotNull()).groupBy(*keys, form).agg(F.count("*").alias("n"))
    return forms.groupBy(*keys).agg(F.min_by(form, F.struct(-F.col("n"), F.length(form), form)).alias("majority"), F.sum("n").alias("n"))


def structure_score(pages: DataFrame, places: DataFrame, key: str, vocabulary: Sequence[str], width: float = 10.0, least: int = 3) -> DataFrame:
    """0.6 of the share of the vocabulary on a page (``words``) and 0.4 of its places (``x``) that line up.

    Places line up if ``least`` or more of a page fall into one bucket of ``width``.
    """
    from ..functions.fields import vocabulary_share

    buckets = places.groupBy(key, F.floor(F.col("x") / width).alias("bucket")).agg(F.count("*").alias("n"))
    aligned = buckets.groupBy(key).agg((F.sum(F.when(F.col("n") >= least, F.col("n")).otherwise(0)) / F.sum("n")).alias("aligned"))
    score = 0.6 * vocabulary_share(F.col("words"), vocabulary) + 0.4 * F.coalesce("aligned", F.lit(0.0))
    return pages.join(aligned, key, "left").select(key, F.round(score, 6).alias("score"))


def dashboard(parts: dict[str, DataFrame]) -> DataFrame:
    """Several indicators (label, value) as one table of metric, label, value."""
    rows = [df.select(F.lit(name).alias("metric"), F.col("label").cast("string").alias("label"), F.col("value").cast("double").alias("value")) for name, df in parts.items()]
    out = rows[0]
    for part in rows[1:]:
        out = out.unionByName(part)
    return out


def journal_report(journal: DataFrame, query: str, empty: Column, n: int) -> DataFrame:
    """Part, query, n: the most frequent queries, the most frequent ones without results, and the total."""
    counted = journal.groupBy(F.col(query).alias("query")).agg(F.count("*").alias("n"), F.count_if(empty).alias("e"))
    frequent = counted.orderBy(F.desc("n"), "query").limit(n).select(F.lit("frequent").alias("part"), "query", "n")
    none = counted.where("e > 0").orderBy(F.desc("e"), "query").limit(n).select(F.lit("empty").alias("part"), "query", F.col("e").alias("n"))
    return frequent.unionByName(none).unionByName(journal.agg(F.lit("total").alias("part"), F.lit("all").alias("query"), F.count("*").alias("n")))


def reindex_measures(name: str, before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows before and after a rebuild, and how many of the former are not among the latter."""
    lost = before.select(key).join(after.select(key), key, "left_anti").agg(F.count("*").alias("lost"))
    one = lambda df, c: df.agg(F.count("*").alias(c))
    return one(before, "before").crossJoin(one(after, "after")).crossJoin(lost).select(F.lit(name).alias("name"), "before", "after", "lost")  # one row each
