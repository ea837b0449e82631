"""Hashing encoder, centroid classifier and keyword rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hashed_terms(df: DataFrame, key: str, text: Column, dimension: int = 384) -> DataFrame:
    """X27, sparse: key, place, weight. A token's place and sign come from its MD5, its weight from its length.

    Place: the first four bytes, little-endian, modulo the dimension; sign: whether the fifth is
    even. Rows are of unit length.
    """
    word = F.regexp_replace(F.col("w"), "^[.,;:!?()\\[\\]«»\"']+|[.,;:!?()\\[\\]«»\"']+$", "")
    words = df.select(key, F.explode(F.split(F.lower(text), "\\s+")).alias("w")).select(key, word.alias("w")).where("w <> ''")
    h = F.md5("w")
    byte = lambda k: F.conv(F.substring(h, 2 * k + 1, 2), 16, 10).cast("long")
    place = (byte(0) + byte(1) * 256 + byte(2) * 65536 + byte(3) * 16777216) % dimension
    sign = F.when(byte(4) % 2 == 0, 1.0).otherwise(-1.0)
    sums = words.groupBy(key, place.alias("place")).agg(F.sum(sign * (1.0 + F.log1p(F.length("w")) * 0.1)).alias("weight"))
    norms = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return sums.join(norms, key).select(key, "place", F.try_divide("weight", "norm").alias("weight"))


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Unit mean vector of each label, as an array; partial sums run before the shuffle."""
    means = df.select(label, F.posexplode(vector).alias("place", "x")).groupBy(label, "place").agg(F.avg(F.col("x").cast("double")).alias("m"))
    whole = means.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("place", "m"))).alias("v"))  # as many as dimensions
    v = F.transform("v", lambda e: e["m"])
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return whole.select(F.col(label).alias("centroid"), F.transform(v, lambda x: F.try_divide(x, norm)).alias("c"))


LABELS = 1_000  # labels that a row meets at once
MOST_SENT = 32_000_000  # bytes of a model that every executor gets; a larger one is joined by its blocks


def classify(df: DataFrame, key: str, vector: str, model: DataFrame) -> DataFrame:
    """Nearest centroid by cosine, with the margin over the next (0 if there is none).

    The model goes in blocks of about ``LABELS`` labels; a row is scored against a block in one expression
    that keeps the best two, so no row for each label is made, and a model of any size is whole.
    """
    labels, dims = model.agg(F.count("*"), F.max(F.size("c"))).first()
    blocks = max(1, -(-labels // LABELS))
    packed = model.groupBy(F.pmod(F.xxhash64("centroid"), F.lit(blocks)).alias("__block")).agg(F.collect_list(F.struct("centroid", "c")).alias("__labels"))
    if labels * (dims or 0) * 8 <= MOST_SENT:
        packed = F.broadcast(packed)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    v = F.col(vector)
    score = lambda label: F.round(F.try_divide(dot(v, label["c"]), F.sqrt(dot(v, v))), 6)
    best = lambda scored: F.slice(F.array_sort(scored), 1, 2)
    met = df.select(key, vector, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("__block")).join(packed, "__block")
    tops = met.select(key, best(F.transform("__labels", lambda x: F.struct((-score(x)).alias("less"), x["centroid"].alias("centroid")))).alias("two"))
    if blocks > 1:
        tops = tops.groupBy(key).agg(best(F.flatten(F.collect_list("two"))).alias("two"))  # two a block
    first, second = F.get("two", F.lit(0)), F.get("two", F.lit(1))
    return tops.select(key, first["centroid"].alias("predicted"), (-first["less"]).alias("score"), F.round(F.coalesce(second["less"], first["less"]) - first["less"], 6).alias("margin"))


def keyword_rules(text: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """The first label one of whose words stands in the text."""
    out = F.lit(default)
    for label, words in reversed(rules):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(text, F.lit(w))
        out = F.when(hit, label).otherwise(out)
    return out


def accuracy(df: DataFrame, truth: Column, *predictions: tuple[str, Column]) -> DataFrame:
    """Share of right answers of each method, side by side."""
    return df.agg(F.count("*").alias("n"), *[F.round(F.avg((p == truth).cast("double")), 6).alias(name) for name, p in predictions])


def stratified_split(key: Column, share: float) -> Column:
    """Held out or not, from the MD5 of the key: the same in every run, and in every label about the same share."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(1000)) < round(share * 1000)
