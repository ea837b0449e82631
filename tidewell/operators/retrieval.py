"""Hybrid retrieval: sources of (source, id, score), fused by reciprocal rank.

Sources, in the order in which equal votes are listed: model, lexical, trigram, text, vector,
reference. Every source is an independent DataFrame; a search is one plan with small top-k
ends, and only the page reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.query import QuerySpec

RRF_K, DEPTH, TRIGRAM_LEAST = 60, 100, 0.30
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2}
SOURCES = ("model", "lexical", "trigram", "text", "vector", "reference")


def depth(offset: int, limit: int) -> int:
    """How many rows of each source are drawn."""
    return min(max(DEPTH, offset + limit), 5000)


def matches(tokens: Column, spec: QuerySpec) -> Column:
    """In one of the query's groups all words and phrases stand in the token array, and nothing excluded does."""
    line = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))

    def holds(term) -> Column:
        found = F.array_contains(tokens, term.words[0]) if len(term.words) == 1 else F.contains(line, F.lit(f" {' '.join(term.words)} "))
        return ~found if term.negated else found

    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, map(holds, g)) for g in spec.groups], F.lit(False))


def lexical(docs: DataFrame, key: str, weighted: dict[str, Column], spec: QuerySpec) -> DataFrame:
    """Documents that match, scored by weighted occurrences over 1 + log(distinct words).

    ``weighted``: token array by weight class. Every word must stand somewhere in any class.
    """
    terms = F.array(*[F.lit(w) for w in [*spec.required, *(w for p in spec.phrases for w in p)]]).cast("array<string>")
    every = F.concat(*weighted.values())
    hits = sum((F.lit(WEIGHTS[c]) * F.size(F.filter(t, lambda w: F.array_contains(terms, w))) for c, t in weighted.items()), F.lit(0.0))
    score = hits / (1 + F.log(F.greatest(F.size(F.array_distinct(every)), F.lit(1))))
    return docs.where(matches(every, spec)).select(F.lit("lexical").alias("source"), F.col(key).alias("id"), F.round(score, 6).alias("score"))


def prefix_search(docs: DataFrame, key: str, name: Column, tokens: Column, prefixes: Sequence[str]) -> DataFrame:
    """Any prefix matches; a bonus of 0.5 if all do; classes exact name, name, content come first."""
    found = [F.size(F.filter(tokens, _starts(p))) for p in prefixes]
    n = sum((F.when(f > 0, 1).otherwise(0) for f in found), F.lit(0))
    key_name = T.search_key(name)
    asked = " ".join(prefixes)
    kind = F.when(key_name == asked, 0).when(F.contains(key_name, F.lit(asked)), 1).otherwise(2)
    score = sum(found, F.lit(0)) / F.greatest(F.size(tokens), F.lit(1)) + F.when(n == len(prefixes), 0.5).otherwise(0.0)
    return docs.where(n > 0).select(F.col(key).alias("id"), kind.alias("match_class"), F.round(score, 6).alias("score"))


def _starts(prefix: str):
    return lambda w: w.startswith(prefix)


def trigram(docs: DataFrame, key: str, text: Column, query: str, least: float = TRIGRAM_LEAST) -> DataFrame:
    """One-word queries only; word similarity strictly above ``least``."""
    scored = docs.select(F.col(key).alias("id"), F.explode(F.array(T.word_similarity(F.lit(query), text, least))).alias("score"))  # once a row
    rows = scored.select(F.lit("trigram").alias("source"), "id", F.round("score", 6).alias("score"))
    return rows.where(F.col("score") > least) if len(query.split()) == 1 else rows.limit(0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays as doubles; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: i.cast("double") * j.cast("double")), F.lit(0.0), lambda s, i: s + i)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector(docs: DataFrame, key: str, embedding: str, query: Column, n: int = DEPTH) -> DataFrame:
    """Exact cosine, best per id, top ``n``."""
    scored = docs.select(F.col(key).alias("id"), F.round(cosine(F.col(embedding), query), 6).alias("score")).where("score IS NOT NULL")
    best = scored.groupBy("id").agg(F.max("score").alias("score"))
    return best.orderBy(F.desc("score"), "id").limit(n).select(F.lit("vector").alias("source"), "id", "score")


def reference(docs: DataFrame, key: str, fields: Sequence[Column], asked: str | None) -> DataFrame:
    """Rows of which one field has the asked key."""
    hit = reduce(lambda a, b: a | b, [T.reference_key(f) == (asked or "") for f in fields]) & F.lit(asked is not None)
    return docs.where(hit).select(F.lit("reference").alias("source"), F.col(key).alias("id"), F.lit(1.0).alias("score"))


def ranked(source: DataFrame, n: int = DEPTH) -> DataFrame:
    """The ``n`` best of one source with their rank; cut before the window, so it sees ``n`` rows."""
    top = source.orderBy(F.desc("score"), "id").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "id")))


def fuse(sources: Sequence[DataFrame], k: int = RRF_K) -> DataFrame:
    """Id, score = sum of 1 / (k + rank), sources in their fixed order. Ties by id belong to the reader's order."""
    every = reduce(DataFrame.unionByName, [s.select("source", "id", "rank") for s in sources])
    order = F.array(*[F.lit(s) for s in SOURCES])
    votes = F.sort_array(F.collect_list(F.struct(F.array_position(order, F.col("source")).alias("place"), "source")))  # as many as there are sources
    fused = every.groupBy("id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 8).alias("score"), votes.alias("votes"))
    return fused.select("id", "score", F.array_join(F.transform("votes", lambda v: v["source"]), ",").alias("sources"))


def promote(fused: DataFrame, exact: DataFrame) -> DataFrame:
    """Exact reference hits go ahead, the order is otherwise kept."""
    hits = exact.select("id").distinct().withColumn("exact", F.lit(True))  # of any number: how they are joined is left to their measured size
    return fused.join(hits, "id", "left").withColumn("exact", F.coalesce("exact", F.lit(False)))


def facets(docs: DataFrame, axes: Sequence[str], filters: dict[str, str], top: int = 20) -> DataFrame:
    """Per axis its values' counts under all filters but its own; the ``top`` by count, then value.

    One scan: each row is spread over the axes it counts for (all, or the one filter it fails).
    """
    passes = {a: F.coalesce(F.col(a).cast("string") == v, F.lit(False)) for a, v in filters.items()}

    def others(axis: str) -> Column:
        return reduce(lambda x, y: x & y, [p for a, p in passes.items() if a != axis], F.lit(True))

    entries = F.array(*[F.when(others(a) & F.col(a).isNotNull(), F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("value"))) for a in axes])
    counts = docs.select(F.inline(F.filter(entries, lambda e: e.isNotNull()))).groupBy("axis", "value").agg(F.count("*").alias("n"))
    best = Window.partitionBy("axis").orderBy(F.desc("n"), "value")
    return counts.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top).select("axis", "value", "n")


def numeric_facet(df: DataFrame, value: str, buckets: int = 5, most: int = 10) -> DataFrame:
    """One bucket a distinct value if there are ``most`` at most, else equal widths, the last closed; empty ones are left out."""
    known = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    span = F.broadcast(known.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("distinct")))
    width = (F.col("high") - F.col("low")) / buckets
    place = F.least(F.floor(F.try_divide(F.col("v") - F.col("low"), width)), F.lit(buckets - 1))
    each = F.col("distinct") <= most
    start = F.when(each, F.col("v")).otherwise(F.col("low") + place * width)
    end = F.when(each, F.col("v")).when(place == buckets - 1, F.col("high")).otherwise(F.col("low") + (place + 1) * width)
    placed = known.crossJoin(span).select(F.round(start, 6).alias("low"), F.round(end, 6).alias("high"), "n")
    return placed.groupBy("low", "high").agg(F.sum("n").alias("n"))


def suggestions(values: Sequence[tuple[str, DataFrame, str]], typed: str, least: float = TRIGRAM_LEAST) -> DataFrame:
    """Exact, then prefix, then fuzzy values of several natures; per folded value the best is kept.

    A prefix scores 0.70 + 0.25 * its share of the value's length.
    """
    own = typed.strip().lower()
    every = reduce(DataFrame.unionByName, [df.select(F.lit(nature).alias("nature"), F.col(c).alias("value")).distinct() for nature, df, c in values])
    keyed = every.where("value IS NOT NULL").withColumn("key", T.search_key(F.col("value")))
    equal, prefix = F.col("key") == own, F.col("key").startswith(own)
    # trigrams only of what is neither equal nor a continuation
    fuzzy = F.when(~(equal | prefix), T.trigram_similarity(T.trigrams(F.col("key")), T.trigrams(F.lit(own))))
    scored = keyed.select("nature", "value", "key", F.explode(F.array(F.coalesce(fuzzy, F.lit(0.0)))).alias("fuzzy"))  # once, not for each test
    rank = F.when(equal, 0).when(prefix, 2).when(F.col("fuzzy") > least, 3)
    score = F.when(equal, 1.0).when(prefix, 0.70 + 0.25 * len(own) / F.length("key")).otherwise(F.col("fuzzy"))
    found = scored.withColumn("rank", rank).withColumn("score", F.round(score, 6)).where("rank IS NOT NULL")
    best = Window.partitionBy("key").orderBy("rank", F.desc("score"), "value", "nature")
    return found.withColumn("place", F.row_number().over(best)).where("place = 1").select("nature", "value", "rank", "score")


def snippet(text: Column, term: str, width: int = 360) -> Column:
    """A window of ``width`` characters around the first hit, from the start without one."""
    at = F.locate(term, F.lower(text))
    start = F.greatest(F.lit(1), at - width // 2)
    return F.substr(text, F.when(at > 0, start).otherwise(F.lit(1)), F.lit(width))


def best_evidence(evidence: DataFrame) -> DataFrame:
    """Q02: per id the best of (matched, score, priority, piece)."""
    order = Window.partitionBy("id").orderBy(F.desc("matched"), F.desc("score"), "priority", "piece")
    return evidence.withColumn("__place", F.row_number().over(order)).where("__place = 1").drop("__place")


def synonyms(tokens: DataFrame, key: str, words: Column, phrases: DataFrame, longest: int = 8) -> DataFrame:
    """R16 / J16 in bulk: spans of up to ``longest`` words looked up by equality; the longest at each start is kept.

    ``phrases``: phrase, target.
    """
    n = F.size(words)
    spans = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), n - i + 1)), lambda m: F.struct(i.alias("at"), m.alias("length"), F.array_join(F.slice(words, i, m), " ").alias("phrase")))))
    spread = tokens.where(n > 0).select(key, F.inline(spans))
    hits = spread.join(phrases, "phrase")
    return hits.groupBy(key, "at").agg(F.max("length").alias("length"), F.max_by("target", F.struct("length", "target")).alias("target"))


def model_match(values: DataFrame, key: str, models: DataFrame, least: float = TRIGRAM_LEAST) -> DataFrame:
    """Per value its best model: equal key, then alias, then prefix, then fuzzy.

    ``models``: model_id, model_key, alias (boolean). Fuzzy candidates share a trigram, found by
    an equality join, so values are never crossed with all models.
    """
    v = values.select(key, T.model_key(F.col(key)).alias("value_key")).distinct()
    exact = v.join(models, F.col("value_key") == F.col("model_key")).select(key, "model_id", F.when(F.col("alias"), 1).otherwise(0).alias("tier"), F.lit(1.0).alias("score"))
    grams = v.select(key, "value_key", F.explode(T.trigrams(F.col("value_key"))).alias("gram"))
    theirs = models.select("model_id", "model_key", F.explode(T.trigrams(F.col("model_key"))).alias("gram"))
    near = grams.join(theirs, "gram").groupBy(key, "value_key", "model_id", "model_key").agg(F.count("*").alias("shared"))
    sizes = F.size(T.trigrams(F.col("value_key"))) + F.size(T.trigrams(F.col("model_key"))) - F.col("shared")
    prefix = F.col("model_key").startswith(F.col("value_key"))
    fuzzy = near.select(key, "model_id", F.when(prefix, 2).otherwise(3).alias("tier"), F.round(F.col("shared") / sizes, 6).alias("score")).where((F.col("tier") == 2) | (F.col("score") >= least))
    best = Window.partitionBy(key).orderBy("tier", F.desc("score"), "model_id")
    return exact.unionByName(fuzzy).withColumn("__p", F.row_number().over(best)).where("__p = 1").drop("__p")


def expand(df: DataFrame, key: str, words: Column, phrases: DataFrame, longest: int = 8) -> DataFrame:
    """R16 in bulk: each row's words with the longest synonyms in their place, from left to right.

    ``phrases``: phrase, target. A phrase that begins inside one already taken is passed over.
    """
    found = synonyms(df, key, words, phrases, longest)
    entry = F.sort_array(F.collect_list(F.struct("at", "length", "target")))  # spans of one row, one a word at most
    taken = found.groupBy(key).agg(entry.alias("found"))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("out"))

    def step(done: Column, x: Column) -> Column:
        free = x["at"] > done["end"]
        return F.struct(F.when(free, x["at"] + x["length"] - 1).otherwise(done["end"]).alias("end"), F.when(free, F.concat(done["out"], F.slice(words, done["end"] + 1, x["at"] - done["end"] - 1), F.array(x["target"]))).otherwise(done["out"]).alias("out"))

    whole = F.aggregate(F.coalesce("found", F.array().cast("array<struct<at:int,length:int,target:string>>")), start, step, lambda done: F.concat(done["out"], F.slice(words, done["end"] + 1, F.greatest(F.size(words) - done["end"], F.lit(0)))))
    return df.join(taken, key, "left").select(key, F.array_join(whole, " ").alias("expanded"))
