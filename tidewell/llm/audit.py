"""Operator 11: what each of five filters removes, in every order they may stand in.

Words are exploded and counted per (document, word), then per document, for totals and distinct
words; the other flags join by document, and each part keeps 32 conditional counts, one for each
set of filters that a document may fail (and as many for documents labelled good and toxic). All
120 orders and their steps are sums over those 32 columns, so a part costs the same whatever its size.

Distribution: words are counted before they are shuffled, and the key holds the document, so a
frequent word, a large source or many copies of one text burden no task. Copies are found by the
text's SHA-256, whose smallest id is brought back by a join that adaptive execution may split.
"""

from __future__ import annotations

import json
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
LEAST_WORDS = 50  # A: fewer words
DISTINCT_SHARE = 65  # B: fewer distinct words, in percent of the words
CAPITAL_SHARE = 5  # C: more A-Z, in percent of the code points
SYMBOLS = "#$%&*|"  # D
SETS = range(1 << len(FILTERS))
SALTS = 16  # places for rows of equal id and text
_KEY = ["doc_id", "key"]  # the key is 64 bits of hash of the text, so that different texts of one id stay apart


def _sum(columns) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0).cast("long"))


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, key, words, distinct of documents (doc_id, key, text) that have words; words of equal rows add up.

    A text goes once to where its words are counted, which takes less room than its words do; the
    salt deals out rows of equal id and text, whose counts then add up.
    """
    place = [*_KEY, "salt"]
    dealt = docs.select(*_KEY, "text", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt")).repartition(*place)
    words = dealt.select(*place, F.explode(F.split("text", "[\\x20\\x09-\\x0D]+")).alias("word")).where("word <> ''")
    each = words.groupBy(*place, "word").agg(F.count("*").alias("n"))
    per_place = each.groupBy(*place).agg(F.sum("n").alias("words"), F.count("*").alias("distinct"))
    return per_place.groupBy(*_KEY).agg(F.sum("words").alias("words"), F.max("distinct").alias("distinct"))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, n (rows of equal id, text and part), fails (bits of FILTERS, A lowest), good, toxic.

    A null text is the empty text: it fails A alone, and E as a copy of another empty text. A null
    source is the part of the empty string. Rows of equal id and text are counted as so many and are
    no copies of each other, nor does a row without an id have a smaller one or be one. A document is
    good or toxic if any of its labels says so; without an id it has none. Further columns are ignored.
    """
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("text"))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    flags = rows.select(
        *_KEY,
        "part",
        F.unhex(F.sha2("text", 256)).alias("digest"),
        (100 * capitals > CAPITAL_SHARE * F.length("text")).alias("c"),
        reduce(lambda a, b: a | b, [F.contains("text", F.lit(x)) for x in SYMBOLS]).alias("d"),
    )
    flags = flags.groupBy(*_KEY, "digest", "c", "d", "part").agg(F.count("*").alias("n"))
    copies = flags.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first")
    # rows of one id and text may stand in several parts; their words were counted together
    flags = flags.groupBy(*_KEY, "digest", "c", "d").agg(F.sum("n").alias("alike"), F.collect_list(F.struct("part", "n")).alias("parts"))
    counted = word_counts(rows).withColumnsRenamed({"doc_id": "w_id", "key": "w_key"})
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    met = flags.join(counted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("key") == F.col("w_key")), "left").join(copies, "digest", "left").join(marks, "doc_id", "left")
    words, distinct = F.coalesce(F.col("words") / F.col("alike"), F.lit(0)), F.coalesce("distinct", F.lit(0))
    failed = {
        "A": words < LEAST_WORDS,
        "B": 100 * distinct < DISTINCT_SHARE * words,
        "C": F.col("c"),
        "D": F.col("d"),
        "E": F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)),
    }
    bits = _sum(failed[f].cast("int") * (1 << k) for k, f in enumerate(FILTERS)).cast("int")
    return met.select(F.inline("parts"), bits.alias("fails"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def _orders() -> tuple[list[str], list]:
    """All orders, and for each step its filter, the filter's bit and the bits of the filters before."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    steps = [{"filter_order": o, "step": k + 1, "bit": FILTERS.index(f), "own": bit[f], "before": sum(bit[g] for g in o[:k])} for o in orders for k, f in enumerate(o)]
    return orders, steps


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    An empty table gives no rows. ``failures`` says what nulls, repeated rows and labels mean.
    """
    orders, steps = _orders()
    failed = failures(docs, labels)
    count = lambda condition, name: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long").alias(name)
    per_part = failed.groupBy("part").agg(
        *[count(F.col("fails") == s, f"n{s}") for s in SETS],
        *[count((F.col("fails") == s) & F.col(kind), f"{kind}{s}") for kind in ("good", "toxic") for s in SETS],
    )
    # a filter comes first among the m filters that a document fails in 1/m of the orders
    first = {m: len(orders) // m for m in range(1, len(FILTERS) + 1)}
    sets = per_part.select(
        "part",
        *[F.array(*[F.col(f"{kind}{s}") for s in SETS]).alias(kind) for kind in ("n", "good", "toxic")],
        F.array(*[_sum(F.col(f"n{s}") * first[s.bit_count()] for s in SETS if s >> k & 1) for k in range(len(FILTERS))]).alias("values"),
    )
    # a constant of 600 structs
    plan = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string, step:int, bit:int, own:int, before:int>>")
    total = lambda kind, keep: F.aggregate(F.sequence(F.lit(0), F.lit(SETS[-1])), F.lit(0).cast("long"), lambda a, s: a + F.when(keep(s), F.get(kind, s)).otherwise(0))
    has = lambda s, bits: s.bitwiseAND(bits) != 0
    first_here = lambda s: has(s, F.col("own")) & ~has(s, F.col("before"))
    return sets.select("*", F.inline(plan)).select(
        "part",
        "filter_order",
        "step",
        total("n", lambda s: ~has(s, F.col("before").bitwiseOR(F.col("own")))).alias("kept"),
        total("n", first_here).alias("removed"),
        total("n", lambda s: has(s, F.col("own")) & has(s, F.col("before"))).alias("redundant"),
        F.get("n", F.col("own")).alias("unique_fails"),
        total("good", first_here).alias("good_lost"),
        total("toxic", first_here).alias("toxic_lost"),
        F.get("values", F.col("bit")).alias("shapley"),
    )


def op11_filter_audit(spark, sf_dir) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
