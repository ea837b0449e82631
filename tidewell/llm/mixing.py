"""Operator 5: mixing sources to target weights by cube-method balanced sampling.

Every document of a source is taken ``floor(target / size of the source)`` times; the fraction
that is left is its probability of one more time. Of ``n`` equal rows, ``n`` times that fraction
is expected: its whole part is taken for sure, and one unit decides by the part that is left.
The cube method moves these probabilities along vectors of the null-space of the balancing
constraints (tokens and documents of the source) until each is 0 or 1, except for a few: the
landing problem.

Distribution: a flight runs inside each (source, block), blocks being hash ranges of bounded
size, and leaves at most two undecided documents each; those form the next level's blocks,
until one block a source is left, which lands. Each level keeps both totals exactly, so the
totals of the whole source are kept, whatever the number of blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Table, bounded_batches, private, with_prefix_sum, word_count

BLOCK = 8192
MOST = 3
LANDING = 12  # so many undecided documents of a source are decided by trying all choices


def targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """source, source_size, target from source and source_size.

    Sources in code point order, null last, weigh 1, 2, 3, 1, ...; targets share the total by
    weight, never above ``most`` times the size; what is above is shared again by weight.
    """
    ordered = sizes.select("source", "source_size", F.col("source").isNull().alias("last"), F.lit(1).alias("one"))
    rows = with_prefix_sum(ordered, ["last", "source"], "one", "place", "sources").df
    rows = Table(rows.select("source", "source_size", (F.col("place") % 3 + 1).alias("weight")), "weights").df
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    capped = F.lit(False)
    level = 0.0
    while True:  # each round caps at least one more of the distinct ratios, or ends
        kept, spent, weights = rows.agg(
            F.count_if(capped), F.sum(F.when(capped, most * F.col("source_size")).otherwise(0)), F.sum(F.when(capped, 0).otherwise(F.col("weight")))
        ).first()
        level = (total - (spent or 0)) / weights if weights else 0.0
        capped = capped | (F.col("weight") * level > most * F.col("source_size"))
        if rows.agg(F.count_if(capped)).first()[0] == kept:
            break
    target = F.when(capped, (most * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.lit(float(level)))
    return rows.select("source", "source_size", target.alias("target"))


def flight(p: list[float], size: list[float], seed: int) -> list[int]:
    """Moves ``p`` in place with sum(p) and sum(p * size) fixed; returns the undecided places.

    Three undecided documents at a time have a null-space of the two constraints, given by the
    differences of their sizes; a step along it, of random sign with the right odds, decides
    at least one of them.
    """
    draws = iter(np.random.default_rng(seed).random(4 * len(p) + 16).tolist())
    open_ = [k for k, x in enumerate(p) if 1e-9 < x < 1 - 1e-9]
    for k, x in enumerate(p):
        if not 1e-9 < x < 1 - 1e-9:
            p[k] = float(round(x))
    hand: list[int] = []
    for k in open_:
        hand.append(k)
        while len(hand) >= 3 or len(hand) == 2 and size[hand[0]] == size[hand[1]]:
            if len(hand) == 2:
                u = [1.0, -1.0]
            else:
                a, b, c = (size[i] for i in hand)
                u = [b - c, c - a, a - b] if a != b or b != c else [1.0, -1.0, 0.0]
            moved = [(i, x) for i, x in zip(hand, u, strict=True) if x]
            up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in moved)
            down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in moved)
            step = up if next(draws) * (up + down) < down else -down
            tight = min(moved, key=lambda m: min(abs(p[m[0]] + step * m[1]), abs(1 - p[m[0]] - step * m[1])))[0]
            for i, x in moved:
                p[i] = min(1.0, max(0.0, p[i] + step * x))
            p[tight] = float(round(p[tight]))
            for i in hand:
                if not 1e-9 < p[i] < 1 - 1e-9:
                    p[i] = float(round(p[i]))
            hand = [i for i in hand if 0.0 < p[i] < 1.0]
    return hand


def landing(p: list[float], size: list[float], hand: list[int]) -> None:
    """Decides the last ones: of all choices, that whose totals are nearest the wanted ones."""
    if not hand:
        return
    choice = (np.arange(1 << len(hand))[:, None] >> np.arange(len(hand))) & 1
    own, chance = np.array([size[i] for i in hand]), np.array([p[i] for i in hand])
    words, count = np.abs(choice @ own - chance @ own), np.abs(choice.sum(1) - chance.sum())
    best = int((20 * words / max(own.mean(), 1.0) + count).argmin())
    for i, x in zip(hand, choice[best], strict=True):
        p[i] = float(x)


def _reserve(size: list[float], places: list[int]) -> list[int]:
    """Undecided documents kept for the landing, each about half as long as the one before.

    Their subsets then make up almost any number of words, as binary digits do.
    """
    kept: list[int] = []
    for k in sorted(places, key=lambda k: -size[k]):
        if len(kept) < LANDING and (not kept or size[k] <= 0.55 * size[kept[-1]]):
            kept.append(k)
    return kept


def _level(last: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["h", "key"], kind="stable")
        p, size = group["p"].tolist(), group["size"].astype(float).tolist()
        kept = set(_reserve(size, [k for k, x in enumerate(p) if 1e-9 < x < 1 - 1e-9])) if last else set()
        first = [k for k in range(len(p)) if k not in kept]
        own, sizes = [p[k] for k in first], [size[k] for k in first]
        hand = [first[k] for k in flight(own, sizes, int(group["h"].iloc[0]) & 0xFFFFFFFF)]
        for k, x in zip(first, own, strict=True):
            p[k] = x
        if last:
            landing(p, size, hand + sorted(kept))
        return group.drop(columns="block").assign(p=p)

    return run


def _totals(docs: DataFrame, block: int, most: int) -> DataFrame:
    """One row for each distinct (doc_id, source, text): ``n`` equal rows, taken ``copies`` times together."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("h"), word_count(F.col("text")).alias("size"))
    units = Table(rows.groupBy("doc_id", "source", "h", "size").agg(F.count("*").alias("n")), "units").df
    sums = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("units"))
    sums = Table(sums, "sums").df
    goal = targets(sums.select("source", "source_size"), most).withColumnRenamed("source", "of")
    goal = goal.join(sums.select(F.col("source").alias("of2"), "units"), F.col("of").eqNullSafe(F.col("of2"))).drop("of2")
    goal = Table(goal.withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)), "goal").df

    fraction = (F.col("ratio") - F.floor("ratio")) * F.col("n")
    state = units.join(goal, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumns(
        {"p": fraction - F.floor(fraction), "key": F.col("doc_id").cast("string"), "base": (F.floor("ratio") * F.col("n") + F.floor(fraction)).cast("long")}
    )
    undecided = (F.col("p") > 0) & (F.col("p") < 1)
    open_ = Table(state.where(undecided).select("key", "source", "h", "size", "units", "p"), "flight0").df
    most_open = goal.agg(F.max("units")).first()[0] or 0
    schema, level, done = open_.schema, 0, None
    while True:  # each level leaves two of ``block``: the number of levels is a logarithm
        last = most_open <= block
        blocks = F.lit(1) if last else F.greatest(F.lit(1), F.ceil(F.col("units") / block)).cast("long")
        open_ = open_.withColumn("block", F.pmod(F.xxhash64("h", "key", F.lit(level)), blocks))
        moved = Table(open_.groupBy("source", "block").applyInPandas(_level(last), schema), f"flight{level + 1}").df
        closed = moved.where(~undecided)
        done = closed if done is None else done.unionByName(closed)
        if last:
            break
        # about so many are left in the largest source: two a block
        most_open = 2 * -(-most_open // block)
        open_ = moved.where(undecided).withColumn("units", 2 * F.ceil(F.col("units") / block))
        level += 1
    extra = done.select(F.col("key").alias("k"), F.col("source").alias("s"), F.col("h").alias("h2"), F.col("p").cast("long").alias("extra"))
    same = (F.col("h") == F.col("h2")) & F.col("key").eqNullSafe(F.col("k")) & F.col("source").eqNullSafe(F.col("s"))
    return state.join(extra, same, "left").select(
        "doc_id", "source", "h", "size", "n", "source_size", "target",
        F.least(F.lit(most) * F.col("n"), F.col("base") + F.coalesce("extra", F.lit(0))).cast("long").alias("copies"),
    )


def decisions(docs: DataFrame, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """doc_id, source, h (hash of the text), size, n (equal rows), source_size, target, copies.

    ``n`` rows of equal doc_id, source and text are each taken ``copies`` times; where they are
    not all taken equally often there are two rows, one copy apart. Sizes are words of whole
    texts, 0 for null. An empty table gives none; a source without words has target 0 and is not
    taken. Null ids and sources are values like any other.
    """
    base, left = F.floor(F.col("copies") / F.col("n")), F.col("copies") % F.col("n")
    parts = F.array(F.struct(left.alias("n"), (base + 1).alias("copies")), F.struct((F.col("n") - left).alias("n"), base.alias("copies")))
    named = [c for c in ("doc_id", "source", "h", "size", "source_size", "target")]
    each = _totals(docs, block, most).select(*named, F.explode(parts).alias("part")).where("part.n > 0")
    return each.select("doc_id", "source", "h", "size", F.col("part.n").alias("n"), "source_size", "target", F.col("part.copies").cast("int").alias("copies"))


def mixed(docs: DataFrame, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns.

    Rows of equal doc_id, source and text share a decision; if it takes them unequally often,
    which of them gets one more is arbitrary. Null and empty texts have no words; they are drawn
    like others of their source. An empty table gives an empty one.
    """
    own = _totals(docs, block, most).where("copies > 0")
    d, s, h2, base, left, h, number, copy = private(docs, "mix_id", "mix_source", "mix_of", "mix_base", "mix_left", "mix_hash", "mix_number", "mix_copy")
    taken = own.select(
        F.col("doc_id").alias(d), F.col("source").alias(s), F.col("h").alias(h2),
        F.floor(F.col("copies") / F.col("n")).cast("int").alias(base), (F.col("copies") % F.col("n")).alias(left),
    )
    taken = Table(taken, "mix").df
    same = (F.col(h) == F.col(h2)) & F.col("doc_id").eqNullSafe(F.col(d)) & F.col("source").eqNullSafe(F.col(s))
    rows = docs.withColumn(h, F.xxhash64("text")).join(taken, same)
    kept = [F.col(f"`{c}`") for c in docs.columns]
    # only equal rows that are taken unequally often need numbers
    even = rows.where(F.col(left) == 0).select(*kept, F.col(base).alias(copy))
    order = Window.partitionBy(d, s, h2).orderBy(F.lit(0))
    odd = rows.where(F.col(left) > 0).withColumn(number, F.row_number().over(order))
    odd = odd.select(*kept, (F.col(base) + F.when(F.col(number) <= F.col(left), 1).otherwise(0)).alias(copy))
    each = even.unionByName(odd).where(F.col(copy) > 0)
    return each.select(*kept, F.explode(F.sequence(F.lit(1), F.col(copy))).alias(copy)).drop(copy)


def op5_mix_sources(spark, sf_dir) -> DataFrame:
    rows = decisions(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    # one row for each of n equal ones, in two steps: no array is longer than a thousand
    step = 1000
    some = rows.withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / step) * step, F.lit(step).cast("long"))))
    each = some.withColumn("__row", F.explode(F.sequence(F.col("__from") + 1, F.least(F.col("n"), F.col("__from") + step))))
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source")
