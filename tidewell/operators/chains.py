"""Hash chains of audit logs that are made and checked in parallel.

Entries of a period (a day, say) are dealt to lanes by a hash of their id and numbered within each;
``BLOCK`` entries of a lane are one chain: an entry's digest covers its content and the digest before
it. A lane's root covers the ends of its blocks in order, a period's root its lanes, and heads
chain the periods. So blocks are made and checked independently, nothing waits for a single last
entry, and the heads, a row a period, tell whether anything is changed, missing or out of its place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANES, BLOCK = 64, 256


def canonical(columns: Sequence[str]) -> Column:
    """The values as one text that no other values give: each with its length, null as a sign of its own."""
    told = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.concat_ws(",", *told)


def _sha(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def _seed(block: int) -> Column:
    """What a block's first entry has before it."""
    return _sha(F.col("period"), F.col("lane").cast("string"), F.floor((F.col("n") - 1) / block).cast("string"))


def sealed(entries: DataFrame, key: str, order: Sequence[str], period: Column, columns: Sequence[str], lanes: int = LANES, block: int = BLOCK) -> DataFrame:
    """The entries with period, lane, n, previous and digest. ``order`` is to be total; a period is sealed once, as a whole."""
    lane = F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 4), 16, 10).cast("int"), F.lit(lanes))
    dealt = entries.withColumns({"period": period.cast("string"), "lane": lane, "content": canonical(columns)})
    numbered = dealt.withColumn("n", F.row_number().over(Window.partitionBy("period", "lane").orderBy(*order)).cast("long"))
    blocks = numbered.groupBy("period", "lane", F.floor((F.col("n") - 1) / block).alias("block")).agg(F.array_sort(F.collect_list(F.struct("n", "content", F.struct(*entries.columns).alias("entry")))).alias("entries"))  # ``block`` at most
    start = F.array(_sha(F.col("period"), F.col("lane").cast("string"), F.col("block").cast("string")))
    digests = F.aggregate("entries", start, lambda done, e: F.concat(done, F.array(_sha(F.element_at(done, -1), e["content"]))))
    told = blocks.select("period", "lane", "entries", F.explode(F.array(digests)).alias("digests")).select("period", "lane", "digests", F.posexplode("entries").alias("at", "e"))
    return told.select("e.entry.*", "period", "lane", "e.n", F.get("digests", F.col("at")).alias("previous"), F.get("digests", F.col("at") + 1).alias("digest"))


def heads(log: DataFrame, block: int = BLOCK) -> DataFrame:
    """period, entries, root, head of a sealed log: periods in order, each head over the one before. As many rows as periods."""
    number = F.floor((F.col("n") - 1) / block)
    ends = log.groupBy("period", "lane", number.alias("block")).agg(F.max_by("digest", "n").alias("end"), F.count("*").alias("entries"))
    in_order = lambda by, what: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, what))), lambda s: s[what]), "|")
    of_lanes = ends.groupBy("period", "lane").agg(F.sha2(in_order("block", "end"), 256).alias("root"), F.sum("entries").alias("entries"))
    of_periods = of_lanes.groupBy("period").agg(F.sha2(in_order("lane", "root"), 256).alias("root"), F.sum("entries").alias("entries"))
    whole = of_periods.agg(F.array_sort(F.collect_list(F.struct("period", "entries", "root"))).alias("periods"))
    chained = F.aggregate("periods", F.array(F.lit("")), lambda done, p: F.concat(done, F.array(_sha(F.element_at(done, -1), p["root"]))))
    told = whole.select("periods", F.explode(F.array(chained)).alias("heads")).select("heads", F.posexplode("periods").alias("at", "p"))
    return told.select("p.period", "p.entries", "p.root", F.get("heads", F.col("at") + 1).alias("head"))


def breaks(log: DataFrame, kept: DataFrame, key: str, columns: Sequence[str], block: int = BLOCK) -> DataFrame:
    """What is wrong with a log: period, id, state; a sound log gives no rows.

    altered: the entry's content is not what its digest covers; unlinked: the entry before it is missing, out
    of place or another; root (id null): the period as a whole is not the one of the ``kept`` heads, which also tells
    of entries or periods lost at an end, and of digests that were all made anew.
    """
    before = Window.partitionBy("period", "lane", F.floor((F.col("n") - 1) / block)).orderBy("n", "digest")
    first = (F.col("n") - 1) % block == 0
    linked = F.when(F.lag("digest").over(before).isNull(), first & (F.col("previous") == _seed(block))).otherwise((F.lag("n").over(before) + 1 == F.col("n")) & (F.col("previous") == F.lag("digest").over(before)))
    sound = F.col("digest") == _sha(F.col("previous"), canonical(columns))
    told = log.select("period", F.col(key).alias("id"), F.when(~F.coalesce(sound, F.lit(False)), "altered").when(~F.coalesce(linked, F.lit(False)), "unlinked").alias("state")).where("state IS NOT NULL")
    now = heads(log, block).select("period", F.struct("entries", "root").alias("now"))
    roots = now.join(kept.select("period", F.struct("entries", "root").alias("then")), "period", "full_outer").where(~F.col("now").eqNullSafe(F.col("then")))
    return told.unionByName(roots.select("period", F.lit(None).cast(log.schema[key].dataType).alias("id"), F.lit("root").alias("state")))
