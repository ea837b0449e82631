"""Models named in free texts: the longest name, else the longest beginning of one, else the most alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import kept

LEAST, LONGEST, TRIED = 0.30, 8, 12  # similarity, words of a phrase, longest phrases of a text that are compared


def similar(left: DataFrame, right: DataFrame, least: float = LEAST) -> DataFrame:
    """l, r, score: all pairs of texts of the two sides (columns ``l`` and ``r``) of trigram similarity ``least`` or more.

    A set-similarity join of two sides. Trigrams are ordered by how many texts of both sides have them; two
    sets that are alike share one of their first ones, as many as the similarity allows to miss, and the
    lengths and places of these bound what can still be shared. So frequent trigrams bring no texts together.
    """
    grams = lambda df, c: df.select(c).distinct().select(F.col(c).alias("t"), F.explode(F.array(T.trigrams(F.col(c)))).alias("g")).where(F.size("g") > 0)
    sides = kept(grams(left, "l").withColumn("side", F.lit(0)).unionByName(grams(right, "r").withColumn("side", F.lit(1))))
    counts = sides.select(F.explode("g").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    spread = sides.select("side", "t", F.size("g").alias("size"), F.explode("g").alias("gram")).join(counts, "gram")
    ranked = spread.groupBy("side", "t", "size").agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("s"))
    many = (F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1).cast("int")
    index = ranked.select("side", "t", "size", F.posexplode(F.slice("s", F.lit(1), many)).alias("at", "x")).select("side", "t", "size", "at", "x.gram")
    a = index.where("side = 0").select(F.col("t").alias("l"), F.col("size").alias("l_size"), F.col("at").alias("l_at"), "gram")
    b = index.where("side = 1").select(F.col("t").alias("r"), F.col("size").alias("r_size"), F.col("at").alias("r_at"), "gram")
    needed = (F.col("l_size") + F.col("r_size")) * (least / (1 + least))
    left_over = F.least(F.col("l_size") - F.col("l_at"), F.col("r_size") - F.col("r_at")) + F.least("l_at", "r_at")
    fits = (F.least("l_size", "r_size") >= F.greatest("l_size", "r_size") * least - 1e-9) & (left_over >= needed - 1e-9)
    pairs = a.join(b, "gram").where(fits).select("l", "r", "l_size", "r_size").distinct()
    held = lambda side, c, g: sides.where(F.col("side") == side).select(F.col("t").alias(c), F.col("g").alias(g))
    both = pairs.join(held(0, "l", "lg"), "l").join(held(1, "r", "rg"), "r")
    # few bytes but much work: dealt out by number, which adaptive execution leaves as it is
    dealt = both.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shared = dealt.select("l", "r", (F.col("l_size") + F.col("r_size")).alias("sizes"), F.explode(F.array(F.size(F.array_intersect("lg", "rg")))).alias("shared"))
    return shared.select("l", "r", F.round(F.col("shared") / (F.col("sizes") - F.col("shared")), 6).alias("score")).where(F.col("score") >= least)


def _longest(rows: DataFrame, key: str, length: str) -> DataFrame:
    """The rows whose ``length`` is the greatest of their key."""
    most = rows.groupBy(key).agg(F.max(length).alias("__most"))
    return rows.join(most, key).where(F.col(length) == F.col("__most")).drop("__most")


def model_links(texts: DataFrame, key: str, text: Column, models: DataFrame, least: float = LEAST) -> DataFrame:
    """key, model_id, tier, score, phrase: the models that a text names.

    ``models``: model_id, model_key (as ``text.model_key`` makes it), alias (boolean). Tier 0 and 1: the longest phrases that are a key
    (score 1.0) or an alias (0.98), so a shorter one inside a longer is none; tier 2, only without those: the longest
    phrases of three signs or more that begin a key, 0.70 + 0.25 * their share of it; tier 3, only without
    any: the similarity of one of the text's ``TRIED`` longest phrases of four signs or more. A model is told once a
    text, by its best tier, score and phrase. Prefixes and phrases meet by equality.
    """
    words = texts.select(F.col(key).alias("id"), F.explode(F.array(F.split(T.model_key(text), " "))).alias("ws")).where("ws[0] <> ''")
    n = F.size("ws")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST), n - i + 1)), lambda m: F.struct(m.alias("words"), F.array_join(F.slice("ws", i, m), " ").alias("phrase")))))
    phrases = kept(words.select("id", F.inline(F.array_distinct(spans))))
    exact = phrases.join(models, F.col("phrase") == F.col("model_key"))
    told = _longest(exact, "id", "words").select("id", "model_id", F.when(F.col("alias"), 1).otherwise(0).alias("tier"), F.when(F.col("alias"), 0.98).otherwise(1.0).alias("score"), "phrase")
    begins = models.select("model_id", F.length("model_key").alias("length"), F.explode(F.transform(F.sequence(F.lit(1), F.length("model_key")), lambda i: F.substr("model_key", F.lit(1), i))).alias("begin"))
    rest = phrases.join(told.select("id").distinct(), "id", "left_anti")
    prefix = rest.where(F.length("phrase") >= 3).join(begins, F.col("phrase") == F.col("begin")).withColumn("signs", F.length("phrase"))
    second = _longest(prefix, "id", "signs").select("id", "model_id", F.lit(2).alias("tier"), F.round(0.70 + 0.25 * F.col("signs") / F.col("length"), 6).alias("score"), "phrase")
    last = rest.join(second.select("id").distinct(), "id", "left_anti").where(F.length("phrase") >= 4)
    order = Window.partitionBy("id").orderBy(F.desc(F.length("phrase")), "phrase")
    tried = last.select("id", "phrase").distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= TRIED)
    near = similar(tried.select(F.col("phrase").alias("l")), models.select(F.col("model_key").alias("r")), least)
    third = tried.join(near, F.col("phrase") == F.col("l")).join(models, F.col("r") == F.col("model_key")).select("id", "model_id", F.lit(3).alias("tier"), "score", "phrase")
    best = Window.partitionBy("id", "model_id").orderBy("tier", F.desc("score"), "phrase")
    every = told.unionByName(second).unionByName(third).withColumn("place", F.row_number().over(best)).where("place = 1")
    return every.select(F.col("id").alias(key), "model_id", "tier", F.round("score", 6).alias("score"), "phrase")
