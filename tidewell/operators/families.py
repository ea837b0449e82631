"""Layout families and merges of models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import kept

LEAST = 0.85
STEPS = 3  # links of a chain that one job decides


def layouts(labels: DataFrame, page: str, label: str) -> DataFrame:
    """X32, first step: pages of exactly equal label sets are one layout: its labels, pages and first page."""
    sets = labels.groupBy(page).agg(F.array_join(F.sort_array(F.collect_set(label)), "+").alias("layout"))  # the labels of one page
    return sets.groupBy("layout").agg(F.count("*").alias("pages"), F.min(page).alias("first"))


def families(found: DataFrame, least: float = LEAST) -> DataFrame:
    """Layout, family: layouts taken from most pages to fewest; each joins the first family head it is ``least`` alike to.

    Greedy and in order, so an iteration over heads: a layout is a head once no head before it is
    alike. ``found``: layout, pages. Alike pairs come from an equality join on the rarest labels,
    as many as the similarity allows to miss. Only a count of undecided layouts reaches the driver.
    """
    rows = kept(found.select("layout", "pages", F.split("layout", "\\+").alias("labels")))  # read many times, made once
    counts = rows.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    ranked = rows.select("layout", F.size("labels").alias("size"), F.explode("labels").alias("label")).join(counts, "label")
    ordered = ranked.groupBy("layout", "size").agg(F.sort_array(F.collect_list(F.struct("n", "label"))).alias("s"))
    prefix = ordered.select("layout", F.explode(F.slice("s", F.lit(1), (F.col("size") - F.ceil(F.col("size") * least) + 1).cast("int"))).alias("x")).select("layout", F.col("x.label").alias("label"))
    other = prefix.select(F.col("layout").alias("head"), "label")
    # sizes bound what two sets can share, before any label is compared
    size = lambda c, name: rows.select(F.col("layout").alias(c), F.size("labels").alias(name))
    pairs = prefix.join(other, "label").where("layout <> head").select("layout", "head").distinct().join(size("layout", "n"), "layout").join(size("head", "head_n"), "head")
    pairs = pairs.where(F.least("n", "head_n") >= F.greatest("n", "head_n") * least - 1e-9).select("layout", "head")
    both = pairs.join(rows.select("layout", "pages", "labels"), "layout").join(rows.select(F.col("layout").alias("head"), F.col("pages").alias("head_pages"), F.col("labels").alias("head_labels")), "head")
    alike = F.size(F.array_intersect("labels", "head_labels")) / F.size(F.array_union("labels", "head_labels")) >= least - 1e-9
    before = (F.col("head_pages") > F.col("pages")) | ((F.col("head_pages") == F.col("pages")) & (F.col("head") < F.col("layout")))
    edges = kept(both.where(alike & before).select("layout", "head", "head_pages"))
    state = kept(rows.select("layout", F.lit(None).cast("string").alias("family")))

    def step(state: DataFrame) -> DataFrame:
        """A layout is decided when all alike ones before it are: by the first of them that is a head, else as a head."""
        known = state.select(F.col("layout").alias("head"), F.col("family").alias("of"))
        seen = edges.join(known, "head").groupBy("layout").agg(
            F.count_if(F.col("of").isNull()).alias("open"), F.min(F.when(F.col("of") == F.col("head"), F.struct((-F.col("head_pages")).alias("p"), "head"))).alias("best")
        )
        decided = F.when(F.coalesce("open", F.lit(0)) == 0, F.coalesce(F.col("best.head"), F.col("layout")))
        return state.join(seen, "layout", "left").select("layout", F.coalesce("family", decided).alias("family"))

    while True:
        for _ in range(STEPS):
            state = step(state)
        state = kept(state)
        if state.where("family IS NULL").isEmpty():
            return state


def merged(models: DataFrame, merges: DataFrame) -> DataFrame:
    """Models with what they are merged into (themselves if nothing) and a snapshot of their name from before."""
    joined = models.join(merges, "id", "left")
    return joined.select("id", F.coalesce("into_id", "id").alias("into_id"), F.when(F.col("into_id").isNotNull(), F.col("name")).alias("snapshot"), F.lit(False).alias("undone"))


def unmerged(state: DataFrame, undo: DataFrame) -> DataFrame:
    """Merges taken back: the model stands for itself again, its snapshot stays for the history."""
    marked = undo.select("id").distinct().withColumn("__undo", F.lit(True))
    back = F.coalesce("__undo", F.lit(False)) & F.col("snapshot").isNotNull()
    joined = state.join(marked, "id", "left")
    return joined.select("id", F.when(back, F.col("id")).otherwise(F.col("into_id")).alias("into_id"), "snapshot", (F.col("undone") | back).alias("undone"))
