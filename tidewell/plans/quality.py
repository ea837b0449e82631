"""Dashboard, cartography and journal queries on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import confidence as C
from ..operators import quality as Q
from ..operators import quantiles as N
from .registry import Tables, query



@query("SELECT count(*) AS total, count(*) FILTER (WHERE l_returnflag = 'R') AS corrected, round((count(*) - count(*) FILTER (WHERE l_returnflag = 'R')) / nullif(count(*), 0)::DOUBLE, 6) AS auto_rate FROM lineitem")
def a01_quality_auto_rate(t: Tables) -> DataFrame:
    return Q.correction_rate(t.lineitem, F.col("l_returnflag") == "R")


@query("""SELECT l_linestatus, strftime(l_shipdate, '%Y-%m') AS month, count(*) AS total, count(*) FILTER (WHERE l_returnflag = 'R') AS corrected,
round((count(*) - count(*) FILTER (WHERE l_returnflag = 'R')) / nullif(count(*), 0)::DOUBLE, 6) AS auto_rate FROM lineitem GROUP BY 1, 2""")
def a02_correction_by_field(t: Tables) -> DataFrame:
    return Q.correction_rate(t.lineitem.withColumn("month", F.date_format("l_shipdate", "yyyy-MM")), F.col("l_returnflag") == "R", "l_linestatus", "month")


@query("""WITH x AS (SELECT o_orderpriority, epoch(l_shipdate) - epoch(o_orderdate) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT o_orderpriority, count(s) AS n, round(quantile_cont(s, 0.5), 3) AS p50, round(quantile_cont(s, 0.95), 3) AS p95, round(avg(s), 3) AS mean, min(s)::BIGINT AS least, max(s)::BIGINT AS most FROM x GROUP BY 1""")
def a03_validation_time_percentiles(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    seconds = F.unix_seconds(F.col("l_shipdate").cast("timestamp")) - F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    return Q.duration_percentiles(rows.withColumn("s", seconds), F.col("s"), "o_orderpriority")


@query("SELECT o_orderpriority AS code, o_orderstatus AS severity, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 100000) AS n_large FROM orders GROUP BY 1, 2")
def a04_frequent_anomalies(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_orderpriority").alias("code"), F.col("o_orderstatus").alias("severity")).agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 100000).alias("n_large"))


@query("SELECT o_orderstatus, count(*) AS n, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS pending FROM orders GROUP BY 1")
def a05_volume_by_status(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("pending"))


@query("""SELECT ts::DATE::VARCHAR AS day, count(*) AS n, round(count(*) FILTER (WHERE value < 10) / count(*)::DOUBLE, 6) AS empty_share
FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 30 DAY GROUP BY 1""")
def a06_search_usage_daily(t: Tables) -> DataFrame:
    return Q.daily_usage(t.events, "ts", F.col("value") < 10, 30).withColumn("day", F.col("day").cast("string"))


@query("""WITH x AS (SELECT CASE WHEN json_extract_string(props, '$.k')::BIGINT % 2 = 0 THEN 'user' ELSE 'api' END AS channel, value FROM events)
SELECT coalesce(channel, 'user') AS channel, count(*) AS n, count(*) FILTER (WHERE value < 10) AS empty FROM x GROUP BY 1""")
def a06_search_by_channel(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("long")
    return t.events.groupBy(F.when(k % 2 == 0, "user").when(k.isNull(), "user").otherwise("api").alias("channel")).agg(F.count("*").alias("n"), F.count_if(F.col("value") < 10).alias("empty"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderstatus, o_orderpriority))")
def a07_batch_counts(t: Tables) -> DataFrame:
    return t.orders.groupingSets([["o_orderstatus"], ["o_orderstatus", "o_orderpriority"]], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT text, count(DISTINCT doc_id) AS n FROM documents GROUP BY text HAVING count(DISTINCT doc_id) > 1)
SELECT (SELECT count(*) FROM g) AS groups, (SELECT coalesce(sum(n), 0)::BIGINT FROM g) AS members, (SELECT count(DISTINCT source) FROM documents WHERE text IN (SELECT text FROM g)) AS sources""")
def a08_duplicate_indicators(t: Tables) -> DataFrame:
    docs = t.documents.withColumn("digest", F.sha2("text", 256)).select("doc_id", "source", "digest")
    groups = docs.groupBy("digest").agg(F.countDistinct("doc_id").alias("n")).where("n > 1")
    sources = docs.join(groups, "digest", "left_semi").agg(F.countDistinct("source").alias("sources"))
    return groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("members")).crossJoin(sources)


@query("""SELECT user_id, count(*) AS actions, round(count(*) / (SELECT count(*) FROM events)::DOUBLE, 6) AS share FROM events GROUP BY 1
UNION ALL SELECT c_custkey, 0, 0.0 FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)""")
def a09_attribution_by_user(t: Tables) -> DataFrame:
    active, idle = Q.attribution(t.events, t.customer.select(F.col("c_custkey").alias("user_id")), "user_id")
    return active.unionByName(idle.select("user_id", F.lit(0).cast("long").alias("actions"), F.lit(0.0).alias("share")))


@query("""SELECT lang, count(*) AS pages, count(*) FILTER (WHERE length(trim(text)) < 20) AS to_ocr, count(DISTINCT source) FILTER (WHERE n_chars > 1000) AS sources,
sum(length(text))::BIGINT AS chars, round(avg(n_chars), 3) AS mean_chars FROM documents GROUP BY 1""")
def a10_ocr_style_page_stats(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(
        F.count("*").alias("pages"), F.count_if(F.length(F.trim("text")) < 20).alias("to_ocr"), F.count_distinct(F.when(F.col("n_chars") > 1000, F.col("source"))).alias("sources"),
        F.sum(F.length("text")).alias("chars"), F.round(F.avg("n_chars"), 3).alias("mean_chars"),
    )


_SIZES = "SELECT o_custkey, o_orderstatus, count(*) AS size FROM orders GROUP BY 1, 2"


@query("SELECT *, size >= 5 AS covered FROM (" + _SIZES + ")")
def a12_group_sizes(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("size")).withColumn("covered", F.col("size") >= 5)


@query(f"""WITH g AS ({_SIZES}), b AS (SELECT CASE WHEN i = 10 THEN '10+' ELSE i::VARCHAR END AS bucket FROM range(1, 11) t(i))
SELECT b.bucket, count(g.size) AS groups, coalesce(sum(g.size), 0)::BIGINT AS members FROM b LEFT JOIN g ON b.bucket = CASE WHEN g.size >= 10 THEN '10+' ELSE g.size::VARCHAR END GROUP BY 1""")
def a13_size_histogram(t: Tables) -> DataFrame:
    return Q.size_histogram(t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("size")), "size")


@query("SELECT p_brand AS value, count(*) AS n FROM part WHERE trim(coalesce(p_brand, '')) <> '' GROUP BY 1")
def a14_value_counts(t: Tables) -> DataFrame:
    return t.part.where(F.trim(F.coalesce("p_brand", F.lit(""))) != "").groupBy(F.col("p_brand").alias("value")).agg(F.count("*").alias("n"))


@query("SELECT word AS value, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1")
def a15_nested_value_counts(t: Tables) -> DataFrame:
    return t.part.select(F.explode(F.split("p_name", " ")).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


_MIXED = "SELECT CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) WHEN p_partkey % 3 = 1 THEN p_name ELSE replace(p_name, ' ', '-') END AS form FROM part"


@query(f"""WITH f AS (SELECT trim(regexp_replace(lower(form), '[^0-9a-z]+', ' ', 'g')) AS key, form, count(*) AS n FROM ({_MIXED}) GROUP BY 1, 2)
SELECT key, count(*) AS n_forms, sum(n)::BIGINT AS total, first(form ORDER BY n DESC, length(form), form) AS majority, string_agg(form, '|' ORDER BY n DESC, length(form), form) AS spellings
FROM f GROUP BY key HAVING count(*) > 1""")
def a16_variants_certain(t: Tables) -> DataFrame:
    form = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).when(F.col("p_partkey") % 3 == 1, F.col("p_name")).otherwise(F.replace("p_name", F.lit(" "), F.lit("-")))
    return Q.certain_variants(t.part.select(form.alias("form")), "form", T.variant_key(F.col("form")))


@query("""WITH k AS (SELECT key, count(*) AS n FROM (SELECT lower(p_name) AS key FROM part UNION ALL SELECT lower(split_part(p_name, ' ', 1)) FROM part) WHERE key <> '' GROUP BY 1)
SELECT a.key AS short_key, b.key AS long_key, a.n AS n_short, b.n AS n_long FROM k a JOIN k b ON a.key <> b.key AND length(a.key) >= 4 AND contains(' ' || b.key || ' ', ' ' || a.key || ' ')""")
def a17_variants_probable(t: Tables) -> DataFrame:
    names = t.part.select(F.lower("p_name").alias("key"))
    return Q.contained_variants(names.unionByName(t.part.select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("key"))), "key")


@query("""WITH s AS (SELECT CASE WHEN doc_id % 11 <> 0 THEN (doc_id * 37 % 100) / 100.0 END::DOUBLE AS s FROM documents), t(threshold) AS (VALUES (0.8::DOUBLE), (0.85), (0.9), (0.95))
SELECT (SELECT count(s) FROM s) AS known, (SELECT count(*) - count(s) FROM s) AS unknown, threshold, count(*) FILTER (WHERE s >= threshold) AS n,
round(count(*) FILTER (WHERE s >= threshold) / nullif(count(s), 0)::DOUBLE, 6) AS share FROM s, t GROUP BY threshold""")
def a18_score_ladder(t: Tables) -> DataFrame:
    score = F.when(F.col("doc_id") % 11 != 0, F.col("doc_id") * 37 % 100 / 100.0)
    return Q.score_ladder(t.documents.withColumn("s", score), F.col("s"), (0.80, 0.85, 0.90, 0.95))


@query("""WITH j AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)), c AS (SELECT count(*) AS total, count(lang) AS lang, count(source) AS source, count(quality) AS quality, count(toxic) AS toxic FROM j)
SELECT total, name, filled, round(filled / nullif(total, 0)::DOUBLE, 6) AS share FROM c UNPIVOT (filled FOR name IN (lang, source, quality, toxic))""")
def a19_completeness(t: Tables) -> DataFrame:
    return Q.completeness(t.documents.join(t.labels, "doc_id", "left"), ["lang", "source", "quality", "toxic"])


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM labels) AS labels, (SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) AS labelled, (SELECT count(*) FROM documents WHERE text IS NULL) AS empty")
def a20_reachability(t: Tables) -> DataFrame:
    docs = t.documents.agg(F.count("*").alias("documents"), F.count_if(F.col("text").isNull()).alias("empty"))
    return docs.crossJoin(t.labels.agg(F.count("*").alias("labels"))).crossJoin(t.documents.join(t.labels, "doc_id", "left_semi").agg(F.count("*").alias("labelled")))


@query("SELECT sha256(text) AS digest, count(DISTINCT doc_id) AS members, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT doc_id) > 1")
def a21_exact_dup_groups(t: Tables) -> DataFrame:
    return Q.exact_duplicate_groups(t.documents.select("doc_id", F.sha2("text", 256).alias("digest")), "digest", "doc_id")


@query("SELECT props AS query, count(*) AS n, count(*) FILTER (WHERE floor(value)::BIGINT % 7 = 0) AS n_empty, max(ts) AS last_at FROM events GROUP BY 1")
def a22_top_queries(t: Tables) -> DataFrame:
    return Q.top_queries(t.events.withColumnRenamed("props", "query").withColumn("results", F.floor("value") % 7), "query", F.col("results"), "ts")


@query("SELECT event_type, count(*) AS n, arg_max(props, (ts, event_id)) AS latest, max(ts) AS last_at FROM events WHERE value < 10 GROUP BY 1")
def a23_zero_result_latest(t: Tables) -> DataFrame:
    return t.events.where("value < 10").groupBy("event_type").agg(F.count("*").alias("n"), F.max_by("props", F.struct("ts", "event_id")).alias("latest"), F.max("ts").alias("last_at"))


@query("""WITH s AS (SELECT l_orderkey, 1 - l_discount AS s FROM lineitem), g AS (SELECT l_orderkey, count(*) FILTER (WHERE s >= 0.99) AS tier_1, count(*) FILTER (WHERE s >= 0.9 AND s < 0.99) AS tier_2,
count(*) FILTER (WHERE s >= 0.85 AND s < 0.9) AS tier_3, count(*) FILTER (WHERE s IS NULL OR s < 0.85) AS tier_4, round(min(s), 6) AS least, round(avg(s), 6) AS mean FROM s GROUP BY 1)
SELECT o_orderkey, coalesce(tier_1, 0) AS tier_1, coalesce(tier_2, 0) AS tier_2, coalesce(tier_3, 0) AS tier_3, coalesce(tier_4, 0) AS tier_4, least, mean FROM orders LEFT JOIN g ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O'""")
def a25_validation_queue(t: Tables) -> DataFrame:
    score = F.lit(1) - F.col("l_discount")
    counts = t.lineitem.withColumn("s", score).groupBy("l_orderkey").agg(*Q.tiers(F.col("s")), F.round(F.min("s"), 6).alias("least"), F.round(F.avg("s"), 6).alias("mean"))
    rows = t.orders.where("o_orderstatus = 'O'").select("o_orderkey").join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select("o_orderkey", *[F.coalesce(f"tier_{k}", F.lit(0)).alias(f"tier_{k}") for k in range(1, 5)], "least", "mean")


_STATS = """q AS (SELECT k, count(*) AS n, quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b, min(v) AS lo, max(v) AS hi FROM x GROUP BY k),
d AS (SELECT x.k, quantile_cont(abs(v - m), 0.5) AS mad FROM x JOIN q USING (k) GROUP BY 1)"""


@query(f"""WITH x AS (SELECT l_suppkey AS k, l_extendedprice AS v FROM lineitem WHERE l_extendedprice IS NOT NULL), {_STATS}
SELECT k AS l_suppkey, n, round_even(m, 3) AS median, round_even(a, 3) AS q1, round_even(b, 3) AS q3, round_even(b - a, 3) AS iqr, round_even(mad, 3) AS mad, round_even(lo, 3) AS least, round_even(hi, 3) AS most FROM q JOIN d USING (k)""")
def a28_robust_stats(t: Tables) -> DataFrame:
    return C.robust_stats(t.lineitem, ["l_suppkey"], "l_extendedprice")


@query(f"""WITH x AS (SELECT l_returnflag AS k, l_extendedprice AS v FROM lineitem WHERE l_extendedprice IS NOT NULL), {_STATS}
SELECT k AS l_returnflag, n, round_even(m, 3) AS median, round_even(a, 3) AS q1, round_even(b, 3) AS q3, round_even(b - a, 3) AS iqr, round_even(mad, 3) AS mad, round_even(lo, 3) AS least, round_even(hi, 3) AS most FROM q JOIN d USING (k)""")
def a28_stats_of_large_groups(t: Tables) -> DataFrame:
    """Three groups hold all rows: none of them meets in one task."""
    return N.robust_stats(t.lineitem, ["l_returnflag"], "l_extendedprice")


_OBS = "SELECT lang, (doc_id * 37 % 100) / 100.0 AS s, quality = 1 AS ok FROM documents JOIN labels USING (doc_id)"


@query(f"""WITH o AS ({_OBS}), b(bound) AS (VALUES (0.5::DOUBLE), (0.8), (0.9), (0.95), (0.99))
SELECT lang, bound, count(*) FILTER (WHERE s >= bound) AS n, count(*) FILTER (WHERE s >= bound AND ok) AS n_correct,
CASE WHEN count(*) FILTER (WHERE s >= bound) >= 5 THEN round(count(*) FILTER (WHERE s >= bound AND ok) / nullif(count(*) FILTER (WHERE s >= bound), 0)::DOUBLE, 4) END AS accuracy FROM o, b GROUP BY 1, 2""")
def a29_calibration_ladder(t: Tables) -> DataFrame:
    return C.calibration_ladder(_observations(t), "lang", "s", F.col("quality") == 1, (0.5, 0.8, 0.9, 0.95, 0.99))


@query(f"""WITH o AS ({_OBS}), c AS (SELECT DISTINCT lang, round(s, 6)::DOUBLE AS threshold FROM o),
a AS (SELECT c.lang, threshold, count(*) AS n, count(*) FILTER (WHERE ok) AS g FROM c JOIN o ON c.lang = o.lang AND o.s >= threshold - 1e-9 GROUP BY 1, 2)
SELECT lang, min(threshold) FILTER (WHERE n >= 5 AND g / n::DOUBLE >= 0.5 - 1e-9) AS threshold FROM a GROUP BY 1""")
def a30_threshold_reco(t: Tables) -> DataFrame:
    return C.recommended_threshold(_observations(t), "lang", "s", F.col("quality") == 1, 0.5)


def _observations(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id").select("lang", (F.col("doc_id") * 37 % 100 / 100.0).alias("s"), "quality")


@query("""WITH v AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY 1, 2) SELECT event_type, count(*) AS n, count(*) FILTER (WHERE v >= 50) AS kept, count(DISTINCT user_id) AS users FROM v GROUP BY 1""")
def a31_latest_verdicts(t: Tables) -> DataFrame:
    latest = t.events.groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("v"))
    return latest.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("v") >= 50).alias("kept"), F.countDistinct("user_id").alias("users"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE n_chars > 2000) AS long, count(DISTINCT source) AS sources FROM documents")
def a33_index_stats(t: Tables) -> DataFrame:
    return t.documents.agg(F.count("*").alias("total"), F.count_if(F.col("n_chars") > 2000).alias("long"), F.countDistinct("source").alias("sources"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 3) AS quantity FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def a34_grouping_sets_quality(t: Tables) -> DataFrame:
    return t.lineitem.groupingSets([["l_returnflag", "l_linestatus"], ["l_returnflag"], []], "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 3).alias("quantity"))


@query("SELECT o_custkey % 50 AS lot, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 2)::DOUBLE AS progress FROM orders GROUP BY 1")
def a35_batch_progress(t: Tables) -> DataFrame:
    done = F.count_if(F.col("o_orderstatus") == "F")
    return t.orders.groupBy((F.col("o_custkey") % 50).alias("lot")).agg(F.count("*").alias("n"), done.alias("done"), F.round(done * 100.0 / F.count("*"), 2).alias("progress"))


@query("WITH g AS (SELECT sha256(text) AS h, n_chars, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) > 1) SELECT count(*) AS groups, sum(n - 1)::BIGINT AS redundant_files, sum((n - 1) * n_chars)::BIGINT AS redundant_bytes FROM g")
def a36_archive_duplicates(t: Tables) -> DataFrame:
    return Q.redundant_bytes(t.documents.select(F.sha2("text", 256).alias("h"), "n_chars"), "h", "n_chars")


@query("SELECT o_custkey, string_agg(o_orderpriority, ' ' ORDER BY o_orderkey) AS told FROM orders GROUP BY 1")
def a38_child_text(t: Tables) -> DataFrame:
    items = F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority")))
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.transform(items, lambda x: x["o_orderpriority"]), " ").alias("told"))
