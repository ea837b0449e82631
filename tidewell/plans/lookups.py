"""Predicates, joins, orders and lookups on the driver tables (P, J, Q, O, U, L)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import dedup as D
from ..operators import filters as B
from ..operators import latest as L
from ..operators import listings as S
from ..operators import retrieval as R
from .registry import Tables, query
from .search import key_sql

# --- predicates ------------------------------------------------------------------------------


def _spec(t: Tables) -> B.FilterSpec:
    return B.FilterSpec(
        equal={"type": "p_type", "brand": "p_brand"}, contains={"name": "p_name"}, ranges={"size": "p_size", "price": "p_retailprice"},
        within={"ordered": (t.lineitem.where("l_quantity > 45"), "l_partkey", "p_partkey")},
    )


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P')")
def p02_status(t: Tables) -> DataFrame:
    return B.with_status(t.orders, "o_orderstatus", True, "F", "P").select("o_orderkey", "o_orderstatus")


@query(f"SELECT p_partkey FROM part WHERE contains({key_sql('p_name')}, 'gear')")
def p04_folded_contains(t: Tables) -> DataFrame:
    return B.apply(t.part, _spec(t), {"name": "GÉAR", "unknown": "x"}).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_type = 'SMALL' AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def p05_semi_join_filters(t: Tables) -> DataFrame:
    return B.apply(t.part, _spec(t), {"type": "SMALL", "ordered": True}).select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) BETWEEN 1994 AND 1995")
def p06_years(t: Tables) -> DataFrame:
    return B.apply(t.orders, B.FilterSpec(year={"year": "o_orderdate"}), {"year": "1994-1995"}).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_size >= 10.5 AND p_retailprice <= 950")
def p07_named_range(t: Tables) -> DataFrame:
    return B.apply(t.part, _spec(t), {"min_size": "10,5", "max_price": 950, "max_size": "many"}).select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE c_name ILIKE '%#0000000__' ESCAPE '!' AND NOT contains(lower(c_name), 'r_0') AND starts_with(c_mktsegment, 'BUILD')")
def p09_like_escaped(t: Tables) -> DataFrame:
    wild = F.col("c_name").ilike("%#0000000__")
    return t.customer.where(wild & ~B.like_escaped(F.col("c_name"), "R_0") & F.col("c_mktsegment").startswith("BUILD")).select("c_custkey")


@query("WITH l AS (SELECT doc_id, CASE WHEN lang <> 'en' THEN lang END AS a, CASE WHEN doc_id % 3 > 0 THEN lang END AS b FROM documents) SELECT doc_id, a IS NOT DISTINCT FROM b AS same FROM l")
def p10_null_safe(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.when(F.col("lang") != "en", F.col("lang")).alias("a"), F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("b"))
    return rows.select("doc_id", F.col("a").eqNullSafe(F.col("b")).alias("same"))


@query("SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_tax > 0.06) AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)")
def p11_guard_chain(t: Tables) -> DataFrame:
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_tax")
    kept = t.orders.join(lines.where("l_returnflag = 'R'"), "o_orderkey", "left_semi").join(lines.where("l_tax > 0.06"), "o_orderkey", "left_anti")
    return kept.join(t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti").select("o_orderkey")


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'purchase') AND user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def p12_set_membership(t: Tables) -> DataFrame:
    rich = t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("user_id"))
    return t.events.where(F.col("event_type").isin("click", "purchase")).join(rich, "user_id", "left_semi").select("event_id")


@query("SELECT 'p_brand' AS asked, p_brand AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2 UNION ALL SELECT 'p_name; drop', NULL, count(*) FROM part")
def p16_guarded_column(t: Tables) -> DataFrame:
    """Columns asked for are counted by value if they are on the closed list; of any other only the rows are told."""
    told = []
    for asked in ("p_brand", "p_type", "p_name; drop"):
        try:
            value = F.col(B.known_column(asked, ("p_brand", "p_type")))
        except ValueError:
            value = F.lit(None).cast("string")
        told.append(t.part.groupBy(value.alias("value")).agg(F.count("*").alias("n")).select(F.lit(asked).alias("asked"), "value", "n"))
    return reduce(DataFrame.unionByName, told)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderdate >= TIMESTAMP '1995-01-01'")
def p17_hot_subset(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus = 'P' AND o_orderdate >= TIMESTAMP '1995-01-01'").select("o_orderkey")


# --- joins -----------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'")
def j01_inner(t: Tables) -> DataFrame:
    final = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t.lineitem.join(final, "l_orderkey").join(t.part, F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", "l_linenumber", "p_name")


@query("SELECT d.doc_id AS b, g.a, g.n FROM documents d JOIN (SELECT sha256(text) AS h, min(doc_id) AS a, count(DISTINCT doc_id) AS n FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) > 1) g ON sha256(d.text) = g.h")
def j05_shared_hash(t: Tables) -> DataFrame:
    """Membership stands for the pairs of a group: each document, its group's first and size."""
    hashed = t.documents.select("doc_id", F.sha2("text", 256).alias("h"))
    groups = hashed.groupBy("h").agg(F.min("doc_id").alias("a"), F.countDistinct("doc_id").alias("n")).where("n > 1")
    return hashed.join(groups, "h").select(F.col("doc_id").alias("b"), "a", "n")


@query("WITH q AS (SELECT min(o_orderdate) AS low, max(o_orderdate) AS high FROM orders) SELECT o_orderkey, round(date_diff('day', low, o_orderdate) / date_diff('day', low, high)::DOUBLE, 6) AS place FROM orders, q")
def j06_one_row_cross(t: Tables) -> DataFrame:
    span = F.broadcast(t.orders.agg(F.min("o_orderdate").alias("low"), F.max("o_orderdate").alias("high")))  # one row
    return t.orders.crossJoin(span).select("o_orderkey", F.round(F.date_diff("o_orderdate", "low") / F.date_diff("high", "low"), 6).alias("place"))


_LINKS = "l AS (SELECT l_partkey AS a, l_suppkey AS b, max(l_quantity) AS score, bool_or(l_returnflag = 'R') AS exact FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY 1, 2)"


def _links(t: Tables) -> DataFrame:
    return t.lineitem.where("l_partkey <> l_suppkey").groupBy(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).agg(F.max("l_quantity").alias("score"), F.bool_or(F.col("l_returnflag") == "R").alias("exact"))


@query(f"WITH {_LINKS} SELECT DISTINCT CASE WHEN a = 5 THEN b ELSE a END AS other FROM l WHERE a = 5 OR b = 5")
def j08_other_end(t: Tables) -> DataFrame:
    return D.links_of(_links(t), 5)


@query("SELECT l_orderkey, l_linenumber, p_name, s_name FROM lineitem LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey")
def j09_both_ends(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"), "left").join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return rows.select("l_orderkey", "l_linenumber", "p_name", "s_name")


@query("SELECT coalesce(a.k, b.k) AS k, a.n AS n_a, b.n AS n_b FROM (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) b ON a.k = b.k")
def j11_full_join(t: Tables) -> DataFrame:
    count = lambda status, n: t.orders.where(F.col("o_orderstatus") == status).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias(n))
    return count("F", "n_a").join(count("P", "n_b"), "k", "full_outer")


@query("""WITH u AS (SELECT o_custkey AS k, 0 AS p, o_orderkey AS link FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_custkey, 1, o_orderkey FROM orders WHERE o_totalprice > 250000 UNION ALL SELECT o_custkey, 2, o_orderkey FROM orders)
SELECT c_custkey, b[1]::INT AS priority, b[2]::BIGINT AS link FROM (SELECT c_custkey, min([p, link]) AS b FROM customer LEFT JOIN u ON k = c_custkey GROUP BY 1)""")
def j12_prioritised_links(t: Tables) -> DataFrame:
    part = lambda where: t.orders.where(where).select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("link"))
    best = S.first_source([part("o_orderstatus = 'P'"), part("o_totalprice > 250000"), part("true")], ["c_custkey"], "link")
    return t.customer.select("c_custkey").join(best, "c_custkey", "left").select("c_custkey", "priority", "link")


@query("SELECT l.l_orderkey, l.l_linenumber, r.n FROM lineitem l LEFT JOIN (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2) r USING (l_returnflag, l_linestatus)")
def j15_two_keys(t: Tables) -> DataFrame:
    counts = t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return t.lineitem.join(counts, ["l_returnflag", "l_linestatus"], "left").select("l_orderkey", "l_linenumber", "n")


# --- latest, orders, pages -------------------------------------------------------------------


@query("SELECT code, version, payload FROM (SELECT user_id AS code, event_id AS version, props AS payload, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def q04_latest_version(t: Tables) -> DataFrame:
    return L.first_per_key(t.events.select(F.col("user_id").alias("code"), F.col("event_id").alias("version"), F.col("props").alias("payload")), ["code"], [F.desc("version")])


@query("SELECT user_id, event_type, value >= 50 AS verdict FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def q06_latest_verdict(t: Tables) -> DataFrame:
    return L.first_per_key(t.events, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", (F.col("value") >= 50).alias("verdict"))


@query("SELECT source, id, rank FROM (SELECT event_type AS source, event_id AS id, row_number() OVER (PARTITION BY event_type ORDER BY round(value, 6) DESC, event_id)::INT AS rank FROM events) WHERE rank <= 50")
def q07_rank_in_source(t: Tables) -> DataFrame:
    """The limit on ranks also runs before the shuffle, so a source of any size sends 50 rows a task."""
    rows = t.events.select(F.col("event_type").alias("source"), F.col("event_id").alias("id"), F.round("value", 6).alias("score"))
    best = Window.partitionBy("source").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= 50).select("source", "id", "rank")


@query("WITH c AS (SELECT user_id, event_id, md5(event_id || ':' || coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id)::VARCHAR, '')) AS link FROM events) SELECT * FROM c")
def q08_previous_link(t: Tables) -> DataFrame:
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    return t.events.select("user_id", "event_id", F.md5(F.concat_ws(":", F.col("event_id").cast("string"), F.coalesce(before.cast("string"), F.lit("")))).alias("link"))


@query("SELECT p_type, p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_size, -p_retailprice, p_name, p_partkey) AS k FROM part) WHERE k = 1")
def q09_best_candidate(t: Tables) -> DataFrame:
    return L.first_per_key(t.part, ["p_type"], [F.asc("p_size"), -F.col("p_retailprice"), F.asc("p_name"), F.asc("p_partkey")]).select("p_type", "p_partkey", "p_name")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 100")
def o01_source_depth(t: Tables) -> DataFrame:
    return t.customer.orderBy(F.desc("c_acctbal"), "c_custkey").limit(R.depth(20, 20)).select("c_custkey", "c_acctbal")


@query("SELECT c_custkey, (SELECT count(*) FROM customer) > 60 AS has_more FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 40")
def o02_page_has_more(t: Tables) -> DataFrame:
    more = L.page(t.customer, [F.asc("c_custkey")], 60, 1).agg((F.count("*") > 0).alias("has_more"))
    return L.page(t.customer, [F.asc("c_custkey")], 40, 20).select("c_custkey").crossJoin(F.broadcast(more))


@query("WITH s AS (SELECT doc_id, min(quality) AS least FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1) SELECT doc_id, least FROM s ORDER BY least NULLS LAST, doc_id LIMIT 40")
def o03_nulls_last(t: Tables) -> DataFrame:
    scored = t.documents.join(t.labels, "doc_id", "left").groupBy("doc_id").agg(F.min("quality").alias("least"))
    return L.page(scored, [F.asc_nulls_last("least"), F.asc("doc_id")], 0, 40)


@query("SELECT p_partkey, round(least(abs(p_size - 12.5), abs(p_retailprice - 912.5)), 6) AS distance FROM part ORDER BY distance, p_partkey LIMIT 25")
def o06_nearest_first(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.round(F.least(F.abs(F.col("p_size") - 12.5), F.abs(F.col("p_retailprice") - 912.5)), 6).alias("distance"))
    return L.page(rows, [F.asc_nulls_last("distance"), F.asc("p_partkey")], 0, 25)


@query("SELECT axis, value, n FROM (SELECT 'o_custkey' AS axis, o_custkey::VARCHAR AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_custkey::VARCHAR) AS k FROM orders GROUP BY o_custkey) WHERE k <= 20")
def o07_facet_top(t: Tables) -> DataFrame:
    return R.facets(t.orders, ["o_custkey"], {})


@query("SELECT value, nature, rank, score FROM (SELECT n_name AS value, 'nation' AS nature, 2 AS rank, round(0.70 + 0.25 / length(n_name), 6)::DOUBLE AS score FROM nation) ORDER BY rank, score DESC, lower(value), nature LIMIT 12")
def o08_suggestion_order(t: Tables) -> DataFrame:
    found = t.nation.select(F.col("n_name").alias("value"), F.lit("nation").alias("nature"), F.lit(2).alias("rank"), F.round(0.70 + 0.25 / F.length("n_name"), 6).alias("score"))
    return L.page(found, [F.asc("rank"), F.desc("score"), F.lower("value").asc(), F.asc("nature")], 0, 12)


@query(f"WITH {_LINKS} SELECT a, b, exact, score FROM l ORDER BY exact DESC, score DESC, a, b LIMIT 60")
def o09_exact_first(t: Tables) -> DataFrame:
    return L.page(_links(t), [F.desc("exact"), F.desc("score"), F.asc("a"), F.asc("b")], 0, 60).select("a", "b", "exact", "score")


@query("SELECT event_id, round(value, 6) AS confidence FROM events WHERE event_id NOT IN (SELECT doc_id FROM labels) ORDER BY round(value, 6), event_id LIMIT 30")
def o11_least_confident(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.round("value", 6).alias("confidence"))
    return S.to_review(rows, t.labels.select(F.col("doc_id").alias("event_id")), "event_id", "confidence", 30)


@query("SELECT 'order' AS kind, o_orderkey AS id FROM orders UNION ALL SELECT 'event', event_id FROM events UNION ALL SELECT 'doc', doc_id FROM documents")
def u02_union_all(t: Tables) -> DataFrame:
    part = lambda kind, df, key: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"))
    return part("order", t.orders, "o_orderkey").unionByName(part("event", t.events, "event_id")).unionByName(part("doc", t.documents, "doc_id"))


# --- listings --------------------------------------------------------------------------------


@query("SELECT o_orderkey, c_name, o_orderstatus, l.n AS lines, l.traces FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n, string_agg(l_linenumber || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS traces FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey")
def l07_sheet_detail(t: Tables) -> DataFrame:
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("field"), F.col("l_returnflag").alias("value"))
    owners = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return S.detail(t.orders.join(owners, "o_custkey", "left"), "o_orderkey", lines).select("o_orderkey", "c_name", "o_orderstatus", "lines", "traces")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 5")
def l07_history(t: Tables) -> DataFrame:
    return L.first_per_key(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id", "event_type")


@query("SELECT kind, label, n FROM (SELECT 'status' AS kind, o_orderstatus AS label, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'total', 'all', count(*) FROM orders UNION ALL SELECT 'page', o_orderkey::VARCHAR, 1 FROM (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 20))")
def l08_list_with_facet(t: Tables) -> DataFrame:
    return S.list_with_facet(t.orders, "o_orderkey", "o_orderstatus", [F.desc_nulls_last("o_orderdate"), F.asc("o_orderkey")], 20, 20)


@query("SELECT source, lang, count(*) AS n, count(lang) AS with_lang, count(quality) AS with_quality FROM documents LEFT JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((source), (lang))")
def l12_counters(t: Tables) -> DataFrame:
    return S.counters(t.documents.join(t.labels, "doc_id", "left"), ["source", "lang"], {"with_lang": "lang", "with_quality": "quality"})


@query("""WITH a AS (SELECT p_partkey, (CASE WHEN p_name IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN p_brand <> 'Brand#1' THEN 1 ELSE 0 END + CASE WHEN p_size > 10 THEN 1 ELSE 0 END) AS filled FROM part)
SELECT p_partkey, round(filled / 3.0, 3)::DOUBLE AS presence, CASE WHEN filled = 3 THEN 'complete' WHEN filled = 0 THEN 'empty' ELSE 'partial' END AS state FROM a""")
def l15_accessory_presence(t: Tables) -> DataFrame:
    known = [F.col("p_name"), F.when(F.col("p_brand") != "Brand#1", F.col("p_brand")), F.when(F.col("p_size") > 10, F.col("p_size"))]
    return t.part.select("p_partkey", *S.presence(known))


@query("""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS pos FROM documents), f(field, anchor, strong) AS (VALUES ('license', 'license', true), ('owner', 'the', false), ('none', 'zzzz', true)),
h AS (SELECT field, strong, doc_id, min(pos) AS place FROM w JOIN f ON lower(word) = anchor GROUP BY 1, 2, 3)
SELECT d.doc_id, f.field, h.place, CASE WHEN h.place IS NULL THEN 0.0 WHEN f.strong THEN 0.9 ELSE 0.6 END::DOUBLE AS confidence FROM documents d CROSS JOIN f LEFT JOIN h ON h.doc_id = d.doc_id AND h.field = f.field""")
def l16_draft_template(t: Tables) -> DataFrame:
    words = t.documents.select("doc_id", F.posexplode(F.split("text", " ")).alias("place", "word")).withColumn("place", F.col("place").cast("long") + 1)
    return S.draft_template(t.documents, words, "doc_id", [("license", "license", True), ("owner", "the", False), ("none", "zzzz", True)])


@query("SELECT event_type AS nature, CASE WHEN value >= 66 THEN 'agree' WHEN value >= 33 THEN 'differ' ELSE 'only_a' END AS status, count(*) AS n FROM events GROUP BY 1, 2")
def l18_verification_counts(t: Tables) -> DataFrame:
    status = F.when(F.col("value") >= 66, "agree").when(F.col("value") >= 33, "differ").otherwise("only_a")
    return t.events.groupBy(F.col("event_type").alias("nature"), status.alias("status")).agg(F.count("*").alias("n"))


@query("SELECT source, CASE WHEN bool_or(quality IS NULL) THEN 'waiting' WHEN bool_and(quality = 1) THEN 'deposited' ELSE 'refused' END AS outcome, count(*) AS files FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def l21_deposit_outcomes(t: Tables) -> DataFrame:
    return S.deposit_outcomes(t.documents.join(t.labels, "doc_id", "left"), "source", F.col("quality"))


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'P' AND date_diff('day', o_orderdate, TIMESTAMP '1998-08-02') > 365 THEN 'expired' ELSE 'kept' END AS state FROM orders WHERE o_totalprice > 100000 ORDER BY o_orderdate, o_orderkey LIMIT 50")
def l22_approval_queue(t: Tables) -> DataFrame:
    return S.approval_queue(t.orders.where("o_totalprice > 100000"), "o_orderkey", "o_orderstatus", "o_orderdate", F.lit("1998-08-02").cast("timestamp"), "P", 365, 50)


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%re%' OR p_brand ILIKE '%re%' OR p_type ILIKE '%re%' ORDER BY p_partkey LIMIT 30 OFFSET 10")
def l23_search_columns(t: Tables) -> DataFrame:
    return L.page(t.part.where(B.any_like(["p_name", "p_brand", "p_type"], "rE")), [F.asc("p_partkey")], 10, 30).select("p_partkey", "p_name")
