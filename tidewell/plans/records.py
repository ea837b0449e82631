"""Records: latest per key, sets, joins, duplicates, comparison, confidence, rules, models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import compare as K
from ..operators import confidence as C
from ..operators import dedup as D
from ..operators import latest as L
from ..operators import ml as M
from ..operators import rules as U
from .registry import Tables, query


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def q03_latest_per_key(t: Tables) -> DataFrame:
    return L.first_per_key(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT user_id, arg_max(event_type, (value, ts, event_id)) AS event_type FROM events GROUP BY 1")
def q10_best_trace(t: Tables) -> DataFrame:
    return L.best_trace(t.events, ["user_id"], "event_type", F.col("value"), F.col("ts"), F.col("event_id"))


@query("SELECT o_custkey, max(o_orderkey) + 1 AS next_version FROM orders GROUP BY 1")
def q05_next_version(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg((F.max("o_orderkey") + 1).alias("next_version"))


@query("SELECT c_custkey, c_name, (SELECT count(*) FROM customer) AS total FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 20 OFFSET 40")
def q01_page_with_total(t: Tables) -> DataFrame:
    rows = L.page(t.customer, [F.desc_nulls_last("c_acctbal"), F.asc("c_custkey")], 40, 20).select("c_custkey", "c_name")
    return rows.crossJoin(t.customer.agg(F.count("*").alias("total")))


@query("WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS b FROM customer) SELECT c_custkey, b FROM c ORDER BY b DESC NULLS FIRST, c_custkey LIMIT 30")
def o04_sort_nulls_first(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("b"))
    orders = {"relevance": [F.asc("c_custkey")], "balance": [F.desc_nulls_first("b"), F.asc("c_custkey")]}
    return L.page(rows, L.sort_columns("balance", orders, "relevance"), 0, 30)


@query("SELECT c_custkey, list_position([42, 7, 99], c_custkey)::BIGINT AS place FROM customer WHERE c_custkey IN (42, 7, 99)")
def o05_order_by_position(t: Tables) -> DataFrame:
    return L.by_given_order(t.customer, "c_custkey", [42, 7, 99]).select("c_custkey", F.col("place").cast("long").alias("place"))


@query("SELECT c_custkey AS k FROM customer UNION SELECT o_custkey FROM orders")
def u01_union_distinct(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("k")).union(t.orders.select("o_custkey")).distinct()


@query("(SELECT 'both' AS kind, count(*) AS n FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)) UNION ALL (SELECT 'idle', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders))")
def u04_setops_intersect_except(t: Tables) -> DataFrame:
    a, b = t.customer.select("c_custkey"), t.orders.select("o_custkey")
    count = lambda kind, df: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return count("both", a.intersect(b)).unionByName(count("idle", a.exceptAll(b.distinct())))


@query("SELECT n_name, r_name, count(o_orderkey) AS orders, round(sum(o_totalprice), 2) AS total FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1, 2")
def j02_star_left_joins(t: Tables) -> DataFrame:
    # dimensions are joined unhinted: adaptive execution broadcasts what is measured to be small
    final = t.orders.where("o_orderstatus = 'F'")
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(final, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.groupBy("n_name", "r_name").agg(F.count("o_orderkey").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE lower(s_name) END AS source FROM supplier)
SELECT DISTINCT s.s_suppkey AS id, x.s_suppkey AS found FROM s JOIN supplier x ON s.source = x.s_name OR s.source = lower(x.s_name)""")
def j07_or_join(t: Tables) -> DataFrame:
    source = F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise(F.lower("s_name"))
    a = t.supplier.select(F.col("s_suppkey").alias("id"), source.alias("k"))
    b = t.supplier.select(F.col("s_suppkey").alias("found"), F.col("s_name").alias("k"))
    c = t.supplier.select(F.col("s_suppkey").alias("found"), F.lower("s_name").alias("k"))
    return a.join(b, "k").select("id", "found").union(a.join(c, "k").select("id", "found")).distinct()


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) AS has_large FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def j10_semi_anti(t: Tables) -> DataFrame:
    rows = t.customer.join(t.orders.where("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")
    large = t.orders.where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("large")).distinct()
    return rows.join(large, "c_custkey", "left").select("c_custkey", F.coalesce("large", F.lit(False)).alias("has_large"))


@query("SELECT p_partkey, w.at - 1 AS rank, w.word FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) AS at FROM part) w")
def j13_lateral_elements(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("rank", "word")).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS most FROM customer")
def j14_scalar_subqueries(t: Tables) -> DataFrame:
    counts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("most"))
    return t.customer.join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), "most")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O') AND year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders) AND contains(lower(o_orderpriority), 'urgent')")
def p01_dynamic_filters(t: Tables) -> DataFrame:
    newest = t.orders.agg(F.max(F.year("o_orderdate")).alias("newest"))
    kept = t.orders.where(F.col("o_orderstatus").isin("F", "O") & F.contains(T.title_key(F.col("o_orderpriority")), F.lit("urgent")))
    return kept.join(F.broadcast(newest), F.year("o_orderdate") == F.col("newest")).select("o_orderkey", "o_totalprice")


_DUPES = "SELECT sha256(text) AS h, min(doc_id) AS a, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1"


@query(f"SELECT g.a, d.doc_id AS b FROM documents d JOIN ({_DUPES}) g ON sha256(d.text) = g.h WHERE d.doc_id <> g.a")
def x15_dup_links(t: Tables) -> DataFrame:
    return D.exact_links(t.documents.select("doc_id", F.sha2("text", 256).alias("h")), "doc_id", "h")


@query("SELECT sha256(text) AS h, count(DISTINCT doc_id) AS n, (count(DISTINCT doc_id) * (count(DISTINCT doc_id) - 1) / 2)::BIGINT AS pairs FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) > 1")
def x15_clique_sizes(t: Tables) -> DataFrame:
    return D.clique_sizes(t.documents.select("doc_id", F.sha2("text", 256).alias("h")), "doc_id", "h")


_T = "list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w)::BIGINT + 2), lambda i: substr('  ' || w || ' ', i::BIGINT, 3)))))"


_TITLE = "lower(p_name || ' ' || p_brand)"


@query(f"""WITH g AS (SELECT p_partkey AS k, p_brand, p_type, {_TITLE} AS n, {_T.replace('lower(p_name)', _TITLE)} AS g FROM part WHERE p_partkey IS NOT NULL AND p_name IS NOT NULL),
p AS (SELECT x.n AS n1, y.n AS n2, x.k AS k1, y.k AS k2, x.p_brand IS NOT DISTINCT FROM y.p_brand AS b, x.p_type IS NOT DISTINCT FROM y.p_type AS t, round(len(list_intersect(x.g, y.g)) / (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g)))::DOUBLE, 6) AS score FROM g x JOIN g y ON x.k < y.k AND x.p_type <= 'Z')
SELECT least(min(CASE WHEN n1 <= n2 THEN k1 ELSE k2 END), min(CASE WHEN n1 <= n2 THEN k2 ELSE k1 END)) AS a, CASE WHEN n1 = n2 THEN max(k2) ELSE greatest(min(CASE WHEN n1 <= n2 THEN k1 ELSE k2 END), min(CASE WHEN n1 <= n2 THEN k2 ELSE k1 END)) END AS b,
score, count(*) AS pairs, count(*) FILTER (WHERE b) AS same_p_brand, count(*) FILTER (WHERE t) AS same_p_type FROM p WHERE score >= 0.8 GROUP BY least(n1, n2), greatest(n1, n2), n1 = n2, score""")
def x16_near_dup_pairs(t: Tables) -> DataFrame:
    return D.near_classes(t.part.withColumn("title", F.concat_ws(" ", "p_name", "p_brand")), "p_partkey", "title", ["p_brand", "p_type"], 0.8)


@query(f"""WITH g AS (SELECT p_partkey, lower(p_name) AS title, p_brand, p_type FROM part WHERE p_partkey IS NOT NULL AND len({_T}) > 0)
SELECT p_partkey, title, min(p_partkey) OVER (PARTITION BY title) AS first, count(*) OVER (PARTITION BY title) AS n, p_brand, p_type FROM g""")
def x16_title_classes(t: Tables) -> DataFrame:
    return D.title_classes(t.part, "p_partkey", "p_name", ["p_brand", "p_type"])


@query("WITH f AS (SELECT lower(p_name) AS n, p_brand, min(p_partkey) AS a FROM part GROUP BY 1, 2 HAVING count(*) > 1) SELECT a, p_partkey AS b FROM part JOIN f ON lower(p_name) = n AND part.p_brand IS NOT DISTINCT FROM f.p_brand WHERE p_partkey <> a")
def j04_same_context_pairs(t: Tables) -> DataFrame:
    return D.same_context_pairs(t.part, "p_partkey", "p_name", ["p_brand"])


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS id, n_nationkey - 3 AS into_ FROM nation WHERE n_nationkey >= 3), c AS (SELECT n_nationkey AS id, n_nationkey AS place FROM nation UNION ALL SELECT c.id, e.into_ FROM c JOIN e ON c.place = e.id)
SELECT id, min(place) AS final FROM c GROUP BY 1""")
def d10_merge_chain(t: Tables) -> DataFrame:
    nodes = t.nation.select(F.col("n_nationkey").alias("id"))
    edges = nodes.where("id >= 3").select("id", (F.col("id") - 3).alias("into"))
    return D.final_of_chain(edges, nodes)


_DIMS = ("p_size", "p_retailprice", "extra")


@query("""WITH r AS (SELECT p_partkey, p_size::DOUBLE AS p_size, p_retailprice, CASE WHEN p_partkey % 3 <> 0 THEN p_size * 1.5 END::DOUBLE AS extra FROM part), p AS (SELECT p_partkey AS a, p_partkey + 1 AS b FROM part),
l AS (SELECT p_partkey, dim, value FROM r UNPIVOT INCLUDE NULLS (value FOR dim IN (p_size, p_retailprice, extra)))
SELECT a, b, x.dim, x.value AS value_a, y.value AS value_b, round(y.value - x.value, 3) AS delta, round((y.value - x.value) / nullif(abs(x.value), 0) * 100, 2) AS percent,
CASE WHEN x.value IS NULL AND y.value IS NULL THEN 'missing' WHEN x.value IS NULL THEN 'only_b' WHEN y.value IS NULL THEN 'only_a' WHEN y.value = x.value THEN 'equal' ELSE 'different' END AS state
FROM p JOIN l x ON x.p_partkey = a JOIN l y ON y.p_partkey = b AND y.dim = x.dim""")
def x19_compare_pair(t: Tables) -> DataFrame:
    records = t.part.withColumn("extra", F.when(F.col("p_partkey") % 3 != 0, F.col("p_size") * 1.5))
    pairs = t.part.select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"))
    return K.compare_pairs(pairs, records, "p_partkey", _DIMS)


@query("""WITH r AS (SELECT p_partkey, p_brand, p_size::DOUBLE AS p_size, p_retailprice, p_partkey = min(p_partkey) OVER (PARTITION BY p_brand) AS ref FROM part), l AS (SELECT p_brand, ref, dim, value FROM r UNPIVOT INCLUDE NULLS (value FOR dim IN (p_size, p_retailprice))),
b AS (SELECT p_brand, dim, max(value) AS base FROM l WHERE ref GROUP BY 1, 2)
SELECT l.p_brand, l.dim, count(value) AS n, min(value) AS least, max(value) AS most, coalesce(min(value) = max(value), false) AS identical, round(max(abs(value - base) / nullif(abs(base), 0) * 100), 2) AS max_gap FROM l LEFT JOIN b ON l.p_brand = b.p_brand AND l.dim = b.dim GROUP BY 1, 2""")
def x20_compare_nway(t: Tables) -> DataFrame:
    firsts = t.part.groupBy("p_brand").agg(F.min("p_partkey").alias("first"))
    return K.compare_many(t.part.join(firsts, "p_brand"), "p_brand", "p_partkey", F.col("p_partkey") == F.col("first"), ("p_size", "p_retailprice"))


@query("""WITH r AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 3 <> 0 THEN p_size END AS a, CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice END AS b FROM part), o AS (SELECT * FROM r WHERE p_partkey = 10)
SELECT r.p_partkey, (CASE WHEN r.a IS NOT NULL AND o.a IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN r.b IS NOT NULL AND o.b IS NOT NULL THEN 1 ELSE 0 END)::INT AS common FROM r JOIN o ON r.p_brand IS NOT DISTINCT FROM o.p_brand WHERE r.p_partkey <> 10""")
def x21_comparable(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 3 != 0, F.col("p_size")).alias("a"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_retailprice")).alias("b"))
    return K.comparable(rows, "p_partkey", ["p_brand"], ["a", "b"], 10)


@query("""WITH r AS (SELECT p_brand, p_type, p_partkey, p_size::DOUBLE AS p_size, p_retailprice FROM part), l AS (SELECT p_brand, p_type, p_partkey, dim, value AS v FROM r UNPIVOT INCLUDE NULLS (value FOR dim IN (p_size, p_retailprice))),
q AS (SELECT p_brand, p_type, dim, count(v) AS n, quantile_cont(v, 0.5) AS m, round_even(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 3) AS iqr FROM l GROUP BY 1, 2, 3),
d AS (SELECT l.p_brand, l.p_type, l.dim, round_even(quantile_cont(abs(v - m), 0.5), 3) AS mad FROM l JOIN q ON l.p_brand = q.p_brand AND l.p_type = q.p_type AND l.dim = q.dim WHERE v IS NOT NULL GROUP BY 1, 2, 3),
s AS (SELECT l.*, round_even(m, 3) AS m, iqr, mad, n, CASE WHEN iqr > 0 THEN iqr / 1.349 WHEN mad > 0 THEN mad * 1.4826 ELSE 0 END AS s FROM l JOIN q ON l.p_brand = q.p_brand AND l.p_type = q.p_type AND l.dim = q.dim JOIN d ON d.p_brand = q.p_brand AND d.p_type = q.p_type AND d.dim = q.dim),
t AS (SELECT p_brand, p_type, p_partkey, n >= 3 AS common, n >= 3 AND CASE WHEN m = 0 THEN iqr > 0 ELSE iqr / nullif(abs(m), 0) > 0.075 END AS mixed,
CASE WHEN n >= 3 AND v IS NOT NULL THEN round_even(CASE WHEN s > 0 THEN exp(-0.5 * pow(abs(v - m) / nullif(s, 0), 2)) * 100 WHEN v = m THEN 100 ELSE greatest(0, least(100, (1 - abs(v - m) / CASE WHEN m = 0 THEN 1 ELSE abs(m) END / 0.10) * 100)) END, 1) END AS score FROM s),
g AS (SELECT p_brand, p_type, p_partkey, count(*) FILTER (WHERE common) AS common, count(*) FILTER (WHERE mixed) AS mixed, count(score) AS scored, round_even(quantile_cont(score, 0.5), 1) AS middle FROM t GROUP BY 1, 2, 3),
v AS (SELECT g.*, n_population, CASE WHEN n_population < 5 THEN 'insufficient' WHEN common > 0 AND 2 * mixed >= common THEN 'heterogeneous' WHEN scored < 2 THEN 'insufficient' WHEN middle >= 75 THEN 'compatible' ELSE 'to_examine' END AS verdict
FROM g JOIN (SELECT p_brand, p_type, count(*) AS n_population FROM part GROUP BY 1, 2) USING (p_brand, p_type))
SELECT p_brand, p_type, p_partkey, n_population, CASE WHEN verdict IN ('compatible', 'to_examine') THEN middle END AS score, verdict FROM v""")
def x22_reuse_confidence(t: Tables) -> DataFrame:
    return C.reuse_confidence(t.part.withColumn("p_size", F.col("p_size").cast("double")), ["p_brand", "p_type"], "p_partkey", ["p_size", "p_retailprice"])


_PRICE = "l_extendedprice / nullif(l_quantity, 0)"


@query(f"""SELECT l_orderkey, l_linenumber, code, severity FROM (SELECT l_orderkey, l_linenumber, unnest(['quantity_range', 'price_ratio', 'order_of_dates', 'discount_above_tax']) AS code, unnest(['blocking', 'warning', 'blocking', 'warning']) AS severity,
unnest([l_quantity < 2 OR l_quantity > 48, {_PRICE} < 1000 OR {_PRICE} > 2000, l_shipdate < o_orderdate, l_discount > l_tax]) AS broken FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey) WHERE broken""")
def x06_anomalies(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"), "left").withColumn("ratio", F.try_divide("l_extendedprice", "l_quantity")).withColumn("line", F.struct("l_orderkey", "l_linenumber"))
    rules = [("quantity_range", "blocking", U.out_of_range("l_quantity", 2, 48)), ("price_ratio", "warning", U.out_of_range("ratio", 1000, 2000)), ("order_of_dates", "blocking", F.col("l_shipdate") < F.col("o_orderdate")), ("discount_above_tax", "warning", F.col("l_discount") > F.col("l_tax"))]
    return U.anomalies(rows, "line", rules).select("line.l_orderkey", "line.l_linenumber", "code", "severity")


@query("""WITH g AS (SELECT l_orderkey, count(*) FILTER (WHERE l_quantity > 48) AS n, count(*) FILTER (WHERE l_discount > 0.08) AS below, 4 - count(*) AS missing FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' OR coalesce(o_totalprice > 400000, false) THEN 'full_revision' WHEN coalesce(n, 0) > 0 THEN 'targeted_review' WHEN coalesce(missing, 4) >= 3 THEN 'full_revision' WHEN coalesce(below, 0) > 0 THEN 'targeted_review' ELSE 'straight_through' END AS route,
coalesce((o_totalprice % 100) / 100 > 0.9 AND NOT o_totalprice > 400000, false) AS validated FROM orders LEFT JOIN g ON o_orderkey = l_orderkey""")
def x10_routing(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count_if(F.col("l_quantity") > 48).alias("n"), F.count_if(F.col("l_discount") > 0.08).alias("below"), (4 - F.count("*")).alias("missing"))
    rows = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    blocking = F.coalesce(F.col("o_totalprice") > 400000, F.lit(False))
    route = U.routing(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")), blocking, F.coalesce("n", F.lit(0)), F.coalesce("missing", F.lit(4)), F.coalesce("below", F.lit(0)))
    return rows.select("o_orderkey", route.alias("route"), U.auto_validation(F.col("o_totalprice") % 100 / 100, blocking).alias("validated"))


@query("""WITH c AS (SELECT doc_id, (contains(text, ' the '))::INT + (contains(text, ' and '))::INT + (contains(text, ' of '))::INT AS en, (contains(text, ' les '))::INT + (contains(text, ' pour '))::INT AS fr, (contains(text, ' der '))::INT + (contains(text, ' und '))::INT AS de FROM documents)
SELECT doc_id, CASE WHEN greatest(en, fr, de) = 0 THEN NULL WHEN en = greatest(en, fr, de) THEN 'en' WHEN fr = greatest(en, fr, de) THEN 'fr' ELSE 'de' END AS template, greatest(en, fr, de) AS anchors FROM c""")
def x02_detect_template(t: Tables) -> DataFrame:
    return U.detect_template(t.documents, "doc_id", F.col("text"), [("en", (" the ", " and ", " of ")), ("fr", (" les ", " pour ")), ("de", (" der ", " und "))])


@query("""WITH w AS (SELECT l_orderkey AS page, l_linenumber AS x0, l_quantity AS top, l_returnflag AS text FROM lineitem), g AS (SELECT *, coalesce(top - lag(top) OVER (PARTITION BY page ORDER BY top, x0), 0) > 2.5 AS gap FROM w),
n AS (SELECT *, sum(gap::INT) OVER (PARTITION BY page ORDER BY top, x0 ROWS UNBOUNDED PRECEDING) AS line FROM g) SELECT page, line::BIGINT AS line, string_agg(text, ' ' ORDER BY x0, text) AS text, min(top) AS top FROM n GROUP BY 1, 2""")
def x01_words_to_lines(t: Tables) -> DataFrame:
    return U.words_to_lines(t.lineitem.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("x0"), F.col("l_quantity").alias("top"), F.col("l_returnflag").alias("text")), "page")


@query("""SELECT c_custkey, CASE WHEN e IS NOT NULL AND s IS NOT NULL AND e <> s OR e IS NULL AND a IS NOT NULL AND s IS NOT NULL AND a <> s THEN 'ambiguous' WHEN e IS NOT NULL THEN 'exact' WHEN a IS NOT NULL THEN 'alias' WHEN s IS NOT NULL THEN 'sheet' WHEN c_nationkey > 12 THEN 'ambiguous' ELSE 'none' END AS link
FROM (SELECT *, CASE WHEN c_custkey % 2 = 0 THEN 1 END AS e, CASE WHEN c_custkey % 3 = 0 THEN 2 END AS a, CASE WHEN c_custkey % 5 = 0 THEN 2 END AS s FROM customer)""")
def x13_linkage_tiers(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t.customer.select("c_custkey", U.linkage(F.when(k % 2 == 0, 1), F.when(k % 3 == 0, 2), F.when(k % 5 == 0, 2), F.greatest(F.col("c_nationkey") - 12, F.lit(0))).alias("link"))


@query("""SELECT l_shipmode AS family, raw, corrected, occurrences, place FROM (SELECT *, row_number() OVER (PARTITION BY l_shipmode, raw ORDER BY occurrences DESC, corrected)::INT AS place FROM
(SELECT l_returnflag AS l_shipmode, l_linestatus AS raw, l_linenumber AS corrected, count(*) AS occurrences FROM lineitem GROUP BY 1, 2, 3)) WHERE place <= 3""")
def x14_learned_corrections(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_returnflag").alias("family"), F.col("l_linestatus").alias("raw"), F.col("l_linenumber").alias("corrected"))
    return U.learned_corrections(rows, ["family"], "raw", "corrected")


@query("""WITH w AS (SELECT event_id, regexp_extract(props, 'k"?\\s*[:=]?\\s*([0-9]+)', 1) AS v FROM events) SELECT event_id, 'k"' AS label, v AS value FROM w WHERE v <> ''""")
def x03_labelled_values(t: Tables) -> DataFrame:
    found = U.labelled_values(t.events, "event_id", "props", [('k"', "[0-9]+")])
    return found.select("event_id", "label", "value")


@query("""WITH a AS (SELECT l_orderkey AS k, l_linenumber AS label, l_quantity AS v FROM lineitem WHERE l_linenumber % 4 <> 0), b AS (SELECT l_orderkey AS k, l_linenumber AS label, CASE WHEN l_linenumber = 2 THEN l_quantity * 1.05 ELSE l_quantity END AS v FROM lineitem WHERE l_linenumber % 5 <> 0)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.label, b.label) AS label, CASE WHEN a.v IS NULL THEN 'only_b' WHEN b.v IS NULL THEN 'only_a' WHEN abs(a.v - b.v) <= greatest(0.005, 0.01 * abs(a.v)) THEN 'agree' ELSE 'differ' END AS state FROM a FULL JOIN b ON a.k = b.k AND a.label = b.label""")
def x09_double_reading(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("label"), F.col("l_quantity").alias("value"))
    b = rows.where("label % 5 <> 0").withColumn("value", F.when(F.col("label") == 2, F.col("value") * 1.05).otherwise(F.col("value")))
    return U.readings_agree(rows.where("label % 4 <> 0"), b, "k", 0.01).select("k", "label", "state")


@query("""WITH n AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM n GROUP BY 1, 2), c AS (SELECT label AS c, list(m ORDER BY i) AS v FROM m GROUP BY 1),
s AS (SELECT vec_id, c, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS s FROM embeddings, c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, c) AS k FROM s)
SELECT vec_id, max(c) FILTER (WHERE k = 1) AS predicted, max(s) AS score, round(max(s) - min(s), 6) AS margin FROM r WHERE k <= 2 GROUP BY 1""")
def x29_classifier_centroid(t: Tables) -> DataFrame:
    return M.classify(t.embeddings, "vec_id", "embedding", M.centroids(t.embeddings, "label", "embedding"))


@query("""SELECT count(*) AS n, round(avg((CASE WHEN contains(text, ' the ') THEN 'en' WHEN contains(text, ' les ') OR contains(text, ' une ') THEN 'fr' WHEN contains(text, ' der ') THEN 'de' ELSE 'es' END = lang)::INT), 6) AS rules, round(avg((lang = 'en')::INT), 6) AS constant FROM documents""")
def x30_rules_accuracy(t: Tables) -> DataFrame:
    guess = M.keyword_rules(F.col("text"), [("en", [" the "]), ("fr", [" les ", " une "]), ("de", [" der "])], "es")
    return M.accuracy(t.documents, F.col("lang"), ("rules", guess), ("constant", F.lit("en")))


@query("""WITH w AS (SELECT p_partkey, regexp_replace(regexp_replace(w, '^[.,;:!?()\\[\\]«»"'']+', ''), '[.,;:!?()\\[\\]«»"'']+$', '') AS w FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w FROM part)),
h AS (SELECT p_partkey, length(w) AS n, md5(w) AS h FROM w WHERE w <> ''),
s AS (SELECT p_partkey, (('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::BIGINT % 384) AS place, sum(CASE WHEN ('0x' || substr(h, 9, 2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END * (1 + ln(1 + n) * 0.1)) AS weight FROM h GROUP BY 1, 2)
SELECT p_partkey, place, round(weight / nullif(sqrt(sum(weight * weight) OVER (PARTITION BY p_partkey)), 0), 6) AS weight FROM s""")
def x27_hashing_encoder(t: Tables) -> DataFrame:
    return M.hashed_terms(t.part, "p_partkey", F.col("p_name")).withColumn("weight", F.round("weight", 6))
