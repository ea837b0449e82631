"""Workflow, queue and write operators on the driver tables (M, T, W, A, X and R rows of the survey)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assistant as A
from ..operators import chains as B
from ..operators import confidence as C
from ..operators import dedup as D
from ..operators import families as Y
from ..operators import ml as M
from ..operators import quality as Q
from ..operators import rules as U
from ..operators import search as H
from ..operators import training as R
from ..operators import workflow as K
from ..sources import merge as W
from ..storage import kept
from ..streaming import jobs as J
from .registry import Tables, query
from .search import tokens_sql

# --- writes ----------------------------------------------------------------------------------


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_totalprice > 150000 THEN coalesce(CASE WHEN o_totalprice > 250000 THEN 'new' END, o_orderpriority) ELSE o_orderpriority END AS o_orderpriority FROM orders")
def w05_upsert_keep_old(t: Tables) -> DataFrame:
    target = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")
    source = t.orders.where("o_totalprice > 150000").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.when(F.col("o_totalprice") > 250000, "new").alias("o_orderpriority"))
    return W.upsert(target, source, ["o_orderkey"], keep_old=True)


@query("SELECT l_orderkey AS record, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1)::INT AS rank, l_partkey, l_quantity FROM lineitem")
def w08_explode_record(t: Tables) -> DataFrame:
    parts = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")))  # the lines of one order
    nested = t.lineitem.groupBy(F.col("l_orderkey").alias("record")).agg(parts.alias("lines"))
    return W.explode_record(nested, "record", ["lines"])["lines"].select("record", "rank", "l_partkey", "l_quantity")


@query("""SELECT p_partkey, md5(p_brand || ' ' || p_name) AS a, md5(coalesce(l.told, '')) AS b FROM part LEFT JOIN (SELECT l_partkey, string_agg(DISTINCT l_returnflag, ' ' ORDER BY l_returnflag) AS told FROM lineitem GROUP BY 1) l ON l_partkey = p_partkey""")
def w10_refresh_search_text(t: Tables) -> DataFrame:
    children = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.array_join(F.sort_array(F.collect_set("l_returnflag")), " ").alias("told"))
    rows = t.part.join(children, "p_partkey", "left")
    text = H.search_text(rows, "p_partkey", F.col("p_brand"), F.col("p_name"), [F.col("told")], F.lit(None).cast("string"), [])
    return text.select("p_partkey", F.md5("a").alias("a"), F.md5("b").alias("b"))


@query(f"""WITH w AS (SELECT p_partkey, unnest(string_split(lower(CASE WHEN p_partkey % 3 = 0 THEN p_name || ' before' ELSE p_name END), ' ')) AS w FROM part), h AS (SELECT p_partkey, md5(w) AS m, 1.0 + ln(1 + length(w)) * 0.1 AS weight FROM w WHERE w <> ''),
b AS (SELECT p_partkey, weight, (('0x' || m[1:2])::INT + ('0x' || m[3:4])::INT * 256 + ('0x' || m[5:6])::INT * 65536 + ('0x' || m[7:8])::BIGINT * 16777216) % 16 AS place, CASE WHEN ('0x' || m[9:10])::INT % 2 = 0 THEN 1.0 ELSE -1.0 END AS sign FROM h),
s AS (SELECT p_partkey, place, sum(sign * weight) AS v FROM b GROUP BY 1, 2), n AS (SELECT p_partkey, sqrt(sum(v * v)) AS norm FROM s GROUP BY 1)
SELECT s.p_partkey, place, round(CASE WHEN norm > 0 THEN v / norm END, 6) AS weight FROM s JOIN n USING (p_partkey)""")
def w11_vector_backfill(t: Tables) -> DataFrame:
    """Only rows without a vector are encoded: a third have one, of an older name, and keep it."""
    stored = kept(M.hashed_terms(t.part.where("p_partkey % 3 = 0"), "p_partkey", F.concat("p_name", F.lit(" before")), 16))
    missing = t.part.join(stored.select("p_partkey").distinct(), "p_partkey", "left_anti")
    return stored.unionByName(M.hashed_terms(missing, "p_partkey", F.col("p_name"), 16)).select("p_partkey", "place", F.round("weight", 6).alias("weight"))


@query("SELECT query, count(*) AS n, count(*) FILTER (WHERE results = 0) AS n_empty FROM (SELECT event_type AS query, CASE WHEN value < 10 THEN 0 ELSE 1 END AS results FROM events UNION ALL SELECT 'hot gear', 3) GROUP BY 1")
def w12_journal_append(t: Tables) -> DataFrame:
    journal = t.events.select(F.col("event_type").alias("query"), F.lit("{}").alias("filters"), F.when(F.col("value") < 10, 0).otherwise(1).alias("results"), F.col("ts").cast("timestamp").alias("created_at"))
    row = H.journal_row(t.spark, "hot gear", {}, 3, None)
    return Q.top_queries(journal.unionByName(row), "query", F.col("results"), "created_at").select("query", "n", "n_empty")


_LOG = ["event_id", "user_id", "event_type", "value"]


def _log(t: Tables) -> DataFrame:
    """Events as an audit log, a chain for each type and lane; values as whole cents, which both engines write alike."""
    rows = t.events.select("event_id", "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("value"))
    return B.sealed(rows, "event_id", ["event_id"], F.col("event_type"), _LOG, lanes=4, block=50)


def log_sql(block: int = 50, lanes: int = 4) -> str:
    """CTEs ``numbered`` and ``blocks``: digests folded over the entries of each block."""
    told = " || ',' || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in _LOG)
    return f"""rows AS (SELECT event_id, user_id, event_type, round(value * 100)::BIGINT AS value FROM events),
dealt AS (SELECT *, event_type AS period, ('0x' || substr(md5(event_id::VARCHAR), 1, 4))::INT % {lanes} AS lane, {told} AS content FROM rows),
numbered AS (SELECT *, row_number() OVER (PARTITION BY period, lane ORDER BY event_id) AS n FROM dealt),
blocks AS (SELECT period, lane, (n - 1) // {block} AS block, count(*) AS entries, list_reduce(list_prepend(sha256(period || '|' || lane || '|' || ((n - 1) // {block})), list(content ORDER BY n)), lambda d, c: sha256(d || '|' || c)) AS tail FROM numbered GROUP BY 1, 2, 3),
of_lanes AS (SELECT period, lane, sha256(string_agg(tail, '|' ORDER BY block)) AS root, sum(entries) AS entries FROM blocks GROUP BY 1, 2),
of_periods AS (SELECT period, sha256(string_agg(root, '|' ORDER BY lane)) AS root, sum(entries)::BIGINT AS entries FROM of_lanes GROUP BY 1)"""


@query(f"""WITH {log_sql()} SELECT period, entries, root, list_reduce(list_prepend('', list(root) OVER (ORDER BY period ROWS UNBOUNDED PRECEDING)), lambda d, c: sha256(d || '|' || c)) AS head FROM of_periods""")
def w13_chain_heads(t: Tables) -> DataFrame:
    return B.heads(_log(t), block=50)


@query(f"""WITH {log_sql()}, found AS (
SELECT period, event_id AS id, CASE WHEN event_id % 97 = 3 THEN 'altered' WHEN n % 50 <> 1 AND lag(event_id) OVER (PARTITION BY period, lane ORDER BY n) % 89 = 5 THEN 'unlinked' END AS state, event_id % 89 = 5 AS gone FROM numbered)
SELECT period, id, state FROM found WHERE NOT gone AND state IS NOT NULL
UNION ALL SELECT period, NULL, 'root' FROM (SELECT period, lane, (n - 1) // 50 AS block, arg_max(event_id, n) AS last, count(*) FILTER (WHERE event_id % 89 = 5) AS gone FROM numbered GROUP BY 1, 2, 3) GROUP BY period HAVING sum(gone) > 0""")
def w13_chain_breaks(t: Tables) -> DataFrame:
    """The log after some entries were altered and others removed, against the heads that were kept."""
    log = kept(_log(t))
    forged = log.where("event_id % 89 <> 5").withColumn("value", F.col("value") + F.when(F.col("event_id") % 97 == 3, 1).otherwise(0))
    return B.breaks(forged, B.heads(log, block=50), "event_id", _LOG, block=50)


@query("SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_custkey % 2 = 0 THEN 2 ELSE 1 END AS revision FROM orders")
def w16_optimistic_revision(t: Tables) -> DataFrame:
    records = t.orders.select("o_orderkey", "o_orderstatus", F.lit(1).alias("revision"))
    asked = t.orders.select("o_orderkey", F.lit("Z").alias("value"), (F.col("o_custkey") % 2 + 1).cast("int").alias("expected"))
    return K.corrected(records, asked, "o_orderkey", "o_orderstatus")[0].select("o_orderkey", "o_orderstatus", "revision")


# --- dashboards ------------------------------------------------------------------------------


@query("""SELECT 'auto_rate' AS metric, 'all' AS label, round(count(*) FILTER (WHERE NOT value < 20) / count(*)::DOUBLE, 6) AS value FROM events UNION ALL SELECT 'events', event_type, count(*)::DOUBLE FROM events GROUP BY 2 UNION ALL SELECT 'duplicates', 'groups', count(*)::DOUBLE FROM (SELECT text FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(DISTINCT doc_id) > 1)""")
def a11_dashboard(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", F.sha2("text", 256).alias("h"))
    board = Q.dashboard({
        "auto_rate": Q.correction_rate(t.events, F.col("value") < 20).select(F.lit("all").alias("label"), F.col("auto_rate").alias("value")),
        "events": t.events.groupBy(F.col("event_type").alias("label")).agg(F.count("*").alias("value")),
        "duplicates": Q.exact_duplicate_groups(docs, "h", "doc_id").agg(F.lit("groups").alias("label"), F.count("*").alias("value")),
    })
    return board


@query("""(SELECT 'frequent' AS part, event_type AS query, count(*) AS n FROM events GROUP BY 2 ORDER BY n DESC, query LIMIT 3) UNION ALL (SELECT 'empty', event_type, count(*) AS n FROM events WHERE value < 5 GROUP BY 2 ORDER BY n DESC, event_type LIMIT 3) UNION ALL SELECT 'total', 'all', count(*) FROM events""")
def a24_journal_report(t: Tables) -> DataFrame:
    return Q.journal_report(t.events, "event_type", F.col("value") < 5, 3)


@query("SELECT user_id, count(*) FILTER (WHERE value >= 99) AS tier_1, count(*) FILTER (WHERE value >= 90 AND value < 99) AS tier_2, count(*) FILTER (WHERE value >= 85 AND value < 90) AS tier_3, count(*) FILTER (WHERE value IS NULL OR value < 85) AS tier_4 FROM events GROUP BY 1")
def a26_tiers(t: Tables) -> DataFrame:
    # scores are compared as they are: a hundredth of 99 is not the double nearest to 0.99
    return t.events.groupBy("user_id").agg(*Q.tiers(F.col("value"), 100.0))


@query("SELECT 'part' AS name, count(*) AS before, count(*) FILTER (WHERE p_size > 10) AS after, count(*) FILTER (WHERE NOT p_size > 10) AS lost FROM part")
def a39_reindex_measures(t: Tables) -> DataFrame:
    return Q.reindex_measures("part", t.part, t.part.where("p_size > 10"), "p_partkey")


@query("SELECT 'status' AS axis, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def a40_facet_counts(t: Tables) -> DataFrame:
    from ..operators import retrieval as R

    return R.facets(t.orders.withColumnsRenamed({"o_orderstatus": "status", "o_orderpriority": "priority"}), ["status", "priority"], {})


# --- question answering ----------------------------------------------------------------------


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE s_suppkey = 3")
def r22_detail_of_page(t: Tables) -> DataFrame:
    page = t.supplier.where("s_suppkey = 3").select("s_suppkey")
    return t.supplier.join(F.broadcast(page), "s_suppkey").select("s_suppkey", "s_name", "s_nationkey")  # a page: one row


@query("""SELECT 'How many  URGENT orders in 1996?' AS question, 'ok' AS state, 'count' AS intent, count(*)::VARCHAR AS told FROM orders WHERE contains(lower(o_orderpriority), 'urgent') AND year(o_orderdate) = 1996
UNION ALL SELECT 'how many low orders in 1994', 'ok', 'count', count(*)::VARCHAR FROM orders WHERE contains(lower(o_orderpriority), 'low') AND year(o_orderdate) = 1994
UNION ALL SELECT 'balance of supplier 3', 'ok', 'value', (s_acctbal)::VARCHAR FROM supplier WHERE s_suppkey = 3""")
def r25_question_driver(t: Tables) -> DataFrame:
    """Questions of two intents, each answered from the tables."""
    intents = [
        A.Intent("value", r"balance of supplier (?P<code>\d+)", lambda code: A.value_of(t.supplier, "s_suppkey", code, "s_acctbal", "s_nationkey", "0")),
        A.Intent("count", r"how many (?P<motif>\w+) orders in (?P<year>\d{4})", lambda motif, year: A.counted(t.orders, "o_orderkey", "o_orderpriority", motif, int(year), "o_orderdate")[0]),
    ]
    told = []
    for question in ("How many  URGENT orders in 1996?", "how many low orders in 1994", "balance of supplier 3"):
        answer = A.ask(question, intents, lambda words: t.orders.limit(0))
        value = F.col("n" if answer.intent == "count" else "value").cast("string")
        told.append(answer.rows.select(F.lit(question).alias("question"), F.lit(answer.state).alias("state"), F.lit(answer.intent).alias("intent"), value.alias("told")))
    return reduce(DataFrame.unionByName, told)


@query("SELECT p_partkey, 'p_size' AS attribute, p_size::VARCHAR AS value FROM part WHERE p_brand = 'Brand#3' AND p_type = 'SMALL'")
def r31_attribute_of_band(t: Tables) -> DataFrame:
    return A.attribute_of(t.part.where("p_type = 'SMALL'"), "p_partkey", "p_brand", "Brand#3", ["p_size"])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'not applicable' ELSE o_totalprice::DECIMAL(15, 2)::VARCHAR END AS value FROM orders WHERE o_custkey = 7")
def r33_surplus_verbatim(t: Tables) -> DataFrame:
    told = F.when(F.col("o_orderstatus") == "P", "Not applicable").otherwise(F.col("o_totalprice").cast("decimal(15,2)").cast("string"))
    return A.verbatim(t.orders.where("o_custkey = 7").select("o_orderkey", told.alias("told")), "o_orderkey", "told")


@query("SELECT c_custkey, 'c_mktsegment' AS field, c_mktsegment AS value FROM customer WHERE c_custkey = 11")
def r35_header_field(t: Tables) -> DataFrame:
    return A.header_field(t.customer, "c_custkey", 11, "segment", {"segment": "c_mktsegment", "name": "c_name"})


@query(f"SELECT doc_id FROM (SELECT doc_id, {tokens_sql('text')} AS ws FROM documents) WHERE list_contains(ws, 'license') ORDER BY len(list_filter(ws, lambda w: w = 'license')) DESC, doc_id LIMIT 3")
def r36_refusal_hints(t: Tables) -> DataFrame:
    def hints(words: list[str]) -> DataFrame:
        ws = T.tokens(F.col("text"))
        hit = F.size(F.filter(ws, lambda w: w.isin(*words)))
        return t.documents.select("doc_id", hit.alias("n")).where("n > 0").orderBy(F.desc("n"), "doc_id").select("doc_id")

    return A.ask("is a license?", [], hints).rows


# --- checks, models, families ------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_returnflag AS label FROM lineitem WHERE l_returnflag NOT IN (SELECT DISTINCT CASE WHEN o_orderstatus = 'F' THEN 'A' ELSE 'R' END FROM orders)")
def x04_unknown_labels(t: Tables) -> DataFrame:
    known = t.orders.select(F.when(F.col("o_orderstatus") == "F", "A").otherwise("R").alias("label")).distinct()
    return U.unknown_labels(t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("label")), known).select("l_orderkey", "l_linenumber", "label")


@query("""WITH m AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2), b AS (SELECT l_orderkey, first(l_returnflag ORDER BY n DESC, l_returnflag) AS main FROM m GROUP BY 1),
s AS (SELECT l_orderkey, round(avg(l_discount), 6) AS confidence, count(*) FILTER (WHERE l_quantity > 45) AS odd, count(DISTINCT l_linenumber) AS filled FROM lineitem GROUP BY 1)
SELECT l_orderkey, confidence, main, CASE WHEN filled >= 4 THEN 'complete' WHEN filled >= 2 THEN 'partial' ELSE 'poor' END AS completeness, CASE WHEN odd = 0 THEN 'plausible' ELSE 'to_check' END AS plausibility FROM s JOIN b USING (l_orderkey)""")
def x05_projection(t: Tables) -> DataFrame:
    odd = F.col("l_quantity") > 45
    return U.projection(t.lineitem, "l_orderkey", "l_discount", "l_returnflag", F.col("l_linenumber"), odd)


@query("SELECT event_id, coalesce(value / 100 > 0.90 AND event_type <> 'error', false) AS auto FROM events")
def x11_auto_validation(t: Tables) -> DataFrame:
    return t.events.select("event_id", U.auto_validation(F.col("value") / 100, F.col("event_type") == "error").alias("auto"))


@query("""WITH e AS (SELECT sha256(text) AS h, min(doc_id) AS a, count(DISTINCT doc_id) AS n FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) > 1), l AS (SELECT a, d.doc_id AS b FROM documents d JOIN e ON sha256(d.text) = h WHERE d.doc_id <> a)
SELECT count(*) AS found, count(*) FILTER (WHERE b % 2 = 0) AS present, count(*) FILTER (WHERE b % 2 <> 0) AS created, (SELECT count(*) FROM (SELECT a FROM l UNION SELECT b FROM l)) AS concerned FROM l""")
def x17_scan_summary(t: Tables) -> DataFrame:
    links = D.exact_links(t.documents.select("doc_id", F.sha2("text", 256).alias("h")), "doc_id", "h")
    return D.scan_summary(links, links.where("b % 2 = 0"))


@query("WITH l AS (SELECT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY 1, 2), u AS (SELECT a AS id, b AS other FROM l UNION SELECT b, a FROM l) SELECT id, count(DISTINCT other) AS links FROM u GROUP BY 1")
def x18_links_both_ways(t: Tables) -> DataFrame:
    links = t.lineitem.where("l_partkey <> l_suppkey").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return D.links_both_ways(links).groupBy("id").agg(F.count("*").alias("links"))


@query("""WITH s AS (SELECT p_brand, count(*) AS n, quantile_cont(p_retailprice, 0.5) AS m FROM part WHERE p_partkey <> 5 GROUP BY 1), o AS (SELECT p_brand, p_retailprice AS v FROM part WHERE p_partkey = 5)
SELECT s.p_brand, n, round(v - m, 3) AS gap, n >= 5 AS scored FROM s JOIN o USING (p_brand)""")
def x24_target_evaluation(t: Tables) -> DataFrame:
    return C.target_gaps(t.part, "p_partkey", 5, ["p_brand"], "p_retailprice")


@query("SELECT user_id, event_id, round(value, 4) AS score, CASE WHEN value >= 75 THEN 'compatible' ELSE 'to_examine' END AS verdict FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 3")
def x25_evaluation_history(t: Tables) -> DataFrame:
    from ..operators import latest as L

    rows = L.first_per_key(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")], 3)
    return rows.select("user_id", "event_id", F.round("value", 4).alias("score"), F.when(F.col("value") >= C.ALERT, "compatible").otherwise("to_examine").alias("verdict"))


@query("""WITH v AS (SELECT event_type AS family, round(value / 100, 2) AS t, count(*) AS n, count(*) FILTER (WHERE event_id % 10 > 0) AS c FROM events GROUP BY 1, 2), r AS (SELECT family, t, sum(n) OVER w AS n, sum(c) OVER w AS c FROM v WINDOW w AS (PARTITION BY family ORDER BY t DESC)), s AS (SELECT event_type AS family, count(DISTINCT user_id) AS sheets FROM events GROUP BY 1)
SELECT family, min(t) FILTER (WHERE n >= 5 AND c / n::DOUBLE >= 0.9 - 1e-9) AS threshold, any_value(sheets) >= 20 AS applicable FROM r JOIN s USING (family) GROUP BY 1""")
def x26_calibration_proposal(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("event_type").alias("family"), F.round(F.col("value") / 100, 2).alias("score"), (F.col("event_id") % 10 > 0).alias("right"), "user_id")
    return C.calibration_proposal(rows, "family", "score", F.col("right"), "user_id", 0.9, 20)


@query("SELECT vec_id, label, ('0x' || substr(md5(vec_id::VARCHAR), 1, 8))::BIGINT % 1000 < 300 AS held FROM embeddings")
def x31_stratified_split(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", "label", M.stratified_split(F.col("vec_id"), 0.3).alias("held"))


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS page, l_returnflag || l_linenumber % 3 AS label FROM lineitem), s AS (SELECT page, string_agg(label, '+' ORDER BY label) AS layout FROM l GROUP BY 1)
SELECT layout, count(*) AS pages, min(page) AS first FROM s GROUP BY 1""")
def x32_layout_sets(t: Tables) -> DataFrame:
    labels = t.lineitem.select(F.col("l_orderkey").alias("page"), F.concat("l_returnflag", (F.col("l_linenumber") % 3).cast("string")).alias("label"))
    return Y.layouts(labels, "page", "label")


@query("""WITH RECURSIVE l AS (SELECT DISTINCT l_orderkey AS page, l_returnflag || l_linenumber % 3 AS label FROM lineitem), s AS (SELECT page, string_agg(label, '+' ORDER BY label) AS layout FROM l GROUP BY 1),
o AS (SELECT layout, row_number() OVER (ORDER BY count(*) DESC, layout) AS i FROM s GROUP BY 1),
g AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS heads, NULL::VARCHAR AS layout, NULL::VARCHAR AS family
UNION ALL SELECT i, CASE WHEN f IS NULL THEN list_append(heads, layout) ELSE heads END, layout, coalesce(f, layout) FROM (SELECT o.i, heads, o.layout, list_filter(heads, lambda h: len(list_intersect(string_split(h, '+'), string_split(o.layout, '+'))) / len(list_distinct(list_concat(string_split(h, '+'), string_split(o.layout, '+'))))::DOUBLE >= 0.75)[1] AS f FROM g JOIN o ON o.i = g.i + 1))
SELECT layout, family FROM g WHERE layout IS NOT NULL""")
def x32_layout_families(t: Tables) -> DataFrame:
    labels = t.lineitem.select(F.col("l_orderkey").alias("page"), F.concat("l_returnflag", (F.col("l_linenumber") % 3).cast("string")).alias("label"))
    return Y.families(Y.layouts(labels, "page", "label"), 0.75)


@query("SELECT l_orderkey, l_linenumber, abs(l_quantity - e) <= greatest(0.005, 0.01 * abs(l_quantity)) AS within FROM (SELECT *, CASE WHEN l_linenumber = 1 THEN l_quantity * 1.02 ELSE l_quantity * 1.005 END AS e FROM lineitem)")
def x33_truth_bench(t: Tables) -> DataFrame:
    got = F.when(F.col("l_linenumber") == 1, F.col("l_quantity") * 1.02).otherwise(F.col("l_quantity") * 1.005)
    return t.lineitem.select("l_orderkey", "l_linenumber", U.within_tolerance(F.col("l_quantity"), got, 0.01).alias("within"))


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey >= 20 THEN n_nationkey - 20 ELSE n_nationkey END AS into_id, CASE WHEN n_nationkey >= 20 THEN n_name END AS snapshot, false AS undone FROM nation WHERE n_nationkey <> 24 UNION ALL SELECT 24, 24, n_name, true FROM nation WHERE n_nationkey = 24")
def x35_merge_and_undo(t: Tables) -> DataFrame:
    models = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    merges = models.where("id >= 20").select("id", (F.col("id") - 20).alias("into_id"))
    state = Y.merged(models, merges)
    return Y.unmerged(state, models.where("id = 24").select("id")).select("id", "into_id", "snapshot", "undone")


# --- workflow --------------------------------------------------------------------------------


@query("SELECT event_id AS id, CASE WHEN event_type = 'click' THEN user_id + 1000 ELSE user_id END AS link, CASE WHEN event_type = 'click' THEN 'human' ELSE 'auto' END AS category FROM events")
def m01_relinked(t: Tables) -> DataFrame:
    # who linked travels with the link: automatic ones reach 1000 too
    records = t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("link"), F.lit("auto").alias("by"))
    chosen = t.events.where("event_type = 'click'").select(F.col("event_id").alias("id"), (F.col("user_id") + 1000).alias("link"), F.lit("human").alias("by"))
    return K.relinked(records, chosen, "id", F.col("by")).drop("by")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')) WHERE k = 1")
def m03_one_pending(t: Tables) -> DataFrame:
    return K.new_requests(t.orders.select("o_custkey", "o_orderkey"), t.orders.where("o_orderstatus = 'P'").select("o_custkey").distinct(), "o_custkey", "o_orderkey")


@query("SELECT user_id, event_id, event_type = 'view' OR user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AS read FROM events")
def m04_mark_read(t: Tables) -> DataFrame:
    notes = t.events.select("user_id", "event_id", F.lit(False).alias("read"))
    some = K.mark_read(notes, "user_id", "event_id", t.events.where("event_type = 'view'").select("user_id", "event_id"))
    return K.mark_read(some, "user_id", "event_id", t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id")))


_EVENT = "CASE event_type WHEN 'click' THEN 'claim' WHEN 'view' THEN 'beat' WHEN 'purchase' THEN 'finish' WHEN 'error' THEN 'fail' ELSE 'queue' END"


@query(f"""WITH l AS (SELECT user_id, ts, {_EVENT} AS e FROM events)
SELECT user_id, CASE arg_max(e, (ts, e)) WHEN 'claim' THEN 'running' WHEN 'beat' THEN 'running' WHEN 'finish' THEN 'done' WHEN 'fail' THEN 'failed' ELSE 'queued' END AS state, count(*) FILTER (WHERE e = 'claim') AS claims FROM l GROUP BY 1""")
def m05_job_registry(t: Tables) -> DataFrame:
    return K.registry_state(t.events.select("user_id", "ts", F.expr(_EVENT).alias("e")), "user_id", "ts", "e").select("user_id", "state", "claims")


@query("SELECT p_partkey, 'luff' AS name, p_size + 0.5 AS number, 'm' AS unit, NULL AS rest FROM part UNION ALL SELECT p_partkey, 'sail name', NULL, NULL, p_name FROM part")
def m09_recovery_sheet(t: Tables) -> DataFrame:
    lines = F.array(F.concat(F.lit(" Luff = "), F.col("p_size").cast("string"), F.lit(",5 m")), F.concat(F.lit("Sail name = "), F.col("p_name")), F.lit("no key here"))
    return K.recovery_sheet(t.part.select("p_partkey", F.explode(lines).alias("line")), "p_partkey", F.col("line"))


@query("""WITH v AS (SELECT p_type AS code, p_partkey AS version, p_name AS body FROM part UNION ALL SELECT p_type, max(p_partkey) + 1, 'draft' FROM part GROUP BY 1)
SELECT code, version, body, version = max(version) OVER (PARTITION BY code) AS active FROM v""")
def m10_publish_template(t: Tables) -> DataFrame:
    stored = t.part.select(F.col("p_type").alias("code"), F.col("p_partkey").alias("version"), F.col("p_name").alias("body"))
    return K.publish(stored, stored.select("code", F.lit("draft").alias("body")).distinct(), "code")


@query("SELECT o_orderkey, 'Z' AS value, CASE WHEN o_custkey % 2 = 0 THEN 'applied' ELSE 'stale' END AS outcome FROM orders")
def m11_correction_history(t: Tables) -> DataFrame:
    records = t.orders.select("o_orderkey", "o_orderstatus", F.lit(1).alias("revision"))
    asked = t.orders.select("o_orderkey", F.lit("Z").alias("value"), (F.col("o_custkey") % 2 + 1).cast("int").alias("expected"))
    return K.corrected(records, asked, "o_orderkey", "o_orderstatus")[1]


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_partkey * 10 BETWEEN 0 AND 500 THEN p_partkey * 10.0 ELSE p_size END::DOUBLE AS p_size FROM part")
def m12_propagate(t: Tables) -> DataFrame:
    fixes = t.part.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, "size").otherwise("colour").alias("field"), F.col("p_partkey").cast("string").alias("value"))
    return K.propagate(t.part.select("p_partkey", "p_size"), fixes, "p_partkey", {"size": ("p_size", 10.0, 0.0, 500.0)})


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'quarantine' WHEN o_orderstatus = 'F' AND o_totalprice > 100000 THEN 'purge' ELSE 'keep' END AS action FROM orders")
def m19_preservation(t: Tables) -> DataFrame:
    return K.preservation(t.orders, "o_orderkey", F.col("o_orderstatus") == "F", F.col("o_totalprice") > 100000, F.col("o_orderstatus") == "P")


_TRAINED = """k AS (SELECT vec_id, label, embedding, ('0x' || substr(md5(vec_id::VARCHAR), 1, 8))::BIGINT % 1000 < 300 AS held FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
n AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM k WHERE NOT held), m AS (SELECT label, i, avg(x) AS m FROM n GROUP BY 1, 2), c AS (SELECT label AS predicted, list(m ORDER BY i) AS v FROM m GROUP BY 1),
s AS (SELECT vec_id, label, predicted, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS s FROM k, c WHERE held), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, predicted) AS place FROM s),
confusion AS (SELECT label, predicted, count(*) AS n FROM r WHERE place = 1 GROUP BY 1, 2)"""


@query(f"WITH {_TRAINED} SELECT * FROM confusion")
def m15_confusion(t: Tables) -> DataFrame:
    return R.train(t.embeddings, "vec_id", "label", "embedding").confusion


@query(f"""WITH {_TRAINED}, b AS (SELECT held, ('0x' || substr(md5(vec_id || ':' || label), 1, 8))::BIGINT AS mark FROM k), p AS (SELECT label, sum(n) AS n, coalesce(sum(n) FILTER (WHERE label = predicted), 0) AS ok FROM confusion GROUP BY 1)
SELECT (SELECT md5('centroid/300/' || sum(mark) FILTER (WHERE NOT held) || '/' || sum(mark) FILTER (WHERE held)) FROM b) AS version, (SELECT count(*) FROM k WHERE NOT held) AS n_train, (SELECT count(*) FROM k WHERE held) AS n_held,
round(sum(ok) / sum(n), 6)::DOUBLE AS accuracy, round(avg(ok / n), 6)::DOUBLE AS macro_recall FROM p""")
def m15_training_run(t: Tables) -> DataFrame:
    return R.train(t.embeddings, "vec_id", "label", "embedding").metrics


@query("""SELECT 'part' AS table_name, 'p_partkey' AS column_name, count(p_partkey) AS filled, count(*) AS rows FROM part UNION ALL SELECT 'part', 'p_colour', NULL, count(*) FROM part
UNION ALL SELECT 'documents', 'lang', count(lang), count(*) FROM documents UNION ALL SELECT 'orders', 'o_orderkey', count(o_orderkey), count(*) FROM orders UNION ALL SELECT 'ghost', 'id', NULL, NULL""")
def m18_schema_gaps(t: Tables) -> DataFrame:
    tables = {"part": t.part, "orders": t.orders, "documents": t.documents}
    return K.schema_health(t.spark, tables, {"part": ["p_partkey", "p_colour"], "documents": ["lang"], "orders": ["o_orderkey"], "ghost": ["id"]})


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE ((o_orderstatus = 'F' AND date_diff('day', o_orderdate::DATE, DATE '1998-08-02') > 1000) OR (o_orderstatus = 'O' AND date_diff('day', o_orderdate::DATE, DATE '1998-08-02') > 2000)) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def m20_retention_plan(t: Tables) -> DataFrame:
    protected = t.lineitem.where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return K.retention_plan(t.orders, "o_orderkey", "o_orderstatus", "o_orderdate", F.lit("1998-08-02").cast("date"), {"F": 1000, "O": 2000}, protected)


# --- queues ----------------------------------------------------------------------------------


@query("""WITH c AS (SELECT user_id AS job, event_id % 3 AS writer, ts FROM events WHERE event_type = 'click'), w AS (SELECT user_id AS job, event_id % 3 AS writer, ts FROM events WHERE event_type = 'purchase'),
b AS (SELECT w.job, w.writer, w.ts, max(struct_pack(a := c.ts, o := c.writer)) AS m FROM w LEFT JOIN c ON c.job = w.job AND c.ts <= w.ts GROUP BY 1, 2, 3)
SELECT job, writer, count(*) AS writes, count(*) FILTER (WHERE coalesce(m.o = writer AND epoch(date_trunc('second', ts)) - epoch(date_trunc('second', m.a)) <= 86400, false)) AS held FROM b GROUP BY 1, 2""")
def t03_fenced_writes(t: Tables) -> DataFrame:
    rows = lambda kind: t.events.where(F.col("event_type") == kind).select(F.col("user_id").alias("job"), (F.col("event_id") % 3).alias("writer"), F.col("ts").alias("at"))
    judged = K.fenced(rows("purchase"), rows("click"), "job", "at", 86400)
    return judged.groupBy("job", "writer").agg(F.count("*").alias("writes"), F.count_if("holds").alias("held"))


@query("WITH f AS (SELECT user_id, min(ts) AS flag FROM events WHERE event_type = 'error' GROUP BY 1) SELECT event_id FROM events e LEFT JOIN f USING (user_id) WHERE event_type = 'view' AND (flag IS NULL OR ts < flag)")
def t08_not_cancelled(t: Tables) -> DataFrame:
    units = t.events.where("event_type = 'view'").select("user_id", "event_id", "ts")
    return K.not_cancelled(units, t.events.where("event_type = 'error'").select("user_id", "ts"), "user_id", "ts").select("event_id")


@query("SELECT source, count(*) AS waiting FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1")
def t09_resumable_lots(t: Tables) -> DataFrame:
    return t.documents.join(t.labels.select("doc_id"), "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("waiting"))


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS session, l_linenumber - 1 AS number FROM lineitem), s AS (SELECT session, count(*) AS present FROM c GROUP BY 1)
SELECT o_orderkey AS session, coalesce(present, 0) AS present, CASE WHEN coalesce(present, 0) < 4 THEN (SELECT min(n) FROM range(0, 8) r(n) WHERE n NOT IN (SELECT number FROM c WHERE c.session = o_orderkey)) END AS missing, coalesce(present, 0) >= 4 AS complete FROM orders LEFT JOIN s ON session = o_orderkey""")
def t11_upload_state(t: Tables) -> DataFrame:
    chunks = t.lineitem.select(F.col("l_orderkey").alias("session"), (F.col("l_linenumber") - 1).alias("number"), "l_quantity")
    expected = t.orders.select(F.col("o_orderkey").alias("session"), F.lit(4).alias("chunks"))
    return K.upload_state(chunks, "session", "number", F.col("l_quantity"), expected).select("session", "present", "missing", "complete")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def t13_daily_windows(t: Tables) -> DataFrame:
    return t.events.groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n")


@query("WITH f AS (SELECT user_id, count(*) AS attempts, count(*) FILTER (WHERE event_type = 'error') AS failures, arg_max(event_type = 'error', (ts, event_id)) AS last FROM events GROUP BY 1) SELECT user_id, CASE WHEN NOT last THEN 'done' WHEN failures >= 3 THEN 'dead' ELSE 'waiting' END AS state FROM f")
def t01_queue_state(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", F.struct("ts", "event_id").alias("at"), (F.col("event_type") == "error").alias("failed"))
    return J.retry_state(rows, "user_id", "at", F.col("failed")).select("user_id", "state")
