"""Ingestion, merges, queue state and operational lookups on the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import files as S
from ..sources import merge as W
from ..sources.stored import StoredTable
from ..storage import shared_dir
from ..streaming import jobs as J
from ..streaming import leases as E
from .registry import Tables, query


@query("""WITH m AS (SELECT o_orderkey, o_totalprice + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS size, CASE WHEN o_orderkey % 15 = 0 THEN 'v0' ELSE 'v1' END AS version FROM orders WHERE o_orderkey % 7 <> 0)
SELECT o.o_orderkey::VARCHAR AS path FROM orders o LEFT JOIN m USING (o_orderkey) WHERE m.o_orderkey IS NULL OR m.size IS DISTINCT FROM o.o_totalprice OR m.version <> 'v1'""")
def s03_manifest_diff(t: Tables) -> DataFrame:
    scan = t.orders.select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_totalprice").alias("size"), F.col("o_orderdate").alias("modified_at"), "o_orderkey")
    old = scan.where("o_orderkey % 7 <> 0").withColumn("size", F.col("size") + F.when(F.col("o_orderkey") % 10 == 0, 1).otherwise(0)).withColumn("extractor_version", F.when(F.col("o_orderkey") % 15 == 0, "v0").otherwise("v1"))
    return S.changed(scan, old, "v1").select("path")


@query(r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'),
'&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))) AS digest FROM pages""")
def s05_html_strip(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.md5(S.strip_markup(F.col("html"))).alias("digest"))


@query("SELECT source AS parent, count(*) AS files, count(*) FILTER (WHERE lang = 'fr') AS hits FROM documents GROUP BY 1 HAVING count(*) FILTER (WHERE lang = 'fr') > 0")
def s16_folders_with(t: Tables) -> DataFrame:
    return S.folders_with(t.documents.select(F.col("source").alias("parent"), F.col("lang").alias("extension")), "fr")


@query("SELECT event_type AS extension, year(ts)::INT AS year, count(*) AS files, sum(event_id)::BIGINT AS bytes FROM events GROUP BY GROUPING SETS ((event_type), (year(ts)::INT))")
def s17_inventory(t: Tables) -> DataFrame:
    return S.inventory(t.events.select(F.col("event_type").alias("extension"), F.col("ts").alias("modified_at"), F.col("event_id").alias("size")))


_NEW = "SELECT o_orderkey + CASE WHEN o_orderkey % 4 = 0 THEN 10000000 ELSE 0 END AS k, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice + 5 END AS v FROM orders WHERE o_orderkey % 2 = 0"


@query(f"""WITH t AS (SELECT o_orderkey AS k, o_totalprice AS v, o_orderstatus AS s FROM orders), n AS ({_NEW})
SELECT coalesce(t.k, n.k) AS k, CASE WHEN n.k IS NULL OR coalesce(t.s = 'F', false) THEN t.v ELSE coalesce(n.v, t.v) END AS v, CASE WHEN n.k IS NULL OR coalesce(t.s = 'F', false) THEN t.s ELSE coalesce('N', t.s) END AS s FROM t FULL JOIN n ON t.k = n.k""")
def w01_upsert(t: Tables) -> DataFrame:
    target = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderstatus").alias("s"))
    fresh = t.orders.where("o_orderkey % 2 = 0").select((F.col("o_orderkey") + F.when(F.col("o_orderkey") % 4 == 0, 10000000).otherwise(0)).alias("k"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice") + 5).alias("v"), F.lit("N").alias("s"))
    return W.upsert(target, fresh, ["k"], guard=F.col("s") == "F", keep_old=True)


@query("""WITH n AS (SELECT o_orderkey + CASE WHEN o_orderkey % 200 = 0 THEN 50000000 ELSE 0 END AS k, 'N' AS s, o_totalprice + 5 AS v FROM orders WHERE o_orderkey % 100 = 0)
SELECT coalesce(n.k, o_orderkey) AS k, coalesce(n.s, o_orderstatus) AS s, coalesce(n.v, o_totalprice) AS v FROM orders FULL JOIN n ON o_orderkey = n.k WHERE coalesce(o_orderkey, 1) % 1000 <> 7""")
def w01_touched_files(t: Tables) -> DataFrame:
    """One key in a hundred upserted and one in a thousand deleted, in the files that hold them."""
    rows = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("v"))
    table = StoredTable(rows.sparkSession, f"{shared_dir(rows.sparkSession)}/orders-{uuid.uuid4().hex}", "k").create(rows, 2_000)
    changes = rows.where("k % 100 = 0").select((F.col("k") + F.when(F.col("k") % 200 == 0, 50_000_000).otherwise(0)).alias("k"), F.lit("N").alias("s"), (F.col("v") + 5).alias("v"))
    table.upsert(changes, rows_a_file=2_000)
    table.delete(rows.where("k % 1000 = 7"), rows_a_file=2_000)
    return table.read()


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase') AND NOT starts_with(c_custkey::VARCHAR, '9')")
def w02_reconcile_delete(t: Tables) -> DataFrame:
    rows = t.customer.select(F.col("c_custkey").cast("string").alias("k"))
    seen = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").cast("string").alias("k"))
    used = t.events.where("event_type = 'purchase'").select(F.col("user_id").cast("string").alias("k"))
    return W.reconcile(rows, seen, "k", protected=["9"], referenced=[used]).select(F.col("k").cast("long").alias("c_custkey"))


@query("""WITH a AS (SELECT * FROM supplier WHERE s_suppkey % 5 <> 0), b AS (SELECT s_suppkey, s_name, s_nationkey, s_acctbal + CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS s_acctbal FROM supplier WHERE s_suppkey % 7 <> 0)
SELECT s_suppkey, state FROM (SELECT coalesce(a.s_suppkey, b.s_suppkey) AS s_suppkey, CASE WHEN a.s_suppkey IS NULL THEN 'lost' WHEN b.s_suppkey IS NULL THEN 'added' WHEN a.s_acctbal IS DISTINCT FROM b.s_acctbal THEN 'altered' END AS state FROM a FULL JOIN b ON a.s_suppkey = b.s_suppkey) WHERE state IS NOT NULL""")
def w03_snapshot_diff(t: Tables) -> DataFrame:
    backup = t.supplier.where("s_suppkey % 7 <> 0").withColumn("s_acctbal", F.col("s_acctbal") + F.when(F.col("s_suppkey") % 3 == 0, 1).otherwise(0))
    return W.snapshot_diff(t.supplier.where("s_suppkey % 5 <> 0"), backup, ["s_suppkey"])


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT DISTINCT r_regionkey + 1000, r_name FROM region WHERE r_name NOT IN (SELECT n_name FROM nation)")
def w04_insert_missing(t: Tables) -> DataFrame:
    fresh = t.region.select((F.col("r_regionkey") + 1000).alias("n_nationkey"), F.col("r_name").alias("n_name"))
    return W.insert_missing(t.nation.select("n_nationkey", "n_name"), fresh, ["n_name"])


@query("SELECT event_type, (count(*) + 10)::BIGINT AS occurrences FROM events GROUP BY 1")
def w06_count_up(t: Tables) -> DataFrame:
    base = t.events.select("event_type", F.lit(10).cast("long").alias("occurrences")).distinct()
    return W.count_up(base, t.events, ["event_type"])


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'document:' || doc_id WHEN doc_id % 4 = 1 THEN 'sha256:' || sha256(text) WHEN doc_id % 4 = 2 THEN 'code:' || source ELSE 'content:' || sha256(coalesce(text, '')) END AS key FROM documents""")
def w07_idempotence_key(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 4
    key = W.idempotence_key(F.when(k == 0, F.col("doc_id")), F.lit(None).cast("string"), F.when(k == 1, F.sha2("text", 256)), F.when(k == 2, F.col("source")), F.col("text"))
    return t.documents.select("doc_id", key.alias("key"))


@query("SELECT count(*) AS names, count(DISTINCT source) AS distinct_names FROM (SELECT source FROM documents UNION SELECT r_name FROM region)")
def w09_resolve_or_create(t: Tables) -> DataFrame:
    known = t.region.select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))
    return W.resolve_or_create(t.documents.select("source"), "source", known, "name", "id").agg(F.count("*").alias("names"), F.countDistinct("name").alias("distinct_names"))


@query("""WITH w AS (SELECT doc_id AS id, source AS stem, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents), taken(name) AS (VALUES ('src1.txt'), ('src1-2.txt'), ('src2-2.txt'), ('src2-4.txt'), ('src3.txt')),
c AS (SELECT stem, n, stem || CASE WHEN n > 1 THEN '-' || n ELSE '' END || '.txt' AS name FROM (SELECT DISTINCT stem FROM w), range(1, (SELECT max(k) + 10 FROM w)) r(n)),
free AS (SELECT stem, name, row_number() OVER (PARTITION BY stem ORDER BY n) AS k FROM c WHERE name NOT IN (SELECT name FROM taken))
SELECT id, name FROM w JOIN free USING (stem, k)""")
def w15_free_names(t: Tables) -> DataFrame:
    wanted = t.documents.select(F.col("doc_id").alias("id"), F.concat("source", F.lit(".txt")).alias("name"))
    taken = [("src1.txt",), ("src1-2.txt",), ("src2-2.txt",), ("src2-4.txt",), ("src3.txt",)]
    return W.free_names(wanted, "name", t.spark.createDataFrame(taken, "name string"))


@query("SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'documents', count(*) FROM documents")
def l02_row_counts(t: Tables) -> DataFrame:
    counts = [getattr(t, n).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in ("orders", "lineitem", "customer", "documents")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


def _with_now(t: Tables) -> DataFrame:
    """Events with the newest time, which stands in for the clock: one row, so it is broadcast."""
    return t.events.crossJoin(F.broadcast(t.events.agg(F.max("ts").alias("now"))))


@query("""WITH a AS (SELECT user_id, floor(epoch(ts))::BIGINT AS s, event_type = 'error' AS failed FROM events), n AS (SELECT max(floor(epoch(ts))::BIGINT) AS now FROM events), ok AS (SELECT user_id, max(s) FILTER (WHERE NOT failed) AS ok FROM a GROUP BY 1),
r AS (SELECT a.user_id, count(*) AS failures, max(s) AS last FROM a JOIN ok USING (user_id), n WHERE failed AND s > coalesce(ok, -4611686018427387904) AND s > now - 10080 * 60 GROUP BY 1)
SELECT user_id, failures, CASE WHEN failures >= 2 THEN greatest(0, last + 10080 * 60 - now) ELSE 0 END::BIGINT AS locked_s FROM r, n""")
def l04_lockout(t: Tables) -> DataFrame:
    return J.lockout(_with_now(t), "user_id", "ts", F.col("event_type") == "error", F.col("now"), 10080, 2)


@query("SELECT doc_id, concat_ws(',', CASE WHEN quality IS NULL THEN 'quality' END, CASE WHEN toxic IS NULL THEN 'toxic' END) AS missing FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR toxic IS NULL")
def l11_missing_axes(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id", "left")
    missing = F.array_join(F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("quality", "toxic")]), lambda x: x.isNotNull()), ",")
    return rows.where("quality IS NULL OR toxic IS NULL").select("doc_id", missing.alias("missing"))


@query("""WITH x AS (SELECT user_id, event_id, ts, CASE WHEN value > 20 THEN value END AS v FROM events), p AS (SELECT *, lag(v) OVER w AS old, lag(event_id) OVER w AS before FROM x WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CASE WHEN old IS NOT NULL AND v IS NULL THEN 'erased' ELSE 'repaired' END AS change FROM p WHERE before IS NOT NULL AND (old IS NULL) <> (v IS NULL)""")
def l14_timeline_audit(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = t.events.withColumn("v", F.when(F.col("value") > 20, F.col("value")))
    rows = rows.withColumn("old", F.lag("v").over(order)).withColumn("before", F.lag("event_id").over(order))
    changed = rows.where(F.col("before").isNotNull() & (F.col("old").isNull() != F.col("v").isNull()))
    return changed.select("event_id", F.when(F.col("v").isNull(), "erased").otherwise("repaired").alias("change"))


@query("SELECT o_custkey, CASE WHEN bool_and(o_orderstatus = 'F') THEN 'uploaded' WHEN bool_or(o_orderstatus = 'F') THEN 'partial' ELSE 'failed' END AS state FROM orders GROUP BY 1")
def l19_preservation_rollup(t: Tables) -> DataFrame:
    done = F.col("o_orderstatus") == "F"
    return t.orders.groupBy("o_custkey").agg(F.when(F.bool_and(done), "uploaded").when(F.bool_or(done), "partial").otherwise("failed").alias("state"))


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def l24_audit_page(t: Tables) -> DataFrame:
    return t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "ts", "event_type")


@query("""WITH g AS (SELECT user_id, count(*) AS attempts, count(*) FILTER (WHERE event_type = 'error') AS failures, arg_max(event_type = 'error', ts) AS last FROM events GROUP BY 1)
SELECT user_id, attempts, failures, CASE WHEN NOT last THEN 'done' WHEN failures >= 3 THEN 'dead' ELSE 'waiting' END AS state, CASE WHEN last AND failures < 3 THEN pow(2, failures)::BIGINT END AS delay_s FROM g""")
def t04_retry_state(t: Tables) -> DataFrame:
    return J.retry_state(t.events, "user_id", "ts", F.col("event_type") == "error")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 5 >= 3 THEN 'fail' ELSE 'requeue' END AS action FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)")
def t05_orphan_recovery(t: Tables) -> DataFrame:
    queue = t.lineitem.where("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.orphans(t.orders.withColumn("attempts", F.col("o_custkey") % 5), queue, "o_orderkey", "attempts")


@query("SELECT event_id FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 300 SECOND")
def t06_stale_heartbeats(t: Tables) -> DataFrame:
    return J.stale(_with_now(t), "ts", F.col("now")).select("event_id")


@query("SELECT user_id AS job, ts AS at FROM events s WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'view' AND b.user_id = s.user_id AND b.ts > s.ts AND b.ts <= s.ts + INTERVAL 3 DAY)")
def t06_silent_jobs(t: Tables) -> DataFrame:
    """Clicks that no view of the same user followed within three days; the same join runs on streams."""
    of = lambda kind: t.events.where(F.col("event_type") == kind).select(F.col("user_id").alias("job"), F.col("ts").alias("at"))
    return E.silent_jobs(of("click"), of("view"), within="3 days")


@query("""WITH w AS (SELECT event_id, count(*) OVER w AS n FROM (SELECT *, floor(epoch(ts))::BIGINT AS s FROM events) WINDOW w AS (PARTITION BY event_type ORDER BY s RANGE BETWEEN 60 PRECEDING AND CURRENT ROW))
SELECT event_id, n AS in_window, n > 2 AS limited FROM w""")
def t07_rate_limit_window(t: Tables) -> DataFrame:
    return J.rate_limited(t.events, "event_type", "ts", 60, 2).select("event_id", "in_window", "limited")


@query("SELECT event_id FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 10 DAY AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def t10_retention(t: Tables) -> DataFrame:
    kept = t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("user_id"))
    return J.retention(_with_now(t), "ts", F.col("now"), 10, kept, "user_id").select("event_id")


@query("""WITH g AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 1800000000, true) AS fresh FROM events),
n AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, session::BIGINT AS session, count(*) AS events, min(ts) AS started, max(ts) AS ended FROM n GROUP BY 1, 2""")
def ext_session_windows(t: Tables) -> DataFrame:
    return J.sessions(t.events, "user_id", "ts")
