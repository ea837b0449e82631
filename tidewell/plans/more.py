"""Further lookups, audits, predicates, sources and decisions on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import assistant as A
from ..operators import decisions as X
from ..operators import dedup as D
from ..operators import latest as L
from ..operators import listings as S
from ..operators import rules as U
from ..operators import search as H
from ..sources import merge as W
from .registry import Tables, query
from .search import key_sql, tokens_sql


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#3' AND p_type IN ('SMALL', 'ECONOMY') AND p_size BETWEEN 5 AND 30 AND p_name LIKE '%b%' AND NOT p_name ILIKE '%GEAR%' AND trim(coalesce(p_name, '')) <> '' AND p_retailprice IS DISTINCT FROM 900.2")
def p03_p13_predicates(t: Tables) -> DataFrame:
    low, high = F.lit("5").try_cast("int"), F.lit("30").try_cast("int")
    named = F.trim(F.coalesce("p_name", F.lit(""))) != ""
    return t.part.where((F.col("p_brand") == "Brand#3") & F.col("p_type").isin("SMALL", "ECONOMY") & F.col("p_size").between(low, high) & F.col("p_name").like("%b%") & ~F.col("p_name").ilike("%GEAR%") & named & ~F.col("p_retailprice").eqNullSafe(900.2)).select("p_partkey")


@query("SELECT p_partkey, CASE WHEN lower(p_name) = 'hot gear' THEN 'exact_name' WHEN contains(lower(p_name), 'gear') THEN 'name' WHEN contains(lower(p_type), 'small') THEN 'path' ELSE 'content' END AS match_type FROM part")
def p14_match_type(t: Tables) -> DataFrame:
    name = F.lower("p_name")
    kind = F.when(name == "hot gear", "exact_name").when(F.contains(name, F.lit("gear")), "name").when(F.contains(F.lower("p_type"), F.lit("small")), "path").otherwise("content")
    return t.part.select("p_partkey", kind.alias("match_type"))


@query("SELECT o_custkey, count(*) AS files, bool_or(o_orderstatus = 'F') AS has_final FROM orders GROUP BY 1")
def p15_generated_columns(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("files"), F.bool_or(F.col("o_orderstatus") == "F").alias("has_final"))


@query(f"""WITH e AS (SELECT doc_id AS id, len(list_filter({tokens_sql("text")}, lambda w: w = 'the'))::DOUBLE AS s FROM documents UNION ALL SELECT doc_id, quality * 10.0 FROM labels)
SELECT 'text' AS source, id, max(s) AS score FROM e GROUP BY id HAVING max(s) > 0""")
def r06_text_source(t: Tables) -> DataFrame:
    docs = t.documents.select(F.col("doc_id").alias("id"), F.size(F.filter(T.tokens(F.col("text")), lambda w: w == "the")).cast("double").alias("s"))
    other = t.labels.select(F.col("doc_id").alias("id"), (F.col("quality") * 10.0).alias("s"))
    return docs.unionByName(other).groupBy("id").agg(F.max("s").alias("score")).where("score > 0").select(F.lit("text").alias("source"), "id", "score")


@query("SELECT p_partkey, list_position(['SMALL', 'ECONOMY'], p_type)::BIGINT AS place FROM part WHERE p_type IN ('SMALL', 'ECONOMY')")
def r09_model_source(t: Tables) -> DataFrame:
    return L.by_given_order(t.part, "p_type", ["SMALL", "ECONOMY"]).select("p_partkey", F.col("place").cast("long").alias("place"))


@query(f"SELECT count(*) AS total FROM (SELECT doc_id FROM documents WHERE list_contains({tokens_sql('text')}, 'license') UNION SELECT doc_id FROM documents WHERE source = 'src7')")
def r12_exact_total(t: Tables) -> DataFrame:
    hits = t.documents.where(F.array_contains(T.tokens(F.col("text")), "license")).select("doc_id")
    return hits.union(t.documents.where("source = 'src7'").select("doc_id")).distinct().agg(F.count("*").alias("total"))


@query("SELECT doc_id, regexp_replace(source || '-x_' || doc_id || '/y', '[-_/]+', ' ', 'g') AS parted FROM documents")
def r17_separators(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.separators_to_spaces(F.concat("source", F.lit("-x_"), "doc_id", F.lit("/y"))).alias("parted"))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 25")
def r20_browse(t: Tables) -> DataFrame:
    find = H.HybridSearch(t.orders, "o_orderkey", {"A": T.tokens(F.col("o_orderpriority"))}, [F.col("o_orderstatus")], ["o_orderstatus"], recent=F.col("o_orderdate"))
    return find.run("", limit=25).page.select("o_orderkey")


@query("""WITH d AS (SELECT p_partkey AS id, lower(p_name) AS n FROM part WHERE p_type = 'SMALL'), l AS (SELECT id, row_number() OVER (ORDER BY id) AS rank FROM d WHERE n = 'hot gear')
SELECT id, round(1.0 / (60 + rank), 8)::DOUBLE AS score, 'lexical' AS sources FROM l ORDER BY score DESC, id LIMIT 20""")
def r21_hybrid_search(t: Tables) -> DataFrame:
    find = H.HybridSearch(t.part, "p_partkey", {"A": T.tokens(F.col("p_name"))}, [F.col("p_brand")], ["p_type", "p_brand"], dims=["p_retailprice"])
    return find.run("hot gear", {"p_type": "SMALL", "ignored": "x"}).page.select("id", "score", "sources")


@query("""WITH a AS (SELECT n_nationkey AS id, n_nationkey - 5 AS parent FROM nation WHERE n_nationkey >= 20)
SELECT replace(lower(n_name), '_', ' ') AS model_key, coalesce(a.parent, n_nationkey) AS model_id, a.parent IS NOT NULL AS alias FROM nation LEFT JOIN a ON id = n_nationkey""")
def r23_model_catalogue(t: Tables) -> DataFrame:
    nodes = t.nation.select(F.col("n_nationkey").alias("id"))
    merged = D.final_of_chain(nodes.where("id >= 20").select("id", (F.col("id") - 5).alias("into")), nodes)
    return t.nation.join(merged, F.col("n_nationkey") == F.col("id")).select(T.model_key(F.col("n_name")).alias("model_key"), F.col("final").alias("model_id"), (F.col("final") != F.col("id")).alias("alias"))


@query("SELECT s_suppkey, s_nationkey, s_acctbal AS value FROM supplier WHERE s_suppkey = 7")
def r27_value_of_code(t: Tables) -> DataFrame:
    intents = [A.Intent("value", r"balance of supplier (?P<code>\d+)", lambda code: A.value_of(t.supplier, "s_suppkey", code, "s_acctbal", "s_nationkey", "0"), "value")]
    return A.ask("What is the Balance of  supplier 7?", intents, lambda words: t.supplier.limit(0)).rows.select("s_suppkey", "s_nationkey", "value")


@query("SELECT p_partkey, p_retailprice AS value FROM part WHERE p_retailprice BETWEEN 905 AND 910")
def r28_codes_between(t: Tables) -> DataFrame:
    intents = [A.Intent("between", r"between (?P<a>\d+) and (?P<b>\d+)", lambda a, b: A.codes_between(t.part, "p_partkey", "p_retailprice", float(a), float(b)))]
    return A.ask("parts between 905 and 910", intents, lambda words: t.part.limit(0)).rows


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE contains(lower(c_name), '0042')")
def r29_attached_to(t: Tables) -> DataFrame:
    return A.attached_to(t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")), "o_orderkey", "c_name", "0042")


@query("SELECT count(*) AS n FROM orders WHERE contains(lower(o_orderpriority), 'urgent') AND year(o_orderdate) = 1995")
def r30_count_by_type_and_year(t: Tables) -> DataFrame:
    return A.counted(t.orders, "o_orderkey", "o_orderpriority", "urgent", 1995, "o_orderdate")[0]


@query("SELECT 'part' AS meaning, p_partkey::VARCHAR AS key, p_name AS value FROM part WHERE contains(p_name, 'ring') UNION ALL SELECT 'type', p_partkey::VARCHAR, p_type FROM part WHERE p_type = 'SMALL' AND p_size = 5")
def r32_interpretations(t: Tables) -> DataFrame:
    return A.interpretations({"part": t.part.where(F.contains("p_name", F.lit("ring"))).select("p_partkey", "p_name"), "type": t.part.where("p_type = 'SMALL' AND p_size = 5").select("p_partkey", "p_type")})


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'n/a' WHEN p_size > 25 THEN 'yes' ELSE 'no' END AS value FROM part WHERE p_partkey IN (4, 5)")
def r34_options(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.lit("large").alias("option"), (F.col("p_size") > 25).alias("flag"), F.when(F.col("p_partkey") % 2 == 0, "n/a").alias("told"))
    return A.option_of(rows, "p_partkey", 4, "large", "flag", "told").unionByName(A.option_of(rows, "p_partkey", 5, "large", "flag", "told"))


@query("""WITH a AS (SELECT l_orderkey AS record, l_returnflag AS field, l_linenumber AS rank FROM lineitem), x AS (SELECT l_orderkey AS record, l_returnflag AS field, l_linenumber AS rank, l_suppkey AS page FROM lineitem WHERE l_linenumber % 2 = 0), g AS (SELECT l_orderkey AS record, l_returnflag AS field, min(l_suppkey) AS page FROM lineitem GROUP BY 1, 2)
SELECT a.record, a.field, a.rank, coalesce(x.page, g.page) AS page FROM a LEFT JOIN x USING (record, field, rank) LEFT JOIN g ON a.record = g.record AND a.field = g.field""")
def r26_citations(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_orderkey").alias("record"), F.col("l_returnflag").alias("field"), F.col("l_linenumber").alias("rank"), F.col("l_suppkey").alias("page"))
    general = rows.groupBy("record", "field").agg(F.min("page").alias("page")).select("record", "field", F.lit(None).cast("int").alias("rank"), "page")
    return H.citations(rows.drop("page"), rows.where("rank % 2 = 0").unionByName(general))


@query("""SELECT p_partkey, regexp_replace(p_brand, '[-_/]+', ' ', 'g') || ' ' || p_name AS a, p_type || ' ' || printf('%.2f', p_retailprice) || ' ' || replace(printf('%.2f', p_retailprice), '.', ',') AS b, '' AS c FROM part""")
def r02_weighted_text(t: Tables) -> DataFrame:
    return H.search_text(t.part, "p_partkey", F.col("p_brand"), F.col("p_name"), [F.col("p_type")], F.lit(None).cast("string"), ["p_retailprice"])


@query("""WITH s AS (SELECT l_orderkey AS k, 'late' AS code, 'warning' AS severity FROM lineitem WHERE l_tax > 0.07 UNION SELECT l_orderkey, 'foreign', 'info' FROM lineitem WHERE l_tax < 0.01), f AS (SELECT l_orderkey AS k, 'late' AS code, 'warning' AS severity FROM lineitem WHERE l_tax > 0.05)
SELECT * FROM s WHERE code <> 'late' UNION SELECT * FROM f""")
def x08_replace_own(t: Tables) -> DataFrame:
    code = lambda c, s, where: t.lineitem.where(where).select(F.col("l_orderkey").alias("k"), F.lit(c).alias("code"), F.lit(s).alias("severity"))
    return U.replace_own(code("late", "warning", "l_tax > 0.07").unionByName(code("foreign", "info", "l_tax < 0.01")), code("late", "warning", "l_tax > 0.05"), "k", ["late"])


@query("SELECT l_orderkey, count(DISTINCT l_returnflag) > 1 AS disagree FROM lineitem GROUP BY 1")
def x07_disagreement(t: Tables) -> DataFrame:
    flags = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_returnflag")).alias("f"))
    return flags.select("l_orderkey", U.disagreement(F.get("f", F.lit(0)), F.get("f", F.lit(1)), F.get("f", F.lit(2))).alias("disagree"))


@query("""WITH c AS (SELECT o_orderkey, 'status' AS field, o_orderstatus AS canonical FROM orders UNION ALL SELECT o_orderkey, 'priority', lower(o_orderpriority) FROM orders), k AS (SELECT o_orderkey, 'status' AS field, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'X' END AS v FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'other', 'z' FROM orders WHERE o_orderkey % 100 = 0)
SELECT k.o_orderkey, k.field, CASE WHEN c.field IS NULL THEN 'not_propagable' WHEN c.canonical = k.v THEN 'coherent' ELSE 'divergent' END AS state FROM k LEFT JOIN c USING (o_orderkey, field)""")
def x12_correction_divergence(t: Tables) -> DataFrame:
    o, k = t.orders, F.col("o_orderkey")
    canonical = X.unpivot_text(o, "o_orderkey", {"status": F.col("o_orderstatus"), "priority": F.lower("o_orderpriority")}, "canonical")
    fixed = o.where(k % 3 == 0).select("o_orderkey", F.lit("status").alias("field"), F.when(k % 2 == 0, F.col("o_orderstatus")).otherwise("X").alias("v"))
    fixed = fixed.unionByName(o.where(k % 100 == 0).select("o_orderkey", F.lit("other").alias("field"), F.lit("z").alias("v")))
    return X.divergence(fixed, canonical, ["o_orderkey", "field"], "v", "canonical")


@query("""WITH m AS (SELECT p_partkey, p_brand, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS role FROM part), n AS (SELECT p_brand, role, count(*) AS total FROM m GROUP BY 1, 2), s AS (SELECT p_brand, role, w, count(*) AS same FROM m GROUP BY 1, 2, 3)
SELECT p_partkey, round(avg(round(same / total::DOUBLE, 3)), 5) AS share FROM m JOIN n USING (p_brand, role) JOIN s USING (p_brand, role, w) GROUP BY 1""")
def x23_material_agreement(t: Tables) -> DataFrame:
    m = t.part.select("p_partkey", "p_brand", F.posexplode(F.split("p_name", " ")).alias("role", "w"))
    return X.agreement(m, "p_brand", "p_partkey", "role", "w")


@query("""WITH k AS (SELECT n_regionkey, first(n_name ORDER BY length(n_name), n_name) AS canonical, count(*) AS n FROM nation GROUP BY 1) SELECT * FROM k""")
def x34_canonical_choice(t: Tables) -> DataFrame:
    return X.canonical_choice(t.nation, "n_regionkey", "n_name")


@query("""WITH l AS (SELECT o_orderkey AS k, 0 AS p, 'final' AS link FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 1, 'large' FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT o_orderkey, 2, 'urgent' FROM orders WHERE contains(o_orderpriority, 'URGENT'))
SELECT o_orderkey, arg_min(link, p) AS link FROM orders LEFT JOIN l ON k = o_orderkey GROUP BY 1""")
def x36_best_link(t: Tables) -> DataFrame:
    part = lambda name, where: t.orders.where(where).select("o_orderkey", F.lit(name).alias("link"))
    links = S.first_source([part("final", "o_orderstatus = 'F'"), part("large", "o_totalprice > 200000"), part("urgent", F.contains("o_orderpriority", F.lit("URGENT")))], ["o_orderkey"], "link")
    return t.orders.select("o_orderkey").join(links, "o_orderkey", "left").select("o_orderkey", "link")


@query("SELECT source, count(*) AS files, arg_max(doc_id, (lang = 'fr', n_chars, doc_id)) AS chosen FROM documents GROUP BY 1")
def x37_folder_plan(t: Tables) -> DataFrame:
    return X.folder_plan(t.documents, "source", "doc_id", F.col("lang") == "fr", F.col("n_chars"))



@query("""WITH f AS (SELECT lower(p_type) AS k, CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE lower(p_type) END AS form, count(*) AS n FROM part GROUP BY 1, 2), b AS (SELECT k, first(form ORDER BY n DESC, length(form), form) AS kept FROM f GROUP BY 1)
SELECT kept, form AS replaced, n FROM f JOIN b USING (k) WHERE form <> kept""")
def a37_correspondence(t: Tables) -> DataFrame:
    form = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_type")).otherwise(F.lower("p_type"))
    return X.correspondence(t.part.select(T.variant_key(F.col("p_type")).alias("k"), form.alias("form")), "k", "form")


@query("SELECT source, round(avg(quality), 6) AS score, count(quality) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def a27_record_score(t: Tables) -> DataFrame:
    return X.record_score(t.documents, t.labels, "doc_id", "source", "quality")


@query("SELECT lang, count(DISTINCT doc_id) AS usable FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY 1")
def a32_usable_evidence(t: Tables) -> DataFrame:
    return X.usable_evidence(t.documents, t.labels.where("quality IS NOT NULL"), "doc_id", "lang")


@query("""SELECT count(*) AS n, sum(('0x' || substr(md5(o_orderkey || '|' || o_custkey || '|' || coalesce(o_orderstatus, '~') || '|' || coalesce(o_orderpriority, '~')), 1, 8))::BIGINT)::BIGINT AS checksum, true AS equal FROM orders""")
def l01_table_checksum(t: Tables) -> DataFrame:
    """The checksum itself is compared, and told to be the same after the rows were dealt anew."""
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    a, b = W.text_checksum(t.orders, columns), W.text_checksum(t.orders.repartition(7, "o_custkey"), columns)
    return a.crossJoin(b.select(F.col("checksum").alias("other"))).select("n", "checksum", (F.col("checksum") == F.col("other")).alias("equal"))


@query("SELECT doc_id, source, lang FROM documents WHERE contains(source, 'src1') AND lang IN ('fr', 'de') ORDER BY doc_id LIMIT 30 OFFSET 5")
def l05_browse_catalogue(t: Tables) -> DataFrame:
    rows = t.documents.where(F.contains("source", F.lit("src1")) & F.col("lang").isin("fr", "de"))
    return L.page(rows, [F.asc("doc_id")], 5, 30).select("doc_id", "source", "lang")


@query("""WITH u AS (SELECT o_custkey AS k, o_orderkey AS x, 0 AS p FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, o_orderkey, 1 FROM orders WHERE o_totalprice > 150000 UNION ALL SELECT o_custkey, o_orderkey, 2 FROM orders) SELECT k, x, min(p) AS origin FROM u GROUP BY 1, 2""")
def l06_attachments(t: Tables) -> DataFrame:
    part = lambda where: t.orders.where(where).select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("x"), F.lit(None).cast("string").alias("v"))
    found = S.first_source([part("o_orderstatus = 'F'"), part("o_totalprice > 150000"), part("true")], ["k", "x"], "v")
    return found.select("k", "x", F.col("priority").alias("origin"))


@query("""WITH r AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 9 = 0 UNION ALL SELECT -1) SELECT k, CASE WHEN o_orderkey IS NULL THEN 'unknown' WHEN o_orderstatus <> 'O' THEN 'wrong_status' WHEN o_totalprice > 300000 THEN 'pending' ELSE 'ok' END AS outcome FROM r LEFT JOIN orders ON o_orderkey = k""")
def l09_batch_validation(t: Tables) -> DataFrame:
    asked = t.orders.where("o_orderkey % 9 = 0").select(F.col("o_orderkey").alias("k")).union(t.spark.createDataFrame([(-1,)], "k long"))
    state = t.orders.select(F.col("o_orderkey").alias("k"), "o_orderstatus", "o_totalprice")
    return X.batch_outcome(asked, state, "k", [("wrong_status", F.col("o_orderstatus") != "O"), ("pending", F.col("o_totalprice") > 300000)])


@query("SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations, count(*) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def l10_referential_listing(t: Tables) -> DataFrame:
    return X.referential_listing(t.region, t.nation, F.col("n_regionkey") == F.col("r_regionkey"), "r_name", "n_name").withColumnRenamed("names", "nations")


@query("""SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 'license' WHEN contains(lower(text), 'token') THEN 'token' END AS label FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL AND (contains(lower(text), 'license') OR contains(lower(text), 'token'))""")
def l13_erased_axes(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id", "left")
    return X.erased_axes(rows, "doc_id", "quality", F.col("text"), ["license", "token"])


@query("SELECT lang, count(*) FILTER (WHERE length(trim(text)) < 60) AS to_read, round(count(*) FILTER (WHERE length(trim(text)) < 60) * 0.69, 3)::DOUBLE AS seconds FROM documents GROUP BY 1")
def l17_ocr_inventory(t: Tables) -> DataFrame:
    n = F.count_if(V.needs_ocr(F.col("text"), 60))
    return t.documents.groupBy("lang").agg(n.alias("to_read"), F.round(n * 0.69, 3).alias("seconds"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 10)")
def l20_purge_gate(t: Tables) -> DataFrame:
    return X.unproven(t.orders, t.lineitem.where("l_quantity > 10").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("SELECT user_id, count(*) AS done FROM events WHERE event_id NOT IN (SELECT doc_id FROM documents) GROUP BY 1")
def t12_resume_work(t: Tables) -> DataFrame:
    return X.resume(t.events, t.documents.select(F.col("doc_id").alias("event_id")), "event_id").groupBy("user_id").agg(F.count("*").alias("done"))


@query(f"SELECT doc_id, md5(replace(replace({key_sql('text')}, '-', ' '), '_', ' ')) AS digest FROM documents")
def f15_type_key(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(F.translate(T.search_key(F.col("text")), "-_", "  ")).alias("digest"))


@query("SELECT o_orderkey, replace(replace(replace(format('{:,.2f}', o_totalprice), ',', '#'), '.', ','), '#', ' ') AS told FROM orders")
def f16_french_number(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", T.french_number(F.col("o_totalprice")).alias("told"))


@query("""WITH g AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, day, n, sum(n) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)::BIGINT AS week FROM g""")
def ext_rolling_week(t: Tables) -> DataFrame:
    days = t.events.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return days.withColumn("week", F.sum("n").over(Window.partitionBy("user_id").orderBy("day").rowsBetween(-6, 0)))
