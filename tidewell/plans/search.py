"""Retrieval queries on the driver tables: lexical, trigram, vector, fusion, facets, suggestions."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import query as P
from ..functions import text as T
from ..functions import values as V
from ..operators import compare as K
from ..operators import completions as Z
from ..operators import index as X
from ..operators import latest as L
from ..operators import links as Y
from ..operators import retrieval as R
from ..operators import trigrams as G
from ..storage import shared_dir
from .registry import Tables, query

ASKED = "the that -loser"
_FOLD = "translate(lower(coalesce({c}, '')), 'àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž', 'aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz')"
_KEY = "trim(regexp_replace(replace(replace(replace(" + _FOLD + r", 'œ', 'oe'), 'æ', 'ae'), 'ß', 'ss'), '[\s\x{{a0}}\x{{202f}}\x{{2007}}]+', ' ', 'g'))"
_TOKENS = "list_filter(string_split(regexp_replace(" + _KEY + r", '[^\pL\pN]+', ' ', 'g'), ' '), lambda w: w <> '')"


def key_sql(column: str) -> str:
    return _KEY.format(c=column)


def tokens_sql(column: str) -> str:
    return _TOKENS.format(c=column)


def _tokens() -> dict[str, Column]:
    return {"A": T.tokens(F.col("text"))}


def documents_index(t: Tables) -> X.Index:
    """The stored index of the documents: made by the first search, read by the others."""
    return X.stored(t.documents, "doc_id", _tokens())


_LEXICAL = f"""lexical AS (SELECT 'lexical' AS source, doc_id AS id, round(len(list_filter(ws, lambda w: w IN ('the', 'that'))) / (1 + ln(greatest(len(list_distinct(ws)), 1))), 6) AS score
FROM (SELECT doc_id, {tokens_sql("text")} AS ws FROM documents) WHERE list_contains(ws, 'the') AND list_contains(ws, 'that') AND NOT list_contains(ws, 'loser'))"""


@query(f"WITH {_LEXICAL} SELECT * FROM lexical ORDER BY score DESC, id LIMIT 100")
def r04_lexical_topk(t: Tables) -> DataFrame:
    return documents_index(t).top(P.parse_query(ASKED), 100, covers=False)


def boolean_sql(spec: P.QuerySpec, documents: str = "documents") -> str:
    """Cover density by window functions over the places of the terms: what ``operators.index`` does over positions."""
    terms = list(dict.fromkeys(t.words for g in spec.groups for t in g))
    wanted = list(dict.fromkeys(t.words for g in spec.groups for t in g if not t.negated))
    told = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    places = " UNION ALL ".join(
        f"SELECT id, {k} AS leaf, i AS s, i + {len(ws) - 1} AS e FROM (SELECT id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d) WHERE ws[i:i+{len(ws) - 1}] = {told(ws)}" for k, ws in enumerate(terms)
    )
    holds = " OR ".join("(" + " AND ".join(f"count(*) FILTER (WHERE leaf = {terms.index(t.words)}) {'= 0' if t.negated else '> 0'}" for t in g) + ")" for g in spec.groups)
    last = ", ".join(f"max(s) FILTER (WHERE leaf = {terms.index(ws)}) OVER w AS l{k}" for k, ws in enumerate(wanted))
    group = lambda ks: f"CASE WHEN {' AND '.join(f'l{k} IS NOT NULL' for k in ks)} THEN least({', '.join(f'l{k}' for k in ks)}) END"
    reach = ", ".join(group([wanted.index(t.words) for t in g if not t.negated]) for g in spec.groups)
    words = " + ".join(f"CASE WHEN l{k} >= reach THEN {len(ws)} ELSE 0 END" for k, ws in enumerate(wanted))
    return f"""WITH d AS (SELECT doc_id AS id, {tokens_sql("text")} AS ws FROM {documents}), p AS ({places}),
m AS (SELECT id FROM p GROUP BY id HAVING {holds}),
o AS (SELECT DISTINCT id, e, {last} FROM p SEMI JOIN m USING (id) WHERE leaf IN ({", ".join(str(terms.index(ws)) for ws in wanted)}) WINDOW w AS (PARTITION BY id ORDER BY e RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
r AS (SELECT *, greatest({reach}, 0) AS reach FROM o), c AS (SELECT *, lag(reach, 1, 0) OVER (PARTITION BY id ORDER BY e) AS before FROM r),
s AS (SELECT id, sum(1.0::DOUBLE / (1 + greatest(0, e - reach + 1 - ({words})))) AS covers FROM c WHERE reach > before GROUP BY id)
SELECT 'lexical' AS source, id, round(covers / (1 + ln(greatest(len(list_distinct(ws)), 1))), 6) AS score FROM s JOIN d USING (id)"""


BOOLEAN = P.parse_query('"all rights reserved" or license -loser or "of the" that')


@query(boolean_sql(BOOLEAN))
def r04_boolean_search(t: Tables) -> DataFrame:
    return documents_index(t).search(BOOLEAN)


@query(boolean_sql(BOOLEAN) + " ORDER BY score DESC, id LIMIT 20")
def r04_boolean_topk(t: Tables) -> DataFrame:
    return documents_index(t).top(BOOLEAN, 20)


def _changed(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id % 5 = 0").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" under the License, all rights reserved")))


@query(boolean_sql(BOOLEAN, "(SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN coalesce(text, '') || ' under the License, all rights reserved' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0)"))
def r04_search_after_changes(t: Tables) -> DataFrame:
    """A fifth of the documents replaced and a seventh deleted in the stored index, then the segments merged."""
    spark = t.documents.sparkSession
    made = X.Index(spark, f"{shared_dir(spark)}/changed-{uuid.uuid4().hex}").create(t.documents.where("doc_id % 3 > 0"), "doc_id", _tokens())
    made.add(t.documents.where("doc_id % 3 = 0"), "doc_id", _tokens())
    made.add(_changed(t.documents), "doc_id", _tokens())
    made.delete(t.documents.where("doc_id % 7 = 0").select(F.col("doc_id").alias("id")))
    made.merge()
    return made.search(BOOLEAN)


@query(f"""WITH d AS (SELECT doc_id AS id, {key_sql("source")} AS name, {tokens_sql("text")} AS ws FROM documents), f AS (SELECT id, name, len(ws) AS n, len(list_filter(ws, lambda w: starts_with(w, 'moti'))) AS a, len(list_filter(ws, lambda w: starts_with(w, 'idio'))) AS b FROM d)
SELECT id, CASE WHEN name = 'moti idio' THEN 0 WHEN contains(name, 'moti idio') THEN 1 ELSE 2 END AS match_class, round((a + b) / greatest(n, 1)::DOUBLE + CASE WHEN a > 0 AND b > 0 THEN 0.5 ELSE 0 END, 6) AS score FROM f WHERE a > 0 OR b > 0""")
def r03_prefix_or_search(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "source", F.explode(F.array(T.tokens(F.col("text")))).alias("ws"))
    return R.prefix_search(docs, "doc_id", F.col("source"), F.col("ws"), ["moti", "idio"])


_GRAMS = "list_distinct(flatten(list_transform({ws}, lambda w: list_transform(range(1, length(w)::BIGINT + 2), lambda i: substr('  ' || w || ' ', i::BIGINT, 3)))))"


def extent_sql(query: str, key: str, column: str, table: str) -> str:
    """CTE ``extents`` (id, score): the best of all continuous extents of the ordered trigrams that begin and end at one of the query's."""
    ordered = "flatten(list_transform({ws}, lambda w: list_transform(range(1, length(w)::BIGINT + 2), lambda i: substr('  ' || w || ' ', i::BIGINT, 3))))"
    own = _GRAMS.format(ws=f"string_split('{query}', ' ')")
    return f"""own AS (SELECT {own} AS q), seqs AS (SELECT {key} AS id, {ordered.format(ws="ws")} AS s FROM (SELECT {key}, {tokens_sql(column)} AS ws FROM {table})),
hits AS (SELECT id, s, q, list_filter(range(1, len(s) + 1), lambda i: list_contains(q, s[i])) AS h FROM seqs, own),
ends AS (SELECT id, s, q, h, unnest(h) AS a FROM hits), stretches AS (SELECT id, q, list_distinct(s[a:b]) AS e FROM (SELECT id, s, q, a, unnest(list_filter(h, lambda b: b >= a)) AS b FROM ends)),
extents AS (SELECT id, max(len(list_intersect(e, q)) / (len(e) + len(q) - len(list_intersect(e, q)))::DOUBLE) AS score FROM stretches GROUP BY id)"""


@query(f"WITH {extent_sql('ringz', 'p_partkey', 'p_name', 'part')} SELECT 'trigram' AS source, id, round(score, 6) AS score FROM extents WHERE round(score, 6) > 0.3")
def r05_trigram_source(t: Tables) -> DataFrame:
    grams = G.stored(t.part, "p_partkey", F.col("p_name"))
    return G.trigram(t.part, "p_partkey", F.col("p_name"), "ringz", grams)


@query(f"""WITH q AS (SELECT {_GRAMS.format(ws="['hot', 'ringz']")} AS g), p AS (SELECT p_partkey AS id, {_GRAMS.format(ws=tokens_sql("p_name"))} AS t FROM part),
s AS (SELECT id, round(len(list_intersect(t, g)) / (len(t) + len(g) - len(list_intersect(t, g)))::DOUBLE, 6) AS score FROM p, q) SELECT id, score FROM s WHERE score >= 0.3""")
def r05_similar_titles(t: Tables) -> DataFrame:
    return G.stored(t.part, "p_partkey", F.col("p_name")).similar("hot ringz")


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 6) AS score FROM embeddings, q)
SELECT 'vector' AS source, id, score FROM s WHERE score IS NOT NULL ORDER BY score DESC, id LIMIT 50""")
def r07_vector_topk(t: Tables) -> DataFrame:
    own = t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    return R.vector(t.embeddings.crossJoin(F.broadcast(own)), "vec_id", "embedding", F.col("q"), 50)


@query("SELECT 'reference' AS source, c_custkey AS id, 1.0::DOUBLE AS score FROM customer WHERE regexp_replace(upper(coalesce(c_name, '')), '[^A-Z0-9]', '', 'g') = 'CUSTOMER000000042' OR regexp_replace(upper(coalesce(c_name, '')), '[^A-Z0-9]', '', 'g') = 'CUSTOMER42'")
def r08_reference_lookup(t: Tables) -> DataFrame:
    number = F.regexp_replace(T.reference_key(F.col("c_name")), "[^0-9]", "").try_cast("long")
    hit = R.reference(t.customer, "c_custkey", [F.col("c_name")], "CUSTOMER000000042")
    return hit.unionByName(R.reference(t.customer.where(number.isNotNull()), "c_custkey", [F.col("c_name")], "CUSTOMER42")).distinct()


@query(f"""WITH {_LEXICAL}, q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0),
vector AS (SELECT 'vector' AS source, vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 6) AS score FROM embeddings, q),
text AS (SELECT 'text' AS source, doc_id AS id, n_chars::DOUBLE AS score FROM documents),
r AS (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY score DESC, id) AS rank FROM (SELECT * FROM lexical UNION ALL SELECT * FROM vector UNION ALL SELECT * FROM text))
SELECT id, round(sum(1.0 / (60 + rank)), 8)::DOUBLE AS score, string_agg(source, ',' ORDER BY CASE source WHEN 'lexical' THEN 2 WHEN 'text' THEN 4 ELSE 5 END) AS sources FROM r WHERE rank <= 100 GROUP BY 1 ORDER BY score DESC, id LIMIT 50""")
def r13_rrf_fusion(t: Tables) -> DataFrame:
    own = t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    vectors = R.vector(t.embeddings.crossJoin(F.broadcast(own)), "vec_id", "embedding", F.col("q"), 100)
    longest = t.documents.select(F.lit("text").alias("source"), F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"))
    words = documents_index(t).top(P.parse_query(ASKED), 100, covers=False)
    fused = R.fuse([R.ranked(words), R.ranked(vectors), R.ranked(longest)])
    return fused.orderBy(F.desc("score"), "id").limit(50)


@query("""WITH a AS (SELECT * FROM (VALUES (5, 1), (7, 2), (9, 3)) v(id, position)), b AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS position FROM customer),
u AS (SELECT id, 0 AS list_no, position FROM a UNION ALL SELECT id, 1, position FROM b WHERE position <= 20)
SELECT id, m[1]::INT AS list_no, m[2]::BIGINT AS position FROM (SELECT id, min([list_no, position]) AS m FROM u GROUP BY id)""")
def u03_ordered_union(t: Tables) -> DataFrame:
    a = t.spark.createDataFrame([(5, 1), (7, 2), (9, 3)], "id long, position long")
    top = R.ranked(t.customer.select(F.lit("x").alias("source"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score")), 20)
    return L.ordered_union([a, top.select("id", F.col("rank").cast("long").alias("position"))], "id", "position")


@query("""WITH r AS (SELECT c_custkey AS id, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer)
SELECT id, round(1.0 / (60 + rank), 8)::DOUBLE AS score, 'text' AS sources, id IN (3, 77) AS exact FROM r WHERE rank <= 100""")
def o10_promotion(t: Tables) -> DataFrame:
    ranked = R.ranked(t.customer.select(F.lit("text").alias("source"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score")))
    return R.promote(R.fuse([ranked]), t.customer.where(F.col("c_custkey").isin(3, 77)).select(F.col("c_custkey").alias("id")))


_AXES = ("p_brand", "p_type", "p_size")


@query("""WITH f AS (SELECT *, p_brand = 'Brand#1' AS fb, p_size::VARCHAR = '10' AS fs FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Brand#1' ELSE p_brand END AS p_brand, p_type, CASE WHEN p_partkey % 3 = 0 THEN 10 ELSE p_size END AS p_size FROM part)),
c AS (SELECT 'p_brand' AS axis, p_brand AS value, count(*) AS n FROM f WHERE fs AND p_brand IS NOT NULL GROUP BY 2
UNION ALL SELECT 'p_type', p_type, count(*) FROM f WHERE fb AND fs AND p_type IS NOT NULL GROUP BY 2
UNION ALL SELECT 'p_size', p_size::VARCHAR, count(*) FROM f WHERE fb AND p_size IS NOT NULL GROUP BY 2)
SELECT axis, value, n FROM (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY n DESC, value) AS k FROM c) WHERE k <= 20""")
def r10_facets_multi_axis(t: Tables) -> DataFrame:
    part = t.part.withColumns({"p_brand": F.when(F.col("p_partkey") % 2 == 0, "Brand#1").otherwise(F.col("p_brand")), "p_size": F.when(F.col("p_partkey") % 3 == 0, 10).otherwise(F.col("p_size"))})
    return R.facets(part, _AXES, {"p_brand": "Brand#1", "p_size": "10"})


@query("""WITH m AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part), b AS (SELECT least(floor((p_retailprice - lo) / ((hi - lo) / 5)), 4) AS k, lo, hi FROM part, m WHERE p_retailprice IS NOT NULL)
SELECT round(lo + k * ((hi - lo) / 5), 6) AS low, round(CASE WHEN k = 4 THEN hi ELSE lo + (k + 1) * ((hi - lo) / 5) END, 6) AS high, count(*) AS n FROM b GROUP BY k, lo, hi""")
def r11_numeric_facet_buckets(t: Tables) -> DataFrame:
    return R.numeric_facet(t.part, "p_retailprice")


@query("SELECT l_tax::DOUBLE AS low, l_tax::DOUBLE AS high, count(*) AS n FROM lineitem WHERE l_tax IS NOT NULL GROUP BY 1, 2")
def r11_numeric_facet_values(t: Tables) -> DataFrame:
    return R.numeric_facet(t.lineitem, "l_tax")


@query("""WITH h AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem), f AS (
SELECT *, least(abs(l_quantity - 25.5), abs(l_extendedprice - 25.5)) AS distance FROM h WHERE l_quantity BETWEEN 25.3725 AND 25.6275 OR l_extendedprice BETWEEN 24000 AND 24200)
SELECT l_orderkey, l_linenumber, round(distance, 6) AS distance FROM f""")
def p08_dimension_tolerance_any(t: Tables) -> DataFrame:
    low, high = P.bounds(P.parse_dimension("quantité 25,5").value)
    near = K.any_within(["l_quantity"], low, high) | K.any_within(["l_extendedprice"], 24000, 24200)
    return t.lineitem.where(near).select("l_orderkey", "l_linenumber", F.round(L.nearest(t.lineitem, 25.5, ["l_quantity", "l_extendedprice"]), 6).alias("distance"))


@query(f"""WITH v AS (SELECT DISTINCT 'part' AS nature, p_name AS value FROM part UNION ALL SELECT DISTINCT 'nation', n_name FROM nation UNION ALL SELECT DISTINCT 'region', r_name FROM region UNION ALL SELECT DISTINCT 'segment', c_mktsegment FROM customer),
k AS (SELECT nature, value, {key_sql("value")} AS key FROM v WHERE value IS NOT NULL),
s AS (SELECT *, len(list_intersect({_GRAMS.format(ws=tokens_sql("key"))}, {_GRAMS.format(ws="['am']")})) / len(list_distinct(list_concat({_GRAMS.format(ws=tokens_sql("key"))}, {_GRAMS.format(ws="['am']")})))::DOUBLE AS fuzzy FROM k),
r AS (SELECT nature, value, key, CASE WHEN key = 'am' THEN 0 WHEN starts_with(key, 'am') THEN 2 WHEN fuzzy > 0.3 THEN 3 END AS rank,
round(CASE WHEN key = 'am' THEN 1.0 WHEN starts_with(key, 'am') THEN 0.70 + 0.25 * 2 / length(key)::DOUBLE ELSE fuzzy END, 6)::DOUBLE AS score FROM s)
SELECT nature, value, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rank, score DESC, value, nature) AS place FROM r WHERE rank IS NOT NULL) WHERE place = 1""")
def r19_suggestions_prefix(t: Tables) -> DataFrame:
    return _completions(t).suggestions("am")


def _completions(t: Tables) -> Z.Completions:
    values = [(t.part, "part", "p_name"), (t.nation, "nation", "n_name"), (t.region, "region", "r_name"), (t.customer, "segment", "c_mktsegment")]
    return Z.stored(reduce(DataFrame.unionByName, [df.select(F.lit(nature).alias("nature"), F.col(c).alias("value")) for df, nature, c in values]))


@query(f"""WITH v AS (SELECT DISTINCT 'part' AS nature, p_name AS value FROM part UNION ALL SELECT DISTINCT 'nation', n_name FROM nation UNION ALL SELECT DISTINCT 'region', r_name FROM region UNION ALL SELECT DISTINCT 'segment', c_mktsegment FROM customer),
k AS (SELECT key, min((value, nature)) AS v FROM (SELECT nature, value, {key_sql("value")} AS key FROM v WHERE value IS NOT NULL) WHERE starts_with(key, 's') GROUP BY key)
SELECT (row_number() OVER (ORDER BY length(key), v[1], v[2]))::INT AS place, v[1] AS value, v[2] AS nature, key FROM k ORDER BY place LIMIT 12""")
def o08_completions(t: Tables) -> DataFrame:
    return _completions(t).complete("s")


@query("""SELECT doc_id, instr(lower(text), 'license') > 0 AS matched, CASE WHEN instr(lower(text), 'license') > 0 THEN substr(text, greatest(1, instr(lower(text), 'license') - 180), 360) ELSE substr(text, 1, 360) END AS piece FROM documents""")
def r18_snippet_window(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", (F.locate("license", F.lower("text")) > 0).alias("matched"), R.snippet(F.col("text"), "license").alias("piece"))


@query("""SELECT doc_id, instr(lower(text), 'idiot') > 0 AS matched, CASE WHEN instr(lower(text), 'idiot') > 0 THEN substr(text, greatest(1, instr(lower(text), 'idiot') - 180), 360) ELSE substr(text, 1, 360) END AS piece FROM documents""")
def r18_snippet_of_each(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", (F.locate("idiot", F.lower("text")) > 0).alias("matched"), R.snippet(F.col("text"), "idiot").alias("piece"))


@query("""WITH e AS (SELECT user_id AS id, value >= 50 AS matched, round(value, 4) AS score, CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 10 ELSE 20 END AS priority, event_id AS piece FROM events)
SELECT id, matched, score, priority, piece FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY matched DESC, score DESC, priority, piece) AS k FROM e) WHERE k = 1""")
def q02_best_evidence(t: Tables) -> DataFrame:
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 10).otherwise(20)
    return R.best_evidence(t.events.select(F.col("user_id").alias("id"), (F.col("value") >= 50).alias("matched"), F.round("value", 4).alias("score"), rank.alias("priority"), F.col("event_id").alias("piece")))


_MODELS = [(1, "Small-Ring", False), (1, "SMALL RINGS", True), (2, "Red Widget2", False), (3, "hot/gears", False), (4, "bolt blue", True)]


@query("""WITH w AS (SELECT p_partkey, list_filter(string_split(lower(p_name), ' '), lambda x: x <> '') AS ws FROM part), n AS (SELECT p_partkey, ws, unnest(range(1, len(ws) + 1)) AS place FROM w),
s AS (SELECT p_partkey, place, ws, unnest(range(1, 9)) AS length FROM n), p AS (SELECT p_partkey, place, length, array_to_string(ws[place:place + length - 1], ' ') AS phrase FROM s WHERE place + length - 1 <= len(ws)),
t(phrase, target) AS (SELECT DISTINCT split_part(lower(p_name), ' ', 1), 'first' FROM part UNION SELECT DISTINCT lower(p_name), 'whole' FROM part)
SELECT p_partkey, place::INT AS place, max(length)::INT AS length, arg_max(target, (length, target)) AS target FROM p JOIN t USING (phrase) GROUP BY 1, 2""")
def j16_synonym_spans(t: Tables) -> DataFrame:
    phrases = t.part.select(F.split_part(F.lower("p_name"), F.lit(" "), F.lit(1)).alias("phrase"), F.lit("first").alias("target"))
    phrases = phrases.unionByName(t.part.select(F.lower("p_name").alias("phrase"), F.lit("whole").alias("target"))).distinct()
    words = F.filter(F.split(F.lower("p_name"), " "), lambda w: w != "")
    return R.synonyms(t.part, "p_partkey", words, phrases).withColumnRenamed("at", "place")


@query(f"""WITH m(model_id, model_key, alias) AS (VALUES (1, 'small ring', false), (1, 'small rings', true), (2, 'red widget 2', false), (3, 'hot gears', false), (4, 'bolt blue', true)),
v AS (SELECT DISTINCT p_name, lower(p_name) AS k FROM part), g AS (SELECT p_name, k, model_id, model_key, alias, {_GRAMS.format(ws="string_split(k, ' ')")} AS x, {_GRAMS.format(ws="string_split(model_key, ' ')")} AS y FROM v, m),
t AS (SELECT p_name, model_id, CASE WHEN alias THEN 1 ELSE 0 END AS tier, 1.0::DOUBLE AS score FROM g WHERE k = model_key
UNION ALL SELECT p_name, model_id, tier, score FROM (SELECT p_name, model_id, CASE WHEN starts_with(model_key, k) THEN 2 ELSE 3 END AS tier, round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y)))::DOUBLE, 6) AS score FROM g WHERE len(list_intersect(x, y)) > 0) WHERE tier = 2 OR score >= 0.3)
SELECT p_name, model_id, tier, score FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY tier, score DESC, model_id) AS place FROM t) WHERE place = 1""")
def r24_model_match(t: Tables) -> DataFrame:
    models = t.spark.createDataFrame(_MODELS, "model_id int, name string, alias boolean").select("model_id", T.model_key(F.col("name")).alias("model_key"), "alias")
    return R.model_match(t.part, "p_name", models)


@query(f"""WITH m(model_id, model_key, alias) AS (VALUES (1, 'small ring', false), (1, 'small rings', true), (2, 'red widget 2', false), (3, 'hot gears', false), (4, 'bolt blue', true)),
w AS (SELECT p_partkey AS id, string_split('pour ' || lower(p_name), ' ') AS ws FROM part),
s AS (SELECT DISTINCT id, b - a + 1 AS words, array_to_string(ws[a:b], ' ') AS phrase FROM (SELECT id, ws, a, unnest(range(a, least(a + 8, len(ws) + 1))) AS b FROM (SELECT id, ws, unnest(range(1, len(ws) + 1)) AS a FROM w))),
e AS (SELECT id, model_id, CASE WHEN alias THEN 1 ELSE 0 END AS tier, CASE WHEN alias THEN 0.98 ELSE 1.0 END AS score, phrase FROM (SELECT *, max(words) OVER (PARTITION BY id) AS most FROM s JOIN m ON phrase = model_key) WHERE words = most),
b AS (SELECT id, model_id, 2 AS tier, round(0.70 + 0.25 * length(phrase) / length(model_key), 6) AS score, phrase FROM (SELECT *, max(length(phrase)) OVER (PARTITION BY id) AS most FROM s JOIN m ON starts_with(model_key, phrase) WHERE length(phrase) >= 3 AND id NOT IN (SELECT id FROM e)) WHERE length(phrase) = most),
l AS (SELECT id, phrase FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY length(phrase) DESC, phrase) AS k FROM s WHERE length(phrase) >= 4 AND id NOT IN (SELECT id FROM e UNION ALL SELECT id FROM b)) WHERE k <= 12),
g AS (SELECT id, model_id, phrase, {_GRAMS.format(ws=tokens_sql("phrase"))} AS x, {_GRAMS.format(ws="string_split(model_key, ' ')")} AS y FROM l, m),
f AS (SELECT id, model_id, 3 AS tier, round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y)))::DOUBLE, 6) AS score, phrase FROM g),
u AS (SELECT * FROM e UNION ALL SELECT * FROM b UNION ALL SELECT * FROM f WHERE score >= 0.3)
SELECT id AS p_partkey, model_id, tier, score::DOUBLE AS score, phrase FROM (SELECT *, row_number() OVER (PARTITION BY id, model_id ORDER BY tier, score DESC, phrase) AS place FROM u) WHERE place = 1""")
def r24_models_in_texts(t: Tables) -> DataFrame:
    models = t.spark.createDataFrame(_MODELS, "model_id int, name string, alias boolean").select("model_id", T.model_key(F.col("name")).alias("model_key"), "alias")
    return Y.model_links(t.part, "p_partkey", F.concat(F.lit("pour "), F.col("p_name")), models)


@query("""SELECT doc_id, length(c)::INT AS kept, md5(c) AS digest FROM (SELECT doc_id, """ + key_sql("text") + """ AS c FROM documents)""")
def f01_search_key(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.search_key(F.col("text")).alias("c")).select("doc_id", F.length("c").alias("kept"), F.md5("c").alias("digest"))


@query(f"SELECT doc_id, len(ws)::INT AS words, len(list_distinct(ws))::INT AS distinct_words, md5(array_to_string(ws, ' ')) AS digest FROM (SELECT doc_id, {tokens_sql('text')} AS ws FROM documents)")
def r01_tokens(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.tokens(F.col("text")).alias("ws")).select("doc_id", F.size("ws").alias("words"), F.size(F.array_distinct("ws")).alias("distinct_words"), F.md5(F.array_join("ws", " ")).alias("digest"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_quantity, ['m', 'cm', 'mm', 'ft'][(l_linenumber % 4 + 1)::INT] AS unit, l_quantity || CASE l_linenumber % 4 WHEN 0 THEN ' m' WHEN 1 THEN ' cm' WHEN 2 THEN ' mm' ELSE '' END AS told FROM lineitem)
SELECT l_orderkey, l_linenumber, round_even(l_quantity * CASE l_linenumber % 4 WHEN 1 THEN 0.01 WHEN 2 THEN 0.001 ELSE 1.0 END::DOUBLE, 3) AS metres FROM v""")
def f10_dimension_metres(t: Tables) -> DataFrame:
    unit = F.element_at(F.array(F.lit(" m"), F.lit(" cm"), F.lit(" mm"), F.lit("")), (F.col("l_linenumber") % 4 + 1).cast("int"))
    text = F.concat(F.replace(F.col("l_quantity").cast("string"), F.lit("."), F.lit(",")), unit)
    return t.lineitem.select("l_orderkey", "l_linenumber", V.dimension_metres(text).alias("metres"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::DATE::VARCHAR END AS literal, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate::DATE::VARCHAR END AS numeric FROM orders""")
def f12_french_dates(t: Tables) -> DataFrame:
    month = F.element_at(F.array(*[F.lit(m) for m in V.MONTHS]), F.month("o_orderdate"))
    literal = F.when(F.col("o_orderkey") % 2 == 0, F.concat_ws(" ", F.dayofmonth("o_orderdate").cast("string"), month, F.year("o_orderdate").cast("string"))).otherwise("le 31 fevrier 2024")
    numeric = F.when(F.col("o_orderkey") % 5 != 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise("32/13/2024")
    return t.orders.select("o_orderkey", V.french_date(literal).cast("string").alias("literal"), V.french_date(numeric).cast("string").alias("numeric"))
