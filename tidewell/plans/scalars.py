"""Scalar functions on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fields as E
from ..functions import text as T
from ..functions import values as V
from ..operators import quality as A
from ..operators import retrieval as R
from .registry import Tables, query
from .search import extent_sql, _FOLD, _GRAMS, key_sql, tokens_sql


@query("SELECT doc_id, md5(trim(regexp_replace(" + _FOLD.format(c="text") + r", '[\s\x{a0}\x{202f}\x{2007}]+', ' ', 'g'))) AS digest FROM documents")
def f02_title_key(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(T.title_key(F.col("text"))).alias("digest"))


@query(f"SELECT doc_id, md5(trim(regexp_replace({key_sql('text')}, '[^0-9a-z]+', ' ', 'g'))) AS digest FROM documents")
def f03_variant_key(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(T.variant_key(F.col("text"))).alias("digest"))


@query("""WITH f AS (SELECT p_brand AS k, CASE WHEN p_partkey % 3 = 0 THEN upper(p_type) ELSE p_type END AS form, count(*) AS n FROM part GROUP BY 1, 2)
SELECT k, first(form ORDER BY n DESC, length(form), form) AS majority, sum(n)::BIGINT AS n FROM f GROUP BY 1""")
def f04_majority_spelling(t: Tables) -> DataFrame:
    written = F.concat(F.lit(" ; "), F.when(F.col("p_partkey") % 3 == 0, F.upper("p_type")).otherwise(F.col("p_type")), F.lit(" . "))
    return A.majority(t.part.select(F.col("p_brand").alias("k"), T.canonical_form(written).alias("form")), ["k"], "form")


@query(f"""WITH q AS (SELECT {_GRAMS.format(ws="['hot', 'ring']")} AS g), p AS (SELECT p_partkey, {tokens_sql("p_name")} AS ws FROM part), {extent_sql("hot ring", "p_partkey", "p_name", "part")}
SELECT p_partkey, round(len(list_intersect(q.g, {_GRAMS.format(ws="ws")})) / len(list_distinct(list_concat(q.g, {_GRAMS.format(ws="ws")})))::DOUBLE, 6) AS similarity,
round(CASE WHEN score >= 0.3 THEN score ELSE 0 END, 6)::DOUBLE AS word_similarity FROM q, p LEFT JOIN extents ON p_partkey = id""")
def f05_trigram_similarities(t: Tables) -> DataFrame:
    name = F.col("p_name")
    return t.part.select("p_partkey", F.round(T.trigram_similarity(T.trigrams(name), T.trigrams(F.lit("hot ring"))), 6).alias("similarity"), F.round(T.word_similarity(F.lit("hot ring"), name), 6).alias("word_similarity"))


@query("""WITH k AS (SELECT p_partkey, regexp_replace(upper(substr(p_type, 1, 3) || '-' || p_partkey), '[^A-Z0-9]', '', 'g') AS key FROM part)
SELECT p_partkey, key, regexp_full_match(key, '[A-Z]{2,4}[0-9]{2,6}|[0-9]{2,6}[A-Z]{1,4}') AS shaped FROM k""")
def f06_reference_shape(t: Tables) -> DataFrame:
    key = T.reference_key(F.concat(F.substring("p_type", 1, 3), F.lit("-"), F.col("p_partkey").cast("string")))
    return t.part.select("p_partkey", key.alias("key"), T.has_reference_shape(key).alias("shaped"))


@query("SELECT p_partkey, 'bavaria ' || p_name || ' ' || p_partkey || ' s 2.5' AS key FROM part")
def f07_model_key(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.model_key(F.concat(F.lit("BAV. "), F.col("p_name"), F.lit(" - "), F.col("p_partkey").cast("string"), F.lit("S/2,5"))).alias("key"))


@query("SELECT o_orderkey, o_totalprice AS decimal_value, try_cast(regexp_extract(o_orderpriority, '[0-9]+') AS BIGINT) AS integer_value FROM orders")
def f08_first_numbers(t: Tables) -> DataFrame:
    told = F.concat(F.lit("total "), F.replace(F.col("o_totalprice").cast("decimal(15,2)").cast("string"), F.lit("."), F.lit(",")), F.lit(" euros"))
    return t.orders.select("o_orderkey", V.first_decimal(told).alias("decimal_value"), V.first_integer(F.col("o_orderpriority")).alias("integer_value"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 < 3 THEN round_even(l_quantity * [1.0, 0.01, 0.001][(l_linenumber % 4 + 1)::INT]::DOUBLE, 3) END AS metres FROM lineitem")
def f09_unit_conversion(t: Tables) -> DataFrame:
    unit = F.element_at(F.array(F.lit("m"), F.lit("cm"), F.lit("mm"), F.lit("ft")), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return t.lineitem.select("l_orderkey", "l_linenumber", V.to_metres(F.col("l_quantity"), unit).alias("metres"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN p_size + 0.5 END::DOUBLE AS grammage FROM part")
def f11_grammage(t: Tables) -> DataFrame:
    sign = F.element_at(F.array(F.lit(",5 g/m²"), F.lit(".5 G / m2"), F.lit(",5 oz")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return t.part.select("p_partkey", V.grammage(F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), sign)).alias("grammage"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN true WHEN 'view' THEN false END AS told FROM events")
def f13_french_boolean(t: Tables) -> DataFrame:
    word = F.when(F.col("event_type") == "click", " Oui, double").when(F.col("event_type") == "view", "NON").otherwise("à voir")
    return t.events.select("event_id", V.french_boolean(word).alias("told"))


@query("SELECT p_partkey, p_name AS name, CASE WHEN p_size > 10 THEN p_type END AS detail, p_brand || '+' || p_type AS pieces FROM part")
def f14_name_and_detail(t: Tables) -> DataFrame:
    both = V.name_and_detail(F.concat("p_name", F.when(F.col("p_size") > 10, F.concat(F.lit(" ("), F.col("p_type"), F.lit(")"))).otherwise(F.lit(" ()"))))
    pieces = V.parts(F.concat(F.col("p_brand"), F.lit(" · ; "), F.col("p_type"), F.lit("|")))
    return t.part.select("p_partkey", both["name"].alias("name"), both["detail"].alias("detail"), F.array_join(pieces, "+").alias("pieces"))


@query("SELECT p_partkey, p_size + 0.5 AS first, p_retailprice AS second FROM part WHERE p_size IS NOT NULL UNION ALL SELECT p_partkey, 3.0, 4.0 FROM part WHERE p_size > 25")
def f17_paired_dimensions(t: Tables) -> DataFrame:
    text = F.concat(F.lit("cut "), F.col("p_size").cast("string"), F.lit(",5 x "), F.col("p_retailprice").cast("string"), F.when(F.col("p_size") > 25, " and 3 × 4 m").otherwise(" and 3"))
    return t.part.select("p_partkey", F.inline(E.paired_dimensions(text))).select("p_partkey", "first", "second")


@query("""WITH f AS (SELECT p_partkey, CASE WHEN p_size > 25 OR p_partkey % 4 = 0 THEN 3 ELSE 2 END AS found, CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END AS suspects FROM part)
SELECT p_partkey, found, suspects, round((found - suspects) / 3.0, 4)::DOUBLE AS confidence FROM f""")
def f18_field_confidence(t: Tables) -> DataFrame:
    # a note that holds another label has bled into it
    note = F.when(F.col("p_partkey") % 4 == 0, F.lit("old owner:x")).otherwise(F.lit("old"))
    owner = F.when(F.col("p_size") > 25, F.concat(F.lit("; owner: "), F.col("p_name"))).otherwise(F.lit("; owner: "))
    values = E.field_values(F.concat(F.lit("Brand: "), F.col("p_brand"), F.lit("; note: "), note, owner), ["brand", "note", "owner"])
    return t.part.select("p_partkey", F.size(values).alias("found"), F.size(F.filter(values, lambda v: v["suspect"])).alias("suspects"), E.field_confidence(values, 3).alias("confidence"))


@query("""WITH h AS (SELECT doc_id, contains(text, 'license')::INT + contains(text, 'token')::INT AS s, contains(text, ' the ')::INT + contains(text, ' der ')::INT + contains(text, ' que ')::INT AS w FROM documents)
SELECT doc_id, CASE WHEN (s > 0 AND s + w >= 2) OR s + w >= 3 THEN 'technical' ELSE 'plan' END AS class FROM h""")
def f20_anchor_class(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", E.anchor_class(F.col("text"), ["license", "token"], [" the ", " der ", " que "]).alias("class"))


@query("""WITH v AS (SELECT p_partkey, list_contains(string_split(lower(p_name), ' '), 'gear')::INT + list_contains(string_split(lower(p_name), ' '), 'ring')::INT + (list_contains(string_split(lower(p_name), ' '), 'bolt') OR list_contains(string_split(lower(p_name), ' '), 'bolts'))::INT AS hits FROM part),
b AS (SELECT l_partkey, floor(l_quantity / 10) AS bucket, count(*) AS n FROM lineitem GROUP BY 1, 2), a AS (SELECT l_partkey, sum(CASE WHEN n >= 3 THEN n ELSE 0 END) / sum(n)::DOUBLE AS aligned FROM b GROUP BY 1)
SELECT p_partkey, round(0.6 * hits / 3 + 0.4 * coalesce(aligned, 0), 6) AS score FROM v LEFT JOIN a ON l_partkey = p_partkey""")
def f21_structure_score(t: Tables) -> DataFrame:
    places = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").alias("x"))
    return A.structure_score(t.part.select("p_partkey", F.split(F.lower("p_name"), " ").alias("words")), places, "p_partkey", ["gear", "ring", "bolt"])


@query("SELECT doc_id FROM documents WHERE length(trim(coalesce(text, ''))) < 40")
def f22_needs_ocr(t: Tables) -> DataFrame:
    return t.documents.where(V.needs_ocr(F.col("text"), 40)).select("doc_id")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'dimension' WHEN 'view' THEN 'material' WHEN 'error' THEN 'option' ELSE 'header' END AS family FROM events")
def f23_field_family(t: Tables) -> DataFrame:
    prefix = F.when(F.col("event_type") == "click", "dim_").when(F.col("event_type") == "view", "mat_").when(F.col("event_type") == "error", "opt_").otherwise("")
    return t.events.select("event_id", E.field_family(F.concat(prefix, "event_type")).alias("family"))


@query("SELECT p_partkey, CASE WHEN contains(lower(p_name), 'gear') THEN 'gear' WHEN contains(lower(p_name), 'ring') THEN 'ring' WHEN p_size > 25 THEN lower(p_type) ELSE 'other' END AS category FROM part")
def f24_category(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", E.category(F.upper("p_name"), F.when(F.col("p_size") > 25, F.lower("p_type")), ["gear", "ring"]).alias("category"))


_CODE = "nullif(regexp_replace(regexp_extract({c}, '^([A-Z]{{2,4}}[-_ ]?[0-9]{{2,6}}|[0-9]{{2,6}}[-_ ]?[A-Z]{{1,4}})([^A-Z0-9]|$)', 1), '[-_ ]', '', 'g'), '')"


@query(f"SELECT o_orderkey, coalesce({_CODE.format(c="'AB-' || o_orderkey || ' PLAN.PDF'")}, {_CODE.format(c="'ZZ_' || o_custkey")}) AS code FROM orders")
def f25_code_from_name(t: Tables) -> DataFrame:
    file = F.concat(F.lit("ab-"), F.col("o_orderkey").cast("string"), F.lit(" plan.pdf"))
    return t.orders.select("o_orderkey", E.code_from_name(file, F.concat(F.lit("ZZ_"), F.col("o_custkey").cast("string"))).alias("code"))


@query("""SELECT o_orderkey, split_part(o_orderpriority, '-', 2) AS part, strftime(o_orderdate, '%Y') AS told, month(date_trunc('quarter', o_orderdate)) AS quarter, greatest(o_custkey, o_orderkey) AS most, least(o_custkey, o_orderkey) AS fewest, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS nf, left(o_orderpriority, 3) || right(o_orderpriority, 2) AS ends FROM orders""")
def f26_sql_scalars(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey", F.split_part("o_orderpriority", F.lit("-"), F.lit(2)).alias("part"), F.date_format("o_orderdate", "yyyy").alias("told"), F.month(F.date_trunc("quarter", "o_orderdate")).cast("long").alias("quarter"),
        F.greatest("o_custkey", "o_orderkey").alias("most"), F.least("o_custkey", "o_orderkey").alias("fewest"), F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("nf"), F.concat(F.left("o_orderpriority", F.lit(3)), F.right("o_orderpriority", F.lit(2))).alias("ends"),
    )


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 3 THEN NULL ELSE l_quantity END::DOUBLE AS value, [NULL, 'mm', 'kg', NULL][(l_linenumber % 4 + 1)::INT] AS unit, CASE l_linenumber % 4 WHEN 0 THEN l_quantity WHEN 1 THEN round(l_quantity * 0.001, 6) WHEN 2 THEN l_quantity END::DOUBLE AS common FROM lineitem")
def r14_dimension_asked(t: Tables) -> DataFrame:
    number = F.format_string("%.1f", F.col("l_quantity"))
    text = F.element_at(F.array(F.concat(F.lit("genoa "), number), F.concat(number, F.lit(" MM luff")), F.concat(F.lit("sail "), F.replace(number, F.lit("."), F.lit(",")), F.lit("kg")), F.lit("sheet 2024")), (F.col("l_linenumber") % 4 + 1).cast("int"))
    asked = E.dimension_asked(text)
    return t.lineitem.select("l_orderkey", "l_linenumber", asked["value"].alias("value"), asked["unit"].alias("unit"), E.common_value(asked["value"], asked["unit"]).alias("common"))


@query("SELECT event_id, round(CASE event_type WHEN 'click' THEN value * 0.01 WHEN 'view' THEN value * 0.001 WHEN 'error' THEN value / 1000 ELSE value END, 6) AS common FROM events")
def r15_common_units(t: Tables) -> DataFrame:
    unit = F.when(F.col("event_type") == "click", "cm").when(F.col("event_type") == "view", "mm").when(F.col("event_type") == "error", "g")
    return t.events.select("event_id", E.common_value(F.col("value"), unit).alias("common"))


@query("""WITH w AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS ws FROM part) SELECT p_partkey, CASE WHEN ws[1] = 'hot' AND ws[2] = 'gear' THEN 'warm wheel' WHEN ws[2] = 'ring' THEN ws[1] || ' loop' ELSE array_to_string(ws, ' ') END AS expanded FROM w""")
def r16_synonym_expansion(t: Tables) -> DataFrame:
    phrases = t.spark.createDataFrame([("hot gear", "warm wheel"), ("gear", "gear"), ("ring", "loop")], "phrase string, target string")
    return R.expand(t.part, "p_partkey", F.split(F.lower("p_name"), " "), phrases)
