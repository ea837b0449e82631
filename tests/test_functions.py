import datetime

import pytest
from pyspark.sql import functions as F

from tidewell.functions import query as P
from tidewell.functions import text as T
from tidewell.functions import values as V


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "key"),
    [("Génois  lourd", "genois lourd"), ("Œuvre\u00a0Æ", "oeuvre ae"), ("e\u0301te\u0301", "ete"), ("Straße", "strasse"), (None, ""), ("  ", "")],
)
def test_search_key(spark, raw, key):
    assert one(spark, T.search_key, raw) == key


def test_keys(spark):
    assert one(spark, T.variant_key, "Medium-OCÉAN, ") == "medium ocean"
    assert one(spark, T.reference_key, "st-101 b") == "ST101B"
    assert one(spark, T.canonical_form, " ; Lazy-bag  2P. ") == "Lazy-bag 2P"
    assert one(spark, T.canonical_form, " .,") is None
    assert one(spark, T.model_key, "Bav. 45.1-CC") == "bavaria 45.1 cc"
    assert one(spark, T.model_key, "BAVARIA-45") == one(spark, T.model_key, "Bavaria 45")
    assert one(spark, lambda c: T.has_reference_shape(T.reference_key(c)), "K-903") is False
    assert one(spark, lambda c: T.has_reference_shape(T.reference_key(c)), "ST 545") is True


def test_trigrams(spark):
    assert sorted(one(spark, T.trigrams, "ab a")) == ["  a", " a ", " ab", "ab "]
    sim = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(F.round(T.trigram_similarity(T.trigrams(F.col("a")), T.trigrams(F.col("b"))), 4)).first()[0]
    assert sim("word", "word") == 1.0 and sim("", "") == 0.0 and sim("word", "two words") == pytest.approx(4 / 11, abs=1e-4)
    near = spark.createDataFrame([("word", "two words here")], "a string, b string").select(T.word_similarity(F.col("a"), F.col("b"))).first()[0]
    assert near == pytest.approx(4 / 5)


def test_values(spark):
    assert one(spark, V.first_decimal, "about -3,25 m") == -3.25
    assert one(spark, V.first_decimal, "none") is None
    assert one(spark, V.dimension_metres, "660 cm") == 6.6
    assert one(spark, V.dimension_metres, "3 x 4 m") is None
    assert one(spark, V.french_date, "1er août 2024") == datetime.date(2024, 8, 1)
    assert one(spark, V.french_date, "31/02/2024") is None
    assert one(spark, V.french_boolean, "Oui, deux") is True and one(spark, V.french_boolean, "peut-être") is None
    assert one(spark, V.grammage, "Dacron 285 g/m²") == 285.0
    assert one(spark, V.parts, "a · b;;c|") == ["a", "b", "c"]
    assert tuple(one(spark, V.name_and_detail, "Spi (asym)")) == ("Spi", "asym")


@pytest.mark.parametrize(
    ("text", "value", "unit", "name", "rest"),
    [("SLU 6,60", 6.6, None, "slu_m", ""), ("spi 660 cm", 660.0, "cm", None, "spi"), ("têtière 15", 15.0, None, "tetiere_cm", ""), ("grand voile 2024 6,60", 6.6, None, None, "grand voile 2024")],
)
def test_dimensions(text, value, unit, name, rest):
    d = P.parse_dimension(text)
    assert (d.value, d.unit, d.name, d.rest) == (value, unit, name, rest)


def test_not_dimensions():
    assert P.parse_dimension("spi exemplia 2026") is None and P.parse_dimension("29er k903") is None
    for text in ("6,6", "6.60 m", "660 cm", "6600 mm"):
        assert P.parse_dimension(text).common() == 6.6
    assert P.parse_dimension("tetiere 150 mm").for_dimension("tetiere_cm") == 15.0
    assert P.parse_dimension("3400 g").common() == 3.4


def test_queries():
    assert P.parse_reference("lazy bag ST545") == "ST545" and P.parse_reference("ST 101") == "ST101" and P.parse_reference("bonjour") is None
    spec = P.parse_query('"Grand Océan" spi -vieux')
    assert (spec.phrases, spec.required, spec.excluded) == ((("grand", "ocean"),), ("spi",), ("vieux",))
    assert P.expand_synonyms(["gv", "full", "batten"], {("full", "batten"): ("lattee",), ("full",): ("x",)}) == ["gv", "lattee"]
