"""Closest extents of trigrams and the stored trigram table, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.operators import trigrams as G
from tidewell.storage import shared_dir


def ordered(text):
    return [f"  {w} "[i : i + 3] for w in text.split() for i in range(len(w) + 1)]


def brute(query, text):
    own, s, best = set(ordered(query)), ordered(text), 0.0
    for a in range(len(s)):
        for b in range(a + 1, len(s) + 1):
            e = set(s[a:b])
            best = max(best, len(e & own) / len(e | own)) if own else 0.0
    return best if best >= 0.3 else 0.0


@pytest.fixture(scope="module")
def pairs():
    pick = random.Random(8)
    word = lambda: "".join(pick.choice("ab" if pick.random() < 0.5 else "abcde") for _ in range(pick.randint(1, 9)))
    made = [(word() if pick.random() < 0.7 else f"{word()} {word()}", " ".join(word() for _ in range(pick.randint(0, 5)))) for _ in range(250)]
    return [*made, ("word", "two words"), ("monofime", "voile monofilm lourde"), ("aaaab", "a" * 60 + "b"), ("ab", ""), ("", "ab"), ("abcd", "x " * 40 + "abcd")]


def test_word_similarity_is_the_best_extent(spark, pairs):
    df = spark.createDataFrame([(i, q, t) for i, (q, t) in enumerate(pairs)], "i int, q string, t string")
    got = {r.i: r.s for r in df.select("i", T.word_similarity(F.col("q"), F.col("t")).alias("s")).collect()}
    for i, (q, t) in enumerate(pairs):
        assert got[i] == pytest.approx(brute(q, t)), (q, t)


def test_known_values(spark):
    of = lambda q, t: spark.range(1).select(T.word_similarity(F.lit(q), F.lit(t))).first()[0]
    assert of("word", "two words") == pytest.approx(0.8)
    assert of("monofime", "voile Monofilm") > 0.3


@pytest.mark.parametrize("query", ["ringz", "monofime", "aab", "zzz", "two words"])
def test_the_stored_table_finds_what_the_scan_finds(spark, pairs, query):
    rows = [(i, t) for i, (_, t) in enumerate(pairs)] + [(900, "hot rings"), (901, "monofilm"), (902, None)]
    docs = spark.createDataFrame(rows, "id long, t string")
    grams = G.Grams(spark, f"{shared_dir(spark)}/grams-{random.random()}").create(docs, "id", F.col("t"))
    got = {r.id: r.score for r in G.trigram(docs, "id", F.col("t"), query, grams).collect()}
    want = {i: pytest.approx(s, abs=1e-6) for i, t in rows if t and (s := round(brute(query, t), 6)) > 0.3}
    assert got == (want if " " not in query else {})
    jaccard = lambda t: len(set(ordered(t)) & set(ordered(query))) / max(1, len(set(ordered(t)) | set(ordered(query))))
    assert {r.id: r.score for r in grams.similar(query).collect()} == {i: pytest.approx(jaccard(t), abs=1e-6) for i, t in rows if t and round(jaccard(t), 6) >= 0.3}
    assert "PushedFilters: [In(gram" in grams.candidates(query)._jdf.queryExecution().executedPlan().toString()


def test_a_long_text_takes_linear_time(spark):
    text = " ".join(f"w{i % 977}x" for i in range(20_000)) + " monofilm"
    assert spark.range(1).select(T.word_similarity(F.lit("monofime"), F.lit(text))).first()[0] > 0.3
