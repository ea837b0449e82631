"""Models named in texts and the two-sided similarity join, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import links as K

MODELS = [(1, "bavaria 45", False), (2, "bavaria 45 cc", False), (2, "bav cc", True), (3, "dufour 310 grand large", False), (4, "sun odyssey", False), (5, "oceanis 40.1", False)]


def grams(t):
    return {f"  {w} "[i : i + 3] for w in t.replace(".", " ").split() for i in range(len(w) + 1)}


def alike(a, b):
    return len(grams(a) & grams(b)) / max(1, len(grams(a) | grams(b)))


def brute(text):
    ws = text.split()
    spans = {(m, " ".join(ws[i : i + m])) for i in range(len(ws)) for m in range(1, min(8, len(ws) - i) + 1)}
    found = [(m, i, (1, 0.98) if alias else (0, 1.0), p) for m, p in spans for i, k, alias in MODELS if k == p]
    if found:
        found = [(i, t, s, p) for m, i, (t, s), p in found if m == max(f[0] for f in found)]
    else:
        begun = [(len(p), i, 0.70 + 0.25 * len(p) / len(k), p) for _, p in spans if len(p) >= 3 for i, k, _ in MODELS if k.startswith(p)]
        found = [(i, 2, s, p) for n, i, s, p in begun if n == max(b[0] for b in begun)]
    if not found:
        tried = sorted({p for _, p in spans if len(p) >= 4}, key=lambda p: (-len(p), p))[:12]
        found = [(i, 3, round(alike(p, k), 6), p) for p in tried for i, k, _ in MODELS if round(alike(p, k), 6) >= 0.3]
    best = {}
    for i, t, s, p in found:
        best[i] = min(best.get(i, (t, -s, p)), (t, -s, p))
    return {(i, t, round(-s, 6), p) for i, (t, s, p) in best.items()}


def test_links_equal_all_comparisons(spark):
    pick = random.Random(3)
    words = ["bavaria", "45", "cc", "bav", "dufour", "310", "grand", "large", "sun", "odysey", "odyssey", "genois", "oceanis", "40", "bavarya", "voile", "du", "oceani"]
    texts = [(i, " ".join(pick.choice(words) for _ in range(pick.randint(1, 6)))) for i in range(120)] + [(900, "bavaria 45 cc"), (901, "zzzz"), (902, None), (903, "")]
    models = spark.createDataFrame(MODELS, "model_id int, model_key string, alias boolean")
    got = K.model_links(spark.createDataFrame(texts, "id long, t string"), "id", F.col("t"), models).collect()
    told = {i: {(r.model_id, r.tier, r.score, r.phrase) for r in got if r.id == i} for i, _ in texts}
    for i, t in texts:
        assert told[i] == (brute(t) if t else set()), t


@pytest.mark.parametrize("least", [0.3, 0.8])
def test_two_sides_equal_all_pairs(spark, least):
    pick = random.Random(int(least * 10))
    word = lambda: "".join(pick.choice("abc") for _ in range(pick.randint(1, 6)))
    left, right = ([f"{word()} {word()}" for _ in range(120)] for _ in range(2))
    got = K.similar(spark.createDataFrame([(x,) for x in left], "l string"), spark.createDataFrame([(x,) for x in right], "r string"), least)
    want = {(a, b, round(alike(a, b), 6)) for a in left for b in right if round(alike(a, b), 6) >= least}
    assert {tuple(r) for r in got.collect()} == want and want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
