"""Whole queries against plain versions: language predictions loop by loop, base personal data by SQL."""

import math
import zlib

import duckdb
import pytest

from tidewell.llm import langid
from tidewell.llm.queries import QUERIES
from tidewell.llm.sql import BASE_PERSONAL


def plain_prediction(model, text):
    """The contract of operator 3 in plain loops: folded letters, hashed n-grams, family, then votes within it."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    kept = [b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in text.lower().encode("utf-8", "surrogatepass")]
    b = [32, 32, *b" ".join(bytes(kept).split()), 32]
    counts = {}
    for i in range(2, len(b)):
        if b[i - 1] == 32 and b[i] == 32:
            continue
        three = (((b[i - 2] << 16 | b[i - 1] << 8 | b[i]) * 2654435761) % 2**32 >> 21) + 2048
        one = (b[i] * 2246822519) % 2**32 >> 21
        for place in (three, one):
            counts[place] = counts.get(place, 0) + 1
    total = sum(counts.values())
    margin = [sum(float(w[k]) * n for k, n in counts.items()) / max(1, total) + float(bias) for w, bias in zip(model.weights, model.bias, strict=True)]
    sure = [1 / (1 + math.exp(-2 * max(-30, min(30, m)))) for m in margin]
    many = len(model.groups) > 1
    g = max(range(len(model.groups)), key=lambda k: (margin[k], -k)) if many else 0
    first = len(model.groups) if many else 0
    told = {}
    for k in model.groups[g]:
        own = [sure[first + p] if a == k else 1 - sure[first + p] for p, (a, c) in enumerate(model.pairs) if k in (a, c)]
        told[k] = (sum(x >= 0.5 for x in own), sum(own), -k, min(own, default=1.0))
    best = max(told, key=lambda k: told[k][:3])
    return model.languages[best], (sure[g] if many else 1.0) * told[best][3]


def test_language_query_equals_plain_loops(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(docs)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = QUERIES["op3_language_id"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        language, score = plain_prediction(model, texts[r.doc_id])
        assert r.lang_pred == language and r.score == pytest.approx(score, abs=1e-4)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_base_personal_data_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    columns = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
    want = con.execute(BASE_PERSONAL).df()[columns]
    got = QUERIES["op10_personal_data"](spark, sf_dir).toPandas()[columns]
    rows = lambda df: sorted(map(tuple, df.values.tolist()))
    assert rows(got) == rows(want) and got.n_email.sum() > 0
