"""The pipeline's stages, each on its own input, against plain Python."""

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from tidewell.llm import mixing

from test_nearcopies import firsts


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    from tidewell.llm.common import Table

    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = Table(stage(spark, docs, sf_dir), name).df
        out[name] = (before.toPandas(), docs.toPandas())
    return out


def test_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    for name in names[:-1]:
        assert list(stages[name][1].columns) == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language_stage_keeps_texts(stages):
    before, after = stages["language_id"]
    assert set(after.doc_id) == {d for d, t in zip(before.doc_id, before.text) if any(c.isalpha() for c in t)}


def test_language_stage_rejects_what_is_uncertain(docs_of):
    """The decision is the model's: with a higher bound more go, and a model without labels keeps all texts with letters."""
    from tidewell.llm import langid

    docs = docs_of([(k, "the cat and the dog " * 9, "en") for k in range(60)] + [(100 + k, "der hund und die katze " * 9, "de") for k in range(60)] + [(300, "ωχ ψη", None), (301, "12", None), (302, None, None)])
    model = langid.fit(docs)
    scores = {r.doc_id: r.score for r in langid.identify(docs, model).collect()}
    for least in (0.0, 0.3, 0.6, 0.9):
        kept = {r.doc_id for r in langid.keep_identified(docs, model, least).collect()}
        assert kept == {d for d, s in scores.items() if s >= least and d not in (301, 302)}
    blank = docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "source")
    assert {r.doc_id for r in langid.keep_identified(blank, langid.fit(blank)).collect()} == set(scores) - {301, 302}


def test_one_document_a_group(stages):
    """The stage's rule: five words, 0.8 (operator 8's own query keeps to 2 bits of three-word fingerprints)."""
    before, after = stages["simhash_near_dedup"]
    assert sorted(after.doc_id) == firsts(list(zip(before.doc_id, before.text, strict=True)))


def test_leaks_go(stages, sf_dir):
    before, after = stages["decontaminate"]
    items = pq.read_table(f"{sf_dir}/benchmark.parquet").to_pandas().text
    holds = {d for d, t in zip(before.doc_id, before.text) if any(i.strip(" .").lower() in t.lower() for i in items)}
    assert holds and not holds & set(after.doc_id)
    assert set(before.doc_id) - set(after.doc_id) == holds


def test_mix_stage(stages):
    before, after = stages["mix_sources"]
    counts = after.groupby("doc_id").size()
    assert counts.max() <= mixing.MOST and set(counts.index) <= set(before.doc_id)


def test_tokens_stage(stages):
    before, after = stages["token_store"]
    assert sorted(before.doc_id) == sorted(after.doc_id)
    rows = after.sort_values("start")
    assert (rows.start.iloc[1:].values == (rows.start + rows.n_tokens).iloc[:-1].values).all()
    assert rows.doc_id.is_monotonic_increasing
