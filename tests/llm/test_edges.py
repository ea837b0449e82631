"""Every operator and stage: empty tables, nulls, empty and long texts, ties, repeated rows, clashing columns."""

import pytest

from tidewell.llm import decontaminate, langid, licenses, mixing, pii, secrets, simhash, substrings, tokenstore, topk

LONG = " ".join(f"word{i}" for i in range(60_000))
ROWS = [(1, "the cat sat on the mat token=abcdef1234"), (1, "the cat sat on the mat token=abcdef1234"), (2, None), (None, "no id here"), (3, ""), (4, " \t\n"), (5, LONG, "fr", None), (6, "é" * 50, None, "src1")]

OPS = {
    "secrets": secrets.scan_secrets,
    "licenses": licenses.scan_licenses,
    "langid": lambda d: langid.identify(d, langid.fit(d)),
    "pii": pii.find_personal_data,
    "simhash": simhash.near_duplicates,
    "substrings": substrings.without_repeats,
    "tokenstore": lambda d: tokenstore.TokenStore.write(d).read(),
}


@pytest.mark.parametrize("name", OPS)
def test_one_row_for_each_row(docs_of, name):
    assert OPS[name](docs_of(ROWS)).count() == len(ROWS)


@pytest.mark.parametrize("name", OPS)
def test_empty_table(docs_of, name):
    assert OPS[name](docs_of([])).count() == 0


def test_mixing_edges(docs_of):
    rows = mixing.decisions(docs_of(ROWS)).collect()
    assert sum(r.n for r in rows) == len(ROWS)
    assert all(0 <= r.copies <= 3 for r in rows)
    assert mixing.decisions(docs_of([])).count() == 0
    assert mixing.mixed(docs_of(ROWS)).columns == docs_of(ROWS).columns


def test_decontamination_edges(spark, docs_of):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, None), (3, ""), (4, "x")], "item_id long, text string")
    docs = docs_of([*ROWS, (9, "so alpha beta gamma delta epsilon zeta eta theta it is")])
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()} == {(9, 1)}
    assert decontaminate.leaks(docs_of([]), bench).count() == 0
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0
    kept = decontaminate.without_leaks(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)


def test_topk_edges(spark):
    schema = "vec_id long, embedding array<float>, label int"
    rows = [(0, [0.5, 0.5], 1), (50, [0.5, 0.5], 1), (1, None, 1), (2, [None, 1.0], 1), (3, [float("nan"), 1.0], 1), (4, [float("inf"), 1.0], 1), (5, [0.5, 0.5], 1), (6, [0.5, 0.5], 1), (None, [1.0, 1.0], 1), (7, [1.0], 1), (8, [], 1)]
    got = topk.top_k(spark.createDataFrame(rows, schema)).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 5), (0, 2, 6), (0, 3, 50), (50, 1, 0), (50, 2, 5), (50, 3, 6)]
    assert topk.top_k(spark.createDataFrame([], schema)).count() == 0


def test_keep_one_edges(docs_of):
    kept = simhash.keep_one(docs_of(ROWS))
    assert kept.columns == docs_of(ROWS).columns
    ids = [r.doc_id for r in kept.collect()]
    # the empty texts 2, 3, 4 are one component; the repeated row stays once
    assert sorted(x for x in ids if x is not None) == [1, 2, 5, 6] and ids.count(None) == 1
