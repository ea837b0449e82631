"""Merges, file extraction and streams on hand-made rows."""

import json
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewell.operators import confidence, dedup, latest, rules
from tidewell.plans import ORACLES, QUERIES
from tidewell.sources import files, merge
from tidewell.streaming import jobs


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upsert_guards_and_keeps(spark):
    old = spark.createDataFrame([(1, "a", "open"), (2, "b", "done"), (None, "n", "open")], "k int, v string, s string")
    new = spark.createDataFrame([(1, None, "x"), (2, "c", "x"), (3, "d", "x"), (3, "d", "x"), (None, "m", "x")], "k int, v string, s string")
    got = merge.upsert(old, new, ["k"], guard=F.col("s") == "done", keep_old=True)
    assert rows(got) == sorted([(1, "a", "x"), (2, "b", "done"), (3, "d", "x"), (None, "m", "x")], key=str)


def test_versions(spark, tmp_path):
    path = str(tmp_path)
    merge.swap(spark.range(3).toDF("x"), path, 1)
    merge.swap(spark.range(5).toDF("x"), path, 2)
    assert merge.current(spark, path).count() == 5


def test_merge_chain_and_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (8, 7)], "id int, into int")
    nodes = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 7, 8)], "id int")
    assert rows(dedup.final_of_chain(edges, nodes)) == [(1, 3), (2, 3), (3, 3), (4, 4), (7, None), (8, None)]


def test_long_merge_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(100)] + [(200, 201), (201, 202), (202, 200)], "id int, into int")
    nodes = spark.createDataFrame([(k,) for k in [*range(101), 200, 201, 202]], "id int")
    assert rows(dedup.final_of_chain(edges, nodes)) == sorted([(k, 100) for k in range(101)] + [(200, None), (201, None), (202, None)], key=str)


def test_robust_stats_of_small_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 2.0), ("c", 1.0), ("c", 2.0), ("c", 4.0), ("c", 10.0), ("d", None)], "k string, v double")
    got = {r.k: r for r in confidence.robust_stats(df, ["k"], "v").collect()}
    assert set(got) == {"a", "b", "c"}
    assert (got["c"].median, got["c"].q1, got["c"].q3, got["c"].mad) == (3.0, 1.75, 5.5, 1.5)
    assert (got["b"].iqr, got["b"].mad) == (0.0, 0.0)


def test_rules(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0)], "k int, v double")
    assert rows(rules.anomalies(df, "k", [("range", "warning", rules.out_of_range("v", 6, 9))])) == [(2, "range", "warning")]


def test_ordered_union_and_top(spark):
    a, b = spark.createDataFrame([(1, 1), (2, 2)], "id int, p int"), spark.createDataFrame([(2, 1), (3, 2)], "id int, p int")
    assert rows(latest.ordered_union([a, b], "id", "p")) == [(1, 0, 1), (2, 0, 2), (3, 1, 2)]


def test_crawl_and_extract(spark, tmp_path):
    (tmp_path / "keep").mkdir()
    (tmp_path / "zone").mkdir()
    (tmp_path / "keep/a.txt").write_text("héllo")
    (tmp_path / "keep/bad.docx").write_bytes(b"no zip")
    (tmp_path / "keep/x.bin").write_bytes(b"\0")
    (tmp_path / "zone/b.txt").write_text("hidden")
    with zipfile.ZipFile(tmp_path / "keep/d.docx", "w") as z:
        z.writestr("word/document.xml", "<p>Some  <b>text</b></p>")
    found = files.crawl(spark, str(tmp_path), reserved=[f"file:{tmp_path}/zone"])
    assert sorted(r.name for r in found.collect()) == ["a.txt", "bad.docx", "d.docx", "x.bin"]
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path / "keep"))
    content = content.withColumn("extension", F.lower(F.regexp_extract("path", "\\.([^./]+)$", 1)))
    got = {r.path.rsplit("/", 1)[1]: (r.status, r.text) for r in files.extract_text(content).collect()}
    assert got == {"a.txt": ("extracted", "héllo"), "bad.docx": ("error", None), "x.bin": ("unavailable", None), "d.docx": ("extracted", "Some text")}


def test_stream_processes_each_task_once(spark, tmp_path):
    source, out, check = (str(tmp_path / d) for d in ("in", "out", "check"))
    (tmp_path / "in").mkdir()

    def drop(name, ids):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps({"id": i, "what": "w"}) for i in ids))

    def go():
        jobs.process_once(jobs.task_stream(spark, source, "id int, what string"), "id", lambda b: b.withColumn("done", F.lit(True)), out, check).awaitTermination()

    drop("1.json", [1, 2, 2])
    go()
    drop("2.json", [2, 3])
    go()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_retry_states(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 1, True), ("c", 1, True), ("c", 2, True), ("c", 3, True)], "k string, at int, failed boolean")
    assert rows(jobs.retry_state(df, "k", "at", F.col("failed"))) == [("a", 2, 1, "done", None), ("b", 1, 1, "waiting", 2), ("c", 3, 3, "dead", None)]


def test_near_pairs_equal_all_pairs(spark):
    names = ["small red ring", "small red rings", "smal red ring", "big blue bolt", "big bleu bolt", "x", "", None, "small red ring"]
    df = spark.createDataFrame(list(enumerate(names)), "k int, n string")
    got = {(r.a, r.b) for r in dedup.near_pairs(df, "k", "n", (), 0.55).collect()}
    grams = lambda s: {f"  {w} "[i : i + 3] for w in (s or "").split() for i in range(len(w) + 1)}
    want = {(i, j) for i in range(9) for j in range(i + 1, 9) if names[i] and names[j] and names[i] != names[j] and len(grams(names[i]) & grams(names[j])) / len(grams(names[i]) | grams(names[j])) >= 0.55}
    assert got == want


def test_pairs_and_classes_hold_equal_titles(spark):
    names = ["small red ring", "small red rings", "Small  red RING", "big blue bolt", "--", "--", "", None, "small red ring"]
    df = spark.createDataFrame(list(enumerate(names)), "k int, n string")
    classes = dedup.title_classes(df, "k", "n").collect()
    assert sorted((r.k, r.first, r.n) for r in classes) == [(0, 0, 3), (1, 1, 1), (2, 0, 3), (3, 3, 1), (8, 0, 3)]
    got = {(r.a, r.b) for r in dedup.near_pairs(df, "k", "n").collect()} | {(a.k, b.k) for a in classes for b in classes if a.k < b.k and a.first == b.first}
    assert got == {(0, 1), (0, 2), (0, 8), (1, 2), (1, 8), (2, 8)}


@pytest.mark.parametrize("name", ["tidewell.plans", "__spark_entry__"])
def test_imports(name):
    __import__(name)


def test_lines_of_words_with_unknown_places_equal_sql(spark, tmp_path):
    words = [(1, 1, 10.0, "a"), (1, 2, 11.0, "b"), (1, 3, 20.0, "c"), (1, 4, None, "n"), (1, None, 21.0, "x"), (1, 5, 21.0, None), (2, 1, None, "only"), (3, 1, 5.0, None), (3, 2, 9.0, "d"), (None, 1, 1.0, "p")]
    frame = spark.createDataFrame(words, "l_orderkey bigint, l_linenumber int, l_quantity double, l_returnflag string")
    frame.write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    assert rows(QUERIES["x01_words_to_lines"](spark, str(tmp_path))) == sorted(con.execute(ORACLES["x01_words_to_lines"]).fetchall(), key=str)


def test_near_pairs_of_many_copies_equal_sql(spark, tmp_path):
    names = ["large green copper bolt", "large green copper bolts", "small red tin nut"]
    parts = [(k, names[k % 3], "b1", [None, "x", "y"][k % 5 % 3]) for k in range(450)]  # 150 records of a title are several blocks
    odd = [(None, names[0], "b1", "x"), (1, names[0], "b1", "x"), (900, None, "large green copper bolt b1", "x")]
    spark.createDataFrame(parts + odd, "p_partkey bigint, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    want = con.execute(ORACLES["j03_near_pairs"]).fetchall()
    found = QUERIES["j03_near_pairs"](spark, str(tmp_path))
    assert rows(found) == sorted(want, key=str) and len(want) > 20_000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode(b_ks") < plan.index("SortMergeJoin")  # records are told apart after the joins


def test_near_pairs_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dedup, "PAIRS", 2_000)
    names = ["large green copper bolt", "Large green  copper bolt", "large green copper bolts", "large green copper bolted"]
    low, high, mixed = [(k, names[2]) for k in range(100)], [(k, names[0]) for k in range(1000, 1150)], [(k, names[k % 4]) for k in range(500, 700)]
    same = [(50, names[0]), (1001, names[2]), (1002, names[2]), (1002, names[3]), (-5, names[3]), (None, names[0])]  # a key under several titles is no pair with itself
    parts = [(k, n, "b1", [None, "x", "y"][(k or 0) % 3]) for k, n in low + high + mixed + same]
    spark.createDataFrame(parts, "p_partkey bigint, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    found = QUERIES["j03_near_pairs"](spark, str(tmp_path))
    by_title = {}
    for k, n, *_ in parts:
        by_title.setdefault(" ".join(n.lower().split()), []).append(k)
    titles = sorted(by_title)
    scored = {(r.t, r.t2) for r in dedup._similar_titles(spark.createDataFrame([(f"{t} b1",) for t in titles], "t string"), 0.8).collect()}
    want = [(min(a, b), max(a, b)) for t in titles for t2 in titles if (f"{t} b1", f"{t2} b1") in scored for a in by_title[t] for b in by_title[t2] if None not in (a, b) and a != b]
    assert sorted((r.a, r.b) for r in found.collect()) == sorted(want) and len(want) > 30_000
    assert found.rdd.getNumPartitions() >= len(want) // 2_000
