"""Filters, names, families, windows and workflow tables on hand-made rows, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.functions import query as P
from tidewell.functions import text as T
from tidewell.operators import dedup, families, filters, intake, retrieval, workflow
from tidewell.plans import QUERIES
from tidewell.sources import merge
from tidewell.streaming import jobs


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_names_are_free_whatever_is_taken(spark):
    wanted = spark.createDataFrame([(1, "x.txt"), (2, "x.txt"), (3, "x.txt"), (4, "x-2.txt"), (5, "y"), (6, "y"), (7, "z-03.pdf"), (8, "z-03.pdf")], "id int, name string")
    taken = spark.createDataFrame([("x.txt",), ("x-3.txt",), ("y-2",), ("z.pdf",)], "name string")
    got = dict(rows(merge.free_names(wanted, "name", taken)))
    assert got == {1: "x-4.txt", 2: "x-5.txt", 3: "x-6.txt", 4: "x-2.txt", 5: "y", 6: "y-3", 7: "z-03.pdf", 8: "z-03-2.pdf"}
    assert len(set(got.values()) | {r.name for r in taken.collect()}) == len(got) + 4
    assert merge.free_names(wanted, "name", taken.limit(0)).count() == 8 and merge.free_names(wanted.limit(0), "name", taken).count() == 0


def test_filters_ignore_what_is_unknown_and_wildcards_are_plain(spark):
    df = spark.createDataFrame([(1, "100% Éclair", 5.0), (2, "100x eclair", None), (3, None, 7.0)], "k int, n string, v double")
    spec = filters.FilterSpec(contains={"n": "n"}, ranges={"v": "v"})
    of = lambda asked: [r.k for r in filters.apply(df, spec, asked).orderBy("k").collect()]
    assert of({}) == [1, 2, 3] and of({"q": "1", "min_q": 2, "n": ""}) == [1, 2, 3]
    assert of({"n": "% ECLAIR"}) == [1] and of({"n": "eclair"}) == [1, 2]
    assert of({"min_v": "5,5"}) == [3] and of({"min_v": "many", "max_v": 6}) == [1]
    assert [r.k for r in df.where(filters.like_escaped(F.col("n"), "0% É")).collect()] == [1]
    with pytest.raises(ValueError):
        filters.known_column("v; DROP TABLE t", ["v"])


def test_rate_windows_cross_spans(spark):
    pick = random.Random(3)
    times = sorted(pick.choice([3590, 7195, 7200]) + pick.randint(0, 40) for _ in range(200))
    df = spark.createDataFrame([(k, k % 2, t) for k, t in enumerate(times)], "event_id int, k int, s long").withColumn("at", F.timestamp_seconds("s"))
    got = {r.event_id: r for r in jobs.rate_limited(df, "k", "at", 20, 5).collect()}
    assert len(got) == 200
    for k, t in enumerate(times):
        own = [x for j, x in enumerate(times) if j % 2 == k % 2 and t - 20 <= x <= t]
        assert (got[k].in_window, got[k].limited) == (len(own), len(own) > 5)
        assert got[k].retry_after == (min(own) + 21 - t if len(own) > 5 else 0)


def test_families_are_greedy_in_order(spark):
    pick = random.Random(9)
    sets = {"+".join(sorted(pick.sample("abcdefgh", pick.randint(1, 8)))): pick.randint(1, 30) for _ in range(60)}
    got = dict(rows(families.families(spark.createDataFrame(list(sets.items()), "layout string, pages int"), 0.7)))
    want, heads = {}, []
    for layout in sorted(sets, key=lambda x: (-sets[x], x)):
        own = set(layout.split("+"))
        want[layout] = next((h for h in heads if len(own & set(h.split("+"))) / len(own | set(h.split("+"))) >= 0.7), layout)
        heads += [layout] * (want[layout] == layout)
    assert got == want


def test_near_classes_stand_for_all_pairs(spark):
    pick = random.Random(5)
    names = ["small red ring", "small red rings", "Small  red RING", "big blue bolt", "big bleu bolt", "--", "", None]
    data = [(k, pick.choice(names), pick.choice(["x", "y", None])) for k in range(60)]
    df = spark.createDataFrame(data, "k int, n string, c string")
    got = dedup.near_classes(df, "k", "n", ["c"], 0.55).collect()
    key = lambda n: " ".join((n or "").lower().split())
    grams = lambda s: {f"  {w} "[i : i + 3] for w in "".join(c if c.isalnum() else " " for c in s).split() for i in range(len(w) + 1)}
    pairs = [(a, b) for a in data for b in data if a[0] < b[0] and grams(key(a[1])) and grams(key(b[1])) and len(grams(key(a[1])) & grams(key(b[1]))) >= 0.55 * len(grams(key(a[1])) | grams(key(b[1])))]
    assert sum(r.pairs for r in got) == len(pairs)
    assert sum(r.same_c for r in got) == sum(a[2] == b[2] for a, b in pairs)
    assert len(got) == len({frozenset((key(a[1]), key(b[1]))) for a, b in pairs})


def test_numbers_of_a_query():
    of = lambda t: [(f.whole, f.decimals, f.unit) for f in P.figures(t)]
    assert of("1 234,5 mm and 12.50") == [("1234", "5", "mm"), ("12", "50", "")]
    assert of("a12 3b 4.5.6 7m²") == [("4", "5", ""), ("7", "", "m²")]
    assert of("6,60 M x 3 mètres") == [("6", "60", "M"), ("3", "", "mètres")]
    assert P.parse_reference("12/ABC") == "12ABC" and P.parse_reference("12/ABCDE") is None and P.parse_reference("k 12-ab, x") == "12AB"


def test_stale_corrections_change_nothing(spark):
    records = spark.createDataFrame([(1, "a", 1), (2, "b", 4)], "k int, v string, revision int")
    asked = spark.createDataFrame([(1, "x", 1), (1, "y", 1), (2, "z", 3), (9, "q", 1)], "k int, value string, expected int")
    after, history = workflow.corrected(records, asked, "k", "v")
    assert rows(after) == [(1, "x", 2), (2, "b", 4)] and rows(history) == [(1, "x", "applied"), (2, "z", "stale")]


def test_requests_decisions_and_notes(spark):
    asked = spark.createDataFrame([("a", 2), ("a", 1), ("b", 1)], "k string, at int")
    pending = spark.createDataFrame([("b",)], "k string")
    assert rows(workflow.new_requests(asked, pending, "k", "at")) == [("a", 1)]
    requests = spark.createDataFrame([("a", "pending"), ("b", "refused")], "k string, status string")
    decided = spark.sql("SELECT 'a' AS k, TIMESTAMP '2024-01-01' AS decided_at, 'granted' AS verdict UNION ALL SELECT 'a', TIMESTAMP '2024-01-02', 'refused' UNION ALL SELECT 'b', TIMESTAMP '2024-01-01', 'granted'")
    assert [(r.k, r.status, str(r.open_until)) for r in workflow.decide(requests, decided, "k").orderBy("k").collect()] == [("a", "granted", "2024-01-02 00:00:00"), ("b", "refused", "None")]


def test_uploads_tell_their_first_gap(spark):
    chunks = spark.createDataFrame([("a", 0, 5), ("a", 0, 5), ("a", 2, 5), ("b", 1, 5), ("c", 0, 5), ("c", 1, 5)], "s string, n int, size int")
    expected = spark.createDataFrame([("a", 3), ("b", 2), ("c", 2), ("d", 1)], "s string, chunks int")
    assert rows(workflow.upload_state(chunks, "s", "n", F.col("size"), expected)) == [("a", 2, 10, 1, False), ("b", 1, 5, 0, False), ("c", 2, 10, None, True), ("d", 0, 0, 0, False)]


def test_automatic_links_of_any_number_stay_automatic(spark, tmp_path):
    events = [(1, 1200, "view"), (2, 7, "click"), (3, None, "click"), (4, 1200, "click"), (5, None, "view"), (6, 7, None)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.id: (r.link, r.category) for r in QUERIES["m01_relinked"](spark, str(tmp_path)).collect()}
    assert got == {1: (1200, "auto"), 2: (1007, "human"), 3: (None, "human"), 4: (2200, "human"), 5: (None, "auto"), 6: (7, "auto")}


def test_links_from_either_end_are_dealt_by_their_number(spark, monkeypatch):
    pairs = [(i % 40, i % 7 + 20) for i in range(300)] + [(None, 1), (3, 3)]
    links = spark.createDataFrame(pairs, "a long, b long")
    monkeypatch.setattr(dedup, "ROWS", 50, raising=False)
    got = dedup.links_both_ways(links)
    assert got.rdd.getNumPartitions() == 13
    assert rows(got) == sorted({x for a, b in pairs for x in ((a, b), (b, a))}, key=str)
