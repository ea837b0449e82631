"""Operators 11 to 13 against plain Python, with nulls, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import duckdb
import numpy as np
import pytest
import zstandard

from tidewell.llm import audit, clusters, suffixes
from tidewell.llm.queries import ORACLES, QUERIES

# --- the three queries, whole, against their SQL ------------------------------------------


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_centroid_clusters", "op13_suffix_dedup"])
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got, want = QUERIES[name](spark, sf_dir).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: Counter(map(tuple, df[sorted(df.columns)].astype(str).values.tolist()))
    assert rows(got) == rows(want)


# --- 11 ------------------------------------------------------------------------------------


def brute_audit(rows, labels):
    failed = []
    for doc, text, source in rows:
        text = text or ""
        ws = text.split(" ") if text else []
        ws = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(ws) < 50,
            "B": 100 * len(set(ws)) < 65 * len(ws),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in rows),
        }
        failed.append((source or "", fails, any(d == doc and q == 1 for d, q, _ in labels if doc is not None), any(d == doc and x == 1 for d, _, x in labels if doc is not None)))
    out, shapley = {}, Counter()
    for part in {p for p, *_ in failed}:
        own = [f for f in failed if f[0] == part]
        for order in map("".join, permutations("ABCDE")):
            gone = set()
            for step, f in enumerate(order, 1):
                here = [k for k, x in enumerate(own) if x[1][f]]
                removed = [k for k in here if k not in gone]
                told = [len(own) - len(gone) - len(removed), len(removed), len(here) - len(removed), sum(sum(own[k][1].values()) == 1 for k in here), sum(own[k][2] for k in removed), sum(own[k][3] for k in removed)]
                out[part, order, step] = told
                shapley[part, f] += len(removed)
                gone |= set(removed)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_edges(spark, docs_of):
    pick = random.Random(2)
    long = lambda n, k: " ".join(f"w{pick.randrange(k)}" for _ in range(n))
    rows = [(i, long(pick.choice([10, 49, 50, 80]), pick.choice([20, 60, 500])) + pick.choice(["", " #", " ABCDEFGHIJKLMNOPQRS" * 3, "\t\n"]), "en", pick.choice(["a", "b", None, ""])) for i in range(40)]
    rows += [(3, rows[0][1], "en", "b"), (0, rows[0][1], "en", "a"), (0, rows[0][1], "en", "b"), (None, rows[0][1], "en", "a"), (50, None), (51, ""), (52, None), (None, None), (53, "É" * 60, "en", "a"), (54, "a b " * 30_000, "en", "a")]
    rows = [(*r, "en", "src0")[:4] if len(r) == 2 else r for r in rows]
    labels = [(i, int(i % 2 == 0), int(i % 3 == 0)) for i in range(30)] + [(1, 1, 1), (None, 1, 1), (0, 0, 0)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS part", "1 AS n")
    got = audit.audit(docs_of(rows), marks).collect()
    told = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}
    assert told == brute_audit([(d, t, s) for d, t, _, s in rows], labels) and len(told) == len(got)


def test_audit_of_nothing(spark, docs_of):
    assert audit.audit(docs_of([]), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


# --- 12 ------------------------------------------------------------------------------------


def brute_clusters(rows, k, rounds, dims, scale=64):
    kept = [(i, [math.floor(Fraction(x) * scale) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in first[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        centroids = [[sum(col) // len(own[n]) for col in zip(*own[n], strict=True)] if own[n] else c for n, c in enumerate(centroids)]
    most = 2**63 - 1
    told = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    per = Counter()
    for _, c, d in told:
        per[c] += min(d, most)
    return sorted(((i, c, min(d, most), min(per[c], most), min(sum(per.values()), most), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in told), key=str)


def told_clusters(df):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("size", [1.0, 1e7, 1e20])
def test_clusters_equal_all_distances(spark, size):
    pick = np.random.default_rng(int(math.log10(size) + 1))
    rows = [(i, [float(x) for x in pick.normal(0, size, 6)]) for i in range(120)]
    rows += [(5, rows[5][1]), (None, rows[7][1]), (200, rows[9][1]), (201, None), (202, [1.0] * 5), (203, [1.0] * 5 + [None]), (204, [float("nan")] * 6), (205, [float("inf")] * 6), (206, []), (207, [0.0] * 6), (208, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS cluster", "'x' AS norms", "2 AS v")
    got = clusters.cluster(df, k=5, dims=6, segment=4)
    assert told_clusters(got) == brute_clusters(rows, 5, 3, 6)


def test_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert clusters.cluster(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, [0.5] * 64), (2, [0.5] * 64), (3, [-0.25] * 64)]
    assert told_clusters(clusters.cluster(spark.createDataFrame(rows, schema))) == brute_clusters(rows, 16, 3, 64)


def test_screening_spares_distances_where_vectors_gather(spark):
    pick = np.random.default_rng(3)
    middles = pick.normal(0, 4, (16, 64))
    rows = [(i, [float(x) for x in middles[i % 16] + pick.normal(0, 0.05, 64)]) for i in range(1600)]
    got = clusters.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).agg({"exact": "avg"}).first()[0]
    assert got < 8  # of 16


# --- 13 ------------------------------------------------------------------------------------


def symbols_of(regions):
    return np.array([x for r in regions for x in [*(b + 1 for b in r), 0]], dtype=np.int16)


def test_suffix_array_and_prefixes(monkeypatch):
    pick = random.Random(1)
    for trial in range(150):
        s = symbols_of([bytes(pick.choice(b"ab\x00\xff" if trial % 2 else b"a") for _ in range(pick.randint(1, 60))) for _ in range(pick.randint(1, 6))])
        monkeypatch.setattr(suffixes, "_LANES", pick.choice([1, 3, 4096]))
        order, rank, key = suffixes.suffix_array(s)
        end = lambda i: i + int(np.flatnonzero(s[i:] == 0)[0])
        want = sorted(range(len(s)), key=lambda i: [int(x) + len(s) for x in s[i : end(i)]] + [end(i)])
        assert order.tolist() == want and (order[rank] == np.arange(len(s))).all()

        def shared(i, j):
            n = 0
            while s[i + n] == s[j + n] != 0:
                n += 1
            return n

        for least in (1, 5, 20):
            alike = [False] + [shared(want[q], want[q - 1]) >= least for q in range(1, len(s))]
            assert suffixes.long_prefixes(s, order, rank, key, least).tolist() == alike


def test_shards_know_their_repeats():
    pick = random.Random(4)
    for _ in range(150):
        width, gram = pick.choice([(8, 4), (10, 3), (12, 6)])
        texts = [bytes(pick.choice(b"ab") for _ in range(pick.randint(width, 40))) for _ in range(pick.randint(1, 5))]
        shard = suffixes._Shard([len(t) for t in texts], zstandard.ZstdCompressor().compress(b"".join(texts)), width, gram)
        places, at = defaultdict(list), 0
        for t in texts:
            for i in range(len(t) - width + 1):
                places[t[i : i + width]].append(at + i)
            at += len(t)
        repeated = sorted(p for v in places.values() if len(v) > 1 for p in v)
        known, single, *_, more, _ = suffixes.classes(shard, np.unique(shard.anchor), 7)
        assert known.tolist() == repeated and single.tolist() == sorted(v[0] for v in places.values() if len(v) == 1)
        assert len(more) == sum(len(v) > 1 for v in places.values())
        alone, *_ = suffixes.classes(shard, np.empty(0, np.uint64), 7)
        assert alone.tolist() == repeated


def test_lists_are_merged_by_binary_search():
    pick = np.random.default_rng(0)
    lists = [np.unique(pick.integers(0, 60, n).astype(np.uint64)) for n in (0, 5, 9, 30, 1, 0, 12)]
    count = Counter(x for v in lists for x in v.tolist())
    assert suffixes.in_several(lists).tolist() == sorted(x for x, n in count.items() if n > 1)
    assert suffixes.in_several([]).tolist() == []


def brute_bytes(texts, width):
    places, out = defaultdict(list), []
    for d, t in enumerate(texts):
        for i in range(len(t) - width + 1):
            places[t[i : i + width]].append((d, i))
    gone = [bytearray(len(t)) for t in texts]
    for found in places.values():
        if len(found) > 1:
            for d, i in found:
                gone[d][i : i + width] = b"\x01" * width
    for t, g in zip(texts, gone, strict=True):
        out.append((bytes(b for b, x in zip(t, g, strict=True) if not x), len(re.findall(b"\x01+", bytes(g)))))
    return out


@pytest.mark.parametrize(("width", "gram", "shard"), [(12, 6, 40), (12, 6, 300), (200, 100, 2_000_000), (30, 10, 100)])
def test_removed_bytes_equal_brute_force(spark, docs_of, width, gram, shard):
    pick = random.Random(width + shard)
    passages = ["".join(pick.choice("abcé ") for _ in range(pick.randint(width // 2, 3 * width))) for _ in range(12)]
    rows = [(i, "".join(pick.choice([pick.choice(passages), "".join(pick.choice("abé") for _ in range(pick.randint(0, width)))]) for _ in range(pick.randint(0, 6)))) for i in range(40)]
    rows += [(0, rows[0][1]), (1, rows[1][1]), (50, None), (None, rows[2][1]), (51, ""), (52, "a" * 3 * width), (53, "ab" * 2 * width), (54, "x" * (width - 1)), (55, passages[0][: width - 1]), (56, "long " * 400 + passages[1])]
    got = suffixes.without_repeats(docs_of(rows), width, gram, shard).collect()
    told = Counter((r.doc_id, *suffixes.kept_bytes(bytes(r.text or b""), r.spans)) for r in got)
    want = brute_bytes([(t or "").encode() for _, t in rows], width)
    assert told == Counter((r[0], *w) for r, w in zip(rows, want, strict=True))


def test_suffixes_of_nothing(docs_of):
    assert suffixes.without_repeats(docs_of([])).count() == 0
    assert [r.spans for r in suffixes.without_repeats(docs_of([(1, None), (2, "short")])).collect()] == [None, None]
