"""Operators against plain Python on small fixtures."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from tidewell.llm import decontaminate, langid, licenses, mixing, pii, queries, secrets, simhash, substrings, tokenstore, topk

WORDS = [f"w{i}" for i in range(400)]


@pytest.fixture(scope="module")
def table():
    return pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pandas()


def run(spark, name, sf_dir):
    return queries.QUERIES[name](spark, sf_dir).toPandas()


# --- 2 -------------------------------------------------------------------------------------


def brute_secrets(text):
    found = []
    for k, rule in enumerate(secrets.RULES):
        pattern = "[0-9a-f]+" if rule.kind == "hex" else rule.pattern
        if rule.kind == "assign":
            pattern = re.sub(r"^\((.*?)\)", r"(?i:(\1))", pattern)
        for m in re.finditer(pattern, text):
            if len(m.group(2) if rule.kind == "assign" else m.group()) >= rule.least:
                found.append((m.start(), k, m.end()))
    return [(secrets.RULES[k].kind, a, b) for a, k, b in sorted(found)]


def test_secrets_equal_regular_expressions(table):
    compiled = secrets.scanner(secrets.RULES)
    pick = random.Random(3)
    pieces = ["token", "secret", "=", " ", '"', "abc", "deadbeef" * 3, "AKIA", "ABCDEFGH12", "é", "ghp_", "eyJ", ".", "x", "api_key", ":", "'", "-----BEGIN ", "PRIVATE KEY-----", "0123456789", "PASSWORD", "_"]
    texts = [*table.text, *("".join(pick.choice(pieces) for _ in range(pick.randint(1, 14))) for _ in range(3000))]
    for text in texts:
        assert secrets.find(text, secrets.RULES, compiled) == brute_secrets(text)


# --- 3 -------------------------------------------------------------------------------------


def test_language_accuracy_and_unknown(spark, table, sf_dir):
    got = run(spark, "op3_language_id", sf_dir).merge(table, on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_families_put_alike_languages_together():
    assert langid.families(np.array([[1, 0.1, 0], [0, 0.1, 1], [1, 0.2, 0], [0, 0.2, 1.0]])) == [[0, 2], [1, 3]]


# --- 4 -------------------------------------------------------------------------------------


def brute_kept(texts, width):
    places = {}
    split = [t.encode().split() if t else [] for t in texts]
    for d, ws in enumerate(split):
        for i in range(len(ws) - width + 1):
            places.setdefault(tuple(ws[i : i + width]), []).append((d, i))
    gone = [set() for _ in texts]
    for found in places.values():
        if len(found) > 1:
            for d, i in found:
                gone[d].update(range(i, i + width))
    return [[w for i, w in enumerate(ws) if i not in gone[d]] for d, ws in enumerate(split)]


def test_substrings_equal_brute_force(spark, docs_of):
    pick = random.Random(5)
    shared = [pick.choices(WORDS, k=60) for _ in range(4)]
    texts = []
    for _ in range(60):
        ws = pick.choices(WORDS, k=pick.randint(0, 150))
        for _ in range(pick.randint(0, 2)):
            at = pick.randint(0, len(ws))
            ws[at:at] = pick.choice(shared)[pick.randint(0, 20) :]
        texts.append(" ".join(ws))
    texts += [texts[0], "a " * 200, None]
    got = substrings.without_repeats(docs_of(list(enumerate(texts)))).collect()
    want = brute_kept(texts, 35)
    assert {r.doc_id: substrings.kept_words((r.text or "").encode().split(), r.spans) for r in got} == dict(enumerate(want))


def test_gaps_round_trip():
    p = np.array([0, 3, 70_000, 70_001, 400_000])
    assert substrings._positions(substrings._gaps(p)).tolist() == p.tolist()
    assert substrings.merged(np.array([0, 1, 40, 80]), 35) == [0, 36, 40, 75, 80, 115]


# --- 5 -------------------------------------------------------------------------------------


def test_flight_keeps_both_totals():
    pick = random.Random(7)
    p, size = [pick.random() for _ in range(500)], [float(pick.randint(1, 900)) for _ in range(500)]
    words, count = sum(a * b for a, b in zip(p, size)), sum(p)
    left = mixing.flight(p, size, 1)
    assert len(left) <= 2 and all(x in (0.0, 1.0) for k, x in enumerate(p) if k not in left)
    assert abs(sum(a * b for a, b in zip(p, size)) - words) < 1e-4 and abs(sum(p) - count) < 1e-6


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        level = (total - sum(3 * sizes[s] for s in capped)) / max(1, sum(weight[s] for s in sizes if s not in capped))
        new = {s for s in sizes if s not in capped and weight[s] * level > 3 * sizes[s]}
        if not new:
            return {s: 3.0 * sizes[s] if s in capped else weight[s] * level for s in sizes}
        capped |= new


@pytest.mark.parametrize("block", [16, 8192])
def test_mix_meets_targets(docs_of, block):
    pick = random.Random(11)
    rows = [(i, " ".join(pick.choices(WORDS, k=pick.randint(1, 60))), "en", pick.choice(["a", "a", "a", "b", "c", "é", None])) for i in range(900)]
    rows += [(1000, "x y z", "en", "tiny")]
    got = mixing.decisions(docs_of(rows), block=block).toPandas()
    got["source"] = got.source.where(got.source.notna(), None)
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    want = brute_targets(sizes)
    for source, target in want.items():
        own = got[got.source.isna()] if source is None else got[got.source == source]
        assert own.target.iloc[0] == pytest.approx(target)
        assert abs((own.copies * own["size"]).sum() - target) <= max(3, 0.01 * target)
    assert (got.copies <= 3).all()
    again = mixing.decisions(docs_of(rows), block=block).toPandas()
    assert dict(zip(got.doc_id, got.copies)) == dict(zip(again.doc_id, again.copies))


# --- 6 -------------------------------------------------------------------------------------


def test_store_equals_plain_tokenizer(spark, table, sf_dir):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenstore.default_tokenizer())
    rows = table.sort_values("doc_id")
    ids = [np.array([*e.ids, 1], dtype="<u4") for e in plain.encode_batch(rows.text.tolist(), add_special_tokens=False)]
    store = tokenstore.TokenStore.write(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    got = store.read().toPandas().sort_values("doc_id")
    n = [len(x) for x in ids]
    assert got.n_tokens.tolist() == n
    assert got.start.tolist() == np.r_[0, np.cumsum(n)[:-1]].tolist()
    assert got.ids_crc32.tolist() == [zlib.crc32(x.tobytes()) for x in ids]
    whole = store.documents().toPandas().sort_values("doc_id")
    assert all(np.array_equal(a, b) for a, b in zip(whole.ids, ids))
    chunks = store.chunks()
    assert chunks.count() == chunks.select("chunk").distinct().count()


def test_words_split_as_the_tokenizer_does():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenstore.default_tokenizer())
    encoder = tokenstore.Encoder(tokenstore.default_tokenizer())
    for text in ["a'b", "it's  Éá  x", "İstanbul ΣΑΣ σ", "<|endoftext|> a <|startoftext|>b", "a b\x1cc\x85d", " ́ a x́ y", "don't 'll", "１２３ ㎏ ﬁ", ""]:
        assert encoder.ids([text])[0].tolist() == [*plain.encode(text, add_special_tokens=False).ids, 1]


def test_crc_of_parts():
    data = bytes(range(256)) * 5
    for cut in (0, 1, 4, 700, len(data)):
        parts = tokenstore.shifted(np.array([zlib.crc32(data[:cut]), zlib.crc32(data[cut:])]), np.array([len(data) - cut, 0]))
        assert parts[0] ^ parts[1] == zlib.crc32(data)


def test_equal_passages_share_chunks():
    rng = np.random.default_rng(2)
    shared = rng.integers(0, 49_000, 6000).astype("<u4")
    cut = lambda x: {tokenstore.address(tokenstore.pack(part)) for part in np.split(x, tokenstore.cuts(x)[:-1])}
    a, b = cut(np.r_[rng.integers(0, 49_000, 777).astype("<u4"), shared]), cut(np.r_[rng.integers(0, 49_000, 1234).astype("<u4"), shared])
    assert len(a & b) >= 5


# --- 7 -------------------------------------------------------------------------------------


def test_license_join_equals_brute_force(docs_of):
    pick = random.Random(13)
    texts = []
    for _ in range(80):
        ws = pick.choices(WORDS, k=pick.randint(0, 200))
        name, template = pick.choice(licenses.TEMPLATES)
        own = [w for w in template.split() if pick.random() < pick.choice([0.6, 0.85, 1.0])]
        at = pick.randint(0, len(ws))
        ws[at:at] = own
        if pick.random() < 0.3:
            ws[0:0] = "All rights Reserved. CC-BY cc by".split()
        texts.append(" ".join(ws))
    got = {r.doc_id: r for r in licenses.scan_licenses(docs_of(list(enumerate(texts)))).collect()}
    for k, text in enumerate(texts):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
        places = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(ws)) if ws[i : i + len(phrase.split())] == phrase.split()]
        base = sorted({label for _, label in places})
        best = {}
        for start, end in licenses.blocks(len(ws)):
            for name, template in licenses.TEMPLATES:
                own = set(template.split())
                share = len(own & set(ws[start:end])) / len(own)
                if share >= licenses.THRESHOLD:
                    best[name] = max(share, best.get(name, 0))
        r = got[k]
        assert (r.n_words, r.n_base, r.base_labels) == (len(ws), len(places), ",".join(base))
        assert (r.first_word, r.last_word) == (min((i for i, _ in places), default=None), max((i for i, _ in places), default=None))
        assert r.labels == ",".join(sorted({*base, *best}))
        assert r.score == pytest.approx(1.0 if base else max(best.values(), default=0.0))


# --- 8 -------------------------------------------------------------------------------------


def brute_print(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not ws:
        return 0
    grams = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or [" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints(table):
    for text in [*table.text[:60], None, "", "One", "One TWO", "É É É"]:
        assert simhash.fingerprint(text) == brute_print(text)


def test_links_and_components_equal_brute_force(spark):
    rng = random.Random(17)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    parent = {x: x for x in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    roots = {r.fp: r.root for r in simhash.named(df, 2).collect()}
    want, got = {}, {}
    for x in prints:
        want.setdefault(find(x), set()).add(x)
        got.setdefault(roots[signed(x)], set()).add(x)
    assert {frozenset(v) for v in want.values()} == {frozenset(v) for v in got.values()}


def test_large_anchors_find_the_same_links():
    rng = np.random.default_rng(3)
    base = np.uint64(rng.integers(0, 2**63))
    prints = np.unique(base ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)))
    a = simhash.linked(prints, prints, 2)
    i, j = np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2)
    want = {(int(prints[x]), int(prints[y])) for x, y in zip(i, j) if x != y}
    assert {(int(x), int(y)) for x, y in zip(*a)} == want
    big = np.unique(np.concatenate([prints, rng.integers(0, 2**63, 4000).astype(np.uint64)]))
    assert len(big) ** 2 > 1 << 22
    b = simhash.linked(big, big, 2)
    assert want <= {(int(x), int(y)) for x, y in zip(*b)}


# --- 9 -------------------------------------------------------------------------------------


def test_common_subsequence():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old = row[:]
            for k, y in enumerate(b):
                row[k + 1] = old[k] + 1 if x == y else max(row[k], old[k + 1])
        return row[-1]

    pick = random.Random(19)
    for _ in range(200):
        a, b = pick.choices("abcde", k=pick.randint(0, 90)), pick.choices("abcde", k=pick.randint(0, 90))
        assert decontaminate.common_subsequence(a, b) == plain(a, b)


def test_leaks_are_found_and_clean_documents_left(spark, docs_of):
    pick = random.Random(23)
    vocabulary = [f"v{i}" for i in range(5000)] + ["the", "of", "and", "to"] * 300
    items = [pick.choices(vocabulary, k=pick.randint(15, 60)) for _ in range(40)]
    rows, want = [], set()
    for d in range(300):
        ws = pick.choices(vocabulary, k=pick.randint(20, 400))
        if d % 3 == 0:
            k = pick.randrange(len(items))
            own = list(items[k])
            if d % 2:  # a light paraphrase
                for i in pick.sample(range(len(own)), len(own) // 8):
                    own[i] = "changed"
            at = pick.randint(0, len(ws))
            ws[at:at] = own
            want.add((d, k))
        rows.append((d, " ".join(ws)))
    bench = spark.createDataFrame([(k, " ".join(ws)) for k, ws in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs_of(rows), bench).collect()}
    assert len(got & want) >= 0.97 * len(want)
    assert {d for d, _ in got} <= {d for d, _ in want}


def test_randomised_svd_spans_the_leading_space(spark):
    rng = np.random.default_rng(29)
    rows = [sorted(rng.choice(range(k * 10, k * 10 + 10), 6).tolist()) for k in range(4) for _ in range(30)]
    basis = decontaminate.randomised_svd(spark.createDataFrame([(r,) for r in rows], "ids array<int>"), 40, 4, np.ones(40))
    a = np.zeros((len(rows), 40))
    for i, r in enumerate(rows):
        at, n = np.unique(r, return_counts=True)
        a[i, at] = n / np.linalg.norm(n)
    _, s, _ = np.linalg.svd(a)
    assert np.linalg.norm(a @ basis) ** 2 >= 0.99 * (s[:4] ** 2).sum()
    assert np.allclose(basis.T @ basis, np.eye(4), atol=1e-6)


# --- 10 ------------------------------------------------------------------------------------


def brute_personal(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    luhn = lambda d: sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    found = [(m.start(), k, kind, m.end()) for k, (kind, pattern, passes) in enumerate(rules) for m in re.finditer(pattern, text or "") if passes(m.group())]
    return sorted(found)


def test_base_spans_equal_regular_expressions(docs_of, table):
    pick = random.Random(31)
    pieces = ["a@b.c", "d@e", ".f", "_", "@", "x", " ", "-", "1.2.3.4", "256.1.1.1", ".5", "4111 1111 1111 1111", "4111-1111", "+1 (415) 555-0123", "+", "12", "é", "5500000000000004", "00", "  "]
    texts = [*table.text, *("".join(pick.choice(pieces) for _ in range(pick.randint(1, 12))) for _ in range(1500))]
    got = {r.doc_id: r.spans for r in pii.find_personal_data(docs_of(list(enumerate(texts)))).collect()}
    for k, text in enumerate(texts):
        assert [tuple(s) for s in got[k] if not s.kind.startswith("ctx_")] == brute_personal(text)


def test_patterns_discover_unseen_identifiers(docs_of):
    rows = [(k, f"please write to us at user{k}@site{k}.org today") for k in range(8)]
    rows += [(100, "please write to us at frank[at]example today, or 7up at home"), (101, "we saw 99 birds and 3 cats")]
    got = {r.doc_id: r.spans for r in pii.find_personal_data(docs_of(rows)).collect()}
    text = rows[8][1].replace("frank[at]example", "frank9")
    rows[8] = (100, text)
    got = {r.doc_id: r.spans for r in pii.find_personal_data(docs_of(rows)).collect()}
    assert [(s.kind, text[s.start : s.end]) for s in got[100]] == [("ctx_email", "frank9")]
    assert got[101] == []


# --- 1 -------------------------------------------------------------------------------------


@pytest.mark.parametrize("shape", [(700, 8, 40, 64, 16), (300, 3, 1000, 16, 8)])
def test_topk_equals_brute_force(spark, shape):
    n, dims, batch, shard, block = shape
    rng = np.random.default_rng(37)
    x = np.round(rng.normal(size=(n, dims)), 1).astype(np.float32)
    x[100:250] = x[100]  # one common vector: ties
    df = spark.createDataFrame([(int(i), [float(c) for c in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in topk.top_k(df, every=10, batch=batch, shard=shard, block=block).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    v = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    for q in range(0, n, 10):
        order = sorted((-int(v[q] @ v[j]), j) for j in range(n) if j != q)[:5]
        assert sorted(got[q]) == [(k + 1, j, -s) for k, (s, j) in enumerate(order)]
