"""Near copies at a five-word Jaccard similarity of 0.8 or more, against plain Python."""

import random

import pyarrow.parquet as pq

import corpus_pipeline
from tidewell.llm import nearcopies, simhash


def grams(text):
    ws = b" ".join(simhash.words(text)).lower().split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def firsts(docs):
    """Smallest id of each component of all pairs; equal word sequences are linked too."""
    sets, parent = [grams(t) for _, t in docs], list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                parent[find(i)] = find(j)
    out = {}
    for i, (d, _) in enumerate(docs):
        out[find(i)] = min(d, out.get(find(i), d))
    return sorted(out.values())


def planted():
    rng = random.Random(5)
    make = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    hot, texts = make(120), []
    for _ in range(40):
        base = make(rng.randrange(30, 200))
        texts.append(base)
        for edits in (1, 2, 4, 8, 16):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = "edited"
            texts.append(copy)
        texts.append(hot + base[:20])  # a passage that many share
        texts.append([*hot[:60], rng.choice("abc"), *hot[61:]])  # a large group
    texts += [["one"], ["one"], ["two"], [], make(3)]
    rng.shuffle(texts)
    return [(k, " ".join(t)) for k, t in enumerate(texts)]


def test_planted_near_copies(docs_of):
    docs = planted()
    got = sorted(r.doc_id for r in nearcopies.keep_one(docs_of(docs)).collect())
    assert got == firsts(docs) and len(got) < len(docs) - 100


def test_similar_equals_all_pairs():
    docs = planted()
    texts = [t for _, t in docs if t]
    pairs = nearcopies.similar([nearcopies.shingles(t) for t in texts])
    assert all(len(grams(texts[i]) & grams(texts[j])) >= 0.8 * len(grams(texts[i]) | grams(texts[j])) for i, j in pairs)
    assert len(texts) - len(pairs) == len(firsts(list(enumerate(texts))))


def test_small_groups_and_cells_give_the_same(docs_of):
    """Leads dealt over many groups, members over many cells."""
    docs = planted()
    got = sorted(r.doc_id for r in nearcopies.keep_one(docs_of(docs), star=3, block=4).collect())
    assert got == firsts(docs)


def test_links_between_members_that_are_not_the_leads(docs_of):
    """A chain of texts, each alike to the next but not to the one after."""
    rng = random.Random(11)
    words, chain = [f"w{rng.randrange(9000)}" for _ in range(150)], []
    for k in range(40):
        at = (k * 12) % 150
        words = words[:at] + [f"n{k}_{i}" for i in range(11)] + words[at + 11 :]
        chain.append(" ".join(words))
    docs = list(enumerate(chain))
    assert firsts(docs) == [0]
    assert [r.doc_id for r in nearcopies.keep_one(docs_of(docs), star=4, block=4).collect()] == [0]


def test_pipeline_mixes_no_near_copies(spark, sf_dir):
    table = pq.read_table(f"{sf_dir}/documents.parquet").to_pandas()
    kept = set(firsts(list(zip(table.doc_id, table.text, strict=True))))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = corpus_pipeline.near_dedup(spark, docs, sf_dir)
    assert sorted(r.doc_id for r in one.collect()) == sorted(kept)
    mixed = {r.doc_id for r in corpus_pipeline.mix(spark, one, sf_dir).select("doc_id").collect()}
    assert mixed and mixed <= kept
