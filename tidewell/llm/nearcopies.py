"""Near copies: groups of documents linked by a Jaccard similarity of ``LEAST`` or more of their five-word shingles.

Candidates are the links of operator 8's anchors, fingerprints within 2 bits. They lack most
edited copies: at 0.8 two fingerprints differ in about ten bits, more than any covering code of
64 bits can bridge. So texts that share one of ``BANDS`` hashes of ``ROWS`` MinHash values are
candidates as well; a pair at the bound shares none with a probability of (1 - 0.8 ** 6) ** 48 =
5e-7, a closer one with less. No pair is taken for its hashes: shingles decide.

1. Each member of a bucket is compared with the bucket's smallest, the lead, and so are both
   ends of a SimHash link. A lead's members are dealt over groups of about ``STAR``, so a bucket
   of any size is many small tasks.
2. Components of these links. What meets the lead within one component is done: more links
   would add nothing.
3. The others of a lead, its strangers, are compared with each other and with all that met it
   without being ``LEAST`` alike to it, in cells of about ``BLOCK`` by ``BLOCK`` texts. With what
   is ``LEAST`` alike to the lead only those need be that are ``RING`` alike to it themselves: one
   minus Jaccard is a metric.

Equal word sequences are one node (64 bits, so two of n differing texts meet with a probability
of n ** 2 / 2 ** 65). No table holds pairs of a bucket, and no task more than a cell.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, bounded_batches, words
from .simhash import components, fingerprint, keep_firsts
from .simhash import links as anchor_links

SEED, SHINGLE, LEAST, BANDS, ROWS = 42, 5, 0.8, 48, 6
RING = 1 - 2 * (1 - LEAST)  # what is less alike to a lead than this is not LEAST alike to anything that is LEAST alike to the lead
STAR, BLOCK = 2048, 512  # members compared with a lead in one group; texts on either side of a cell
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = np.cumprod(np.full(SHINGLE, 0x9E3779B97F4A7C15, dtype=np.uint64))


def lowered(text: str | None) -> bytes:
    """The words with A-Z lower-cased, one space between them."""
    return b" ".join(words(text)).lower()


def node(text: str | None) -> int:
    return xxhash.xxh64_intdigest(lowered(text), SEED)


def shingles(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the different five-word shingles; fewer words are one shingle, none give none."""
    ws = lowered(text).split()
    if not ws:
        return np.empty(0, dtype=np.uint64)
    of = np.array([xxhash.xxh64_intdigest(w, SEED) for w in ws], dtype=np.uint64)
    n = max(1, len(of) - SHINGLE + 1)
    x = np.zeros(n, dtype=np.uint64)
    for k in range(min(SHINGLE, len(of))):
        x += of[k : k + n] * _POWERS[k]
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(by)
    return np.unique(x ^ x >> np.uint64(31))


def bands(grams: np.ndarray) -> list[int]:
    """A signed hash a band; none for an empty set."""
    if not len(grams):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(grams), 512):
        least = np.minimum(least, ((grams[at : at + 512, None] ^ _ODD[0]) * _ODD[1]).min(axis=0))
    least = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(least[k].tobytes(), k) - (1 << 63) for k in range(BANDS)]


def similar(grams: list[np.ndarray], least: float = LEAST) -> list[tuple[int, int]]:
    """Links (i, j) that connect exactly the sets linked by chains of pairs at ``least`` or more."""
    parent = list(range(len(grams)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    values, of, counts = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    place = np.empty(len(values), dtype=np.int64)
    place[np.argsort(counts, kind="stable")] = np.arange(len(values))  # rarest first
    ends = np.cumsum([len(g) for g in grams])
    ranked = [np.sort(x) for x in np.split(place[of], ends[:-1])]
    index, sets, out = defaultdict(list), [], []
    for i, mine in enumerate(ranked):
        n, held = len(mine), set(mine.tolist())
        sets.append(held)
        prefix = mine[: n - int(np.ceil(n * least - 1e-9)) + 1].tolist()
        seen = set()
        for gram in prefix:
            for j in index[gram]:
                if j in seen:
                    continue
                seen.add(j)
                m = len(sets[j])
                if min(n, m) < max(n, m) * least - 1e-9 or find(i) == find(j):
                    continue
                both = len(held & sets[j])
                if both >= least * (n + m - both) - 1e-9:
                    out.append((i, j))
                    parent[find(i)] = find(j)
            index[gram].append(i)
    return out


def across(left: list[np.ndarray], right: list[np.ndarray], tags: tuple[list, list], least: float = LEAST) -> list[tuple[int, int]]:
    """Pairs (i, j) of ``left`` and ``right`` at ``least`` or more whose tags differ, by the prefix and length filters."""
    values, counts = np.unique(np.concatenate([*left, *right]), return_counts=True)
    place = np.empty(len(values), dtype=np.int64)
    place[np.argsort(counts, kind="stable")] = np.arange(len(values))  # rarest first
    ranked = lambda grams: np.sort(place[np.searchsorted(values, grams)])
    prefix = lambda g: g[: len(g) - int(np.ceil(len(g) * least - 1e-9)) + 1].tolist()
    index, sets, out = defaultdict(list), [], []
    for i, grams in enumerate(left):
        own = ranked(grams)
        sets.append(set(own.tolist()))
        for gram in prefix(own):
            index[gram].append(i)
    for j, grams in enumerate(right):
        own = ranked(grams)
        n, held = len(own), set(own.tolist())
        for i in {i for gram in prefix(own) for i in index.get(gram, ())}:
            m = len(sets[i])
            if tags[0][i] == tags[1][j] or min(n, m) < max(n, m) * least - 1e-9:
                continue
            both = len(held & sets[i])
            if both >= least * (n + m - both) - 1e-9:
                out.append((i, j))
    return out


def _groups(batches, keys: int):
    """Lists of the rows of equal first ``keys`` columns, which come sorted by them; a group's rows are held together."""
    rows, last = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != last and rows:
                yield rows
                rows = []
            last = row[:keys]
            rows.append(row)
    if rows:
        yield rows


def _edges(rows: list[tuple]) -> pa.RecordBatch:
    a, b, alike = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(alike, pa.float64())], ["a", "b", "alike"])


def leads(members: DataFrame) -> DataFrame:
    """Distinct (lead, node): each member of a bucket with the bucket's smallest. ``members``: band, node, distinct."""
    heads = members.groupBy("band").agg(F.min("node").alias("lead"), F.count("*").alias("n")).where("n > 1").select("band", "lead")
    return members.join(heads, "band").where("node <> lead").select("lead", "node").distinct()


def stars(pairs: DataFrame, texts: DataFrame, star: int) -> DataFrame:
    """(a, b, alike) of each (lead, node): the Jaccard similarity of their texts. ``texts``: node, text, one a node."""
    degree = pairs.groupBy("lead").agg(F.ceil(F.count("*") / star).alias("deals"))
    deal = F.pmod(F.xxhash64("node"), F.col("deals"))
    # the lead goes to each of its groups, as the row that comes first
    heads = degree.select("lead", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)).alias("deal"), F.lit(0).alias("side"), F.col("lead").alias("node"))
    spread = pairs.join(degree, "lead").select("lead", deal.alias("deal"), F.lit(1).alias("side"), "node").unionByName(heads)

    def compare(batches):
        key, own = None, None
        for batch in batches:
            out = []
            for lead, deal, side, node, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                grams = shingles(text)
                if side == 0:
                    key, own = (lead, deal), grams
                    continue
                if key != (lead, deal):
                    raise ValueError("a group came without its lead")
                both = len(np.intersect1d(own, grams, assume_unique=True))
                out.append((lead, node, both / max(1, len(own) + len(grams) - both)))
            yield _edges(out)

    met = spread.join(texts, "node").select("lead", "deal", "side", "node", "text").repartition("lead", "deal").sortWithinPartitions("lead", "deal", "side")
    return met.mapInArrow(compare, "a long, b long, alike double")


def rest(alike: DataFrame, roots: DataFrame, texts: DataFrame, block: int) -> DataFrame:
    """(a, b, alike) of links that the leads do not tell. ``alike``: a (lead), b, alike; ``roots``: node, root of what is linked."""
    root = lambda rows, of, out: rows.join(roots.select(F.col("node").alias(of), F.col("root").alias("__r")), of, "left").withColumn(out, F.coalesce("__r", of)).drop("__r")
    met = root(root(alike, "a", "root_a"), "b", "root")
    stranger, direct = F.col("root_a") != F.col("root"), F.col("alike") >= LEAST - 1e-9
    met = met.select(F.col("a").alias("lead"), F.col("b").alias("node"), "root", stranger.alias("stranger"), direct.alias("direct"), (stranger & (F.col("alike") >= RING - 1e-9)).alias("ring"))
    met = Table(met, "met").df
    far = F.count_if(~F.col("direct"))  # strangers among them
    sizes = met.groupBy("lead").agg(F.count_if("stranger").alias("left"), F.bool_or("ring").alias("wide"), F.count("*").alias("every"), far.alias("far")).where("left > 0")
    sizes = sizes.select("lead", "wide", "left", F.when(F.col("wide"), F.col("every")).otherwise(F.col("far")).alias("right")).where("right > 1")
    sizes = sizes.select("lead", "wide", F.ceil(F.col("left") / block).alias("lefts"), F.ceil(F.col("right") / block).alias("rights"))
    each = met.join(sizes, "lead")
    at = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    all_ = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    cells = each.where("stranger").select("lead", at("lefts").alias("i"), all_("rights").alias("j"), F.lit(0).alias("side"), "node", "root")
    cells = cells.unionByName(each.where("wide OR NOT direct").select("lead", all_("lefts").alias("i"), at("rights").alias("j"), F.lit(1).alias("side"), "node", "root"))

    def compare(batches):
        for group in _groups(batches, 3):
            left, right = [r for r in group if r[3] == 0], [r for r in group if r[3] == 1]
            if left and right:
                pairs = across([shingles(r[6]) for r in left], [shingles(r[6]) for r in right], ([r[5] for r in left], [r[5] for r in right]))
                yield _edges([(left[i][4], right[j][4], LEAST) for i, j in pairs])

    dealt = cells.join(texts, "node").select("lead", "i", "j", "side", "node", "root", "text").repartition("lead", "i", "j").sortWithinPartitions("lead", "i", "j")
    return dealt.mapInArrow(compare, "a long, b long, alike double")


def groups(docs: DataFrame, prints: DataFrame, star: int = STAR, block: int = BLOCK) -> DataFrame:
    """(node, root) of the nodes that are linked. ``prints``: node, fp, bands of all rows."""
    spark = docs.sparkSession
    bounded_batches(spark)
    members = prints.dropDuplicates(["node"]).select(F.explode("bands").alias("band"), "node")
    # a fingerprint's nodes go with its smallest one, those of linked fingerprints with each other
    firsts = prints.groupBy("fp").agg(F.min("node").alias("lead"))
    within = prints.select("node", "fp").distinct().join(firsts, "fp").where("node <> lead").select("lead", "node")
    one = lambda out, fp: firsts.select(F.col("fp").alias(fp), F.col("lead").alias(out))
    between = anchor_links(prints.select("fp").distinct()).join(one("lead", "a"), "a").join(one("node", "b"), "b").select("lead", "node")
    pairs = Table(leads(members).unionByName(within).unionByName(between).distinct(), "leads").df

    def texts_of(batches):
        for batch in batches:
            nodes = np.array([node(t) for t in batch.column(0).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), batch.column(0)], ["node", "text"])

    wanted = pairs.select("node").unionByName(pairs.select(F.col("lead").alias("node"))).distinct()
    texts = docs.select("text").mapInArrow(texts_of, "node long, text string").join(wanted, "node", "left_semi").dropDuplicates(["node"])
    texts = Table(texts, "texts").df
    alike = Table(stars(pairs, texts, star), "alike").df
    near = alike.where(F.col("alike") >= LEAST - 1e-9).select("a", "b")
    roots = components(near).df
    more = Table(rest(alike, roots, texts, block).select("a", "b"), "rest").df
    if more.isEmpty():
        return roots
    known = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b")  # as connected as all links before
    return components(known.unionByName(more)).df


def keep_one(docs: DataFrame, star: int = STAR, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row of smallest doc_id stays, unchanged.

    Texts without words are one component, being equal. Rows without an id stay only if
    their component has no other; of equal rows of equal id one stays. An empty table gives an
    empty one; all columns are kept, whatever their names.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            signed = lambda xs: pa.array(np.array(xs, dtype=np.uint64).view(np.int64))
            got = [bands(shingles(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), signed([node(t) for t in texts]), signed([fingerprint(t) for t in texts]), pa.array(got, pa.list_(pa.int64()))], ["doc_id", "node", "fp", "bands"])

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    prints = Table(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_type}, node long, fp long, bands array<long>"), "bands").df
    roots = groups(docs, prints, star, block).withColumnRenamed("node", "linked")
    rows = prints.select("doc_id", F.col("node").alias("fp"))
    named = rows.select("fp").distinct().join(roots, F.col("fp") == F.col("linked"), "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return keep_firsts(docs, rows, named, node)
