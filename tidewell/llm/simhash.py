"""Operator 8: near-duplicates by SimHash, linked through anchor points of a covering code.

Fingerprints within ``THRESHOLD`` bits are linked. Anchors are the codewords of the product of
two perfect [23, 12] Golay codes over the first 46 bits: every fingerprint's halves lie within
the covering radius, 3, of exactly one codeword each, its home anchor. A fingerprint within the
threshold of another lies, half by half, within radius plus its share of the threshold of that
one's home, so each is replicated to all anchors whose excesses over the radius sum to the
threshold at most (about 61), and is compared there with the fingerprints at home. No link is
missed and no pair is compared off an anchor they share.

Equal fingerprints are one node, so groups of copies cost one comparison. Links at an anchor
are emitted as a spanning forest. Components come from alternating star contraction over a
written edge table.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Table, bounded_batches, private, words

SEED, SHINGLE, THRESHOLD, HALF, RADIUS = 42, 3, 2, 23, 3


def fingerprint(text: str | None) -> int:
    """Bits set in over half the XXH64 of all word shingles of the text with A-Z lower-cased."""
    ws = words(text)
    if not ws:
        return 0
    ws = b" ".join(ws).lower().split()  # bytes.lower changes A-Z only
    n = max(1, len(ws) - SHINGLE + 1)
    counts, of = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    if len(ws) <= SHINGLE:
        hashes = [of(b" ".join(ws), SEED)]
    else:
        hashes = [of(a + b" " + b + b" " + c, SEED) for a, b, c in zip(ws, ws[1:], ws[2:], strict=False)]
    for at in range(0, n, 1 << 15):
        part = np.array(hashes[at : at + (1 << 15)], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and its fingerprint as a signed long, one row for each row."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            prints = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], ["doc_id", "fp"])

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_type}, fp long")


class Golay:
    """The perfect binary [23, 12] code: decoding, and nearby codewords with their excess over the radius."""

    def __init__(self, threshold: int):
        generator = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
        rows = [generator << k for k in range(12)]
        codewords = np.array([reduce(lambda a, k: a ^ (rows[k] if m >> k & 1 else 0), range(12), 0) for m in range(4096)])
        self.generator = generator
        low = [1 << k for k in range(HALF)]
        errors = [0, *low, *(a | b for i, a in enumerate(low) for b in low[:i])]
        errors += [a | b | c for i, a in enumerate(low) for j, b in enumerate(low[:i]) for c in low[:j]]
        errors = np.array(errors)
        self.error_of = np.zeros(2048, dtype=np.int64)
        self.error_of[self.syndrome(errors)] = errors
        self.near: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        light = codewords[np.bitwise_count(codewords) <= 2 * RADIUS + threshold]
        for e in errors.tolist():
            excess = np.maximum(np.bitwise_count(light ^ e).astype(np.int64) - RADIUS, 0)
            self.near[e] = (light[excess <= threshold], excess[excess <= threshold])

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        x = np.array(x, dtype=np.int64)
        for k in range(HALF - 1, 10, -1):
            x = np.where(x >> k & 1, x ^ (self.generator << (k - 11)), x)
        return x

    def error(self, x: np.ndarray) -> np.ndarray:
        """What ``x`` differs in from its nearest codeword."""
        return self.error_of[self.syndrome(x)]


def anchors(prints: np.ndarray, code: Golay, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor) of all replicas; the home anchor of each comes first."""
    mask = (1 << HALF) - 1
    halves = [prints & mask, prints >> HALF & mask]
    errors = [code.error(h) for h in halves]
    homes = [h ^ e for h, e in zip(halves, errors, strict=True)]
    which, out = [], []
    # fingerprints of equal error patterns have equal offsets; home (offset 0, 0) is put first
    for k, (e1, e2) in enumerate(zip(errors[0].tolist(), errors[1].tolist(), strict=True)):
        (w1, x1), (w2, x2) = code.near[e1], code.near[e2]
        i, j = np.nonzero(x1[:, None] + x2[None, :] <= threshold)
        offsets = w1[i] | w2[j] << HALF
        which.append(np.full(len(offsets), k))
        out.append(offsets ^ (homes[0][k] | homes[1][k] << HALF))
    return (np.concatenate(which), np.concatenate(out)) if out else (np.empty(0, int), np.empty(0, int))


def _masks(threshold: int) -> np.ndarray:
    bits = [1 << k for k in range(64)]
    out = [0, *bits, *(a | b for i, a in enumerate(bits) for b in bits[:i])]
    return np.array(out[1:] if threshold == 2 else bits, dtype=np.uint64)


def linked(home: np.ndarray, all_: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (home, other), other larger or not at home, within the threshold. Both sorted, uint64.

    Small anchors are compared in blocks; at large ones the few fingerprints within the
    threshold of each are looked up, so the cost stays in proportion to the group.
    """
    left, right = [], []
    if len(home) * len(all_) <= 1 << 22 or threshold > 2:
        for at in range(0, len(home), 512):
            i, j = np.nonzero(np.bitwise_count(home[at : at + 512, None] ^ all_[None, :]) <= threshold)
            left.append(home[at + i])
            right.append(all_[j])
    else:
        for mask in _masks(threshold):
            want = home ^ mask
            j = np.minimum(np.searchsorted(all_, want), len(all_) - 1)
            hit = all_[j] == want
            left.append(home[hit])
            right.append(all_[j[hit]])
    a, b = np.concatenate(left), np.concatenate(right)
    return a[a != b], b[a != b]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest of its component: as connected as the given ones."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[label[own]], nodes[own]


def links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints linked by chains of ``threshold`` bits. Column ``fp``, distinct."""
    spark = distinct.sparkSession
    bounded_batches(spark)

    def replicate(batches):
        code = Golay(threshold)
        for batch in batches:
            prints = batch.column(0).to_numpy()
            for at in range(0, len(prints), 2048):
                part = prints[at : at + 2048]
                which, anchor = anchors(part, code, threshold)
                home = np.ones(len(which), dtype=bool)
                home[1:] = which[1:] != which[:-1]
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[which]), pa.array(home)], ["anchor", "fp", "home"])

    def compare(batches):
        held: list[list[np.ndarray]] = []  # of the last anchor, which may go on in the next batch
        for batch in batches:
            got = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            if not len(batch):
                continue
            if held and held[0][0][0] == got[0][-1]:
                held.append(got)
                continue
            last = int(np.searchsorted(got[0], got[0][-1]))
            yield from at_anchors(*(np.concatenate(x) for x in zip(*held, [x[:last] for x in got], strict=True)))
            held = [[x[last:] for x in got]]
        if held:
            yield from at_anchors(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def at_anchors(anchor, fp, home):
        if not len(anchor):
            return
        fp = fp.view(np.uint64)
        starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        ends = np.r_[starts[1:], len(anchor)]
        some = (np.add.reduceat(home.astype(np.int64), starts) > 0) & (ends - starts > 1)
        left, right = [], []
        for s, e in zip(starts[some].tolist(), ends[some].tolist(), strict=True):
            a, b = linked(np.sort(fp[s:e][home[s:e]]), np.sort(fp[s:e]), threshold)
            if len(a):
                left.append(a)
                right.append(b)
        if left:  # one forest for all anchors at hand: far fewer edges than links
            a, b = forest(np.concatenate(left), np.concatenate(right))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    # a fingerprint gives some 60 rows: dealt out first, lest one small partition gives them all
    spread = distinct.select("fp").repartition(F.xxhash64("fp")).mapInArrow(replicate, "anchor long, fp long, home boolean")
    met = spread.repartition("anchor").sortWithinPartitions("anchor")
    return met.mapInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> Table:
    """(node, root) of every node of ``edges`` (a, b): root is one node for each component.

    Large and small stars in turn: every node links its larger (then smaller) neighbours to its
    smallest one until nothing changes; a logarithm of rounds, each a written table. Only
    counts and sums reach the driver.
    """
    now = Table(edges.select("a", "b").where("a <> b"), "edges")
    seen = None
    while True:
        both = now.df.unionByName(now.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "u")
        large = Table(both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        # small star: neighbours not above a node, and the node itself, go to the smallest
        down = large.df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        least = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        joined = down.join(least, F.col("a") == F.col("u"))
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        new = Table(small.where("a <> b").distinct(), "small")
        state = new.df.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.hash("b", "a").cast("long"))).first()
        now.drop()
        large.drop()
        now = new
        if state == seen:
            break
        seen = state
    roots = now.df.select(F.col("a").alias("node"), F.col("b").alias("root"))
    table = Table(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "roots")
    now.drop()
    return table


def named(rows: DataFrame, threshold: int) -> DataFrame:
    """fp -> root, one fingerprint for each component. ``rows`` has fp."""
    classes = rows.select("fp").distinct()
    roots = components(links(classes, threshold)).df
    return classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable, itself included) of every row.

    A null or empty text has fingerprint zero, linked like any other. Rows of equal ids each
    get a row; rows without an id take part in links, and get a null component only if no
    member of their component has an id. An empty table gives an empty one.
    """
    rows = Table(fingerprints(docs), "fingerprints").df
    firsts = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    placed = Table(named(rows, threshold).join(firsts, "fp"), "classes").df
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    found = Table(placed.join(smallest, "root").select("fp", "component_id"), "components").df
    return rows.join(found, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row of smallest doc_id stays.

    Rows without an id stay only if their component has no other; of rows with equal id in one
    component, one of the smallest fingerprint stays.
    """
    rows = Table(fingerprints(docs), "fingerprints").df
    return keep_firsts(docs, rows, named(rows, threshold), fingerprint)


def keep_firsts(docs: DataFrame, rows: DataFrame, roots: DataFrame, of) -> DataFrame:
    """The first row of each component. ``rows``: doc_id, fp; ``roots``: fp, root; ``of`` a text is its fp, unsigned."""
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "fp")
    firsts = rows.groupBy("fp").agg(F.min(order).alias("first"))
    placed = roots.join(firsts, "fp")
    best = placed.groupBy("root").agg(F.min("first").alias("first"))
    kept_id, kept_fp, own = private(docs, "kept_id", "kept_fp", "kept_print")
    kept = Table(best.select(F.col("first.doc_id").alias(kept_id), F.col("first.fp").alias(kept_fp)), "kept").df
    same = (F.col(own) == F.col(kept_fp)) & F.col("doc_id").eqNullSafe(F.col(kept_id))
    again = rows.withColumnRenamed("fp", own).join(kept, same).groupBy("doc_id", own).count().where("count > 1").limit(1).count()

    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            prints = np.array([of(t) for t in batch.column(at).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints)], [*batch.schema.names, own])

    printed = docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(own, LongType())]))
    whole = printed.join(kept, same)
    if again:  # rows of one id and fingerprint: any of them, which needs the rows themselves sorted
        whole = whole.dropDuplicates(["doc_id", own])
    return whole.select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_simhash_near_dedup(spark, sf_dir) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
