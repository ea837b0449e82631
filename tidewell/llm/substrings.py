"""Operator 4: substring dedup over fixed-length word windows.

Every window of ``WIDTH`` words gets a Rabin-Karp hash (a polynomial modulo 2**64 over word
hashes, by differences of prefix sums). Windows are counted in Spark by hash; those that start
more than once anywhere are merged into maximal intervals of words, which are removed.

Distribution: a map task packs the hashes of up to ``CHUNK`` words of documents into one binary
per hash bucket, so a shuffled row holds thousands of windows at 8 bytes and about one byte of
position each. Within a chunk, equal windows are sent once with a mark and equal texts are
worked once, so no repeated passage, however common, makes a large bucket. Buckets hold a
bounded number of windows each; their answers (positions of repeated windows) return to the
chunk, which knows its texts only by SHA-256. Documents join intervals by that hash, so equal
texts share them and repeated ids do no harm.

A window's identity is its bucket (from a second hash) and 64 bits of hash. Different windows
are taken for equal anywhere with a probability of about windows ** 2 / 2 ** 65 / buckets, and
the number of buckets grows with the data: 5e-6 for 1.4e8 windows, 3e-4 for 8e9.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, bounded_batches, words

WIDTH = 35
CHUNK = 1_500_000  # words whose windows a map task holds at once
BUCKET = 1_500_000  # windows aimed at in a bucket
REMEMBER = 1_000_000  # word hashes a worker remembers
DEALS = 8  # partitions that copies of one text are dealt over
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)  # odd, so invertible modulo 2**64


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Windows:
    """Rabin-Karp hashes of all windows of a sequence of word hashes."""

    def __init__(self, width: int, base: int):
        self.width, self.base = width, base
        self.grow(1 << 12)

    def grow(self, n: int) -> None:
        self.inverse = np.cumprod(np.full(n, pow(self.base, -1, 1 << 64), dtype=np.uint64))
        self.power = np.cumprod(np.full(n, self.base, dtype=np.uint64))

    def __call__(self, v: np.ndarray) -> np.ndarray:
        n = len(v)
        if n < self.width:
            return np.empty(0, dtype=np.uint64)
        if n > len(self.power):
            self.grow(2 * n)
        total = np.cumsum(v * self.inverse[:n])
        h = total[self.width - 1 :].copy()
        h[1:] -= total[: n - self.width]
        h *= self.power[self.width - 1 : n]
        h ^= h >> np.uint64(32)  # mixes, so that all bits depend on all words
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(29)
        return h


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    b = (h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    return b.astype(np.uint16 if buckets <= 1 << 16 else np.uint32)


def merged(starts: np.ndarray, width: int) -> list[int]:
    """[start, end, start, end, ...] of the union of [s, s + width) over sorted starts."""
    if not len(starts):
        return []
    new = np.flatnonzero(np.diff(starts) > width)
    begins, ends = starts[np.r_[0, new + 1]], starts[np.r_[new, len(starts) - 1]] + width
    return np.column_stack([begins, ends]).ravel().tolist()


def _gaps(positions: np.ndarray) -> bytes:
    """Ascending positions as differences, 2 bytes each (0xFFFF: 65535 more, go on)."""
    d = np.diff(positions, prepend=0)
    if len(d) and d.max() >= 0xFFFF:
        many = d // 0xFFFF
        out = np.full(int(many.sum()) + len(d), 0xFFFF, dtype="<u2")
        out[np.cumsum(many + 1) - 1] = d % 0xFFFF
        return out.tobytes()
    return d.astype("<u2").tobytes()


def _positions(data: bytes) -> np.ndarray:
    d = np.frombuffer(data, dtype="<u2").astype(np.int64)
    return np.cumsum(d)[d != 0xFFFF]


PACKED = "bucket int, chunk string, several binary, single binary, place binary, texts array<binary>, offsets array<int>, known binary"


def _pack(width: int, buckets: int):
    def run(batches):
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        hashes, windows, second = _WordHashes(), Windows(width, _BASES[0]), Windows(width, _BASES[1])
        texts: dict[bytes, list[int]] = {}  # digest -> [first window, windows, copies here]
        parts: list[np.ndarray] = []
        where: list[np.ndarray] = []  # their buckets
        total = 0

        def flush():
            nonlocal texts, parts, where, total, number
            if not total:
                return
            h, bucket = np.concatenate(parts), np.concatenate(where)
            parts, where = [], []
            repeated = np.zeros(total, dtype=bool)
            for first, n, copies in texts.values():
                if copies > 1:
                    repeated[first : first + n] = True
            order = np.argsort(h, kind="stable")
            order = order[np.argsort(bucket[order], kind="stable")]
            ordered, bucket = h[order], bucket[order]
            same = np.r_[False, (ordered[1:] == ordered[:-1]) & (bucket[1:] == bucket[:-1])]
            # a mark on any of equal windows is a mark on all of them
            group = np.cumsum(~same) - 1
            marked = np.zeros(int(group[-1]) + 1, dtype=bool)
            marked[group[same]] = True
            marked[group[repeated[order]]] = True
            repeated[order] = marked[group]
            own, own_h, bucket = order[~same], ordered[~same], bucket[~same]  # one window for each hash
            del order, ordered, same, group, marked, h
            chunk = f"{task}-{number}"
            number += 1
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            rows = []
            for b in np.flatnonzero(np.diff(cut)).tolist():
                at, hs = own[cut[b] : cut[b + 1]], own_h[cut[b] : cut[b + 1]]
                more = repeated[at]
                one = np.argsort(at[~more])
                rows.append((b, chunk, hs[more].tobytes(), hs[~more][one].tobytes(), _gaps(at[~more][one]), None, None, None))
                if len(rows) >= 64:
                    yield _batch(rows)
                    rows = []
            # a bucket below zero carries the chunk's own directory; it is passed on, not counted
            rows.append((-1 - zlib.crc32(chunk.encode()) // 2, chunk, None, None, None, list(texts), [x for t in texts.values() for x in t[:2]], _gaps(np.flatnonzero(repeated))))
            yield _batch(rows)
            texts, total = {}, 0

        for batch in batches:
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest in texts:
                    texts[digest][2] += 1
                    continue
                ws = words(text)
                if len(ws) < width:
                    continue
                if len(hashes) > REMEMBER:
                    hashes.clear()
                v = np.array([hashes[w] for w in ws], dtype=np.uint64)
                h = windows(v)
                texts[digest] = [total, len(h), 1]
                parts.append(h)
                where.append(_bucket(second(v), buckets))
                total += len(h)
                if total >= CHUNK:
                    yield from flush()
        yield from flush()

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary()]
    names = [x.split()[0] for x in PACKED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _count(table: pa.Table) -> pa.Table:
    """Answers of one bucket: per chunk, the places of its windows that also start elsewhere."""
    if table["bucket"][0].as_py() < 0:
        return table.select(["chunk", "texts", "offsets", "known"]).rename_columns(["chunk", "texts", "offsets", "places"])
    several, single, places = (table[c].to_pylist() for c in ("several", "single", "place"))
    hs = [np.frombuffer(x, dtype=np.uint64) for x in single]
    everyone = np.concatenate(hs)
    everyone.sort()
    repeated = np.unique(np.concatenate([everyone[1:][everyone[1:] == everyone[:-1]], *(np.frombuffer(x, dtype=np.uint64) for x in several)]))
    del everyone
    chunks, found = [], []
    for chunk, h, place in zip(table["chunk"].to_pylist(), hs, places, strict=True):
        if len(h) and len(repeated):
            hit = repeated[np.minimum(np.searchsorted(repeated, h), len(repeated) - 1)] == h
            if hit.any():
                chunks.append(chunk)
                found.append(_gaps(_positions(place)[hit]))
    none = [None] * len(chunks)
    columns = [pa.array(chunks, pa.string()), pa.array(none, pa.list_(pa.binary())), pa.array(none, pa.list_(pa.int32())), pa.array(found, pa.binary())]
    return pa.table(columns, ["chunk", "texts", "offsets", "places"])


def _gather(width: int):
    def run(table: pa.Table) -> pa.Table:
        """One chunk: its directory and all answers, to intervals of words for each text."""
        own = [k for k, t in enumerate(table["texts"].to_pylist()) if t is not None]
        digests, offsets = table["texts"][own[0]].as_py(), np.array(table["offsets"][own[0]].as_py()).reshape(-1, 2)
        every = [_positions(x) for x in table["places"].to_pylist() if x is not None]
        repeated = np.zeros(int(offsets.sum(1).max()), dtype=bool)
        for p in every:
            repeated[p] = True
        texts, spans = [], []
        for digest, (first, n) in zip(digests, offsets.tolist(), strict=True):
            starts = np.flatnonzero(repeated[first : first + n])
            if len(starts):
                texts.append(digest)
                spans.append(merged(starts, width))
        return pa.table({"digest": pa.array(texts, pa.binary()), "spans": pa.array(spans, pa.list_(pa.int32()))})

    return run


def removal_intervals(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """digest (SHA-256 of the text), spans ([start, end, ...] in words) of texts with repeated windows."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.where(F.col("text").isNotNull()).select(F.unhex(F.sha2("text", 256)).alias("digest"), "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, int(size // 6 // BUCKET) + 1)  # about six bytes a word
    packed = texts.mapInArrow(_pack(width, buckets), PACKED)
    answers = packed.groupBy("bucket").applyInArrow(_count, "chunk string, texts array<binary>, offsets array<int>, places binary")
    found = answers.groupBy("chunk").applyInArrow(_gather(width), "digest binary, spans array<int>")
    # a text in several chunks has the same windows, so the same intervals, in each
    return Table(found.dropDuplicates(["digest"]), "intervals").df


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text, spans (removed intervals of words; null if none) of every row.

    A window counts as repeated if its words also start at any other place of any row, the
    same row included; all its places are removed. Null and empty texts and those of fewer
    than ``width`` words have nothing to remove; repeated rows remove each other.
    """
    spans = removal_intervals(docs, width)
    # what is too short to hold a window, nulls too, is not shuffled
    least = 2 * width - 1  # characters of ``width`` words of one letter
    short = F.coalesce(F.length("text") < least, F.lit(True))
    whole = docs.where(~short).select("doc_id", "text", F.unhex(F.sha2("text", 256)).alias("digest"), F.pmod(F.xxhash64("doc_id"), F.lit(DEALS)).alias("deal"))
    # copies of one text are dealt over several partitions, each with its intervals
    dealt = spans.select("digest", "spans", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALS - 1).cast("long"))).alias("deal"))
    met = whole.join(dealt, ["digest", "deal"], "left").select("doc_id", "text", "spans")
    return met.unionByName(docs.where(short).select("doc_id", "text", F.lit(None).cast("array<int>").alias("spans")))


def kept_words(ws: list[bytes], spans: list[int] | None) -> list[bytes]:
    out, at = [], 0
    for start, end in zip(spans[::2], spans[1::2], strict=True) if spans else ():
        out += ws[at:start]
        at = end
    return out + ws[at:] if at else ws


def op4_substring_dedup(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

    def run(batches):
        for batch in batches:
            n, removed, digests = [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ws = words(text)
                kept = kept_words(ws, spans)
                n.append(len(ws))
                removed.append(len(ws) - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    return without_repeats(docs).mapInArrow(run, f"doc_id {doc_type}, n_words long, n_removed long, kept_sha256 string")
