"""Operator 13: byte substring dedup by suffix arrays.

Every string of ``WIDTH`` bytes that starts more than once anywhere is removed wherever it stands.

1. Texts are packed into shards of up to ``SHARD`` bytes, written once; a longer text is cut, the pieces
   overlapping by ``WIDTH - 1`` bytes, so memory is bounded by the shard whatever the text. Equal texts of
   a shard are kept once.
2. Each string of ``WIDTH`` bytes is named by its anchor, the ``GRAM`` bytes in it of the smallest hash.
   Equal strings have equal anchors, so strings whose anchor stands nowhere else are single. Shards send
   their anchors (about one in fifty positions), each with a hash of its run, the neighbouring strings that
   share it. Where all shards that have an anchor have the same run, its strings all repeat.
3. The suffixes that are left, those of anchors whose runs differ and of anchors that a shard has twice,
   are sorted per shard by Larsson-Sadakane refinement (``suffix_array``), and Kasai's rule gives common
   prefixes (``long_prefixes``): the shard knows which strings it holds twice. Of strings that may stand
   in other shards, one suffix of each set of equal ones goes on, as 64 bits of hash in one of many buckets.
4. A bucket gets the hashes of all shards and merges them by binary search (``merge``); shards learn which
   of their single strings stand in another shard, and intervals go back by the text's SHA-256.

Distribution: what a shard sends to a bucket is one row; a passage that stands in every document is
sent once a shard. Shards are rows of a written table, so a lost executor changes no name. Different
strings are taken for equal with a probability of about strings ** 2 / 2 ** 65 / buckets, strings
being those left after step 2, and runs and anchors likewise; the number of buckets grows with the data.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, bounded_batches, per_worker
from .substrings import DEALS, Windows, _bucket, _gaps, _positions, merged

WIDTH = 200
GRAM = 100
SHARD = 2_000_000  # bytes whose suffixes are sorted at once
BUCKET = 8_000_000  # bytes of text for each bucket
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)  # odd, so invertible modulo 2**64
_BYTES = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], dtype=np.uint64)
_PREFIX = 7  # symbols of 9 bits in a first key
_LANES = 4096  # lanes that follow Kasai's rule side by side, of 32 suffixes at least


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, ranks and first keys of ``symbols``: 1 to 256, and 0 at the end of each region.

    Zeros differ from each other and are ordered by position, so no suffix reaches beyond its region.
    First by keys of ``_PREFIX`` symbols, then by Larsson-Sadakane rounds: a suffix's rank is where its
    group begins, and only groups of several suffixes are sorted again, by the rank as far on as has
    been sorted already, which doubles from round to round.
    """
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(_PREFIX, symbols.dtype)]).astype(np.int64)
    key, alive = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    for t in range(_PREFIX):
        part = padded[t : t + n]
        key = (key << 9) | np.where(alive, part, 0)
        alive &= part != 0
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    first = np.ones(n, dtype=bool)
    first[1:] = (ordered[1:] != ordered[:-1]) | ~alive[order][1:]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    several = ~(first & np.r_[first[1:], True])
    at, depth = np.flatnonzero(several), _PREFIX  # places in the array of suffixes that share a rank
    while len(at):
        own = order[at]
        both = rank[own] * n + rank[own + depth]
        o = np.argsort(both)
        both, own = both[o], own[o]
        order[at] = own
        first = np.r_[True, both[1:] != both[:-1]]
        rank[own] = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        at = at[~(first & np.r_[first[1:], True])]
        depth *= 2
    return order, rank, key


def long_prefixes(symbols: np.ndarray, order: np.ndarray, rank: np.ndarray, key: np.ndarray, least: int) -> np.ndarray:
    """For each place of the array: does its suffix share ``least`` symbols or more with the one before?

    Kasai's rule: a suffix shares with its predecessor at most one symbol less than the suffix before it in
    the text did. ``_LANES`` stretches of the text follow it side by side, ``_PREFIX`` symbols a step.
    """
    n = len(symbols)
    ends = np.flatnonzero(symbols == 0)
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # symbols up to the region's end
    each = max(32, -(-n // _LANES))
    lanes = -(-n // each)
    out = np.zeros(n, dtype=bool)
    begin = np.arange(lanes) * each
    shared = np.zeros(lanes, dtype=np.int64)
    for t in range(min(each, n)):
        i = begin + t
        if i[-1] >= n:
            i, shared = i[:-1], shared[:-1]
            begin = begin[:-1]
        place = rank[i]
        j = order[np.maximum(place - 1, 0)]
        room = np.minimum(np.minimum(left[i], left[j]), least)
        room[place == 0] = 0
        shared = np.minimum(np.maximum(shared - 1, 0), room)
        more = np.flatnonzero(shared < room)
        while len(more):
            at = shared[more]
            x = key[i[more] + at] ^ key[j[more] + at]
            equal = np.zeros(len(more), dtype=np.int64)
            for k in range(1, _PREFIX + 1):
                equal += (x >> (9 * (_PREFIX - k))) == 0
            shared[more] = np.minimum(at + equal, room[more])
            more = more[(equal == _PREFIX) & (shared[more] < room[more])]
        out[place] = shared >= least
    return out


def _windows(width: int, base: int) -> Windows:
    """Hashes of windows; their tables of powers are kept by the worker."""
    return per_worker(("windows", width, base), lambda: Windows(width, _BASES[base]))


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours, from minima running to and from every ``width``-th place."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    to = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], to[width - 1 : n])


def merge(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two ascending lists without repeats as one, and what stood in both."""
    if len(a) < len(b):
        a, b = b, a
    at = np.searchsorted(a, b)
    both = a[np.minimum(at, len(a) - 1)] == b if len(a) else np.zeros(len(b), dtype=bool)
    return np.insert(a, at[~both], b[~both]), b[both]


def in_several(lists: list[np.ndarray]) -> np.ndarray:
    """Values in more than one of the ascending lists: neighbours are merged until one list is left."""
    found = [np.empty(0, dtype=np.uint64)]
    while len(lists) > 1:
        merged_lists = []
        for k in range(0, len(lists) - 1, 2):
            one, both = merge(lists[k], lists[k + 1])
            merged_lists.append(one)
            found.append(both)
        lists = merged_lists + lists[len(lists) // 2 * 2 :]
    return np.unique(np.concatenate(found))


SHARDS = "shard long, digests array<binary>, bases array<long>, sizes array<int>, copied array<boolean>, data binary"
_SHARD_TYPES = [pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.binary()]


def _columns(rows: list[tuple], types: list, names: str) -> pa.RecordBatch:
    told = [x.strip().split()[0] for x in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], told)


def _pack(width: int, most: int):
    """Texts (digest, bytes) to shards; rows of a table once written, numbered by task and place."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        pieces: dict[tuple[bytes, int], list] = {}  # digest and where the piece begins -> [bytes, stands twice here]
        total = 0

        def flush():
            nonlocal pieces, total, number
            if pieces:
                data = zstandard.ZstdCompressor(level=1).compress(b"".join(p[0] for p in pieces.values()))
                row = (number, [d for d, _ in pieces], [b for _, b in pieces], [len(p[0]) for p in pieces.values()], [p[1] for p in pieces.values()], data)
                yield _columns([row], _SHARD_TYPES, SHARDS)
                pieces, total, number = {}, 0, number + 1

        for batch in batches:
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for base in range(0, len(text) - width + 1, most):
                    if (digest, base) in pieces:
                        pieces[digest, base][1] = True
                        continue
                    piece = text[base : base + most + width - 1]
                    if total + len(piece) > most:
                        yield from flush()
                    pieces[digest, base] = [piece, False]
                    total += len(piece)
        yield from flush()

    return run


class _Shard:
    """A shard's bytes and its runs: neighbouring strings of ``width`` bytes that have one anchor."""

    def __init__(self, sizes, data: bytes, width: int, gram: int):
        self.bytes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=int(sum(sizes))), dtype=np.uint8)
        self.sizes, self.ends, self.width, self.span = np.array(sizes), np.cumsum(sizes), width, width - gram + 1
        values = _BYTES[self.bytes]
        self.grams = _windows(gram, 0)(values)
        anchors = smallest(self.grams, self.span)
        whole = np.ones(len(anchors), dtype=bool)  # does a string begin here that its text holds whole?
        for end in self.ends[:-1].tolist():
            whole[max(0, end - width + 1) : end] = False
        first = whole.copy()
        first[1:] &= ~whole[:-1] | (anchors[1:] != anchors[:-1])
        self.begin = np.flatnonzero(first)
        stop = np.r_[self.begin[1:], len(whole)]
        gaps = np.flatnonzero(~whole)  # a run ends at the next run, or before, where its text does
        nearest = np.r_[gaps, len(whole)][np.searchsorted(gaps, self.begin)]
        self.end = np.minimum(stop, nearest)
        self.anchor = anchors[self.begin]
        # a run's bytes as a hash of any length, from sums over inverse powers
        powers = _windows(width, 1)
        if len(values) > len(powers.power):
            powers.grow(len(values))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers.inverse[: len(values)])])
        self.piece = (total[self.end + width - 1] - total[self.begin]) * powers.power[self.begin] + (self.end - self.begin).astype(np.uint64)

    def told(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors, ascending, and the hash of their run's bytes; 0 where runs of one anchor differ."""
        order = np.lexsort((self.piece, self.anchor))
        anchor, piece = self.anchor[order], self.piece[order]
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        last = np.r_[first[1:], len(anchor)] - 1
        return anchor[first], np.where(piece[first] == piece[last], piece[first], np.uint64(0))

    def twice(self) -> np.ndarray:
        """Anchors that stand at several places here."""
        own = np.unique(self.anchor)
        near = self.grams[self.grams <= own[-1]]
        near = near[own[np.searchsorted(own, near)] == near]
        value, count = np.unique(near, return_counts=True)
        return value[count > 1]


ANCHORS = "bucket int, shard long, anchors binary, pieces binary"


def _anchors(width: int, gram: int, buckets: int):
    def run(batches):
        for batch in batches:
            for shard, sizes, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                anchor, piece = _Shard(sizes, data, width, gram).told()
                bucket = _bucket(anchor * np.uint64(_BASES[2]), buckets)  # anchors are small numbers: spread them first
                by = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[by], np.arange(buckets + 1))
                rows = [(k, shard, anchor[at].tobytes(), piece[at].tobytes()) for k in np.flatnonzero(np.diff(cut)).tolist() for at in [by[cut[k] : cut[k + 1]]]]
                for k in range(0, len(rows), 256):
                    yield _columns(rows[k : k + 256], [pa.int32(), pa.int64(), pa.binary(), pa.binary()], ANCHORS)

    return run


HITS = "shard long, settled binary, mixed binary"


def _met(table: pa.Table) -> pa.Table:
    """Of one bucket's anchors, for each shard those that another shard has too.

    Settled: the runs of all shards are the same bytes, so all their strings repeat. Mixed: they are not.
    """
    shards, lists = table["shard"].to_pylist(), [np.frombuffer(x, dtype=np.uint64) for x in table["anchors"].to_pylist()]
    shared = in_several(lists)
    alike = np.ones(len(shared), dtype=bool)
    seen = np.zeros(len(shared), dtype=np.uint64)
    found = []
    for own, piece in zip(lists, (np.frombuffer(x, dtype=np.uint64) for x in table["pieces"].to_pylist()), strict=True):
        at = np.searchsorted(shared, own)
        here = np.flatnonzero(shared[np.minimum(at, len(shared) - 1)] == own) if len(shared) else at[:0]
        place, piece = at[here], piece[here]
        fresh = seen[place] == 0
        seen[place[fresh]] = piece[fresh]
        alike[place] &= (piece == seen[place]) & (piece != 0)
        found.append(place)
    told = [(s, shared[p[alike[p]]].tobytes(), shared[p[~alike[p]]].tobytes()) for s, p in zip(shards, found, strict=True) if len(p)]
    types = [pa.int64(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*told, strict=True) if told else [[]] * 3, types, strict=True)], ["shard", "settled", "mixed"])


PARTS = "bucket int, shard long, several binary, single binary, place binary, texts array<binary>, offsets array<long>, known binary"
_PART_TYPES = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary()]


def _in(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    return ascending[np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)] == values if len(ascending) else np.zeros(len(values), dtype=bool)


def _each(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All places in the stretches [begin, end)."""
    size = end - begin
    return np.repeat(begin - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(int(size.sum()))


def classes(s: _Shard, mixed: np.ndarray, buckets: int):
    """Suffixes whose anchor another shard has in other company, or which stands here twice, sorted: their sets of equal strings.

    Returns places that repeat here; of strings with a mixed anchor, the places of single ones with hash and
    bucket, then hash and bucket of one of each set of repeated ones.
    """
    none = np.empty(0, dtype=np.int64)
    runs = _in(s.anchor, np.union1d(mixed, s.twice())) if len(s.anchor) else np.zeros(0, dtype=bool)
    if not runs.any():
        return none, none, none.astype(np.uint64), none, none.astype(np.uint64), none
    places = _each(s.begin[runs], s.end[runs])
    spans = np.array(merged(places, s.width), dtype=np.int64).reshape(-1, 2)
    begin, end = spans[:, 0], spans[:, 1]
    # regions that meet at the end of a text are cut there, so that no suffix crosses from one text to another
    cuts = s.ends[:-1]
    inside = cuts[np.searchsorted(begin, cuts, side="left") - 1 == np.searchsorted(end, cuts, side="right")]
    begin, end = np.sort(np.r_[begin, inside]), np.sort(np.r_[end, inside])
    where = _each(begin, end + 1)  # place in the shard of each symbol; one more for the region's end
    stop = np.cumsum(end - begin + 1) - 1
    raw = s.bytes[np.minimum(where, len(s.bytes) - 1)]
    symbols = raw.astype(np.int16) + 1
    symbols[stop] = 0
    order, rank, key = suffix_array(symbols)
    alike = long_prefixes(symbols, order, rank, key, s.width)
    group = np.cumsum(~alike)  # of equal strings, in the array's order
    is_string = np.zeros(len(s.bytes) + 1, dtype=bool)
    is_string[places] = True
    keep = is_string[where[order]] & (symbols[order] != 0)
    at, group = order[keep], group[keep]
    first = np.r_[True, group[1:] != group[:-1]]
    alone = first & np.r_[first[1:], True]
    sent = np.zeros(len(s.bytes) + 1, dtype=bool)
    asked = _in(s.anchor, mixed)
    sent[_each(s.begin[asked], s.end[asked])] = True
    values = _BYTES[raw]
    h, b = _windows(s.width, 1)(values), _bucket(_windows(s.width, 2)(values), buckets)
    single, several = np.sort(at[alone & sent[where[at]]]), at[first & ~alone & sent[where[at]]]
    return np.sort(where[at[~alone]]), where[single], h[single], b[single], h[several], b[several]


def _sorted_classes(width: int, gram: int, buckets: int):
    def run(batches):
        for batch in batches:
            for shard, digests, bases, sizes, copied, data, hits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = _Shard(sizes, data, width, gram)
                settled, mixed = (np.unique(np.concatenate([np.frombuffer(h[kind], dtype=np.uint64) for h in hits or []] or [np.empty(0, np.uint64)])) for kind in ("settled", "mixed"))
                known, single, h, b, more, more_b = classes(s, mixed, buckets)
                firsts = s.ends - s.sizes
                mark = np.zeros(len(s.bytes), dtype=bool)
                mark[known] = True
                agreed = _in(s.anchor, settled)
                mark[_each(s.begin[agreed], s.end[agreed])] = True
                for first, size, twice in zip(firsts.tolist(), sizes, copied, strict=True):
                    if twice:
                        mark[first : first + size - width + 1] = True
                rows, by, more_by = [], np.argsort(b, kind="stable"), np.lexsort((more, more_b))
                cut, more_cut = np.searchsorted(b[by], np.arange(buckets + 1)), np.searchsorted(more_b[more_by], np.arange(buckets + 1))
                for k in np.flatnonzero(np.diff(cut) + np.diff(more_cut)).tolist():
                    at = by[cut[k] : cut[k + 1]]
                    rows.append((k, shard, more[more_by[more_cut[k] : more_cut[k + 1]]].tobytes(), h[at].tobytes(), _gaps(single[at]), None, None, None))
                    if len(rows) >= 64:
                        yield _columns(rows, _PART_TYPES, PARTS)
                        rows = []
                # a bucket below zero carries the shard's directory; it is passed on, not merged
                offsets = [x for t in zip(bases, firsts.tolist(), [z - width + 1 for z in sizes], strict=True) for x in t]
                rows.append((-1 - zlib.crc32(str(shard).encode()) // 2, shard, None, None, None, digests, offsets, _gaps(np.flatnonzero(mark))))
                yield _columns(rows, _PART_TYPES, PARTS)

    return run


ANSWERS = "shard long, texts array<binary>, offsets array<long>, places binary"


def _merged(table: pa.Table) -> pa.Table:
    """Answers of one bucket: for each shard the places of its single strings that stand in another shard."""
    names = ["shard", "texts", "offsets", "places"]
    if table["bucket"][0].as_py() < 0:
        return table.select(["shard", "texts", "offsets", "known"]).rename_columns(names)
    several, single, places = (table[c].to_pylist() for c in ("several", "single", "place"))
    hs = [np.frombuffer(x, dtype=np.uint64) for x in single]
    repeated = np.unique(np.concatenate([in_several([np.sort(h) for h in hs]), *(np.frombuffer(x, dtype=np.uint64) for x in several)]))
    shards, found = [], []
    for shard, h, place in zip(table["shard"].to_pylist(), hs, places, strict=True):
        if len(h) and len(repeated):
            hit = repeated[np.minimum(np.searchsorted(repeated, h), len(repeated) - 1)] == h
            if hit.any():
                shards.append(shard)
                found.append(_gaps(_positions(place)[hit]))
    none = [None] * len(shards)
    return pa.table([pa.array(shards, pa.int64()), pa.array(none, pa.list_(pa.binary())), pa.array(none, pa.list_(pa.int64())), pa.array(found, pa.binary())], names)


def _gather(width: int):
    def run(table: pa.Table) -> pa.Table:
        """One shard: its directory and all answers, to intervals of bytes for each piece."""
        own = [k for k, t in enumerate(table["texts"].to_pylist()) if t is not None]
        digests, offsets = table["texts"][own[0]].as_py(), np.array(table["offsets"][own[0]].as_py()).reshape(-1, 3)
        repeated = np.zeros(int((offsets[:, 1] + offsets[:, 2]).max()), dtype=bool)
        for x in table["places"].to_pylist():
            repeated[_positions(x)] = True
        texts, bases, spans = [], [], []
        for digest, (base, first, n) in zip(digests, offsets.tolist(), strict=True):
            starts = np.flatnonzero(repeated[first : first + n])
            if len(starts):
                texts.append(digest)
                bases.append(base)
                spans.append([x + base for x in merged(starts, width)])
        return pa.table({"digest": pa.array(texts, pa.binary()), "base": pa.array(bases, pa.int64()), "spans": pa.array(spans, pa.list_(pa.int64()))})

    return run


def removal_intervals(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """digest (SHA-256 of the text), spans ([start, end, ...] in bytes; pieces of a long text may overlap) of texts with repeated strings."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.where(F.octet_length("text") >= width).select(F.unhex(F.sha2("text", 256)).alias("digest"), F.col("text").cast("binary").alias("text"))
    packed = Table(texts.mapInArrow(_pack(width, shard), SHARDS), "shards")
    size = packed.df.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = int(size // BUCKET) + 1
    anchors = packed.df.select("shard", "sizes", "data").mapInArrow(_anchors(width, gram, buckets), ANCHORS)
    hits = anchors.groupBy("bucket").applyInArrow(_met, HITS)
    per_shard = hits.groupBy("shard").agg(F.collect_list(F.struct("settled", "mixed")).alias("hits"))  # no more than the shard's anchors
    met = packed.df.join(per_shard, "shard", "left").select("shard", "digests", "bases", "sizes", "copied", "data", "hits")
    parts = met.mapInArrow(_sorted_classes(width, gram, buckets), PARTS)
    answers = parts.groupBy("bucket").applyInArrow(_merged, ANSWERS)
    found = answers.groupBy("shard").applyInArrow(_gather(width), "digest binary, base long, spans array<long>")
    # a text in several shards has the same strings, so the same intervals, in each
    pieces = found.dropDuplicates(["digest", "base"]).groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("base", "spans"))).alias("pieces"))
    out = Table(pieces.select("digest", F.flatten(F.col("pieces.spans")).alias("spans")), "intervals").df
    packed.drop()
    return out


def without_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """doc_id, text (UTF-8 bytes), spans (removed intervals of bytes; null if none) of every row.

    A string counts as repeated if it also starts at any other place of any row, the same row included; all
    its places are removed. Null texts (null bytes) and texts under ``width`` bytes have nothing to remove;
    repeated rows remove each other. Further columns are ignored.
    """
    spans = removal_intervals(docs, width, gram, shard)
    short = F.coalesce(F.octet_length("text") < width, F.lit(True))
    as_bytes = F.col("text").cast("binary").alias("text")
    whole = docs.where(~short).select("doc_id", as_bytes, F.unhex(F.sha2("text", 256)).alias("digest"), F.pmod(F.xxhash64("doc_id"), F.lit(DEALS)).alias("deal"))
    # copies of one text are dealt over several partitions, each with its intervals
    dealt = spans.select("digest", "spans", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALS - 1).cast("long"))).alias("deal"))
    met = whole.join(dealt, ["digest", "deal"], "left").select("doc_id", "text", "spans")
    return met.unionByName(docs.where(short).select("doc_id", as_bytes, F.lit(None).cast("array<long>").alias("spans")))


def kept_bytes(text: bytes, spans: list[int] | None) -> tuple[bytes, int]:
    """What is left of the text, and the number of maximal removed runs."""
    out, at, runs = [], -1, 0
    for start, end in zip(spans[::2], spans[1::2], strict=True) if spans else ():
        if start > at:
            out.append(text[max(at, 0) : start])
            runs += 1
        at = max(at, end)
    return b"".join(out) + text[max(at, 0) :], runs


def op13_suffix_dedup(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

    def run(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                kept, runs = kept_bytes(text or b"", spans)
                rows.append((len(text or b""), len(text or b"") - len(kept), runs, hashlib.sha256(kept).hexdigest()))
            cells = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cells, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return without_repeats(docs).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
