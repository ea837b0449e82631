"""Operator 9: benchmark decontamination by latent semantic retrieval.

1. Benchmark items are cut into passages of ``2 * STEP`` words. Words are weighted by term
   frequency and by inverse document frequency counted over the whole corpus.
2. A distributed randomised SVD (Gaussian sketch, one power iteration, small eigenproblem) of
   the benchmark's TF-IDF passages gives the latent space. It is the passages' own space, so
   what a corpus passage shares with any of them survives the projection.
3. All windows of ``2 * STEP`` words, every ``STEP``, of all documents are folded in. Pairs with
   a cosine of ``COSINE`` or more are candidates if the window's part along the passage is at
   least ``HELD`` of the passage: what else a window says lowers its cosine, but not that part.
4. A candidate is a leak if the longest common subsequence of the item and the words around the
   window covers ``VERBATIM`` of the item; from ``PARAPHRASE`` on, the answer check decides:
   ``ANSWER`` of the item's rarest words (a third of its distinct ones) must stand there too.

Benchmarks of any size are taken in blocks of ``ITEMS`` items, each with its own space and its
own pass; what travels to the executors is a block's, so its size is bounded. Nothing is
shuffled but sums over the vocabulary of a block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

STEP, ITEMS, RANK, EXTRA = 32, 1024, 192, 8
COSINE, HELD, VERBATIM, PARAPHRASE, ANSWER = 0.12, 0.35, 0.7, 0.5, 0.75
GROUP = 50_000  # words folded in at once

_SPACE = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Lower-case runs of letters and digits (any longer character counts as one)."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_SPACE).split() if text else []


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, a row of the table as one integer's bits."""
    places: dict = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        if x in places:
            u = row & places[x]
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


@dataclass(frozen=True)
class Space:
    """One block's vocabulary, latent space and passages."""

    vocabulary: dict[bytes, int]
    fold: np.ndarray  # (words, rank): inverse document frequency times the space
    latent: np.ndarray  # (passages, rank), of unit length
    length: np.ndarray  # their lengths before
    owner: np.ndarray  # the item of each passage
    items: tuple[tuple[int, tuple[bytes, ...], frozenset[bytes]], ...]  # id, words, answer words

    def found(self, texts: list[str | None]) -> list[list[tuple]]:
        """Per text its leaks: (item_id, covered, answered, cosine, first word, end word)."""
        out: list[list[tuple]] = [[] for _ in texts]
        group, size = [], 0
        for k, text in enumerate(texts):
            ws = terms(text)
            if ws:
                group.append((k, ws))
                size += len(ws)
            if size >= GROUP:
                self._search(group, out)
                group, size = [], 0
        if group:
            self._search(group, out)
        return out

    def _search(self, group, out) -> None:
        get = self.vocabulary.get
        ids, block, firsts, blocks = [], [], [], 0
        for _, ws in group:
            firsts.append(blocks)
            own = np.array([get(w, -1) for w in ws])
            ids.append(own)
            block.append(blocks + np.arange(len(ws)) // STEP)
            blocks += -(-len(ws) // STEP)
        ids, block = np.concatenate(ids), np.concatenate(block)
        known = ids >= 0
        ids, block = ids[known], block[known]
        sums = np.zeros((blocks + 1, self.fold.shape[1]), dtype=np.float32)
        for at in range(0, len(ids), GROUP):
            b = block[at : at + GROUP]
            starts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
            sums[b[starts]] += np.add.reduceat(self.fold[ids[at : at + GROUP]], starts, axis=0)
        last = np.zeros(blocks + 1, dtype=bool)
        last[[f - 1 for f in firsts[1:]] + [blocks - 1]] = True
        for at in range(0, blocks, 4096):
            window = sums[at : min(at + 4096, blocks)].copy()
            go_on = ~last[at : at + len(window)]
            window[go_on] += sums[at + 1 : at + 1 + len(window)][go_on]
            length = np.linalg.norm(window, axis=1)
            along = window @ self.latent.T
            w, p = np.nonzero(along >= np.maximum(HELD * self.length[None, :], COSINE * length[:, None]))
            cosine = along[w, p] / np.maximum(length[w], 1e-9)
            for b, item, c in zip((w + at).tolist(), self.owner[p].tolist(), cosine.tolist(), strict=True):
                d = int(np.searchsorted(firsts, b, side="right")) - 1
                self._judge(group[d], out[group[d][0]], item, (b - firsts[d]) * STEP, c)

    def _judge(self, doc, hits: list[tuple], item: int, at: int, cosine: float) -> None:
        item_id, own, answer = self.items[item]
        if any(h[0] == item_id for h in hits):
            return
        ws = doc[1]
        start, end = max(0, at - len(own)), min(len(ws), at + 2 * STEP + len(own))
        region = ws[start:end]
        if sum(map(set(region).__contains__, own)) < PARAPHRASE * len(own):
            return  # the subsequence has no other words than these: most alignments are spared
        covered = common_subsequence(own, region) / len(own)
        if covered < PARAPHRASE:
            return
        answered = len(answer.intersection(region)) / max(1, len(answer))
        if covered >= VERBATIM or answered >= ANSWER:
            hits.append((item_id, covered, answered, cosine, start, end))


def _partials(rows: DataFrame, compute, width: int) -> np.ndarray:
    """Sum over tasks of ``compute(list of rows) -> (places, vectors)``; at most one vector a place reaches the driver."""

    def run(batches):
        for batch in batches:
            at, vectors = compute(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([v.astype("<f8").tobytes() for v in vectors], pa.binary())], ["at", "v"])

    def add(table: pa.Table) -> pa.Table:
        total: dict[int, np.ndarray] = {}
        for at, v in zip(table["at"].to_pylist(), table["v"].to_pylist(), strict=True):
            total[at] = total.get(at, 0) + np.frombuffer(v, dtype="<f8")
        return pa.table({"at": pa.array(list(total), pa.int32()), "v": pa.array([v.tobytes() for v in total.values()], pa.binary())})

    parts = rows.mapInArrow(run, "at int, v binary").withColumn("slice", F.pmod("at", F.lit(64)))
    sums = parts.groupBy("slice").applyInArrow(lambda t: add(t), "at int, v binary").collect()
    return {r["at"]: np.frombuffer(r["v"], dtype="<f8") for r in sums}


def randomised_svd(passages: DataFrame, words: int, rank: int, weights: np.ndarray) -> np.ndarray:
    """(words, rank): leading right singular vectors of the matrix whose rows are ``passages`` (array of word numbers).

    The sketch Z = A^T A G and one power iteration are sums over the distributed rows; only
    matrices of words times rank are held on the driver.
    """
    rank = min(rank, words)
    width = min(words, rank + EXTRA)
    q = np.random.default_rng(5).standard_normal((words, width))

    def row(ids):
        at, n = np.unique(ids, return_counts=True)
        v = n * weights[at]
        return at, v / max(np.linalg.norm(v), 1e-12)

    for _ in range(2):

        def sketch(batch, q=q):
            total: dict[int, np.ndarray] = {}
            for ids in batch:
                if ids:
                    at, v = row(ids)
                    y = v @ q[at]
                    for a, x in zip(at.tolist(), v.tolist(), strict=True):
                        total[a] = total.get(a, 0) + x * y
            return list(total), list(total.values())

        z = np.zeros((words, width))
        for at, v in _partials(passages, sketch, width).items():
            z[at] = v
        q, _ = np.linalg.qr(z)

    def gram(batch):
        b = np.zeros((width, width))
        for ids in batch:
            if ids:
                at, v = row(ids)
                y = v @ q[at]
                b += np.outer(y, y)
        return list(range(width)), list(b)

    g = np.zeros((width, width))
    for at, v in _partials(passages, gram, width).items():
        g[at] = v
    values, vectors = np.linalg.eigh(g)
    return q @ vectors[:, np.argsort(-values)[:rank]]


def _document_frequency(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """In how many documents each word of the vocabulary stands, over all documents, and their number."""
    n = len(vocabulary)
    size = 512

    def run(batches):
        counts = np.zeros(n + 1, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts[n] += 1
                counts[[vocabulary[w] for w in vocabulary.keys() & set(terms(text))]] += 1
        slices = range(0, n + 1, size)
        yield pa.RecordBatch.from_arrays([pa.array([s // size for s in slices], pa.int32()), pa.array([counts[s : s + size].tobytes() for s in slices], pa.binary())], ["at", "v"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v, dtype=np.int64) for v in table["v"].to_pylist())
        return pa.table({"at": table["at"].slice(0, 1), "v": pa.array([total.tobytes()], pa.binary())})

    rows = docs.select("text").mapInArrow(run, "at int, v binary").groupBy("at").applyInArrow(lambda t: add(t), "at int, v binary").collect()
    counts = np.zeros(n + 1, dtype=np.int64)
    for r in rows:
        counts[r["at"] * size : r["at"] * size + size] = np.frombuffer(r["v"], dtype=np.int64)
    return counts[:n], int(counts[n])


def spaces(docs: DataFrame, benchmark: DataFrame):
    """The latent space of each block of ``ITEMS`` benchmark items, in order of item_id and text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = benchmark.where(F.col("text").isNotNull()).select("item_id", "text").distinct().orderBy("item_id", "text")
    block: list = []
    for r in rows.toLocalIterator():  # a block is held at a time
        block.append((r["item_id"], terms(r["text"])))
        if len(block) == ITEMS:
            yield _space(docs, block)
            block = []
    if any(ws for _, ws in block):
        yield _space(docs, block)


def _space(docs: DataFrame, block: list) -> Space:
    spark = docs.sparkSession
    block = [(i, ws) for i, ws in block if ws]
    vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in block for w in ws}))}
    frequency, n = _document_frequency(docs, vocabulary)
    weights = np.log((1 + n) / (1 + frequency)) + 0.1
    passages = [(k, [vocabulary[w] for w in ws[at : at + 2 * STEP]]) for k, (_, ws) in enumerate(block) for at in range(0, max(1, len(ws) - STEP), STEP)]
    table = spark.createDataFrame([(p,) for _, p in passages], "ids array<int>")
    basis = randomised_svd(table, len(vocabulary), RANK, weights)
    fold = (basis * weights[:, None]).astype(np.float32)
    latent = np.stack([fold[p].sum(0) for _, p in passages])
    length = np.linalg.norm(latent, axis=1)
    latent /= np.maximum(length, 1e-9)[:, None]
    items = []
    for item_id, ws in block:
        distinct = sorted(set(ws), key=lambda w: (-weights[vocabulary[w]], w))
        items.append((item_id, tuple(ws), frozenset(distinct[: max(1, len(distinct) // 3)])))
    return Space(vocabulary, fold, latent.astype(np.float32), length.astype(np.float32), np.array([k for k, _ in passages]), tuple(items))


LEAKS = "item_id long, covered double, answered double, cosine double, first_word int, end_word int"


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id and one row for each leaked item: item_id, covered (share of the item in order), answered, cosine, words.

    Null and empty texts, on either side, leak nothing; repeated documents and items are
    answered each (equal items once). Empty tables give no rows.
    """
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    out = None
    for space in spaces(docs, benchmark):

        def run(batches, space=space):
            for batch in batches:
                ids, rows = [], []
                for doc, hits in zip(batch.column(0).to_pylist(), space.found(batch.column(1).to_pylist()), strict=True):
                    ids += [doc] * len(hits)
                    rows += hits
                types = [pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.int32()]
                columns = zip(*rows, strict=True) if rows else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.types[0]), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", *(x.split()[0] for x in LEAKS.split(", "))])

        part = docs.select("doc_id", "text").mapInArrow(lambda b, run=run: run(b), f"doc_id {doc_type}, {LEAKS}")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], f"doc_id {doc_type}, {LEAKS}")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, unchanged."""
    at = docs.columns.index("text")
    for space in spaces(docs, benchmark):

        def run(batches, space=space):
            for batch in batches:
                yield batch.filter(pa.array([not hits for hits in space.found(batch.column(at).to_pylist())], pa.bool_()))

        docs = docs.mapInArrow(lambda b, run=run: run(b), docs.schema)
    return docs


def op9_decontaminate(spark, sf_dir) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
