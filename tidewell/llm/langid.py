"""Operator 3: hierarchical language identification.

Languages are first grouped into families by agglomerating their mean profiles. A family is
predicted by one-versus-rest linear support vector machines; within it, one-versus-one linear
support vector machines separate the related languages, by votes and then by margins.

Features are byte uni- and trigrams of the lower-cased text with all but letters blanked,
hashed into ``BUCKETS`` bins, as shares of the text. A linear model of shares is the mean over
the text of its n-grams' weights, so whole texts of any length are scored in one vectorised pass
and bounded memory.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, bounded_batches

BUCKETS = 4096
SAMPLE = 2048  # labelled rows the classifier is fitted on, over all languages; a documented bound
UNKNOWN = "und"
LEAST_SCORE = 0.3  # a stage rejects what scores less; two undecided choices, of a family and within it, score 0.25

# Bytes that are kept: letters of ASCII and all bytes of longer characters.
_BLANK = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def grams(data: bytes) -> np.ndarray:
    """Bins of all n-grams of folded bytes."""
    b = np.frombuffer(b"  " + data + b" ", dtype=np.uint8).astype(np.uint32)
    three = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    three = ((three * np.uint32(2654435761)) >> np.uint32(21)) + np.uint32(2048)  # 11 bits
    one = ((b[2:] * np.uint32(2246822519)) >> np.uint32(21))
    blank = (b[1:-1] == 0x20) & (b[2:] == 0x20)
    return np.concatenate([three[~blank], one[~blank]])


def folded(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_BLANK).split())


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def profile(text: str) -> np.ndarray:
    counts = np.bincount(grams(folded(text)), minlength=BUCKETS).astype(np.float32)
    return counts / max(1.0, counts.sum())


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 8.0, rounds: int = 12) -> np.ndarray:
    """Dual coordinate descent for squared hinge loss; the last weight is the bias. y: +1 / -1."""
    x = np.column_stack([x, np.ones(len(x), np.float32)])
    square = (x * x).sum(1) + 1.0 / (2 * cost)
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    order = np.random.default_rng(17)
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            gradient = y[i] * (w @ x[i]) - 1 + alpha[i] / (2 * cost)
            new = max(alpha[i] - gradient / square[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


def families(centroids: np.ndarray) -> list[list[int]]:
    """Average-link agglomeration by cosine until half as many groups as languages are left."""
    unit = centroids / np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
    total, size = (unit @ unit.T).astype(np.float64), np.ones(len(unit))  # sums of cosines between groups
    groups = [[k] for k in range(len(unit))]
    while len(groups) > max(1, (len(unit) + 1) // 2):
        close = np.where(np.triu(np.ones_like(total, dtype=bool), 1), total / np.outer(size, size), -np.inf)
        i, j = np.unravel_index(int(close.argmax()), close.shape)
        total[i] += total[j]
        total[:, i] += total[:, j]
        total = np.delete(np.delete(total, j, 0), j, 1)
        size[i] += size[j]
        size = np.delete(size, j)
        groups[i] = sorted(groups[i] + groups.pop(j))
    return sorted(groups)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    groups: tuple[tuple[int, ...], ...]
    weights: np.ndarray  # (classifiers, BUCKETS): families first, then pairs
    bias: np.ndarray
    pairs: tuple[tuple[int, int], ...]

    @staticmethod
    def fit(x: np.ndarray, labels: list[str]) -> Model:
        """``x``: a profile in each row."""
        languages = tuple(sorted(set(labels)))
        if not languages:
            return Model((), (), np.zeros((0, BUCKETS), np.float32), np.zeros(0), ())
        place = {name: k for k, name in enumerate(languages)}
        y = np.array([place[x] for x in labels])
        scale = (1.0 / np.sqrt(x.mean(0) + 1e-5)).astype(np.float32)
        x *= scale  # frequent bins would drown the rest
        groups = families(np.stack([x[y == k].mean(0) for k in range(len(languages))]))
        family = np.array([next(g for g, own in enumerate(groups) if k in own) for k in y])
        models = [linear_svm(x, np.where(family == g, 1, -1)) for g in range(len(groups))] if len(groups) > 1 else []
        pairs = [(a, b) for own in groups for a in own for b in own if a < b]
        for a, b in pairs:
            of = (y == a) | (y == b)
            models.append(linear_svm(x[of], np.where(y[of] == a, 1, -1)))
        w = np.array(models).reshape(len(models), BUCKETS + 1)
        return Model(languages, tuple(map(tuple, groups)), (w[:, :-1] * scale).astype(np.float32), w[:, -1].copy(), tuple(pairs))

    def margins(self, data: bytes) -> np.ndarray:
        total, n = np.zeros(len(self.bias)), 0
        for at in range(0, len(data), 1 << 20):  # n-grams across the cuts are read with both
            bins = grams(data[max(0, at - 2) : at + (1 << 20)])
            counts = np.bincount(bins, minlength=BUCKETS)
            total += self.weights @ counts
            n += len(bins)
        return total / max(1, n) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        m = self.margins(folded(text))
        sure = 1.0 / (1.0 + np.exp(-2.0 * np.clip(m, -30, 30)))
        g = int(m[: len(self.groups)].argmax()) if len(self.groups) > 1 else 0
        score = float(sure[g]) if len(self.groups) > 1 else 1.0
        first = len(self.groups) if len(self.groups) > 1 else 0
        votes: dict[int, list[float]] = {k: [0, 0.0, 1.0] for k in self.groups[g]}
        for p, (a, b) in enumerate(self.pairs, first):
            if a in votes:
                for k, own in ((a, sure[p]), (b, 1 - sure[p])):
                    votes[k][0] += own >= 0.5
                    votes[k][1] += float(own)
                    votes[k][2] = min(votes[k][2], float(own))
        best = max(votes, key=lambda k: (votes[k][0], votes[k][1], -k))
        return self.languages[best], score * votes[best][2]


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on about ``sample`` labelled rows outside the held-out part, evenly over languages.

    ``sample`` bounds the labelled rows that are used (twice as many at most) and nothing else:
    labels are counted over all rows, every label has its even share of the sample, and the rows
    used are those whose id's hash falls below a share chosen per label, so reruns use the same
    ones. Profiles of whole texts are taken where the rows are; the driver holds one of fixed
    size for each row of the sample, however long the texts.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    buckets = 1 << 20
    place = F.pmod(F.xxhash64("doc_id"), F.lit(buckets))
    counts = known.groupBy("lang").agg(F.count("*").alias("n"), F.min(place).alias("least"))
    counts = Table(counts, "labels").df  # written: its size is known to the join
    languages = counts.count()
    if not languages:
        return Model.fit(np.zeros((0, BUCKETS), np.float32), [])
    share = F.least(F.lit(buckets), F.floor(F.lit(buckets * max(1, sample // languages)) / F.col("n")) + 1)
    shares = counts.select(F.col("lang").alias("label"), F.greatest(share, F.col("least") + 1).alias("share"))  # one row of each label at least
    rows = known.select("lang", "text", "doc_id").join(shares, F.col("lang") == F.col("label")).where(place < F.col("share"))

    def run(batches):
        for batch in batches:
            kept = [k for k, t in enumerate(batch.column(1).to_pylist()) if has_letter(t)]
            texts = batch.column(1).take(pa.array(kept, pa.int64())).to_pylist()
            profiles = [profile(t) for t in texts]
            filled = [np.flatnonzero(p).astype("<u2") for p in profiles]  # few bins of a text are
            profiles = pa.array([at.tobytes() + p[at].tobytes() for at, p in zip(filled, profiles, strict=True)], pa.binary())
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), profiles, batch.column(2).take(at)], ["lang", "profile", "doc_id"])

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    profiles = rows.mapInArrow(run, f"lang string, profile binary, doc_id {doc_type}")
    order = [F.xxhash64("doc_id"), "doc_id", "lang", "profile"]
    taken = profiles.orderBy(*order).limit(2 * sample).collect()  # a bounded number of rows of bounded size
    x = np.zeros((len(taken), BUCKETS), np.float32)
    for k, r in enumerate(taken):
        n = len(r["profile"]) // 6
        x[k, np.frombuffer(r["profile"], dtype="<u2", count=n)] = np.frombuffer(r["profile"], dtype="<f4", offset=2 * n)
    return Model.fit(x, [r["lang"] for r in taken])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text, from the text alone.

    ``und`` with score 0 where the text is null, empty or has no letter, or nothing was
    learned. Rows with a null id count as not held out; repeated rows are answered each.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            got = [model.predict(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {doc_type}, held_out boolean, lang_pred string, score double")


def op3_language_id(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))


def keep_identified(docs: DataFrame, model: Model, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language was told with a score of ``least`` or more, unchanged; the others go.

    Null and empty texts and those without a letter go; repeated rows go or stay together. Of a
    model that has learned nothing (no labelled row) all texts with a letter stay. An empty
    table gives an empty one; all columns are kept as they are, whatever their names.
    """
    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def told(text: str | None) -> bool:
        if not model.languages:
            return has_letter(text)
        language, score = model.predict(text)
        return language != UNKNOWN and score >= least

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([told(t) for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
