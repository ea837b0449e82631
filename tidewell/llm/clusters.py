"""Operator 12: exact integer k-means with block-norm screening.

A vector is cut into segments of ``SEGMENT`` components. Their Euclidean norms, measured from one
fixed origin (the middle of the first centroids), are computed once and stored beside the vector.
By Cauchy-Schwarz two vectors are at least as far apart as their lists of segment norms, so those
short lists give a lower bound of every squared distance. Per vector the centroid of the lowest
bound is tried first; only centroids whose bound does not exceed the distance found get an exact
integer distance. A bound is lowered by more than its rounding error, and a centroid that could tie
is never passed over, so the result is that of trying them all.

Distribution: the quantised vectors and their norms are written once; a round is one pass without a
shuffle of vectors. A task adds up its own vectors and sends a row for each centroid and component;
the driver gets the sums of all tasks, ``k`` times components (and a count) however large the table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, bounded_batches

DIMS, SCALE, K, ROUNDS, SEGMENT = 64, 64, 16, 3, 8
_SMALL = 2.0**27  # integers below it have squared distances below 2**62, whatever they are
_LIMB = 60  # bits of a part of a sum, so that sums of any size travel as longs
_LONG = 2**63 - 1


def quantised(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and v: floor(scale * x) of each component x as double, kept as doubles, which hold such integers exactly.

    Vectors that are null, of another length, or hold a null or non-finite component are left out.
    """
    x = lambda c: c.cast("double")
    finite = lambda c: F.coalesce(~F.isnan(x(c)) & (F.abs(x(c)) < float("inf")), F.lit(False))
    # a double from 2**52 on has no fraction; SQL's floor gives a long, which ends at 2**63
    floor = lambda c: F.when(F.abs(c) < 2.0**52, F.floor(c).cast("double")).otherwise(c)
    kept = vectors.where((F.size("embedding") == dims) & F.forall("embedding", finite))
    return kept.select("vec_id", F.transform("embedding", lambda c: floor(x(c) * scale)).alias("v"))


def _rows(column: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def norms(rows: np.ndarray, origin: np.ndarray, segment: int) -> np.ndarray:
    """Segment norms of rows measured from ``origin``; the last segment may be short."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.sqrt(np.add.reduceat((rows - origin) ** 2, np.arange(0, rows.shape[1], segment), axis=1))


def _distances(rows: np.ndarray, centroid: list[int]) -> np.ndarray:
    """Exact squared distances of integers held as doubles: 64-bit where they must fit, else Python's integers."""
    if max(map(abs, centroid)) < _SMALL and (not rows.size or np.abs(rows).max() < _SMALL):
        d = rows.astype(np.int64) - np.array(centroid, dtype=np.int64)
        return np.einsum("ij,ij->i", d, d)
    exact = [sum((int(a) - b) ** 2 for a, b in zip(row, centroid, strict=True)) for row in rows.tolist()]
    return np.array(exact, dtype=object)


def assign(rows: np.ndarray, sizes: np.ndarray, centroids: list[list[int]], centre_sizes: np.ndarray):
    """Nearest centroid (ties: smaller number), squared distance and number of exact distances of each row."""
    n, k = len(rows), len(centroids)
    with np.errstate(over="ignore", invalid="ignore"):
        bounds = ((sizes[:, None, :] - centre_sizes[None]) ** 2).sum(2)
        slack = 1e-9 * ((sizes**2).sum(1)[:, None] + (centre_sizes**2).sum(1)[None]) + 1
        bounds = np.where(np.isfinite(bounds) & np.isfinite(slack), bounds - slack, -np.inf)  # what overflows is never passed over
    best = bounds.argmin(1)
    distance = np.zeros(n, dtype=object if any(abs(x) >= _SMALL for c in centroids for x in c) or (n and np.abs(rows).max() >= _SMALL) else np.int64)
    tried = np.ones(n, dtype=np.int32)
    for c in range(k):
        own = np.flatnonzero(best == c)
        distance[own] = _distances(rows[own], centroids[c])
    first = best.copy()
    for c in range(k):
        own = np.flatnonzero((first != c) & (bounds[:, c] <= distance.astype(np.float64)))
        d = _distances(rows[own], centroids[c])
        tried[own] += 1
        nearer = (d < distance[own]) | ((d == distance[own]) & (c < best[own]))
        better = own[nearer.astype(bool)]
        distance[better], best[better] = d[nearer.astype(bool)], c
    return best, distance, tried


def _screen(centroids: list[list[int]], origin: np.ndarray, segment: int):
    return norms(np.array(centroids, dtype=np.float64), origin, segment)


def _totals(centroids, origin, segment):
    """A task's sums: (cluster, component, limb, total), component -1 for the count."""
    centre_sizes, k, dims = _screen(centroids, origin, segment), len(centroids), len(origin)

    def run(batches):
        sums, counts = [[0] * dims for _ in range(k)], [0] * k
        for batch in batches:
            rows = _rows(batch.column(0))
            if not len(rows):
                continue
            best, _, _ = assign(rows, _rows(batch.column(1)), centroids, centre_sizes)
            for c in np.unique(best).tolist():
                own = rows[best == c]
                small = np.abs(own).max() < _SMALL
                part = own.astype(np.int64).sum(0).tolist() if small else [sum(map(int, col)) for col in own.T.tolist()]
                sums[c] = [a + b for a, b in zip(sums[c], part, strict=True)]
                counts[c] += len(own)
        out = [(c, -1, 0, n) for c, n in enumerate(counts) if n]
        for c, line in enumerate(sums):
            for j, total in enumerate(line):
                sign, rest, limb = (-1 if total < 0 else 1), abs(total), 0
                while rest:
                    out.append((c, j, limb, sign * (rest & ((1 << _LIMB) - 1))))
                    rest, limb = rest >> _LIMB, limb + 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["cluster", "component", "limb", "total"])

    return run


def _moved(kept: DataFrame, centroids, origin, segment) -> list[list[int]]:
    """Centroids after a round: componentwise floor of the mean; one without vectors stays where it is."""
    parts = kept.select("v", "norms").mapInArrow(_totals(centroids, origin, segment), "cluster int, component int, limb int, total long")
    told = parts.groupBy("cluster", "component", "limb").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    counts, sums = {}, {}
    for r in told.collect():  # a row for each centroid, component and limb
        if r.component < 0:
            counts[r.cluster] = int(r.total)
        else:
            sums[r.cluster, r.component] = sums.get((r.cluster, r.component), 0) + (int(r.total) << (_LIMB * r.limb))
    return [[sums.get((c, j), 0) // counts[c] for j in range(len(old))] if counts.get(c) else old for c, old in enumerate(centroids)]


def _answers(centroids, origin, segment):
    centre_sizes = _screen(centroids, origin, segment)

    def run(batches):
        for batch in batches:
            best, distance, tried = assign(_rows(batch.column(1)), _rows(batch.column(2)), centroids, centre_sizes) if len(batch) else ([], np.zeros(0), [])
            told = [min(int(d), _LONG) for d in distance.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.int32()), pa.array(told, pa.int64()), pa.array(tried, pa.int32())], ["vec_id", "cluster", "distance", "exact"])

    return run


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, segment: int = SEGMENT) -> DataFrame:
    """A row for each kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, exact (distances computed).

    The first centroids are the kept vectors of the smallest sha256 of ``1:<vec_id>``, equal ids by their
    components, null ids last; with fewer than ``k`` kept vectors there are as many centroids. Repeated
    rows are vectors like others. Components may be of any finite size; a distance or an inertia beyond a
    long is told as the largest long. An empty table, or one without a kept vector, gives no rows.
    Further columns are ignored.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    made = quantised(vectors, dims, scale)
    seeds = made.orderBy(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "v").limit(k).collect()
    centroids = [[int(x) for x in r.v] for r in seeds]
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, cluster int, distance long, exact int"
    if not centroids:
        return spark.createDataFrame([], f"{schema}, cluster_inertia long, inertia long, centroid_sha256 string")
    origin = np.array(centroids, dtype=np.float64).mean(0)

    def measured(batches):
        for batch in batches:
            sizes = norms(_rows(batch.column(1)), origin, segment) if len(batch) else np.zeros((0, 1))
            lists = pa.ListArray.from_arrays(np.arange(len(batch) + 1, dtype=np.int32) * sizes.shape[1], pa.array(sizes.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["vec_id", "v", "norms"])

    kept = Table(made.mapInArrow(measured, f"vec_id {kind}, v array<double>, norms array<double>"), "vectors")
    for _ in range(rounds):
        centroids = _moved(kept.df, centroids, origin, segment)
    assigned = Table(kept.df.select("vec_id", "v", "norms").mapInArrow(_answers(centroids, origin, segment), schema), "clusters")
    kept.drop()
    per = {r.cluster: int(r.total) for r in assigned.df.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # k rows at most
    told = [(c, min(total, _LONG), min(sum(per.values()), _LONG), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, total in per.items()]
    facts = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.df.join(F.broadcast(facts), "cluster")  # k rows at most


def op12_centroid_clusters(spark, sf_dir) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("exact")
