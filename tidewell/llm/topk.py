"""Operator 1: exact top-k search with block-at-a-time pruning.

Rows are ordered by the centroid they are nearest to (centroids fitted on a bounded sample; any
centroids give the same results, good ones give tight blocks) and cut into document-range
blocks, each with a forward index (its matrix) and per-dimension maxima and minima. Per query
the bound of a block is the sum over dimensions of the largest product its range allows. Blocks
are scored in descending bound until the bound falls below the query's k-th score; a block that
could only tie is skipped if all its ids are above the k-th id.

Distribution: blocks are grouped into shards of bounded size, queries into batches of bounded
size; each (shard, batch) cell is one group, and a last aggregation merges the shards' lists of
k. Cells read every query once a shard and every row once a batch, and all are independent.
Scores are exact: doubles, 64-bit or unbounded integers, by the bound of what a block can give.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Table, bounded_batches

K, BLOCK, SHARD, BATCH = 5, 128, 16384, 4096
SAMPLE, CENTROIDS = 4096, 64  # rows and centroids of the fitted order, whatever the table's size


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v, floor(scale * x) of each component as double, of vectors without null or non-finite parts.

    What is finite stays, however large: a component times ``scale`` is at most about 1e41 for floats.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: F.coalesce(finite(x.cast("double")), F.lit(False)))).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        # floor of a double is a long in SQL, which ends at 2**63; doubles from 2**52 on have no fraction
        F.transform("embedding", lambda x: _floor(x.cast("double") * scale)).alias("v"),
    )


def _floor(x: F.Column) -> F.Column:
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def _centroids(rows: DataFrame) -> np.ndarray:
    """A few rounds of Lloyd's algorithm on the ``SAMPLE`` rows that a hash of the id orders first."""
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    if not picked:
        return np.zeros((0, 0))
    dims = max(len(r.v) for r in picked)
    x = np.array([r.v for r in picked if len(r.v) == dims], dtype=np.float64)
    c = np.unique(x, axis=0)
    c = c[np.linspace(0, len(c) - 1, min(CENTROIDS, len(c))).astype(int)]
    for _ in range(8):
        near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        for k in np.unique(near):
            c[k] = x[near == k].mean(0)
    return c


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _scores(queries: np.ndarray, rows: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products of integers held as doubles; ``most`` bounds any partial sum.

    Doubles add up exactly to 2**53, 64-bit integers to 2**63, Python's integers without end.
    """
    if most < 2.0**53:
        return (queries @ rows.T).astype(np.int64)
    if most < 2.0**62:
        return queries.astype(np.int64) @ rows.astype(np.int64).T
    exact = lambda m: np.array([[int(x) for x in r] for r in m.tolist()], dtype=object).reshape(m.shape)
    return exact(queries) @ exact(rows).T


def search_cell(q_ids, q_rows, queries, ids, row_numbers, rows, k: int, block: int):
    """The k best of ``rows`` for each query, as lists (query position, vec_id, score), and how many blocks were scored.

    ``q_rows`` and ``row_numbers`` tell rows apart, so that a query meets all rows but itself.
    """
    starts = np.arange(0, len(ids), block)
    top, low = np.maximum.reduceat(rows, starts), np.minimum.reduceat(rows, starts)
    smallest = np.minimum.reduceat(ids, starts)
    with np.errstate(over="ignore", invalid="ignore"):
        size = np.abs(queries) @ np.maximum(np.abs(top), np.abs(low)).T  # no partial sum is larger
        bounds = np.maximum(queries, 0) @ top.T + np.minimum(queries, 0) @ low.T
        # rounding beyond 2**53 is made up for; what overflows is never passed over
        bounds = np.where(size < 2.0**53, bounds, np.where(np.isfinite(size) & np.isfinite(bounds), bounds + size * 1e-12, np.inf))
    order = np.argsort(-bounds, axis=1, kind="stable")
    best: list[list[tuple]] = [[] for _ in q_ids]  # (-score, vec_id, row), ascending, k at most
    alive, scored = np.arange(len(q_ids)), 0
    for step in range(len(starts)):
        # queries that want the same block next are scored together
        wanted = order[alive, step]
        stay = np.ones(len(alive), dtype=bool)
        for b in np.unique(wanted):
            todo = []
            for i in np.flatnonzero(wanted == b):
                q = alive[i]
                kth = best[q][-1] if len(best[q]) >= k else None
                if kth is not None and bounds[q, b] < -kth[0]:
                    stay[i] = False  # this and all later blocks are below the k-th
                elif kth is None or bounds[q, b] > -kth[0] or smallest[b] <= kth[1]:
                    todo.append(q)
            if not todo:
                continue
            scored += len(todo)
            own = slice(starts[b], starts[b] + block)
            numbers, own_ids = row_numbers[own], ids[own]
            for q, line in zip(todo, _scores(queries[todo], rows[own], float(size[todo, b].max())), strict=True):
                keep = numbers != q_rows[q]
                if len(best[q]) >= k:
                    keep &= line >= -best[q][-1][0]
                at = np.flatnonzero(keep)
                if len(at) > 4 * k and line.dtype != object:  # ties with the last place stay
                    at = at[line[at] >= np.partition(line[at], -k)[-k]]
                if len(at):
                    new = zip((-line[at]).tolist(), own_ids[at].tolist(), numbers[at].tolist(), strict=True)
                    best[q] = sorted([*best[q], *new])[:k]
        alive = alive[stay]
        if not len(alive):
            break
    return best, scored


def top_k(vectors: DataFrame, every: int = 50, k: int = K, block: int = BLOCK, shard: int = SHARD, batch: int = BATCH) -> DataFrame:
    """For each row whose vec_id is divisible by ``every``: the k other rows of largest integer inner product.

    Ties go to the smaller vec_id. Vectors that are null, hold a null or a non-finite component, or
    have no id take no part; of differing lengths, those of another length than the query's take
    no part in its list. Repeated ids each count as a row, as queries too: a query meets every
    row but itself. Scores are exact and ordered as such whatever their size; one that a long
    cannot hold is given as the nearest long. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = quantised(vectors)
    centroids = _centroids(rows)

    def place(batches):
        half = (centroids * centroids).sum(1) / 2
        for b in batches:
            lists, near = b.column(1), np.full(len(b), -1, dtype=np.int32)
            of = np.flatnonzero(lists.value_lengths().to_numpy(zero_copy_only=False) == centroids.shape[1])
            if len(of):
                with np.errstate(over="ignore", invalid="ignore"):
                    near[of] = (half - _matrix(lists.take(pa.array(of))) @ centroids.T).argmin(1)
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(near)], ["vec_id", "v", "near"])

    if centroids.size:
        rows = rows.mapInArrow(place, "vec_id long, v array<double>, near int")
    else:
        rows = rows.withColumn("near", F.lit(-1))
    rows = rows.withColumn("dims", F.size("v"))
    count = vectors.count()
    ordered = Table(
        rows.repartitionByRange(max(1, -(-count // shard)), "dims", "near", "vec_id").sortWithinPartitions("dims", "near", "vec_id")
        .withColumns({"shard": F.spark_partition_id(), "row": F.monotonically_increasing_id()}),
        "topk",
    )  # written, so that shards and row numbers are data
    # the shards there are, not those asked for
    shards = (ordered.df.agg(F.max("shard")).first()[0] or 0) + 1
    batches = max(1, -(-(count // every + 1) // batch))
    queries = ordered.df.where(F.col("vec_id") % every == 0).withColumn("batch", F.pmod(F.xxhash64("row"), F.lit(batches)).cast("int"))
    cells = (
        queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "batch", F.lit(True).alias("query"), "row", "vec_id", "v", "near")
        .unionByName(ordered.df.select("shard", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch"), F.lit(False).alias("query"), "row", "vec_id", "v", "near"))
    )

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lists = table["v"].combine_chunks()
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
        is_query = table["query"].to_numpy()
        near, vec_id, number = (table[c].to_numpy() for c in ("near", "vec_id", "row"))
        out: list[tuple] = []
        for d in np.unique(lengths):
            of = np.flatnonzero(lengths == d)
            q, r = of[is_query[of]], of[~is_query[of]]
            if len(q) and len(r):
                r = r[np.lexsort((vec_id[r], near[r]))]  # the document order of the blocks
                m = (lambda at, d=d: _matrix(lists.take(pa.array(at))) if d else np.zeros((len(at), 1)))
                best, _ = search_cell(vec_id[q], number[q], m(q), vec_id[r], number[r], m(r), k, block)
                for query, row, found in zip(vec_id[q].tolist(), number[q].tolist(), best, strict=True):
                    out += [(row, query, i, -s) for s, i, _ in found]
        rows, ids, found, scores = zip(*out, strict=True) if out else [()] * 4
        # exact order in decimal digits; the widest product of floats has 82 and of doubles over 600
        told = [str(s) for s in scores]
        bounded = [max(-(1 << 63), min((1 << 63) - 1, s)) for s in scores]
        columns = [pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(found, pa.int64()), pa.array(bounded, pa.int64()), pa.array(list(map(_sortable, told)), pa.string())]
        return pa.table(columns, ["row", "query_id", "vec_id", "score", "exact"])

    lists = cells.groupBy("shard", "batch").applyInArrow(search, "row long, query_id long, vec_id long, score long, exact string")
    # the limit on ranks also runs before the shuffle, so each task sends k rows a query at most
    ranked = Window.partitionBy("row").orderBy(F.desc("score"), F.desc("exact"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _sortable(score: str) -> str:
    """Digits whose order as text is that of the integers, told only where a long cannot hold them."""
    if -(1 << 63) <= int(score) < 1 << 63:
        return ""
    if score[0] != "-":
        return f"{len(score):05d}{score}"
    return f"-{99999 - len(score):05d}" + score[1:].translate(str.maketrans("0123456789", "9876543210"))


def op1_topk_search(spark, sf_dir) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
