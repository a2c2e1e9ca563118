"""Exact k-means over integer vectors, with annulus search for the nearest centroid.

Centroids are sorted by norm. A vector's distance to the centroid of nearest norm
bounds the distance to its nearest one, and by the triangle inequality that one's
norm lies within the bound of the vector's norm. Binary search gives the centroids of
that annulus; they are compared exactly, from the nearest norm outwards, and the
annulus shrinks as nearer ones are found. Norms are floats with a margin over their
rounding, so a centroid at the edge, which may tie, is always compared.

Each round is one pass over the vectors: every task adds up its vectors by centroid,
and only those sums (one row a task and centroid) are shuffled. The driver holds the
k centroids, and no more.

Cases: vectors that are null, of another length or with a null or non-finite
component are left out; a vec_id may be null (its vector never starts as a centroid)
or repeated (each row counts); with fewer vectors than k there are as many centroids;
components beyond 2**27 in size count as 2**27, so that distances fit a long; other
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provara.llm import shared

#: Components are at most so large, and vectors are taken so many at a time.
BOUND, ROWS = 1 << 27, 8192
#: More than the relative error of norms and their differences.
MARGIN = 1e-9


def whole_numbers(embedding: str, dims: int, scale: int) -> Column:
    """floor(scale * x) of each component, null for vectors that are left out."""
    x = F.col(f"`{embedding}`").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    low, high = F.lit(float(-BOUND)), F.lit(float(BOUND))
    whole = F.transform(x, lambda v: F.floor(F.greatest(F.least(v * scale, high), low)).cast("int"))
    return F.when((F.size(x) == dims) & F.coalesce(finite, F.lit(False)), whole)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row of x (ties: the smaller number), its squared distance, and how many were compared."""
    norms = np.sqrt((centroids * centroids).sum(1).astype(float))
    order = np.argsort(norms, kind="stable")
    norms, sorted_ = norms[order], centroids[order]
    own = np.sqrt((x * x).sum(1).astype(float))
    after = np.searchsorted(norms, own)
    before = np.maximum(after - 1, 0)
    after = np.minimum(after, len(norms) - 1)
    start = np.where(own - norms[before] <= norms[after] - own, before, after)
    away = x - sorted_[start]
    best, label = (away * away).sum(1), order[start]

    def reach(rows: np.ndarray) -> np.ndarray:
        bound = np.sqrt(best[rows].astype(float))
        return bound + MARGIN * (own[rows] + bound + 1)

    every = np.arange(len(x))
    low = np.searchsorted(norms, own - reach(every), "left")
    high = np.searchsorted(norms, own + reach(every), "right")
    compared = len(x)
    for side in (-1, 1):
        rows, step = every, side
        while len(rows):
            at = start[rows] + step
            rows = rows[(low[rows] <= at) & (at < high[rows])]
            at = start[rows] + step
            within = np.abs(norms[at] - own[rows]) <= reach(rows)
            rows, at = rows[within], at[within]  # norms further out differ by more
            away = x[rows] - sorted_[at]
            distance = (away * away).sum(1)
            nearer = (distance < best[rows]) | ((distance == best[rows]) & (order[at] < label[rows]))
            best[rows[nearer]], label[rows[nearer]] = distance[nearer], order[at][nearer]
            compared += len(rows)
            step += side
    return label, best, compared


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for a in range(0, b.num_rows, ROWS):
            part = b.slice(a, ROWS)
            yield part, part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _sums(centroids: np.ndarray, dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for _, x in _blocks(batches, dims):
            label, _, _ = nearest(x, centroids)
            np.add.at(total, label, x)
            n += np.bincount(label, minlength=len(centroids))
        held = np.flatnonzero(n)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(total[held].ravel()), dims).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(n[held]), lists], ["cluster", "n", "total"])

    return run


def _assigned(centroids: np.ndarray, dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _blocks(batches, dims):
            label, distance, _ = nearest(x, centroids)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(label.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def _moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of the mean of each centroid's vectors; one without vectors stays."""
    dims = centroids.shape[1]
    parts = vectors.mapInArrow(_sums(centroids, dims), "cluster int, n long, total array<long>")
    sums = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[i]) for i in range(dims))).alias("total"))
    now = centroids.copy()
    for row in sums.collect():  # at most k rows
        now[row.cluster] = [t // row.n for t in row.total]
    return now


def clustered(
    vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, embedding: str = "embedding"
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid (its final components), one row a vector kept.

    The first centroids are the k vectors of least sha256 of "seed:vec_id".
    """
    spark = vectors.sparkSession
    with shared.Scratch(spark) as tables:
        whole = vectors.select("vec_id", whole_numbers(embedding, dims, scale).alias("v")).where("v is not null")
        # the rounds read the integers, which are a fraction of the floats
        held = tables.keep(whole)
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = held.where("vec_id is not null").orderBy(place, "v").limit(k).select("v").collect()
    if not first:  # no vector has an id
        first = held.orderBy("v").limit(k).select("v").collect()
    kind = held.schema["vec_id"].dataType.simpleString()
    if not first:
        none = "cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
        return spark.createDataFrame([], f"vec_id {kind}, {none}")
    centroids = np.array([row.v for row in first], np.int64)
    for _ in range(rounds):
        now = _moved(held, centroids)
        settled, centroids = (now == centroids).all(), now
        if settled:  # the rounds left would not move them either
            break
    told = held.mapInArrow(_assigned(centroids, dims), f"vec_id {kind}, cluster int, distance long")
    sums = {row.cluster: row.inertia for row in told.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    about = [(c, sums.get(c, 0), sum(sums.values()), v.tolist()) for c, v in enumerate(centroids)]
    side = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return told.join(F.broadcast(side), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
