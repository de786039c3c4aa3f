"""k-means with any distance, principal components and visual words."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sembla.functions.distances import distance_kernel
from sembla.functions.vectors import mix
from sembla.operators.dataset import nearest_chain
from sembla.operators.search import matrix, select_pivots
from sembla.session import map_arrow

_NEAR = "id long, centroid_id long, distance double"


def assign(df: DataFrame, key: str, vector: str, centroids: np.ndarray, distance: str = "L2") -> DataFrame:
    """id, centroid_id, distance: the nearest centroid of every vector (the smaller number at a tie). A narrow map."""
    kernel, points = distance_kernel(distance), np.asarray(centroids, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, x = matrix(batch.column(1))
            if len(good):
                d = kernel(x, points)
                c = d.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good)), pa.array(c), pa.array(d[np.arange(len(c)), c])], names=["id", "centroid_id", "distance"])

    return df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).transform(map_arrow, run, _NEAR)


def _step(df: DataFrame, vector: str, points: np.ndarray, distance: str, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Sums, counts, squared error and moved vectors of one assignment; one row per batch and centroid is shuffled."""
    kernel = distance_kernel(distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = matrix(batch.column(0))
            if not len(x):
                continue
            d = kernel(x, points)
            c = d.argmin(1)
            moved = (kernel(x, before).argmin(1) != c) if before is not None else np.ones(len(c), bool)
            for k in np.unique(c):
                mine = c == k
                yield pa.RecordBatch.from_pylist([{"c": int(k), "n": int(mine.sum()), "s": x[mine].sum(0).tolist(), "e": float((d[mine, k] ** 2).sum()), "m": int(moved[mine].sum())}], schema=pa.schema([("c", pa.int64()), ("n", pa.int64()), ("s", pa.list_(pa.float64())), ("e", pa.float64()), ("m", pa.int64())]))

    parts = df.select(F.col(vector).cast("array<double>")).transform(map_arrow, run, "c long, n long, s array<double>, e double, m long")
    flat = parts.select("c", "n", "e", "m", F.posexplode("s").alias("d", "x"))
    sums = flat.groupBy("c", "d").agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.sum("e").alias("e"), F.sum("m").alias("m")).collect()
    total, counts, error, moved = np.zeros_like(points), np.zeros(len(points), np.int64), np.zeros(len(points)), np.zeros(len(points), np.int64)
    for r in sums:
        total[r.c, r.d] = r.x
        counts[r.c], error[r.c], moved[r.c] = r.n, r.e, r.m
    return total, counts, float(error.sum()), int(moved.sum())


def adjust(points: np.ndarray, total: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Means of the clusters; an empty cluster keeps its centroid."""
    return np.where(counts[:, None] > 0, total / np.maximum(counts, 1)[:, None], points)


@dataclass
class KMeansState:
    """Centroids, elements per centroid, squared error and steps made."""

    centroids: np.ndarray
    counts: np.ndarray
    error: float
    steps: int
    moved: int


def kmeans(df: DataFrame, key: str, vector: str, k: int, distance: str = "L2", init: str | np.ndarray = "sss", max_steps: int = 20, min_moved: float = 0.0, min_centroids: float = 0.0, seed: int = 0, callback: Callable[[KMeansState], None] | None = None) -> KMeansState:
    """Alternates assignment and adjustment until at most min_moved vectors (a share, or a number from 1 on), or at most
    min_centroids centroids, move, or the sizes have been the same three times, or max_steps are made.

    init: sss (spread-out pivots of a bounded sample), random (hashed order), or an
    array. callback gets the state after every step. The centroids are put in nearest-neighbour order. Only sums per centroid
    reach the driver.
    """
    clean = df.where(F.col(vector).isNotNull())
    if isinstance(init, np.ndarray):
        points = np.asarray(init, np.float64)
    elif init == "random":
        points = np.array([r.v for r in clean.orderBy(mix(F.col(key), seed), key).limit(k).select(F.col(vector).cast("array<double>").alias("v")).collect()])
    else:
        points = np.array([v for _, v in select_pivots(clean, key, vector, k, distance)])
    points = points[nearest_chain(points)]
    n = clean.count()
    before, sizes = None, []
    counts, error, moved, step = np.zeros(len(points), np.int64), 0.0, n, 0
    for step in range(1, max_steps + 1):
        total, counts, error, moved = _step(clean, vector, points, distance, before)
        after = adjust(points, total, counts)
        shifted = int((np.abs(after - points).max(1) > 1e-12).sum())
        before, points = points, after
        sizes.append(counts.tolist())
        if callback:
            callback(KMeansState(points, counts, error, step, moved))
        few = moved <= (min_moved * n if min_moved < 1 else min_moved)
        still = shifted <= (min_centroids * len(points) if min_centroids < 1 else min_centroids)
        if few or still or (len(sizes) > 2 and sizes[-1] == sizes[-2] == sizes[-3]):
            break
    return KMeansState(points, counts, error, step, moved)


def kmeans_subsets(df: DataFrame, key: str, vector: str, k: int, distance: str = "L2", max_steps: int = 20, seed: int = 0) -> KMeansState:
    """Runs on growing hashed samples of 10 k 3^i rows (stopping at 0.1 % moved vectors or 1 % moved centroids), then on all rows."""
    clean = df.where(F.col(vector).isNotNull())
    n, size, start = clean.count(), 10 * k, "sss"
    while size < n:
        some = clean.where(mix(F.col(key), seed) < int(2**32 * size / n))
        state = kmeans(some, key, vector, k, distance, start, max_steps, 0.001, 0.01)
        start, size = state.centroids, size * 3
    return kmeans(clean, key, vector, k, distance, start, max_steps)


def cluster_stats(assigned: DataFrame) -> DataFrame:
    """Per centroid: elements, sum_sse, average_sse and the smallest, largest, mean distance and its deviation."""
    d = F.col("distance")
    return assigned.groupBy("centroid_id").agg(
        F.count(F.lit(1)).alias("elements"), F.sum(d * d).alias("sum_sse"), F.avg(d * d).alias("average_sse"), F.min(d).alias("dist_min"), F.max(d).alias("dist_max"), F.avg(d).alias("dist_avg"), F.stddev_pop(d).alias("dist_std")
    )


@dataclass
class PCAState:
    """Averages, eigenvectors (rows, largest eigenvalue first) and eigenvalues of the population covariance."""

    averages: np.ndarray
    transformation: np.ndarray
    eigenvalues: np.ndarray


def pca_fit(df: DataFrame, vector: str) -> PCAState:
    """Moments per batch in NumPy, summed; a matrix of dims x dims reaches the driver. The largest entry of each axis is positive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = matrix(batch.column(0))
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array([len(x)]), pa.array([x.sum(0).tolist()]), pa.array([(x.T @ x).ravel().tolist()])], names=["n", "s", "ss"])

    parts = df.select(F.col(vector).cast("array<double>")).transform(map_arrow, run, "n long, s array<double>, ss array<double>")
    add = lambda c: parts.select(F.posexplode(c).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).toPandas().sort_values("i")["x"].to_numpy()
    n = parts.agg(F.sum("n")).first()[0] or 0
    if not n:
        return PCAState(np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    s, ss = add("s"), add("ss")
    mean = s / n
    cov = ss.reshape(len(s), len(s)) / n - np.outer(mean, mean)
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)
    axes = axes[:, order].T
    sign = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])
    return PCAState(mean, axes * sign[:, None], values[order])


def pca_apply(df: DataFrame, key: str, vector: str, state: PCAState, dims: int) -> DataFrame:
    """id, vector: (x - averages) on the first dims axes; unusable vectors are left out."""
    axes, mean = state.transformation[:dims].T, state.averages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, x = matrix(batch.column(1))
            if len(good):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good)), pa.array(((x - mean) @ axes).tolist(), pa.list_(pa.float64()))], names=["id", "vector"])

    return df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>")).transform(map_arrow, run, "id long, vector array<double>")


def pca_report(state: PCAState) -> list[tuple[int, float, float]]:
    """(number, eigenvalue, accumulated share) of every axis."""
    share = np.cumsum(state.eigenvalues) / max(float(state.eigenvalues.sum()), 1e-300)
    return [(i, float(v), float(s)) for i, (v, s) in enumerate(zip(state.eigenvalues, share))]


def bow_histogram(assigned: DataFrame, frames: DataFrame, key: str, frame: str, words: int) -> DataFrame:
    """frame, histogram: how often each of ``words`` centroids is the nearest of the frame's vectors, scaled to norm 1.

    assigned: id, centroid_id; frames: key, frame.
    """
    counts = assigned.join(frames.select(F.col(key).cast("long").alias("id"), frame), "id").groupBy(frame, "centroid_id").agg(F.count(F.lit(1)).cast("double").alias("n"))
    packed = counts.groupBy(frame).agg(F.map_from_entries(F.collect_list(F.struct("centroid_id", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(words - 1).cast("long")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("norm"))
    return packed.select(frame, cells.alias("histogram"))


def average_descriptor(df: DataFrame, group: list[str], vector: str) -> DataFrame:
    """group, vector: element-wise mean of a group's vectors, by partial sums per element; null vectors and groups are left out."""
    flat = df.where(F.col(vector).isNotNull()).dropna(subset=group).select(*group, F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x"))
    means = flat.groupBy(*group, "i").agg(F.avg("x").alias("x"))
    return means.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("vector"))
