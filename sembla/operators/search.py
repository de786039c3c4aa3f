"""Similarity joins of a query set against all references: exact in blocks, with pivots, with hashing.

Results are rows (query_id, rank, ref_id, distance), ordered by (distance, ref_id).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sembla.functions.distances import Kernel, distance_kernel
from sembla.session import map_arrow, ship_package

#: Queries that are broadcast at most; more are searched as a grid of blocks.
QUERY_BLOCK = 20_000
_PAIRS = "query_id long, ref_id long, distance double"


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the rows with a usable vector (not null or empty, without null elements), and these vectors.

    Usable vectors of different lengths raise a ValueError.
    """
    sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    row = np.repeat(np.arange(len(sizes)), sizes)
    bad = np.bincount(row[flat.is_null().to_numpy(zero_copy_only=False)], minlength=len(sizes)) > 0 if flat.null_count else np.zeros(len(sizes), bool)
    good = np.flatnonzero((sizes > 0) & ~bad)
    if not len(good):
        return good, np.zeros((0, 0))
    width = sizes[good[0]]
    if (sizes[good] != width).any():
        raise ValueError("vectors of different lengths")
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if len(good) < len(sizes):
        keep = np.zeros(len(sizes), bool)
        keep[good] = True
        values = values[keep[row]]
    return good, values.reshape(-1, width)


Block = tuple[np.ndarray, np.ndarray, np.ndarray]


def _unpacked(table: pa.Table | pa.RecordBatch) -> Block | None:
    """Ids, vectors and group hashes of the usable rows of id, v, g."""
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns]
    good, x = matrix(columns[1])
    return (columns[0].to_numpy()[good], x, columns[2].to_numpy()[good]) if len(good) else None


def _stream(batches: Iterable[pa.RecordBatch]) -> bytes:
    """Record batches as one value of bytes."""
    sink = pa.BufferOutputStream()
    batches = list(batches)
    with pa.ipc.new_stream(sink, batches[0].schema) as out:
        for batch in batches:
            out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def against(queries: DataFrame, references: DataFrame, scan: Callable, schema: str, most: int | None = None, unpack: Callable = _unpacked) -> DataFrame:
    """scan(block of queries)(batches of references) for every block against all references; both sides begin with id.

    A block is what unpack makes of a table of queries (None: nothing to do).

    Up to ``most`` queries (QUERY_BLOCK) are one block, which is broadcast: the references are
    scanned where they are. More are a grid: queries in blocks and references in batches are
    packed, one row each, and every block meets every batch by a join on (block, lane), where
    the batches are spread over lanes and the blocks copied to all of them. Neither side
    reaches the driver then, and each is read once.
    """
    spark, most = references.sparkSession, most or QUERY_BLOCK
    parts = max(1, math.ceil(queries.count() / most))
    if parts == 1:
        block = unpack(queries.toArrow())
        if block is None:
            return spark.createDataFrame([], schema)
        shared = spark.sparkContext.broadcast(block)
        return references.transform(map_arrow, lambda batches: scan(shared.value)(batches), schema)
    lanes = max(1, math.ceil(4 * int(spark.conf.get("spark.sql.shuffle.partitions")) / parts))

    def pack_block(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "queries": pa.array([_stream(table.drop_columns(["block"]).combine_chunks().to_batches())], pa.binary())})

    def pack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([_stream([batch])], pa.binary()), pa.array([int(batch.column(0)[0].as_py()) % lanes])], names=["references", "lane"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, r in zip(batch.column(0), batch.column(1)):
                block = unpack(pa.ipc.open_stream(q.as_buffer()).read_all())
                if block:
                    yield from scan(block)(iter(pa.ipc.open_stream(r.as_buffer()).read_all().to_batches()))

    ship_package(spark)
    numbered = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(parts).cast("long")))
    blocks = numbered.groupBy("block").applyInArrow(pack_block, "block long, queries binary").withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))
    packed = references.transform(map_arrow, pack_batches, "references binary, lane long").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return packed.join(blocks, ["block", "lane"]).select("queries", "references").transform(map_arrow, meet, schema)


def _prepare(df: DataFrame, key: str, vector: str, exclude: str | None) -> DataFrame:
    group = F.xxhash64(F.col(exclude)) if exclude else F.lit(0).cast("long")
    return df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), group.alias("g"))


def ranked(pairs: DataFrame, k: int, farthest: bool = False) -> DataFrame:
    """The k best pairs of every query with their rank; ties go to the smaller reference."""
    d = F.col("distance").desc() if farthest else F.col("distance")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(d, "ref_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "ref_id", "distance")


def knn_join(
    queries: DataFrame, references: DataFrame, key: str, vector: str, distance: str | Kernel = "L2", k: int = 2, range_: float | None = None, farthest: bool = False, exclude: str | None = None, skip_self: bool = False
) -> DataFrame:
    """Exact k nearest (or farthest) references of every query.

    A block of queries is broadcast, or more of them meet the references as a grid
    (see against); every batch of references gives its own k best per query, and these
    few are ranked. No pairs are shuffled but a batch's best ones. range_ keeps distances up to it (0 or None:
    all), with farthest those from it on. exclude names a column whose equal
    values are no match (such as the file of a segment). distance is a name or a function
    of two matrices (one row per vector) that gives the distances of all pairs.

    Edge cases: rows with a null key or a null, empty or partly null vector are left
    out; k below 1 counts as 1; repeated keys count once, a reference by its best row; an empty side gives no rows.
    """
    kernel, k = distance if callable(distance) else distance_kernel(distance), max(1, k)
    limit = range_ if range_ else None
    refs = _prepare(references, key, vector, exclude)

    def scan(block: Block):
        ids, x, groups = block

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good, y = matrix(batch.column(1))
                if not len(good):
                    continue
                refs_of = batch.column(0).to_numpy()[good]
                d = kernel(x, y)
                score = -d if farthest else d
                bad = np.zeros(d.shape, bool)
                if exclude:
                    bad |= groups[:, None] == batch.column(2).to_numpy()[good][None]
                if skip_self:
                    bad |= ids[:, None] == refs_of[None]
                if limit is not None:
                    bad |= d < limit if farthest else d > limit
                score = np.where(bad, np.inf, score)
                keys = np.unique(refs_of)
                if len(keys) < len(refs_of):
                    # the k best are k different keys: of a repeated one the best row counts
                    by_key = np.argsort(refs_of, kind="stable")
                    starts = np.searchsorted(refs_of[by_key], keys)
                    score = np.fmin.reduceat(score[:, by_key], starts, axis=1)
                    bad = np.logical_and.reduceat(bad[:, by_key], starts, axis=1)
                    refs_of, d = keys, -score if farthest else score
                rows, cols = _first_columns(score, refs_of, k)
                keep = ~bad[rows, cols]
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows[keep]]), pa.array(refs_of[cols[keep]]), pa.array(d[rows[keep], cols[keep]])], names=["query_id", "ref_id", "distance"])

        return run

    found = against(_prepare(queries, key, vector, exclude).dropDuplicates(["id"]), refs, scan, _PAIRS)
    best = F.max("distance") if farthest else F.min("distance")
    return ranked(found.groupBy("query_id", "ref_id").agg(best.alias("distance")), k, farthest)


def _first_columns(score: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k smallest scores of every row; at the k-th score all ties, of which the smaller keys are kept."""
    if score.shape[1] > 4 * k:
        edge = np.partition(score, k - 1, axis=1)[:, k - 1]
        rows, cols = np.nonzero(score <= edge[:, None])
    else:
        rows, cols = (x.ravel() for x in np.indices(score.shape))
    order = np.lexsort((keys[cols], score[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], cols[place < k]


def range_join(queries: DataFrame, references: DataFrame, key: str, vector: str, radius: float, distance: str = "L2") -> DataFrame:
    """All (query_id, ref_id, distance) within the radius (inclusive); blocks and edge cases as in knn_join."""
    kernel = distance_kernel(distance)
    refs = _prepare(references, key, vector, None)

    def scan(block: Block):
        ids, x, _ = block

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good, y = matrix(batch.column(1))
                if len(good):
                    d = kernel(x, y)
                    rows, cols = np.nonzero(d <= radius)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(batch.column(0).to_numpy()[good][cols]), pa.array(d[rows, cols])], names=["query_id", "ref_id", "distance"])

        return run

    return against(_prepare(queries, key, vector, None).dropDuplicates(["id"]), refs, scan, _PAIRS).distinct()


def pivot_table(df: DataFrame, pivots: list[list[float]], vector: str, distance: str, name: str = "pivot_distances") -> DataFrame:
    """df with the distances of every vector to the pivots (a bounded set)."""
    ship_package(df.sparkSession)
    kernel, points = distance_kernel(distance), np.array(pivots, np.float64)

    @F.pandas_udf("array<double>")
    def to_pivots(v):
        import pandas as pd

        return pd.Series(list(kernel(np.array(v.tolist(), np.float64), points))) if len(v) else pd.Series([], dtype=object)

    return df.withColumn(name, to_pivots(F.col(vector).cast("array<double>")))


def hashed_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows, the same whatever their order and partitions: those whose hashed key is under a threshold; all rows of a small table."""
    n = df.count()
    return df if n <= rows else df.where(F.pmod(F.xxhash64(key), F.lit(1 << 40)) < int((1 << 40) * rows / n))


def select_pivots(df: DataFrame, key: str, vector: str, count: int, distance: str = "L2", alpha: float = 0.5, sample: int = 5000) -> list[tuple[int, list[float]]]:
    """Sparse spatial selection on a bounded sample in hashed order: an object farther than a threshold from all pivots is one.

    The threshold is the alpha-quantile of the sample's distances to its first
    200 objects; it shrinks by a tenth until there are enough pivots.
    """
    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).transform(hashed_sample, "id", sample).orderBy(F.xxhash64("id"), "id").collect()
    kernel = distance_kernel(distance)
    x = np.array([r.v for r in rows])
    if not len(x):
        return []
    theta = float(np.quantile(kernel(x[:200], x), alpha))
    while True:
        chosen = [0]
        far = kernel(x[:1], x)[0]
        for i in range(1, len(x)):
            if len(chosen) == count:
                break
            if far[i] > theta:
                chosen.append(i)
                far = np.minimum(far, kernel(x[i : i + 1], x)[0])
        if len(chosen) >= min(count, len(x)) or theta < 1e-9:
            return [(rows[i].id, rows[i].v) for i in chosen[:count]]
        theta *= 0.9


def laesa_join(queries: DataFrame, references: DataFrame, key: str, vector: str, pivots: list[list[float]], distance: str = "L2", k: int = 5, method: str = "EXACT", approximation: float = 0.1) -> DataFrame:
    """k-NN by lower bounds from pivot distances.

    EXACT prunes references by the triangle inequality with the query's current
    k-th distance and gives the result of knn_join for a metric. LB_ONLY ranks by the
    bound, which is also the distance it reports. APPROX takes the share
    ``approximation`` of the references with the smallest bounds and ranks these exactly.
    Repeated keys count once.
    """
    kernel, points = distance_kernel(distance), np.array(pivots, np.float64)
    refs = _prepare(references, key, vector, None)
    total = references.count() if method == "APPROX" else 0
    m = max(1, math.floor(total * approximation)) if method == "APPROX" else 0

    def scan(block: Block):
        ids, x, _ = block
        qp = kernel(x, points)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            radius = np.full(len(ids), np.inf)
            best: list[dict[int, float]] = [{} for _ in ids]

            def nearest(known: dict[int, float], refs: np.ndarray, d: np.ndarray) -> dict[int, float]:
                """The k nearest different keys."""
                if len(known) == k:
                    refs, d = refs[d <= max(known.values())], d[d <= max(known.values())]
                order = np.lexsort((refs, d))
                order = order[_firsts(refs[order], k)]
                out = dict(known)
                for r, x in zip(refs[order].tolist(), d[order].tolist()):
                    out[r] = min(x, out.get(r, np.inf))
                return dict(sorted(out.items(), key=lambda t: (t[1], t[0]))[:k])

            for batch in batches:
                good, y = matrix(batch.column(1))
                if not len(good):
                    continue
                refs_of = batch.column(0).to_numpy()[good]
                bound = _bounds(qp, kernel(y, points))
                out_q, out_r, out_d, out_b = [], [], [], []
                for i in range(len(ids)):
                    if method == "EXACT":
                        order = np.argsort(bound[i], kind="stable")
                        seed = order[_firsts(refs_of[order], k)]
                        near = nearest(best[i], refs_of[seed], kernel(x[i : i + 1], y[seed])[0])
                        limit = min(radius[i], max(near.values()) if len(near) == k else np.inf)
                        pick = np.flatnonzero(bound[i] <= limit * (1 + 1e-12))
                        d = kernel(x[i : i + 1], y[pick])[0]
                        best[i] = nearest(best[i], refs_of[pick], d)
                        radius[i] = max(best[i].values()) if len(best[i]) == k else np.inf
                        keep = d <= radius[i]
                        pick, d = pick[keep], d[keep]
                    else:
                        size = k if method == "LB_ONLY" else m
                        pick = np.lexsort((refs_of, bound[i]))
                        pick = pick[_firsts(refs_of[pick], size)]
                        d = bound[i][pick] if method == "LB_ONLY" else kernel(x[i : i + 1], y[pick])[0]
                    out_q.append(np.full(len(pick), ids[i]))
                    out_r.append(refs_of[pick])
                    out_d.append(d)
                    out_b.append(bound[i][pick])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in (out_q, out_r, out_d, out_b)], names=["query_id", "ref_id", "distance", "bound"])

        return run

    found = against(_prepare(queries, key, vector, None).dropDuplicates(["id"]), refs, scan, _PAIRS + ", bound double")
    found = found.groupBy("query_id", "ref_id").agg(F.min("distance").alias("distance"), F.min("bound").alias("bound"))
    if method == "APPROX":
        place = F.row_number().over(W.partitionBy("query_id").orderBy("bound", "ref_id"))
        found = found.withColumn("m", place).where(F.col("m") <= m)
    return ranked(found.drop("bound", "m"), k)


def _firsts(keys: np.ndarray, most: int) -> np.ndarray:
    """Places of the first row of each key, in order, ``most`` at most."""
    return np.sort(np.unique(keys, return_index=True)[1])[:most]


def _bounds(qp: np.ndarray, rp: np.ndarray) -> np.ndarray:
    """Greatest difference of pivot distances, queries x references."""
    out = np.zeros((len(qp), len(rp)))
    for p in range(qp.shape[1]):
        np.maximum(out, np.abs(qp[:, p][:, None] - rp[:, p][None]), out=out)
    return out


def two_nn_matches(result: DataFrame, ratio: float) -> DataFrame:
    """The nearest reference of a query if it is clearly nearer than the second: d1 / d2 <= ratio (a lone neighbour stays)."""
    first = result.where(F.col("rank") <= 2).groupBy("query_id").agg(
        F.min_by("ref_id", "rank").alias("ref_id"), F.min_by("distance", "rank").alias("distance"), F.max(F.when(F.col("rank") == 2, F.col("distance"))).alias("second")
    )
    ok = F.col("second").isNull() | (F.col("distance") <= ratio * F.col("second")) if 0 <= ratio < 1 else F.lit(True)
    return first.where(ok).select("query_id", "ref_id", "distance")


def _planes(dims: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(tables, bits, dims))


def lsh_join(queries: DataFrame, references: DataFrame, key: str, vector: str, k: int = 5, tables: int = 12, bits: int = 6, seed: int = 1, probes: int = 3) -> DataFrame:
    """Approximate L2 k-NN: random hyperplanes through the mean of a bounded sample, equal buckets, exact re-ranking.

    Queries also look into the buckets that differ in one of the ``probes`` bits
    nearest to their plane. A large bucket isn't cut: AQE splits its join.
    """
    sample = hashed_sample(references.where(F.col(vector).isNotNull()), key, 5000).select(F.col(vector).cast("array<double>").alias("v")).toPandas()["v"]
    if not len(sample):
        return references.sparkSession.createDataFrame([], "query_id long, rank int, ref_id long, distance double")
    centre = np.mean(np.array(sample.tolist()), axis=0)
    planes = _planes(len(centre), tables, bits, seed)
    weight = 1 << np.arange(bits)

    def bucketed(df: DataFrame, multi: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good, x = matrix(batch.column(1))
                for t in range(tables if len(good) else 0):
                    side = (x - centre) @ planes[t].T
                    code = ((side > 0) * weight).sum(1)
                    codes = [code]
                    near = np.argsort(np.abs(side), axis=1)[:, :multi]
                    codes += [code ^ weight[near[:, j]] for j in range(multi)]
                    for c in codes:
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good)), batch.column(1).take(pa.array(good)), pa.array(c.astype(np.int64) + (t << 32))], names=["id", "v", "bucket"])

        return _prepare(df, key, vector, None).select("id", "v").transform(map_arrow, run, "id long, v array<double>, bucket long")

    q = bucketed(queries, probes).select(F.col("id").alias("query_id"), "bucket").distinct()
    r = bucketed(references, 0).select(F.col("id").alias("ref_id"), "bucket").distinct()
    pairs = q.join(r, "bucket").select("query_id", "ref_id").distinct()
    qv = _prepare(queries, key, vector, None).select(F.col("id").alias("query_id"), F.col("v").alias("qv"))
    rv = _prepare(references, key, vector, None).select(F.col("id").alias("ref_id"), F.col("v").alias("rv"))
    square = F.aggregate(F.zip_with("qv", "rv", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    scored = pairs.join(qv, "query_id").join(rv, "ref_id").select("query_id", "ref_id", F.sqrt(square).alias("distance"))
    return ranked(scored, k)


def ivf_join(queries: DataFrame, references: DataFrame, key: str, vector: str, centroids: list[list[float]], k: int = 5, probe: int = 3) -> DataFrame:
    """Approximate L2 k-NN: every reference belongs to its nearest centroid, queries look into their ``probe`` nearest cells, exact re-ranking."""
    points = np.array(centroids, np.float64)

    def cells(df: DataFrame, n: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good, x = matrix(batch.column(1))
                if not len(good):
                    continue
                d = (x * x).sum(1)[:, None] + (points * points).sum(1)[None] - 2 * x @ points.T
                near = np.argsort(d, axis=1, kind="stable")[:, :n]
                for j in range(near.shape[1]):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good)), batch.column(1).take(pa.array(good)), pa.array(near[:, j].astype(np.int64))], names=["id", "v", "cell"])

        return _prepare(df, key, vector, None).select("id", "v").transform(map_arrow, run, "id long, v array<double>, cell long")

    q = cells(queries, probe).select(F.col("id").alias("query_id"), F.col("v").alias("qv"), "cell")
    r = cells(references, 1).select(F.col("id").alias("ref_id"), F.col("v").alias("rv"), "cell")
    square = F.aggregate(F.zip_with("qv", "rv", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return ranked(q.join(r, "cell").select("query_id", "ref_id", F.sqrt(square).alias("distance")).dropDuplicates(["query_id", "ref_id"]), k)


def spatial_inliers(pairs: DataFrame, keys: list[str], model: str = "translation", cycles: int = 100, limit: float = 5.0, seed: int = 1) -> DataFrame:
    """Matches of each pair of frames that agree with one movement: keys, matches, inliers.

    pairs: keys, x1, y1, x2, y2. RANSAC with a seed per group; model translation, scale
    (one factor and a shift), similarity, affine or perspective. A group is the matches of one pair of frames (bounded by
    the keypoints of a frame). Rows with null coordinates are left out.
    """
    size = {"translation": 1, "scale": 2, "similarity": 2, "affine": 3, "perspective": 4}[model]
    types = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}

    def system(a: np.ndarray) -> np.ndarray:
        one, zero = np.ones(len(a)), np.zeros(len(a))
        if model == "translation":
            return np.stack([np.stack([one, zero], 1), np.stack([zero, one], 1)], 1)
        if model == "scale":
            return np.stack([np.stack([a[:, 0], one, zero], 1), np.stack([a[:, 1], zero, one], 1)], 1)
        if model == "similarity":
            return np.stack([np.stack([a[:, 0], -a[:, 1], one, zero], 1), np.stack([a[:, 1], a[:, 0], zero, one], 1)], 1)
        return np.stack([np.stack([a[:, 0], a[:, 1], one, zero, zero, zero], 1), np.stack([zero, zero, zero, a[:, 0], a[:, 1], one], 1)], 1)

    def plane(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The 3 x 3 map of four or more points, from the null space of their equations."""
        x, y, u, v = a[:, 0], a[:, 1], b[:, 0], b[:, 1]
        one, zero = np.ones(len(a)), np.zeros(len(a))
        m = np.concatenate([np.stack([x, y, one, zero, zero, zero, -u * x, -u * y, -u], 1), np.stack([zero, zero, zero, x, y, one, -v * x, -v * y, -v], 1)])
        return np.linalg.svd(m)[2][-1].reshape(3, 3)

    def errors(a: np.ndarray, b: np.ndarray, rows: np.ndarray, target: np.ndarray, pick: np.ndarray) -> np.ndarray:
        if model == "perspective":
            moved = np.concatenate([a, np.ones((len(a), 1))], 1) @ plane(a[pick], b[pick]).T
            with np.errstate(divide="ignore", invalid="ignore"):
                return np.nan_to_num(np.sqrt(((moved[:, :2] / moved[:, 2:] - b) ** 2).sum(1)), nan=np.inf)
        found = np.linalg.lstsq(rows[pick].reshape(-1, rows.shape[2]), target[pick].ravel(), rcond=None)[0]
        return np.sqrt(((rows @ found - target) ** 2).sum(1))

    def verify(pdf):
        import pandas as pd

        a, b = pdf[["x1", "y1"]].to_numpy(float), pdf[["x2", "y2"]].to_numpy(float)
        target = b - a if model == "translation" else b
        rows, best = system(a), 0
        rng = np.random.default_rng(seed)
        for _ in range(cycles if len(a) >= size else 0):
            pick = rng.choice(len(a), size, replace=False)
            best = max(best, int((errors(a, b, rows, target, pick) <= limit).sum()))
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "matches": len(a), "inliers": best}])

    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "matches long", "inliers long"])
    ship_package(pairs.sparkSession)
    clean = pairs.select(*keys, "x1", "y1", "x2", "y2").dropna(subset=["x1", "y1", "x2", "y2"])
    return clean.groupBy(*keys).applyInPandas(verify, schema)


def exclude_same(result: DataFrame, left: Column, right: Column, k: int) -> DataFrame:
    """Drops matches within one file and ranks again, before any limit."""
    return ranked(result.where(left != right).drop("rank"), k)


def name_parts(name: Column) -> tuple[Column, Column]:
    """File and number of a segment name ``file@number`` (``file@number|local`` for a local vector); null where it is none."""
    bare = F.regexp_replace(name, r"\|[^|]*$", "")
    return F.nullif(F.regexp_extract(bare, r"^(.*)@\d+$", 1), F.lit("")), F.regexp_extract(bare, r"@(\d+)$", 1).try_cast("long")


def find_segments(names: DataFrame, name: str, segments: DataFrame) -> DataFrame:
    """names with the columns of the segment each names (file_id, num_segment); names of no segment are dropped."""
    file, number = name_parts(F.col(name))
    return names.withColumns({"file_id": file, "num_segment": number}).join(segments, ["file_id", "num_segment"])


def join_truth(detections: DataFrame, truth: DataFrame) -> DataFrame:
    """detection_id and truth_id: for each detection the first true copy of the same files that it overlaps on both sides.

    truth: truth_id, video_q, start_q, end_q, video_r, start_r, end_r. The pairs of one pair
    of files are bounded by its detections and true copies.
    """
    both = detections.select("detection_id", "video_q", "video_r", "sec_start_q", "sec_end_q", "sec_start_r", "sec_end_r").join(truth, ["video_q", "video_r"])
    meets = lambda a, b, c, d: F.greatest(a, c) <= F.least(b, d)
    hit = both.where(meets("sec_start_q", "sec_end_q", "start_q", "end_q") & meets("sec_start_r", "sec_end_r", "start_r", "end_r"))
    return hit.groupBy("detection_id").agg(F.min("truth_id").alias("truth_id"))
