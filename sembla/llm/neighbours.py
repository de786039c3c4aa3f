"""The most similar vectors of every vector, by shifted Hilbert curves.

Each curve projects the vectors onto a few random directions, shifts them, and
orders them along a Hilbert curve. The rows are range-partitioned on (curve, key);
a vector is compared with the vectors in a window around its place. The windows
of all curves merge, and exact distances decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sembla.llm.groups import HOT_SHARE, hot_join
from sembla.operators.ordered import RUN, by_run, sorted_runs
from sembla.session import map_arrow, write_table

#: Vectors read to fit the scale of the curves, at most.
FIT_ROWS = 20_000
#: Rows that are compared at once.
TILE = 256
#: Queries of one stretch of a curve.
BLOCK_ROWS = 1 << 14
#: Sizes of nodes are told up to this number.
SIZE_MOST = 1_000_000
#: Records of a vector from which on it may be hot.
HOT_ROWS = 100_000
#: A neighbour in a packed list: its id, its distance and its size.
NEAR = np.dtype([("id", "<i8"), ("d", "<f4"), ("n", "<i4")])


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of cells (n x m, whole numbers under 2**bits) on the Hilbert curve; m * bits < 64.

    Works on all rows at once, one bit plane after the other, from the highest:
    the plane's cell gives m bits of the key, and its reflection and rotation are
    applied to the lower planes.
    """
    n, m = cells.shape
    x = [cells[:, i].astype(np.int64) for i in range(m)]
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(m):
            up = (x[i] >> level) & 1 == 1
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] = x[0] ^ np.where(up, low, swap)
            x[i] = x[i] ^ swap
    for i in range(1, m):
        x[i] = x[i] ^ x[i - 1]
    odd = np.zeros(n, np.int64)
    for level in range(bits - 1, 0, -1):
        odd ^= np.where((x[m - 1] >> level) & 1 == 1, (1 << level) - 1, 0)
    key = np.zeros(n, np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(m):
            key = (key << 1) | (((x[i] ^ odd) >> level) & 1)
    return key


@dataclass(frozen=True)
class Curves:
    """Projections and shifts of several curves, fitted to a bounded sample."""

    centre: np.ndarray
    scale: float
    axes: np.ndarray
    shifts: np.ndarray
    bits: int

    @staticmethod
    def fit(sample: np.ndarray, count: int, dims: int, bits: int, seed: int) -> Curves:
        """Random orthonormal projections; the scale covers four standard deviations either way."""
        d = sample.shape[1]
        dims = min(dims, d)
        rng = np.random.default_rng(seed)
        axes = np.stack([np.linalg.qr(rng.normal(size=(d, d)))[0][:, :dims] for _ in range(count)])
        spread = float(np.sqrt(np.mean(sample.var(axis=0)))) or 1.0
        return Curves(sample.mean(axis=0), 8 * spread, axes, rng.uniform(-0.05, 0.05, (count, dims)), bits)

    def keys(self, vectors: np.ndarray, curve: int) -> np.ndarray:
        place = (vectors - self.centre) @ self.axes[curve] / self.scale + 0.5 + self.shifts[curve]
        top = 1 << self.bits
        return hilbert_keys(np.clip(place * top, 0, top - 1).astype(np.int64), self.bits)


def _matrix(column: pa.Array, dtype: np.dtype) -> np.ndarray:
    """A binary column of equally long vectors as a float32 matrix."""
    chunks = column.to_pylist()
    return np.frombuffer(b"".join(chunks), dtype).reshape(len(chunks), -1).astype(np.float32)


def _nearest(q: np.ndarray, b: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices and distances of the k nearest rows of b for each row of q; own: q's index in b, or -1. Ties by id."""
    d = (q * q).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (q @ b.T)
    mine = np.flatnonzero(own >= 0)
    d[mine, own[mine]] = np.inf
    k = min(k, d.shape[1])
    wide = min(d.shape[1], 2 * k + 4)
    near = np.argpartition(d, wide - 1, axis=1)[:, :wide] if wide < d.shape[1] else np.broadcast_to(np.arange(d.shape[1]), d.shape).copy()
    gap = q[:, None, :].astype(np.float64) - b[near].astype(np.float64)
    exact = np.sqrt((gap * gap).sum(2))
    exact[np.isinf(np.take_along_axis(d, near, 1))] = np.inf
    order = np.lexsort((ids[near], exact), axis=1)[:, :k]
    return np.take_along_axis(near, order, 1), np.take_along_axis(exact, order, 1)


class _Window:
    """Rows of one run in curve order; gives the neighbours of its queries as the rows pass by."""

    def __init__(self, k: int, width: int, dtype: np.dtype, chain: bool):
        self.k, self.width, self.dtype, self.chain = k, width, dtype, chain
        self.vectors: np.ndarray | None = None
        self.done = 0

    def add(self, piece: pa.RecordBatch, last: bool) -> Iterator[tuple[np.ndarray, ...]]:
        """(query ids, their sizes, neighbour ids, distances, sizes), padded with id -1."""
        if piece is not None:
            get = lambda n: piece.column(piece.schema.get_field_index(n)).to_numpy(zero_copy_only=False)
            fresh = _matrix(piece.column(piece.schema.get_field_index("vec")), self.dtype), get("qid").astype(np.int64), get("bid").astype(np.int64), get("size").astype(np.int32)
            if self.vectors is None:
                self.vectors, self.qid, self.bid, self.size = fresh
            else:
                self.vectors, self.qid, self.bid, self.size = (np.concatenate(x) for x in zip((self.vectors, self.qid, self.bid, self.size), fresh))
        if self.vectors is None:
            return
        n = len(self.vectors)
        until = n if last else max(self.done, n - self.width)
        for a in range(self.done, until, TILE):
            z = min(a + TILE, until)
            rows = a + np.flatnonzero(self.qid[a:z] >= 0)
            low, high = max(0, a - self.width), min(n, z + self.width)
            base = low + np.flatnonzero(self.bid[low:high] >= 0)
            if not len(rows) or not len(base):
                continue
            own = np.searchsorted(base, rows)
            here = (own < len(base)) & (base[np.minimum(own, len(base) - 1)] == rows)
            near, dist = _nearest(self.vectors[rows], self.vectors[base], np.where(here, own, -1), self.bid[base], self.k)
            ids, sizes = np.where(np.isfinite(dist), self.bid[base][near], -1), self.size[base][near]
            if self.chain:
                # the next row of the curve is always linked, so that a curve is one path
                after = rows + 1
                good = (after < n) & (self.bid[np.minimum(after, n - 1)] >= 0)
                after = np.where(good, after, rows)
                gap = self.vectors[rows].astype(np.float64) - self.vectors[after].astype(np.float64)
                ids = np.concatenate([ids, np.where(good, self.bid[after], -1)[:, None]], 1)
                dist = np.concatenate([dist, np.sqrt((gap * gap).sum(1))[:, None]], 1)
                sizes = np.concatenate([sizes, self.size[after][:, None]], 1)
            yield self.qid[rows], self.size[rows], ids, dist, sizes
        self.done = until
        cut = max(0, until - self.width)
        self.vectors, self.qid, self.bid, self.size, self.done = self.vectors[cut:], self.qid[cut:], self.bid[cut:], self.size[cut:], until - cut


def pack(df: DataFrame, vector: str, dtype: str = "float32") -> DataFrame:
    """df with the vector column as binary ``__vec``; rows whose vector is null or holds a null or NaN are left out."""
    clean = df.where(F.col(vector).isNotNull()).where(~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double"))))
    keep = [c for c in df.columns if c != vector]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "__vec binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keep))
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype)
            ends = np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)) * np.dtype(dtype).itemsize
            raw = pa.py_buffer(flat.tobytes())
            offsets = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32).tobytes())
            packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, offsets, raw])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), packed], names=[*keep, "__vec"])

    return clean.select(*keep, F.col(vector)).transform(map_arrow, run, schema)


def distinct_vectors(rows: DataFrame, key: str, query: str, base: str) -> DataFrame:
    """One node per different vector: vec, qid and bid (smallest query and base key, -1 if none), size (different keys).

    rows: key (bigint), boolean query and base, __vec. Copies of one vector, however
    many, are one row from here on; combined on the map side.
    """
    once = rows.groupBy("__vec", key).agg(F.max(query).alias("q"), F.max(base).alias("b"))
    return once.groupBy(F.col("__vec").alias("vec")).agg(
        F.coalesce(F.min(F.when(F.col("q"), F.col(key))), F.lit(-1)).alias("qid"),
        F.coalesce(F.min(F.when(F.col("b"), F.col(key))), F.lit(-1)).alias("bid"),
        F.count(F.lit(1)).alias("size"),
    )


def hot_nodes(nodes: DataFrame) -> DataFrame | None:
    """vec, qid and bid of nodes with more than HOT_SHARE of all records, at least HOT_ROWS (1 / HOT_SHARE nodes at most); None if there are none."""
    total, largest = nodes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    least = max(HOT_ROWS, int(HOT_SHARE * total))
    return nodes.where(F.col("size") > least).select("vec", "qid", "bid") if largest > least else None


def window_neighbours(nodes: DataFrame, k: int, dtype: str = "float32", curves: int = 6, width: int = 256, dims: int = 5, bits: int = 10, seed: int = 7, chain: bool = False) -> DataFrame:
    """For every query node and curve one row: qid, lane (the curve's number), block (a stretch of the curve), near (array of struct d, id, nearest first). With chain near is a packed list (NEAR) that ends with the next node on the curve, and own is the size of the node; sizes are at most SIZE_MOST.

    nodes: a written table of distinct_vectors. Windows end at the borders of a
    run; these lie elsewhere on every curve.
    """
    spark = nodes.sparkSession
    n = nodes.count()
    share = max(1, -(-n // FIT_ROWS))
    rows = nodes.where(F.pmod(F.xxhash64("vec"), F.lit(share)) == 0).limit(2 * FIT_ROWS).select("vec").toArrow().column(0)
    element = np.dtype(dtype)
    schema = "qid long, lane short, block long, near binary, own int" if chain else "qid long, lane short, block long, near array<struct<d: double, id: long>>"
    if not len(rows):
        return spark.createDataFrame([], schema)
    fitted = Curves.fit(_matrix(rows, element), curves, dims, bits, seed)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column(0), element)
            for c in range(curves):
                key = pa.array(fitted.keys(vectors, c))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, c, np.int16)), key, *batch.columns], names=["curve", "key", "vec", "qid", "bid", "size"])

    size = F.least("size", F.lit(SIZE_MOST)) if chain else F.lit(1)
    placed = nodes.select("vec", "qid", "bid", size.cast("int").alias("size")).transform(map_arrow, keyed, "curve short, key long, vec binary, qid long, bid long, size int")
    runs, _ = sorted_runs(placed, ["curve", "key"])
    item = pa.struct([("d", pa.float64()), ("id", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window, was = None, None
        seen[0] = TaskContext.get().partitionId() << 32
        for run, piece in by_run(batches):
            # a curve that ends within a run ends the window
            if piece is None:
                yield from rows_of(was, window.add(None, True)) if window else ()
                window = was = None
                continue
            lane = piece.column(piece.schema.get_field_index("curve")).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(lane[1:] != lane[:-1]) + 1).tolist(), len(lane)]
            for a, z in zip(cuts, cuts[1:]):
                if was is not None and lane[a] != was:
                    yield from rows_of(was, window.add(None, True))
                    window = None
                was = lane[a]
                window = window or _Window(k, width, element, chain)
                yield from rows_of(was, window.add(piece.slice(a, z - a), False))

    seen = [0]

    def rows_of(lane: int, found: Iterator) -> Iterator[pa.RecordBatch]:
        for qid, own, ids, dist, sizes in found:
            keep = ids >= 0
            offsets = np.concatenate([[0], np.cumsum(keep.sum(1))]).astype(np.int32)
            if chain:
                flat = np.zeros(int(offsets[-1]), NEAR)
                flat["id"], flat["d"], flat["n"] = ids[keep], dist[keep], sizes[keep]
                near = pa.Array.from_buffers(pa.binary(), len(qid), [None, pa.py_buffer((offsets * NEAR.itemsize).tobytes()), pa.py_buffer(flat.tobytes())])
            else:
                near = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(dist[keep]), pa.array(ids[keep])], fields=list(item)))
            seen[0] += len(qid)
            block = pa.array(np.full(len(qid), seen[0] // BLOCK_ROWS))
            yield pa.RecordBatch.from_arrays([pa.array(qid), pa.array(np.full(len(qid), lane, np.int16)), block, near, *([pa.array(own)] if chain else [])], names=["qid", "lane", "block", "near", *(["own"] if chain else [])])

    return runs.select(RUN, "curve", "vec", "qid", "bid", "size").transform(map_arrow, search, schema)


def similar_vectors(df: DataFrame, key: str, vector: str, k: int, query: str | None = None, base: str | None = None, dtype: str = "float32", neighbour: str = "neighbour", distance: str = "distance", **curves: int) -> DataFrame:
    """Columns key, neighbour, distance: the k base vectors nearest (L2) to every query vector.

    query and base name boolean columns (default: every row is both; a row is
    never its own neighbour, a copy of it is). Copies of a vector are searched
    once, each with its k smallest keys, so a vector that a third of all rows
    bear costs no more than another. dtype is how elements are stored on the way
    ('uint8' for whole numbers up to 255). Approximate: a neighbour is missed when
    it is outside the window on every curve; raise curves or width for recall.

    Edge cases: rows with a null key, or a vector that is null, empty or holds a
    null or NaN, are left out; vectors must have one length (ValueError in the
    task otherwise); at equal distance the smaller key is nearer; repeated rows
    count once; fewer than k base vectors give all; an empty table gives no rows;
    other columns are ignored.
    """
    flags = [F.col(query) if query else F.lit(True), F.col(base) if base else F.lit(True)]
    rows = df.where(F.col(key).isNotNull() & (F.size(vector) > 0))
    rows = pack(rows.select(F.col(key).cast("long").alias("key"), flags[0].alias("q"), flags[1].alias("b"), F.col(vector).alias("v")), "v", dtype)
    rows, _ = write_table(rows, "vectors")
    nodes, _ = write_table(distinct_vectors(rows, "key", "q", "b"), "nodes")
    per_curve = window_neighbours(nodes, k, dtype, **curves)
    pairs = per_curve.select("qid", F.inline("near")).groupBy("qid", F.col("id").alias("bid")).agg(F.min("d").alias("d"))
    # the node of a copy that is both query and base is its own nearest: distance 0
    own = nodes.where("qid >= 0 and bid >= 0 and size > 1").select("qid", "bid", F.lit(0.0).alias("d"))
    order = W.partitionBy("qid").orderBy("d", "bid")
    best = pairs.unionByName(own).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")
    # copies: up to k + 1 base keys of a node can be among the k nearest of a query
    place = F.dense_rank().over(W.partitionBy("__vec").orderBy("key"))
    copies = rows.where("b").withColumn("r", place).where(F.col("r") <= k + 1).groupBy("__vec").agg(F.array_sort(F.collect_set("key")).alias("ids"))
    many = copies.where(F.size("ids") > 1).select(F.col("ids")[0].alias("bid"), "ids")
    askers = rows.where("q").select("__vec", "key").distinct()
    twins = nodes.where("qid >= 0").select(F.col("vec").alias("__vec"), "qid")
    # the keys of a vector that a large part of all rows bear stay spread
    hot = hot_nodes(nodes)
    pick = lambda c, name: hot.where(F.col(c) >= 0).select(F.col("vec" if name == "__vec" else c).alias(name)) if hot is not None else None
    asked = hot_join(askers, "__vec", twins, pick("qid", "__vec")).select("qid", "key")
    ranked = best.join(many, "bid", "left").select("qid", "d", F.explode(F.coalesce("ids", F.array("bid"))).alias("n"))
    full = hot_join(asked, "qid", ranked, pick("qid", "qid")).where("n <> key")
    final = W.partitionBy("key").orderBy("d", "n")
    out = full.withColumn("r", F.row_number().over(final)).where(F.col("r") <= k)
    return out.select(F.col("key").alias(key), F.col("n").alias(neighbour), F.col("d").alias(distance))
