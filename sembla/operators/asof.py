"""As-of join: for every point the last edge at or before it (or the first at or after it) under the same key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sembla.operators.ordered import RUN, by_run, key_hash, sorted_runs, summaries
from sembla.session import map_arrow

_SUMMARY = "run long, last_g long, single boolean, first_g long, has boolean, edge double"


def _columns(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    get = lambda n: piece.column(piece.schema.get_field_index(n)).to_numpy(zero_copy_only=False)
    return get("__g"), get("__v"), get("__p").astype(bool)


def _fill(g: np.ndarray, v: np.ndarray, point: np.ndarray, before: tuple[int | None, float]) -> tuple[np.ndarray, tuple[int, float]]:
    """The last edge of the group up to every row (NaN if none), and the state after the last row."""
    n = len(g)
    start = np.empty(n, bool)
    start[1:] = g[1:] != g[:-1]
    start[0] = before[0] is None or g[0] != before[0]
    at = np.where(point, -1, np.arange(n))
    first = np.where(start, np.arange(n), 0)
    np.maximum.accumulate(at, out=at)
    np.maximum.accumulate(first, out=first)
    carried = np.nan if start[0] else before[1]
    new_group = np.logical_or.accumulate(start)
    out = np.where(at >= first, v[np.maximum(at, 0)], np.where(new_group, np.nan, carried))
    if not new_group.all():
        head = ~new_group
        out[head] = np.where(at[head] >= 0, v[np.maximum(at[head], 0)], carried)
    return out, (int(g[-1]), float(out[-1]))


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[dict] = []
    state: tuple[int | None, float] = (None, np.nan)
    first, single = None, True
    for run, piece in by_run(batches):
        if piece is None:
            rows.append({"run": run, "last_g": state[0], "single": single, "first_g": first, "has": not np.isnan(state[1]), "edge": state[1]})
            state, first, single = (None, np.nan), None, True
            continue
        g, v, p = _columns(piece)
        _, state = _fill(g, v, p, state)
        first = int(g[0]) if first is None else first
        single = single and bool((g == first).all())
    kinds = {"run": pa.int64(), "last_g": pa.int64(), "single": pa.bool_(), "first_g": pa.int64(), "has": pa.bool_(), "edge": pa.float64()}
    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(kinds.items())))


def asof_join(points: DataFrame, edges: DataFrame, keys: list[str], point: str, edge: str, forward: bool = False, name: str = "edge") -> DataFrame:
    """points with ``name``: the last edge <= the point of the same key (forward: the first edge >= it), null if there is none.

    Points and edges are range-sorted together, every run is summarised by its last
    edge, the summaries are combined in order and the runs are scanned again, so
    a key with any share of the rows is spread over many tasks and no pairs are made.

    Edge cases: null keys match null keys; null and NaN points have no edge, null and
    NaN edges don't count; repeated points give a row each; columns of edges other
    than keys and edge are ignored.
    """
    sign = -1.0 if forward else 1.0
    kept = [c for c in points.columns]
    names = [f"__k{i}" for i in range(len(keys))]
    p = points.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), (F.col(point).cast("double") * sign).alias("__v"), F.lit(True).alias("__p"), F.struct(*kept).alias("__row"))
    lost = p.where(F.col("__v").isNull() | F.isnan("__v"))
    empty = F.lit(None).cast(p.schema["__row"].dataType)
    e = edges.where(F.col(edge).isNotNull() & ~F.isnan(F.col(edge).cast("double"))).select(*(F.col(k).alias(n) for k, n in zip(keys, names)), (F.col(edge).cast("double") * sign).alias("__v"), F.lit(False).alias("__p"), empty.alias("__row"))
    both = p.where(F.col("__v").isNotNull() & ~F.isnan("__v")).unionByName(e.distinct())
    # at a tie the edge (false) comes first
    runs, _ = sorted_runs(both, [*names, "__v", "__p"])
    runs = runs.withColumn("__g", key_hash(*(F.col(n) for n in names)))
    states: dict[int, tuple[int | None, float]] = {}
    g, last = None, float("nan")
    for r in summaries(runs.select(RUN, "__g", "__v", "__p"), _summarise, _SUMMARY):
        states[r["run"]] = (g, last)
        if not (r["single"] and r["first_g"] == g and not r["has"]):
            g, last = r["last_g"], r["edge"] if r["has"] else float("nan")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        was, state = None, (None, np.nan)
        for run, piece in by_run(batches):
            if piece is None:
                was = None
                continue
            if run != was:
                was, state = run, states[run]
            g, v, is_point = _columns(piece)
            filled, state = _fill(g, v, is_point, state)
            at = np.flatnonzero(is_point)
            if len(at):
                found = filled[at]
                edge_column = pa.array(found * sign + 0.0, mask=np.isnan(found))
                yield pa.RecordBatch.from_arrays([piece.column(piece.schema.get_field_index("__row")).take(pa.array(at)), edge_column], names=["__row", "__edge"])

    row = both.schema["__row"].dataType.simpleString()
    found = runs.transform(map_arrow, scan, f"__row {row}, __edge double")
    out = found.unionByName(lost.select("__row", F.lit(None).cast("double").alias("__edge")))
    return out.select("__row.*", F.col("__edge").alias(name))
