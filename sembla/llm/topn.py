"""Top N items within every group, by exact positions in one global order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sembla.operators.ordered import RUN, by_run, key_hash, sorted_runs, summaries
from sembla.session import map_arrow

_SUMMARY = pa.schema([(n, pa.int64()) for n in ("run", "first_g", "first_k", "last_g", "last_k", "single", "n")])


def _longs(piece: pa.RecordBatch, name: str) -> np.ndarray:
    return piece.column(piece.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _new(values: np.ndarray, before: int | None) -> np.ndarray:
    out = np.empty(len(values), bool)
    out[1:] = values[1:] != values[:-1]
    out[0] = before is None or values[0] != before
    return out


def _positions(g: np.ndarray, k: np.ndarray, last_g: int | None, last_k: int | None, count: int) -> tuple[np.ndarray, np.ndarray]:
    """1-based position of every row among the different items of its group; whether it repeats the row before."""
    starts, fresh = _new(g, last_g), _new(k, last_k)
    fresh |= starts
    total = np.cumsum(fresh)
    at = np.flatnonzero(starts)
    base = np.empty(len(at) + 1, np.int64)
    base[0] = -count
    base[1:] = total[at] - 1
    return total - base[np.cumsum(starts)], ~fresh


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per run: first and last group and item, whether it is all one group, different items of the last group."""
    rows: list[dict] = []
    head = tail = None
    single, n = True, 0
    for run, piece in by_run(batches):
        if piece is None:
            rows.append({"run": run, "first_g": head[0], "first_k": head[1], "last_g": tail[0], "last_k": tail[1], "single": int(single), "n": n})
            head = tail = None
            single, n = True, 0
            continue
        g, k = _longs(piece, "__g"), _longs(piece, "__k")
        position, _ = _positions(g, k, *(tail or (None, None)), n)
        head = head or (int(g[0]), int(k[0]))
        tail, n = (int(g[-1]), int(k[-1])), int(position[-1])
        single = single and bool((g == head[0]).all())
    yield pa.RecordBatch.from_pylist(rows, schema=_SUMMARY)


def _combine(rows: list[dict]) -> dict[int, tuple[int | None, int | None, int]]:
    """Per run: group and item before it, and how many items of that group lie before it."""
    states: dict[int, tuple[int | None, int | None, int]] = {}
    g = k = None
    n = 0
    for r in rows:
        states[r["run"]] = (g, k, n)
        if r["single"] and r["first_g"] == g:
            n += r["n"] - (r["first_k"] == k)
        else:
            n = r["n"]
        g, k = r["last_g"], r["last_k"]
    return states


def top_n(df: DataFrame, group: list[str], score: str, item: str, n: int, ascending: bool = True, position: str | None = None) -> DataFrame:
    """The n best items of every group; columns: group columns, score, item (and position, if named).

    All rows are range-sorted on (group, score, item); groups are counted per
    run, the counts are prefix-summed into exact positions, and positions up to n
    stay. A group of any size is spread over as many runs as it fills; runs
    wholly behind the first n of one group aren't read again.

    Edge cases: null and NaN scores don't count; ties go to the smaller item;
    repeated rows (same group, score and item) count once; a null group part is a
    value of its own, a null item sorts first; groups with fewer rows give all;
    an empty table gives no rows; other columns are ignored.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    names = [f"__k{i}" for i in range(len(group))]
    work = df.select(*(F.col(c).alias(x) for c, x in zip(group, names)), F.col(score).alias("__s"), F.col(item).alias("__i"))
    kind = dict(work.dtypes)["__s"]
    work = work.where(F.col("__s").isNotNull())
    if kind in ("double", "float"):
        # 0.0 and -0.0 are one score
        work = work.where(~F.isnan("__s")).withColumn("__s", F.col("__s") + F.lit(0.0).cast(kind))
    order = F.col("__s") if ascending else -F.col("__s")
    runs, _ = sorted_runs(work.withColumn("__o", order), [*names, "__o", "__i"])
    g = key_hash(*(F.col(x) for x in names))
    runs = runs.withColumns({"__g": g, "__k": key_hash(*(F.col(x) for x in names), F.col("__o"), F.col("__i"))})
    found = summaries(runs.select(RUN, "__g", "__k"), _count, "run long, first_g long, first_k long, last_g long, last_k long, single long, n long")
    states = _combine(found)
    behind = [r["run"] for r in found if r["single"] and states[r["run"]][0] == r["first_g"] and states[r["run"]][2] >= n]
    if behind:
        # one row per run at most
        gone = df.sparkSession.createDataFrame([(b,) for b in behind], f"{RUN} {dict(runs.dtypes)[RUN]}")
        runs = runs.join(F.broadcast(gone), RUN, "left_anti")
    fields = {f.name: f.dataType.simpleString() for f in work.schema.fields}
    schema = ", ".join([*(f"`{x}` {fields[x]}" for x in [*names, "__s", "__i"]), "__p long"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        was, state = None, (None, None, 0)
        for run, piece in by_run(batches):
            if piece is None:
                was = None
                continue
            if run != was:
                was, state = run, states[run]
            g, k = _longs(piece, "__g"), _longs(piece, "__k")
            at, repeat = _positions(g, k, *state)
            state = (int(g[-1]), int(k[-1]), int(at[-1]))
            good = np.flatnonzero((at <= n) & ~repeat)
            if len(good):
                taken = [piece.column(piece.schema.get_field_index(x)).take(pa.array(good)) for x in [*names, "__s", "__i"]]
                yield pa.RecordBatch.from_arrays([*taken, pa.array(at[good], pa.int64())], names=[*names, "__s", "__i", "__p"])

    out = runs.transform(map_arrow, keep, schema)
    columns = [*(F.col(x).alias(c) for x, c in zip(names, group)), F.col("__s").alias(score), F.col("__i").alias(item)]
    return out.select(*columns, *([F.col("__p").alias(position)] if position else []))
