"""Globally sorted runs: one range shuffle, then scans that carry state from run to run.

``sorted_runs`` range-partitions a frame on its sort keys, sorts every partition
and writes it. A *run* is a contiguous piece of that order that one task reads
(a file, or a split of a large file). Operators make one small summary row per
run, combine these rows in order into the state each run starts with, and scan
again. Only summaries reach the driver: one row per run, whatever it holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sembla.session import map_arrow, write_table

RUN = "__run"
_PART = "__part"


def key_hash(*columns: Column) -> Column:
    """A 64-bit hash in which null differs from every value and from a null elsewhere."""
    parts: list[Column] = []
    for c in columns:
        parts += [c, c.isNull()]
    return F.xxhash64(*parts)


def sorted_runs(df: DataFrame, keys: list[str], tie: bool = True) -> tuple[DataFrame, str]:
    """df in global order of keys (nulls first), as a written table with column __run.

    Runs are ordered by __run. A key may hold any share of the rows: with tie a
    row number is appended to the range key, so that equal keys are split too. The
    row number asks for a df that gives its rows in one order whenever a task is
    repeated: a scan or a written table, narrowly transformed.
    """
    ranged = [F.col(k) for k in keys]
    if tie:
        df = df.withColumn("__tie", F.monotonically_increasing_id())
        ranged.append(F.col("__tie"))
    out = df.repartitionByRange(*ranged).sortWithinPartitions(*keys)
    if tie:
        out = out.drop("__tie")
    table, path = write_table(out.withColumn(_PART, F.spark_partition_id().cast("long")), "runs")
    run = F.shiftleft(F.col(_PART), 40) + F.col("_metadata.file_block_start")
    return table.withColumn(RUN, run).drop(_PART), path


def by_run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch | None]]:
    """Pieces of batches, each of one run; (run, None) when a run is over."""
    current: int | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        runs = batch.column(batch.schema.get_field_index(RUN)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(runs[1:] != runs[:-1]) + 1).tolist(), len(runs)]
        for a, b in zip(cuts, cuts[1:]):
            if current is not None and runs[a] != current:
                yield current, None
            current = int(runs[a])
            yield current, batch.slice(a, b - a)
    if current is not None:
        yield current, None


def summaries(runs: DataFrame, make: Callable, schema: str) -> list[dict[str, Any]]:
    """One row per run, in order. make: batches of a task -> record batches of schema."""
    table = runs.transform(map_arrow, make, schema).toArrow()
    return sorted(table.to_pylist(), key=lambda r: r["run"])


def running_max(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Running maximum of int64 values that starts anew where group (non-decreasing from 0) changes."""
    low = int(value.min())
    span = int(value.max()) - low + 1
    if (int(group[-1]) + 1) * span < 2**62:
        shifted = group * span + (value - low)
        return np.maximum.accumulate(shifted) - group * span + low
    out = value.copy()
    edges = [*np.flatnonzero(np.r_[True, group[1:] != group[:-1]]).tolist(), len(group)]
    for a, b in zip(edges, edges[1:]):
        np.maximum.accumulate(out[a:b], out=out[a:b])
    return out


def _number(run_offsets: dict[int, int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for run_id, piece in by_run(batches):
            if piece is None:
                continue
            first = run_offsets[run_id] + seen.get(run_id, 0)
            seen[run_id] = seen.get(run_id, 0) + piece.num_rows
            columns = [piece.column(i) for i in range(piece.num_columns) if piece.schema.names[i] != RUN]
            names = [n for n in piece.schema.names if n != RUN]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(first, first + piece.num_rows))], names=[*names, "__pos"])

    return run


def with_positions(df: DataFrame, keys: list[str], name: str = "pos") -> DataFrame:
    """df with the 0-based place of every row in the order of keys, in one range shuffle.

    Runs are counted, the counts (one per run) are prefix-summed, and each run is
    numbered from its offset. Equal keys are numbered in an order of their own, so
    keys should be unique where the places matter.
    """
    columns = df.columns
    runs, _ = sorted_runs(df, keys)
    counts = sorted(runs.groupBy(RUN).count().collect())
    offsets, total = {}, 0
    for run, n in counts:
        offsets[run] = total
        total += n
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "__pos long"])
    out = runs.select(*columns, RUN).transform(map_arrow, _number(offsets), schema)
    return out.withColumnRenamed("__pos", name)
