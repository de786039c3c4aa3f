"""Interval operators: continuous periods and gaps, overlap joins, overlap ratio."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sembla.operators.ordered import RUN, by_run, key_hash, running_max, sorted_runs, summaries
from sembla.session import map_arrow

_LOW = -(2**63)
_SUMMARY = "run long, first_g long, first_s long, last_g long, single boolean, top long, opened long"


class _Scan:
    """State of a scan over sorted (group, start, end): the open period of the last group."""

    def __init__(self, g: int | None = None, top: int = _LOW, opened: int = 0):
        self.g, self.top, self.opened = g, top, opened

    def feed(self, g: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, ...]:
        """Closed periods and gaps: rows at which a period begins, and what came before each.

        Returns (at, new_group, before_start, before_end): a period begins at row
        ``at``; the one before it ran from before_start to before_end.
        """
        fresh = np.empty(len(g), bool)
        fresh[1:] = g[1:] != g[:-1]
        fresh[0] = self.g is None or g[0] != self.g
        e = e.copy()
        carried = not fresh[0]
        first = max(int(e[0]), self.top) if carried else int(e[0])
        e[0] = first
        number = np.cumsum(fresh) - int(fresh[0])
        top = running_max(number, e)
        before = np.empty(len(g), np.int64)
        before[1:] = top[:-1]
        before[0] = self.top
        begins = fresh | (s > before)
        at = np.flatnonzero(begins)
        opened = np.empty(len(at), np.int64)
        opened[1:] = s[at[:-1]]
        if len(at):
            opened[0] = self.opened
        out = at, fresh[at], opened, before[at]
        self.g, self.top = int(g[-1]), int(top[-1])
        if len(at):
            self.opened = int(s[at[-1]])
        return out


def _long(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[dict] = []
    scan, head = _Scan(), None
    single = True
    for run, piece in by_run(batches):
        if piece is None:
            rows.append({"run": run, "first_g": head[0], "first_s": head[1], "last_g": scan.g, "single": single, "top": scan.top, "opened": scan.opened})
            scan, head, single = _Scan(), None, True
            continue
        g, s = _long(piece, "__g"), _long(piece, "__s")
        head = head or (int(g[0]), int(s[0]))
        scan.feed(g, s, _long(piece, "__e"))
        single = single and bool((g == head[0]).all())
    schema = pa.schema([("run", pa.int64()), ("first_g", pa.int64()), ("first_s", pa.int64()), ("last_g", pa.int64()), ("single", pa.bool_()), ("top", pa.int64()), ("opened", pa.int64())])
    yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _combine(rows: list[dict]) -> dict[int, tuple[int | None, int, int, bool]]:
    """Per run: group, maximum end and start of the period that is open before it; whether its last period goes on."""
    states: dict[int, tuple[int | None, int, int, bool]] = {}
    g, top, opened = None, _LOW, 0
    for k, r in enumerate(rows):
        came = (g, top, opened)
        if r["single"] and r["first_g"] == g:
            opened = r["opened"] if r["opened"] > top else opened
            top = max(top, r["top"])
        else:
            g, top, opened = r["last_g"], r["top"], r["opened"]
        after = rows[k + 1] if k + 1 < len(rows) else None
        goes_on = bool(after and after["first_g"] == g and after["first_s"] <= top)
        states[r["run"]] = (*came, goes_on)
    return states


def merge_intervals(df: DataFrame, entity: list[str], start: str, end: str, kind: str = "kind", gaps: bool = True) -> DataFrame:
    """Continuous periods of each entity and the gaps between them.

    Intervals that overlap, nest or touch form one period; a gap is what lies
    between two consecutive periods of an entity. Columns: entity columns, kind
    ('period' or 'gap'), start, end (bigint).

    One range shuffle on (entity, start) with ties split, one summary row per
    run, prefix combination, one rescan: an entity with a third of all rows is
    spread over as many tasks as its rows need.

    Edge cases: an interval with a null bound, or whose end is not after its
    start, is left out; a null entity part is a value of its own; repeated rows
    change nothing; an empty table gives no rows; other columns are ignored.
    Bounds are whole numbers (cast to bigint); scale fractions first.
    """
    if len({*entity, kind, start, end}) < len(entity) + 3:
        raise ValueError("entity, kind, start and end need different names")
    names = [f"__k{i}" for i in range(len(entity))]
    work = df.select(*(F.col(c).alias(n) for c, n in zip(entity, names)), F.col(start).cast("long").alias("__s"), F.col(end).cast("long").alias("__e"))
    work = work.where(F.col("__e") > F.col("__s"))
    runs, _ = sorted_runs(work, [*names, "__s"])
    runs = runs.withColumn("__g", key_hash(*(F.col(n) for n in names)))
    states = _combine(summaries(runs.select(RUN, "__g", "__s", "__e"), _summarise, _SUMMARY))

    kinds = {f.name: f.dataType for f in work.schema.fields}
    schema = ", ".join([*(f"`{n}` {kinds[n].simpleString()}" for n in names), "kind string", "s long", "e long"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last, run_was = None, None, None
        for run, piece in by_run(batches):
            if run != run_was:
                g, top, opened, goes_on = states[run]
                state, run_was = _Scan(g, top, opened), run
            if piece is None:
                if not goes_on:
                    yield rows(last, np.array([0]), ["period"], np.array([state.opened]), np.array([state.top]))
                last, run_was = None, None
                continue
            keys = piece.select(names)
            in_run = last is not None
            at, fresh, opened, before = state.feed(_long(piece, "__g"), _long(piece, "__s"), _long(piece, "__e"))
            s = _long(piece, "__s")[at]
            # what closed: the run before has already given the period that ended there
            closed = np.ones(len(at), bool)
            if len(at) and at[0] == 0 and not in_run:
                closed[0] = False
            if closed.any():
                prior = pa.Table.from_batches([last, keys]) if in_run else pa.Table.from_batches([keys])
                pick = at[closed] - 1 + (1 if in_run else 0)
                yield rows(prior.combine_chunks().to_batches()[0], pick, ["period"] * len(pick), opened[closed], before[closed])
            gap = ~fresh
            if gaps and gap.any():
                yield rows(keys, at[gap], ["gap"] * int(gap.sum()), before[gap], s[gap])
            last = keys.slice(keys.num_rows - 1, 1)

    def rows(keys: pa.RecordBatch, pick: np.ndarray, what: list[str], s: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
        taken = [keys.column(i).take(pa.array(pick)) for i in range(keys.num_columns)]
        return pa.RecordBatch.from_arrays([*taken, pa.array(what, pa.string()), pa.array(s, pa.int64()), pa.array(e, pa.int64())], names=[*names, "kind", "s", "e"])

    out = runs.transform(map_arrow, scan, schema)
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, entity)), F.col("kind").alias(kind), F.col("s").alias(start), F.col("e").alias(end))


def overlap_ratio(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """0 for disjoint or touching intervals, 1 for nested ones, else overlap by the shorter length; null if a bound is null."""
    overlap = F.least(e1, e2) - F.greatest(s1, s2)
    nested = ((s1 <= s2) & (e2 <= e1)) | ((s2 <= s1) & (e1 <= e2))
    unknown = s1.isNull() | e1.isNull() | s2.isNull() | e2.isNull()
    return F.when(unknown, F.lit(None).cast("double")).when(overlap <= 0, 0.0).when(nested, 1.0).otherwise((overlap / F.least(e1 - s1, e2 - s2)).cast("double"))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: float) -> DataFrame:
    """Pairs of rows with equal keys whose closed intervals intersect.

    Bins come on several levels, each four times as wide as the one before. An
    interval's own level is the first whose bins are as long as it is, so that it
    touches two at most; it stands in its bins on this level and on the coarser ones that the other side has,
    and a pair meets by an equi-join on (keys, level, bin) at the coarser of both own
    levels, in the first bin both share, so it comes out once. An interval thus is a few
    rows, whatever its length. Choose width near the length of short intervals. Columns of
    the right side that clash get the suffix ``_r``. Null keys or bounds never match.
    """
    ls, le = left_span
    clash = set(left.columns) & set(right.columns)
    right = right.select(*(F.col(c).alias(f"{c}_r" if c in clash else c) for c in right.columns))
    rs, re_ = (f"{c}_r" if c in clash else c for c in right_span)

    def level(s: str, e: str) -> Column:
        length = F.greatest(F.col(e) - F.col(s), F.lit(width)).cast("double") / width
        return F.greatest(F.lit(0), F.ceil(F.log(length) / F.log(F.lit(4.0)) - 1e-9)).cast("int")

    def proper(df: DataFrame, s: str, e: str) -> DataFrame:
        return df.where((F.col(e) >= F.col(s)) & ~F.isnan(F.col(s).cast("double")) & ~F.isnan(F.col(e).cast("double")))

    left, right = proper(left, ls, le), proper(right, rs, re_)
    # at most one row per level on either side
    sides = left.select(F.lit(0).alias("side"), level(ls, le).alias("at")).unionByName(right.select(F.lit(1).alias("side"), level(rs, re_).alias("at"))).distinct().collect()
    levels = [sorted(r["at"] for r in sides if r["side"] == i) for i in (0, 1)]
    wide = lambda at: F.lit(float(width)) * F.pow(F.lit(4.0), at)

    def binned(df: DataFrame, s: str, e: str, own: str, at: str, name: str, others: list[int]) -> DataFrame:
        coarser = F.filter(F.array(*map(F.lit, others)).cast("array<int>"), lambda x: x > F.col(own))
        levelled = df.withColumn(own, level(s, e)).withColumn(at, F.explode(F.concat(F.array(F.col(own)), coarser)))
        return levelled.withColumn(name, F.explode(F.sequence(F.floor(F.col(s) / wide(F.col(at))), F.floor(F.col(e) / wide(F.col(at))))))

    a, b = binned(left, ls, le, "__ol", "__ll", "__bl", levels[1]), binned(right, rs, re_, "__or", "__lr", "__br", levels[0])
    on = (F.col("__bl") == F.col("__br")) & (F.col("__ll") == F.col("__lr")) & (F.greatest("__ol", "__or") == F.col("__ll"))
    for k in keys:
        on = on & (a[k] == b[f"{k}_r" if k in clash else k])
    first = F.floor(F.greatest(F.col(ls), F.col(rs)) / wide(F.col("__ll")))
    hit = (F.greatest(F.col(ls), F.col(rs)) <= F.least(F.col(le), F.col(re_))) & (F.col("__bl") == first)
    return a.join(b, on).where(hit).drop("__bl", "__br", "__ll", "__lr", "__ol", "__or")
