"""From neighbours of segments to copy detections: offsets, voting, merging, printing.

matches: q_file, r_file, q_start, q_end, r_start, r_end (seconds), rank (from 1),
closeness (1 for equal segments, towards 0 for far ones).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sembla.operators.asof import asof_join
from sembla.operators.grouped import apply_groups
from sembla.session import map_arrow

_KEYS = ["q_file", "r_file"]


def offsets(matches: DataFrame, step: float) -> DataFrame:
    """matches with the range of r - q offsets that a match allows, widened by step (off_low, off_high)."""
    gaps = [F.col(r) - F.col(q) for r in ("r_start", "r_end") for q in ("q_start", "q_end")]
    return matches.withColumns({"off_low": F.least(*gaps) - step, "off_high": F.greatest(*gaps) + step})


def offset_islands(matches: DataFrame, step: float = 0.25, least: int = 6, skip_near: float | None = None) -> DataFrame:
    """Merged offset ranges of every pair of files with at least ``least`` voters: q_file, r_file, low, high, voters.

    skip_near drops, within one file, offsets that close to 0. Ranges that touch are
    merged. A pair's matches are bounded by the segments of its query file.
    """
    rows = offsets(matches.dropna(subset=[*_KEYS, "q_start", "q_end", "r_start", "r_end"]), step)
    if skip_near is not None:
        rows = rows.where((F.col("q_file") != F.col("r_file")) | (F.least(F.abs("off_low"), F.abs("off_high")) > skip_near))
    order = W.partitionBy(*_KEYS).orderBy("off_low", "off_high")
    top = F.max("off_high").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("fresh", F.when(top.isNull() | (F.col("off_low") > top), 1).otherwise(0))
    rows = rows.withColumn("island", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    out = rows.groupBy(*_KEYS, "island").agg(F.min("off_low").alias("low"), F.max("off_high").alias("high"), F.count(F.lit(1)).alias("voters"))
    return out.where(F.col("voters") >= least).drop("island")


def offset_probes(islands: DataFrame, step: float = 0.25) -> DataFrame:
    """Windows of width step that slide across each island from low - step / 2: q_file, r_file, probe, probe_low."""
    # rounded, so that the last digits of a sum don't decide about a probe
    n = F.ceil((F.round(F.col("high") - F.col("low"), 9) + step / 2) / step).cast("int")
    out = islands.withColumn("probe", F.explode(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)))
    return out.select(*_KEYS, "probe", (F.col("low") - step / 2 + F.col("probe") * step).alias("probe_low"))


def scan_votes(frames: list[tuple], low: float, high: float, rank_weight: float, match_vote: float, miss_cost: float) -> list[dict]:
    """Stretches of one probe. frames: per query frame with matches (start, end, [(r_start, r_end, off_low, off_high, rank, closeness)],
    number of frames without any since the one before), in order.

    A match whose offsets meet the probe votes if its reference frame hasn't voted; a
    frame without one costs miss_cost. The best running score since the last reset is
    kept (a later equal one replaces it); a score below 0 reports it and starts anew.
    """
    out, used = [], set()
    score = voters = misses = 0
    best = start = None

    def report() -> None:
        nonlocal best, start, score, voters, misses
        if best:
            out.append(best)
        best = start = None
        score = voters = misses = 0

    def miss() -> None:
        nonlocal score, misses
        score += miss_cost
        misses += 1
        if score < 0:
            report()

    for q_start, q_end, near, gap in frames:
        while gap and start is not None:
            miss()
            gap -= 1
        vote = None
        for r_start, r_end, off_low, off_high, rank, closeness in near:
            if off_low <= high and low <= off_high and r_start not in used:
                vote = (r_start, r_end, match_vote * rank_weight ** (rank - 1) * closeness)
                break
        if vote:
            used.add(vote[0])
            if start is None:
                start = (q_start, vote[0], vote[1])
            score += vote[2]
            voters += 1
            first, last = min(start[1], vote[0]), max(start[2], vote[1])
            start = (start[0], first, last)
            if best is None or score >= best["score"]:
                best = {"score": score, "start_q": start[0], "end_q": q_end, "start_r": first, "end_r": last, "voters": voters, "misses": misses}
        elif start is not None:
            miss()
    report()
    return out


def equalise(start_q: float, end_q: float, start_r: float, end_r: float, clip_q: float = math.inf, clip_r: float = math.inf) -> tuple[float, float, float, float]:
    """Both sides to one length: a quarter of the difference is added to or taken from each end, then both are clipped to their files."""
    quarter = ((end_q - start_q) - (end_r - start_r)) / 4
    start_q, end_q, start_r, end_r = start_q + quarter, end_q - quarter, start_r - quarter, end_r + quarter
    head = max(0.0, -start_q, -start_r)
    tail = max(0.0, end_q - clip_q, end_r - clip_r)
    return start_q + head, end_q - tail, start_r + head, end_r - tail


def equalise_columns(sq: Column, eq: Column, sr: Column, er: Column) -> list[Column]:
    """The same as columns, without clipping at the end: start_q, end_q, start_r, end_r."""
    quarter = ((eq - sq) - (er - sr)) / 4
    a, b = sq + quarter, sr - quarter
    head = F.greatest(F.lit(0.0), -a, -b)
    return [(a + head).alias("start_q"), (eq - quarter).alias("end_q"), (b + head).alias("start_r"), (er + quarter).alias("end_r")]


_DETECTION = "score double, video_q string, sec_start_q double, sec_end_q double, video_r string, sec_start_r double, sec_end_r double, num_voters long, num_misses long"


def _gated(s: dict, min_length: float) -> dict | None:
    """A stretch that passes the report rules, with its bonus and equal lengths."""
    if s["voters"] < s["misses"]:
        return None
    s["start_q"], s["end_q"], s["start_r"], s["end_r"] = equalise(s["start_q"], s["end_q"], s["start_r"], s["end_r"])
    if s["end_q"] - s["start_q"] < min_length:
        return None
    if s["voters"] > 10 and s["misses"] <= 2:
        s["score"] *= 1.5
    return s


def detect_copies(
    matches: DataFrame, step: float = 0.25, rank_weight: float = 0.75, match_vote: float = 1.0, miss_cost: float = -0.1, min_length: float = 1.0, max_detections: int = 10, least: int = 6, bonus: bool = True
) -> DataFrame:
    """Detections by voting: for every pair of files the stretches where segments vote for one offset.

    Pairs that have an offset island are scanned probe by probe, in order of the
    offset. Stretches with fewer voters than misses, or shorter than min_length, are
    dropped; ones with over 10 voters and at most 2 misses count half as much again;
    lengths are equalised; of stretches that overlap on both sides the best stays.
    Per query file the max_detections best stay, and the best one gets the bonus of
    half its score. A scan holds one pair of files, which is bounded by the segments
    of the query file.
    """
    rows = offsets(matches.dropna(subset=[*_KEYS, "q_start", "q_end", "r_start", "r_end"]), step)
    found = offset_islands(matches, step, least)
    # frames are numbered within their file, so that ones without a match of a pair count as misses
    frame = ["q_file", "q_start", "q_end"]
    numbers = rows.select(*frame).distinct().withColumn("frame", F.row_number().over(W.partitionBy("q_file").orderBy("q_start", "q_end")))
    rows = rows.join(numbers, frame)
    spans = found.groupBy(*_KEYS).agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("islands"))
    wanted = rows.join(spans, _KEYS).select(*_KEYS, "q_start", "q_end", "frame", "r_start", "r_end", "off_low", "off_high", "rank", "closeness", "islands")

    def scan(rows: list[tuple]) -> list[tuple]:
        q, r, islands = rows[0][0], rows[0][1], rows[0][-1]
        frames: list[tuple] = []
        last = rows[0][4]
        for _, _, q_start, q_end, number, *near, _ in rows:
            if not frames or number != last:
                frames.append((q_start, q_end, [], max(0, number - last - 1)))
                last = number
            frames[-1][2].append(tuple(near))
        kept: list[dict] = []
        for island in islands:
            low = island["low"] - step / 2
            while low < island["high"]:
                kept += scan_votes(frames, low, low + step, rank_weight, match_vote, miss_cost)
                low += step
        kept = [s for s in (_gated(s, min_length) for s in kept) if s]
        kept.sort(key=lambda s: (-s["score"], s["start_q"], s["start_r"]))
        best: list[dict] = []
        for s in kept:
            if not any(min(s["end_q"], b["end_q"]) > max(s["start_q"], b["start_q"]) and min(s["end_r"], b["end_r"]) > max(s["start_r"], b["start_r"]) for b in best):
                best.append(s)
        return [(s["score"], q, s["start_q"], s["end_q"], r, s["start_r"], s["end_r"], s["voters"], s["misses"]) for s in best[:max_detections]]

    raw = apply_groups(wanted, _KEYS, ["q_start", "q_end", "rank", "r_start"], scan, _DETECTION)
    out = rank_detections(raw).where(F.col("rank") <= max_detections)
    return (best_bonus(out) if bonus else out).drop("rank")


#: Which detections of a query file are alike: by query stretch or not, and by any reference, the same file, or the same stretch of it.
ALIKE = {1: (False, "any"), 2: (False, "file"), 3: (False, "stretch"), 4: (True, "any"), 5: (True, "file"), 6: (True, "stretch")}


def keep_single(detections: DataFrame, mode: int, most: int | None = None) -> DataFrame:
    """Of alike detections of a query file the best one (ties by reference file, starts and ends), at most ``most`` per query file.

    mode is a number of ALIKE; stretches are alike when they share at least half of the shorter one. Modes
    1 and 2 are windows; in the others rows stream past, best first, and each is compared with the kept ones near it. What only
    the same reference file can make alike is apart by (query file, reference file), so that a query file with a large share of all
    rows is spread over the tasks. A task holds the bounds that one such group has kept.
    """
    by_stretch, reference = ALIKE[mode]
    clean = detections.dropna(subset=["video_q", "video_r", "score"]).where(~F.isnan("score"))
    if mode <= 2:
        keys = ["video_q"] if mode == 1 else ["video_q", "video_r"]
        order = W.partitionBy(*keys).orderBy(F.desc("score"), "video_r", "sec_start_q", "sec_start_r")
        out = clean.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == 1).drop("rank")
    else:
        kinds = dict(c.split() for c in _DETECTION.split(", "))
        keys = ["video_q"] if reference == "any" else ["video_q", "video_r"]
        sides = {"q": by_stretch, "r": reference == "stretch"}

        def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, kept, n = None, _Boxes(), 0
            for batch in batches:
                bounds: list[list] = []
                for side, used in sides.items():
                    # a side that doesn't matter is the same for all rows
                    bounds += [batch.column(f"sec_{end}_{side}").to_pylist() if used else [fixed] * batch.num_rows for end, fixed in (("start", 0.0), ("end", 1.0))]
                take = []
                for i, (mine, box) in enumerate(zip(zip(*(batch.column(k).to_pylist() for k in keys)), zip(*bounds))):
                    if mine != key:
                        key, kept, n = mine, _Boxes(), 0
                    if (most is None or n < most) and kept.add(box):
                        n += 1
                        take.append(i)
                yield batch.select(list(kinds)).take(pa.array(take, pa.int64()))

        rows = clean.select(*(F.col(c).cast(t).alias(c) for c, t in kinds.items())).repartition(*keys)
        order = ["video_r", "sec_start_q", "sec_start_r", "sec_end_q", "sec_end_r", "num_voters", "num_misses"]
        out = map_arrow(rows.sortWithinPartitions(*keys, F.desc("score"), *order), single, _DETECTION)
    return rank_detections(out).where(F.col("rank") <= most).drop("rank") if most else out


class _Boxes:
    """Boxes (start and end on two sides) no two of which share half of the shorter one on both sides.

    Boxes whose lengths have the same powers of two lie in cells as wide as these, so that
    a box touches two cells at most on a side. Boxes of one level that share a cell are few, as they are not alike.
    """

    def __init__(self) -> None:
        self.levels: dict[tuple[float, float], tuple[list[tuple], dict[tuple, list[tuple]]]] = {}
        self.endless: list[tuple] = []

    def add(self, box: tuple) -> bool:
        """Adds a box unless one is alike; one without a known length is like no other."""
        s, e, t, f = box
        # false for nan too
        if None in box or not (s < e and t < f):
            return True
        if any(_alike(box, b) for b in self.endless):
            return False
        for (wide, high), (boxes, cells) in self.levels.items():
            # an infinite bound makes nan, which asks for all boxes
            a, b, c, d = s // wide, e // wide, t // high, f // high
            if (b - a + 1) * (d - c + 1) < len(boxes):
                near = (x for i in range(int(a), int(b) + 1) for j in range(int(c), int(d) + 1) for x in cells.get((i, j), ()))
            else:
                near = boxes
            if any(_alike(box, x) for x in near):
                return False
        if max(e - s, f - t) > 2.0**1000:
            self.endless.append(box)
            return True
        wide, high = (math.ldexp(1.0, math.frexp(x)[1]) for x in (e - s, f - t))
        boxes, cells = self.levels.setdefault((wide, high), ([], {}))
        boxes.append(box)
        for i in range(int(s // wide), int(e // wide) + 1):
            for j in range(int(t // high), int(f // high) + 1):
                cells.setdefault((i, j), []).append(box)
        return True


def _alike(a: tuple, b: tuple) -> bool:
    return _overlap(a[0], a[1], b[0], b[1]) >= 0.5 and _overlap(a[2], a[3], b[2], b[3]) >= 0.5


def _overlap(s1: float, e1: float, s2: float, e2: float) -> float:
    """Shared part of the shorter of two stretches; 0 if one has an unknown end."""
    if None in (s1, e1, s2, e2):
        return 0.0
    over, shorter = min(e1, e2) - max(s1, s2), min(e1 - s1, e2 - s2)
    return 0.0 if over <= 0 else 1.0 if over >= shorter else over / shorter


def rank_detections(detections: DataFrame) -> DataFrame:
    """detections with their rank by score within the query file; ties by reference file, starts and ends."""
    order = W.partitionBy("video_q").orderBy(F.desc("score"), "video_r", "sec_start_q", "sec_start_r", "sec_end_q", "sec_end_r")
    return detections.withColumn("rank", F.row_number().over(order))


def best_bonus(ranked: DataFrame, factor: float = 1.5) -> DataFrame:
    """The best detection of a query file counts more."""
    return ranked.withColumn("score", F.when(F.col("rank") == 1, F.col("score") * factor).otherwise(F.col("score")))


def merge_detections(detections: DataFrame, least_overlap: float = 0.5) -> DataFrame:
    """Detections of several runs merged: same files and at least half overlap on both sides.

    Greedy in a fixed order (best score first): bounds are joined, scores, voters and
    misses are summed, num_merged counts. A group is one pair of files.
    """

    def ratio(s1: float, e1: float, s2: float, e2: float) -> float:
        over = min(e1, e2) - max(s1, s2)
        if over <= 0:
            return 0.0
        shorter = min(e1 - s1, e2 - s2)
        return 1.0 if shorter <= 0 else over / shorter

    columns = [c.split()[0] for c in _DETECTION.split(", ")]

    def merge(group: list[tuple]) -> list[tuple]:
        rows: list[dict] = []
        for d in (dict(zip([*columns, "worse"], x)) for x in group):
            for m in rows:
                if ratio(m["sec_start_q"], m["sec_end_q"], d["sec_start_q"], d["sec_end_q"]) >= least_overlap and ratio(m["sec_start_r"], m["sec_end_r"], d["sec_start_r"], d["sec_end_r"]) >= least_overlap:
                    for side in "qr":
                        m[f"sec_start_{side}"] = min(m[f"sec_start_{side}"], d[f"sec_start_{side}"])
                        m[f"sec_end_{side}"] = max(m[f"sec_end_{side}"], d[f"sec_end_{side}"])
                    for c in ("score", "num_voters", "num_misses"):
                        m[c] += d[c]
                    m["num_merged"] += 1
                    break
            else:
                rows.append(d | {"num_merged": 1})
        return [tuple(m[c] for c in [*columns, "num_merged"]) for m in rows]

    clean = detections.select(*columns).dropna().where(~F.isnan("score")).withColumn("worse", -F.col("score"))
    return apply_groups(clean, ["video_q", "video_r"], ["worse", "sec_start_q", "sec_start_r"], merge, _DETECTION + ", num_merged long")


def fit_to_segments(detections: DataFrame, segments: DataFrame) -> DataFrame:
    """detections with sec_start_q and sec_end_q moved to the nearest segment boundary of the query file (the earlier at a tie).

    segments: file_id, start_second, end_second. Files without segments stay as they are.
    """
    edges = segments.select(F.col("file_id").alias("video_q"), F.explode(F.array("start_second", "end_second")).alias("edge"))
    out = detections
    for c in ("sec_start_q", "sec_end_q"):
        out = asof_join(out, edges, ["video_q"], c, "edge", name="__before")
        out = asof_join(out, edges, ["video_q"], c, "edge", forward=True, name="__after")
        back, ahead = F.round(F.col(c) - F.col("__before"), 9), F.round(F.col("__after") - F.col(c), 9)
        near = F.when(F.col("__before").isNull(), F.col("__after")).when(F.col("__after").isNull() | (back <= ahead), F.col("__before")).otherwise(F.col("__after"))
        out = out.withColumn(c, F.coalesce(near, c)).drop("__before", "__after")
    return out


def printable(detections: DataFrame, limit: int | None = None, min_score: float = 0.0) -> DataFrame:
    """Detections with a score above min_score, at most ``limit`` per query file, best first, as the lines of the table format.

    An unknown (null) num_voters or num_misses is printed as 0, since readers of the format expect a number.
    """
    ranked = rank_detections(detections.where((F.col("score") > min_score) & ~F.isnan("score")))
    if limit:
        ranked = ranked.where(F.col("rank") <= limit)
    line = F.format_string("%.4f\t%s\t%.3f\t%.3f\t%s\t%.3f\t%.3f\t%d\t%d", "score", "video_q", "sec_start_q", "sec_end_q", "video_r", "sec_start_r", "sec_end_r", *(F.coalesce(c, F.lit(0)) for c in ("num_voters", "num_misses")))
    return ranked.select("video_q", "rank", line.alias("line"))
