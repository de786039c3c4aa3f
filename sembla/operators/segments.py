"""Time segmentation of files and interval lookups against segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def segment_constant(files: DataFrame, key: str, length: str, size: float, step: float | None = None) -> DataFrame:
    """Segments of ``size`` seconds: key, num_segment, start_second, selected_second, end_second.

    Without step the file is cut into equal parts, as many as sizes fit (rounded, at
    least one), so that no rest is left. With step windows start every step and stay
    while their middle lies before the end, at least one; these may overlap. Files
    with a null or non-positive length have no segments.
    """
    if size <= 0 or (step is not None and step <= 0):
        raise ValueError("size and step must be positive")
    n = F.col(length).cast("double")
    ok = files.where(n.isNotNull() & ~F.isnan(n) & (n > 0)).select(key, n.alias("__n"))
    if step is None:
        count = F.greatest(F.lit(1), F.floor(F.col("__n") / size + 0.5)).cast("long")
        out = ok.withColumn("__c", count).withColumn("num_segment", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__c") - 1)))
        start, end = F.col("num_segment") * F.col("__n") / F.col("__c"), (F.col("num_segment") + 1) * F.col("__n") / F.col("__c")
    else:
        count = F.greatest(F.lit(1), F.ceil((F.col("__n") - size / 2) / step)).cast("long")
        out = ok.withColumn("num_segment", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
        start = F.col("num_segment") * step
        end = F.least(start + size, F.col("__n"))
    return out.select(key, "num_segment", start.alias("start_second"), ((start + end) / 2).alias("selected_second"), end.alias("end_second"))


def segment_sample(files: DataFrame, key: str, length: str, parts: int) -> DataFrame:
    """``parts`` equal segments per file; columns and edge cases as in segment_constant."""
    n = F.col(length).cast("double")
    ok = files.where(n.isNotNull() & ~F.isnan(n) & (n > 0)).select(key, n.alias("__n"))
    out = ok.withColumn("num_segment", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    start, end = F.col("num_segment") * F.col("__n") / parts, (F.col("num_segment") + 1) * F.col("__n") / parts
    return out.select(key, "num_segment", start.alias("start_second"), ((start + end) / 2).alias("selected_second"), end.alias("end_second"))


def segment_shots(shots: DataFrame, key: str, parts: int, remove_start: float = 0.0, remove_end: float = 0.0) -> DataFrame:
    """``parts`` equal segments per shot (key, start_second, end_second) after its ends were cut; shots that vanish give none."""
    s, e = F.col("start_second") + remove_start, F.col("end_second") - remove_end
    ok = shots.select(key, s.alias("__s"), e.alias("__e")).where(F.col("__e") > F.col("__s"))
    out = ok.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    width = (F.col("__e") - F.col("__s")) / parts
    start = F.col("__s") + F.col("part") * width
    rows = out.select(key, "part", start.alias("start_second"), (start + width / 2).alias("selected_second"), (start + width).alias("end_second"))
    place = F.row_number().over(W.partitionBy(key).orderBy("start_second", "part")).cast("long") - 1
    return rows.withColumn("num_segment", place).select(key, "num_segment", "start_second", "selected_second", "end_second")


def segmentation_summary(segments: DataFrame, key: str) -> DataFrame:
    """One row: files, segments, mean seconds and frames per segment, mean segments per file."""
    per = segments.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end_second") - F.col("start_second")).alias("s"), F.sum(F.col("end_frame") - F.col("start_frame") + 1).alias("f"))
    return per.agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("segments"), (F.sum("s") / F.sum("n")).alias("mean_seconds"), (F.sum("f") / F.sum("n")).alias("mean_frames"), F.avg("n").alias("mean_per_file"))


def invalid_segments(segments: DataFrame, key: str, allow_overlap: bool = False) -> DataFrame:
    """Segments that break a rule: ends before they start, selected outside, or (unless allowed) start before the previous one ends."""
    before = F.max("end_second").over(W.partitionBy(key).orderBy("start_second", "num_segment").rowsBetween(W.unboundedPreceding, -1))
    bad = F.when(F.col("end_second") < F.col("start_second"), "reversed").when(~F.col("selected_second").between(F.col("start_second"), F.col("end_second")), "selected outside")
    if not allow_overlap:
        bad = bad.when(before > F.col("start_second"), "overlap")
    return segments.withColumn("problem", bad).where(F.col("problem").isNotNull()).select(key, "num_segment", "problem")


def frame_differences(frames: DataFrame, key: str, order: str, distance: Column, previous: list[str]) -> DataFrame:
    """Each frame with ``difference`` to the previous one of its key; distance reads the columns and their ``prev_`` twins."""
    w = W.partitionBy(key).orderBy(order)
    return frames.withColumns({f"prev_{c}": F.lag(c).over(w) for c in previous}).withColumn("difference", distance)


def interpolate_truth(queries: DataFrame, truth: DataFrame, references: DataFrame, width: float = 10.0) -> DataFrame:
    """Query frames to the reference frames that a true copy maps them to.

    queries: q_file, q_segment, q_second; truth: q_file, start_q, end_q, r_file, start_r,
    end_r; references: r_file, r_segment, r_start, r_end. A query second inside a true
    segment is mapped linearly; the reference frame that contains it matches.
    """
    bins = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width)))
    asked = queries.withColumn("__q", F.floor(F.col("q_second") / width))
    both = asked.join(truth.where(F.col("end_q") > F.col("start_q")).withColumn("__q", bins("start_q", "end_q")), ["q_file", "__q"]).where((F.col("q_second") >= F.col("start_q")) & (F.col("q_second") <= F.col("end_q")) & (F.col("end_q") > F.col("start_q")))
    share = (F.col("q_second") - F.col("start_q")) / (F.col("end_q") - F.col("start_q"))
    mapped = both.withColumn("r_second", F.col("start_r") + share * (F.col("end_r") - F.col("start_r"))).withColumn("__b", F.floor(F.col("r_second") / width))
    binned = references.withColumn("__b", F.explode(F.sequence(F.floor(F.col("r_start") / width), F.floor(F.col("r_end") / width))))
    return mapped.join(binned, ["r_file", "__b"]).where((F.col("r_second") >= F.col("r_start")) & (F.col("r_second") < F.col("r_end"))).select("q_file", "q_segment", "r_file", "r_segment", "r_second").distinct()


def segment_by_code(files: DataFrame, key: str, length: str, code: str, shots: DataFrame | None = None) -> DataFrame:
    """Segments by a code: ``SEGCTE_size[_step]``, ``VIDEOSAMPLE_n``, or ``FILESHOTS_n[_start[_end]]`` with the shots of the files. Sizes may be fractions a/b."""
    name, *rest = code.split("_")
    number = lambda t: float(t.split("/")[0]) / float(t.split("/")[1]) if "/" in t else float(t)
    p = [number(x) for x in rest]
    if name == "SEGCTE" and len(p) in (1, 2):
        return segment_constant(files, key, length, *p)
    if name == "VIDEOSAMPLE" and len(p) == 1:
        return segment_sample(files, key, length, int(p[0]))
    if name == "FILESHOTS" and 1 <= len(p) <= 3 and shots is not None:
        return segment_shots(shots.join(files.select(key), key, "left_semi"), key, int(p[0]), *p[1:])
    raise ValueError(f"unknown segmentation {code}")
