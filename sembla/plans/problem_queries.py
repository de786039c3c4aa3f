"""Queries of the general training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sembla.operators.intervals import merge_intervals
from sembla.session import read_table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods and gaps of both sides of every pair of videos, in whole milliseconds."""
    d = read_table(spark, sf_dir, "detection").where("video_q is not null and video_r is not null")

    def side(name: str) -> F.Column:
        ms = lambda c: F.round(F.col(f"{c}_{name}") * 1000).cast("long")
        return F.struct(F.lit(name).alias("side"), ms("sec_start").alias("start_ms"), ms("sec_end").alias("end_ms"))

    spans = d.select("video_q", "video_r", F.inline(F.array(side("q"), side("r"))))
    out = merge_intervals(spans, ["side", "video_q", "video_r"], "start_ms", "end_ms")
    return out.select("side", "video_q", "video_r", "kind", "start_ms", "end_ms")


P3_SQL = """
WITH s AS (
  SELECT 'q' AS side, video_q, video_r, CAST(round(sec_start_q * 1000) AS BIGINT) AS s, CAST(round(sec_end_q * 1000) AS BIGINT) AS e FROM detection
  UNION ALL
  SELECT 'r', video_q, video_r, CAST(round(sec_start_r * 1000) AS BIGINT), CAST(round(sec_end_r * 1000) AS BIGINT) FROM detection
), v AS (
  SELECT DISTINCT * FROM s WHERE video_q IS NOT NULL AND video_r IS NOT NULL AND e > s
), m AS (
  SELECT *, max(e) OVER (PARTITION BY side, video_q, video_r ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM v
), i AS (
  SELECT *, sum(CASE WHEN top IS NULL OR s > top THEN 1 ELSE 0 END) OVER (PARTITION BY side, video_q, video_r ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM m
), p AS (
  SELECT side, video_q, video_r, n, min(s) AS start_ms, max(e) AS end_ms FROM i GROUP BY ALL
)
SELECT side, video_q, video_r, 'period' AS kind, start_ms, end_ms FROM p
UNION ALL
SELECT side, video_q, video_r, 'gap', before, start_ms FROM (
  SELECT *, lag(end_ms) OVER (PARTITION BY side, video_q, video_r ORDER BY n) AS before FROM p
) WHERE before IS NOT NULL
"""

QUERIES = {"p3_found": p3_found}
SQL = {"p3_found": P3_SQL}
