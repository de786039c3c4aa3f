"""Structured Streaming: searches against a fixed reference set, windows, and running statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sembla.operators.search import knn_join


def stream_search(queries: DataFrame, references: DataFrame, key: str, vector: str, distance: str, k: int, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Each micro-batch of queries is searched against the references; sink gets the result and the batch number.

    A batch that is repeated after a failure has the same number, so a sink that
    overwrites by number writes every result once.
    """

    def each(batch: DataFrame, number: int) -> None:
        sink(knn_join(batch, references, key, vector, distance, k), number)

    writer = queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_stats(events: DataFrame, time: str, value: str, size: str, step: str | None = None, late: str = "1 hour") -> DataFrame:
    """n, low, high, mean and deviation of values per event-time window; rows later than ``late`` behind the newest are dropped."""
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    window = F.window(time, size, step) if step else F.window(time, size)
    x = F.col(value)
    grouped = events.withWatermark(time, late).groupBy(window.alias("w"))
    out = grouped.agg(F.count(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("deviation"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "low", "high", "mean", "deviation")


def running_histogram(events: DataFrame, value: str, low: float, width: float, bins: int) -> DataFrame:
    """bin, amount: counts per bin so far (complete or update mode); values outside go to the first and last bin."""
    place = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(value) - low) / width)))
    return events.where(F.col(value).isNotNull()).groupBy(place.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("amount"))


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Processes what is there and gives the result (a memory table, for bounded aggregates)."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
