"""Statistics of numbers, vectors and distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sembla.operators.ordered import with_positions
from sembla.operators.search import matrix
from sembla.session import map_arrow

#: The quantiles of the statistics report.
FRACTIONS = (0.0001, 0.001, 0.01, 0.02, 0.05, 0.1, 0.2, 0.25, 0.4, 0.5, 0.6, 0.75, 0.8, 0.9, 0.95, 0.98, 0.99, 0.999, 0.9999)


def dimension_stats(df: DataFrame, vector: str) -> DataFrame:
    """Per dimension: n, low, high, mean, variance and deviation (population), rho = mean^2 / (2 variance).

    Sums are made per batch in NumPy, around the first vector's values to keep
    digits, and combined; one row per batch and dimension is shuffled. Null and
    partly null vectors are left out; rho is null where the variance is 0.
    """
    first = df.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())).select(F.col(vector).cast("array<double>")).first()
    base = np.array(first[0] if first else [], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = matrix(batch.column(0))
            if len(x):
                y = x - base
                d = np.arange(x.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(np.full(len(d), len(x))), pa.array(x.min(0)), pa.array(x.max(0)), pa.array(y.sum(0)), pa.array((y * y).sum(0)), pa.array(base)], names=["dim", "n", "low", "high", "s", "ss", "base"])

    parts = df.select(F.col(vector).cast("array<double>")).transform(map_arrow, run, "dim long, n long, low double, high double, s double, ss double, base double")
    total = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.first("base").alias("base"))
    mean, variance = F.col("s") / F.col("n"), F.greatest(F.lit(0.0), F.col("ss") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2))
    out = total.select("dim", "n", "low", "high", (mean + F.col("base")).alias("mean"), variance.alias("variance"))
    return out.withColumns({"deviation": F.sqrt("variance"), "rho": F.when(F.col("variance") > 0, F.col("mean") * F.col("mean") / (2 * F.col("variance")))})


def covariance_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Population covariance of every pair of columns: x, y, covariance; rows with a null in a pair don't count for it."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*(F.covar_pop(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    cells = F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"c{i}").alias("covariance")) for i, (a, b) in enumerate(pairs)))
    return row.select(F.inline(cells))


def fixed_quantiles(df: DataFrame, value: str, fractions: tuple[float, ...] = FRACTIONS) -> DataFrame:
    """fraction, value: of the sorted values the one at place round((n - 1) * fraction). Exact; null and NaN don't count."""
    clean = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.col(value).cast("double").alias("value"))
    placed = with_positions(clean, ["value"])
    n = clean.count()
    spark = df.sparkSession
    if not n:
        return spark.createDataFrame([], "fraction double, value double")
    places = spark.createDataFrame([(float(f), int(np.floor((n - 1) * f + 0.5))) for f in fractions], "fraction double, pos long")
    return placed.join(F.broadcast(places), "pos").select("fraction", "value")


def histogram(df: DataFrame, value: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """bin, interval_start, interval_end, amount, pct, accumulated, accumulated_pct over equal widths; empty bins are listed.

    The bounds are those of the data unless given; the last bin includes its end.
    """
    clean = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.col(value).cast("double").alias("x"))
    if low is None or high is None:
        least, most = clean.agg(F.min("x"), F.max("x")).first()
        low, high = least if low is None else low, most if high is None else high
    spark = df.sparkSession
    if low is None:
        return spark.createDataFrame([], "bin long, interval_start double, interval_end double, amount long, pct double, accumulated long, accumulated_pct double")
    width = (high - low) / bins or 1.0
    place = F.least(F.lit(bins - 1), F.floor((F.col("x") - low) / width)).cast("long")
    counts = clean.where(F.col("x").between(low, high)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("amount"))
    full = spark.range(bins).withColumnRenamed("id", "bin").join(F.broadcast(counts), "bin", "left").withColumn("amount", F.coalesce("amount", F.lit(0).cast("long")))
    # as many rows as bins
    run = W.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    every = W.orderBy("bin").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    out = full.withColumns({"accumulated": F.sum("amount").over(run), "total": F.sum("amount").over(every)})
    return out.select(
        "bin", (F.lit(low) + F.col("bin") * width).alias("interval_start"), (F.lit(low) + (F.col("bin") + 1) * width).alias("interval_end"), "amount",
        (F.col("amount") / F.col("total")).alias("pct"), "accumulated", (F.col("accumulated") / F.col("total")).alias("accumulated_pct"),
    )


def value_at_quantile(hist: DataFrame, alpha: float) -> DataFrame:
    """One row, value: where the accumulated share reaches alpha, linear within the bin."""
    hit = hist.where((F.col("accumulated_pct") >= alpha) & (F.col("amount") > 0))
    share = (F.lit(alpha) - (F.col("accumulated_pct") - F.col("pct"))) / F.col("pct")
    value = F.col("interval_start") + (F.col("interval_end") - F.col("interval_start")) * F.greatest(F.lit(0.0), share)
    return hit.orderBy("bin").limit(1).select(value.alias("value"))


def distinct_per(df: DataFrame, group: list[str], value: Column) -> DataFrame:
    """Different values per group; exact, in two aggregations so that a hot group is spread over its values."""
    return df.select(*group, value.alias("__v")).distinct().groupBy(*group).agg(F.count("__v").alias("n"))


def shape_stats(df: DataFrame, value: str) -> DataFrame:
    """One row: n, mean, deviation, skewness and kurtosis (population, excess over normal); nulls and NaN don't count."""
    x = F.when(~F.isnan(F.col(value).cast("double")), F.col(value))
    return df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("deviation"), F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis"))


def pixel_stats(frames: DataFrame, key: str, frame: str) -> DataFrame:
    """key, y, x, mean, variance: every pixel over the frames of a file (frames: array of arrays), by map-side sums."""
    rows = frames.where(F.col(frame).isNotNull()).select(key, F.posexplode(frame).alias("y", "row")).select(key, "y", F.posexplode("row").alias("x", "v"))
    return rows.groupBy(key, "y", "x").agg(F.avg("v").alias("mean"), F.var_pop("v").alias("variance"))


def static_crop(stats: DataFrame, key: str, limit: float = 1.0, share: float = 1 / 8) -> DataFrame:
    """key, top, bottom, left, right: without border rows and columns of which at most ``share`` of the pixels change over time."""
    moving = F.when(F.col("variance") > limit, 1.0).otherwise(0.0)
    rows = stats.groupBy(key, "y").agg(F.avg(moving).alias("m")).where(F.col("m") > share).groupBy(key).agg(F.min("y").alias("top"), F.max("y").alias("bottom"))
    cols = stats.groupBy(key, "x").agg(F.avg(moving).alias("m")).where(F.col("m") > share).groupBy(key).agg(F.min("x").alias("left"), F.max("x").alias("right"))
    return rows.join(cols, key)


def sample_pairs(left: DataFrame, right: DataFrame, key: str, count: int | None = None, seed: int = 0) -> DataFrame:
    """Repeatable pseudo-random pairs (a, b) of different keys, each key at most once per side.

    Both sides are put into hashed orders and matched by place. Without count the
    number is max(100, ln(n) n / 100) of the smaller side's n, as far as there are rows.
    """
    from sembla.operators.dataset import permute_hashed

    n = min(left.count(), right.count())
    wanted = count if count is not None else int(max(100, np.log(max(n, 2)) * n / 100))
    a = permute_hashed(left.select(key), key, seed).select(F.col(key).alias("a"), "pos")
    b = permute_hashed(right.select(key), key, seed + 1).select(F.col(key).alias("b"), "pos")
    return a.join(b, "pos").where(F.col("a") != F.col("b")).orderBy("pos").limit(wanted).select("a", "b")
