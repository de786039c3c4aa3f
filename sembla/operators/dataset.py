"""Dataset algebra: concatenation, combination, subsets, samples, orders."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sembla.functions.vectors import mix
from sembla.operators.ordered import with_positions


def concatenate(parts: list[DataFrame], key: str) -> DataFrame:
    """Rows of all parts in order, with subset (number of the part), subset_pos and the overall pos.

    Parts must have one schema. Nothing is dropped; empty parts count as a number.
    """
    if len({tuple(p.dtypes) for p in parts}) != 1:
        raise ValueError("the parts have different schemas")
    union = reduce(DataFrame.unionByName, (p.withColumn("subset", F.lit(i)) for i, p in enumerate(parts)))
    placed = with_positions(union, ["subset", key], "pos")
    starts = placed.groupBy("subset").agg(F.min("pos").alias("first"))
    return placed.join(F.broadcast(starts), "subset").withColumn("subset_pos", F.col("pos") - F.col("first")).drop("first")


def combine(left: DataFrame, right: DataFrame, key: str, vector: str) -> DataFrame:
    """Multi-object of both sides by key: key, parts (struct a, b). A key that stands on one side only raises an error when it is read."""
    a = left.select(key, F.col(vector).alias("__a"))
    b = right.select(key, F.col(vector).alias("__b"))
    whole = F.col("__l").isNotNull() & F.col("__r").isNotNull()
    both = a.withColumn("__l", F.lit(True)).join(b.withColumn("__r", F.lit(True)), key, "full")
    parts = F.struct(F.col("__a").alias("a"), F.col("__b").alias("b"))
    return both.select(key, F.when(whole, parts).otherwise(F.raise_error(F.concat(F.lit("only one side has "), F.coalesce(F.col(key).cast("string"), F.lit("a null key"))))).alias("parts"))


def subset_segment(df: DataFrame, keys: list[str], start: int, length: int) -> DataFrame:
    """Rows at places start .. start + length - 1, clipped to the table."""
    return with_positions(df, keys).where((F.col("pos") >= start) & (F.col("pos") < start + length))


def subset_positions(df: DataFrame, keys: list[str], places: list[int]) -> DataFrame:
    """Rows at the given places, in the given order and as often as given, with their number ord. places is a driver list."""
    wanted = df.sparkSession.createDataFrame([(i, int(p)) for i, p in enumerate(places)], "ord int, pos long")
    return with_positions(df, keys).join(F.broadcast(wanted), "pos")


def sample_hashed(df: DataFrame, key: str, amount: float, seed: int = 0) -> DataFrame:
    """A repeatable sample: the rows whose hashed key comes first.

    amount of 1 or more is a number of rows, between 0 and 1 a share (rounded to a
    whole number of rows), 0 or less is everything.
    """
    if amount <= 0:
        return df
    n = int(amount) if amount >= 1 else round(df.count() * amount)
    return df.withColumn("__h", mix(F.col(key), seed)).orderBy("__h", key).limit(n).drop("__h")


def permute_hashed(df: DataFrame, key: str, seed: int = 0, name: str = "pos") -> DataFrame:
    """Rows in a repeatable pseudo-random order, with their place."""
    return with_positions(df.withColumn("__h", mix(F.col(key), seed)), ["__h", key], name).drop("__h")


def include_exclude(df: DataFrame, key: str, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Rows whose key is in include (if given) and not in exclude; null keys are in neither."""
    if include is not None:
        df = df.join(include.select(key), key, "left_semi")
    if exclude is not None:
        df = df.join(exclude.select(key).where(F.col(key).isNotNull()), key, "left_anti")
    return df


def sample_levels(df: DataFrame, levels: list[tuple[list[str], float]], seed: int = 0) -> DataFrame:
    """Staged samples: of each level (its columns name what is drawn), the share of different values kept by hash."""
    for k, (columns, share) in enumerate(levels):
        h = F.pmod(F.xxhash64(F.lit(seed + k), *(F.col(c).cast("string") for c in columns)), F.lit(1_000_000))
        df = df.where(h < int(share * 1_000_000)) if 0 < share < 1 else df
    return df


def nearest_chain(vectors: np.ndarray, first: int | None = None) -> list[int]:
    """Greedy order: from the vector nearest to zero (or first) always to the nearest one not used yet.

    For bounded sets such as centroids; sequential by nature.
    """
    x = np.asarray(vectors, np.float64)
    if not len(x):
        return []
    at = int((x * x).sum(1).argmin()) if first is None else first
    left = np.ones(len(x), bool)
    order = []
    for _ in range(len(x)):
        order.append(at)
        left[at] = False
        if left.any():
            d = ((x - x[at]) ** 2).sum(1)
            d[~left] = np.inf
            at = int(d.argmin())
    return order
