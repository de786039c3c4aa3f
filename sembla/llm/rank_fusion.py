"""One ranking from several differently scaled scores, by closeness to an ideal point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sembla.session import write_table

#: What an item that a list lacks gets, as a multiple of the worst normalised value in the list.
MISSING = 1.5

#: Criteria whose bounds may be broadcast.
CRITERIA = 10_000


def ideal_point_scores(
    df: DataFrame, key: str, criterion: str, item: str, value: str, winsor: tuple[float, float] = (0.01, 0.95), weights: dict[str, float] | None = None, closeness: str = "closeness"
) -> DataFrame:
    """Relative closeness in [0, 1] (1 is best) of every item of every key; smaller values are better.

    Rows are (key, criterion, item, value); the rows of a key and criterion form
    one list. Values are winsorised at quantiles of their criterion over all rows
    (approximate, accuracy 1/10000), each list is divided by its Euclidean norm,
    and an item is judged by its weighted distances to the ideal point (the best
    of every list) and the anti-ideal point (behind the worst of every list). An
    item that a list lacks stands at the anti-ideal there. Every list of a key has
    the same weight unless weights names others.

    All steps are aggregations with map-side combination and joins on list or
    key; nothing is gathered per key, so a key may hold any share of the rows.

    Edge cases: rows with a null key, item, criterion or null or NaN value don't
    count; an item that is repeated in a list counts with its smallest value; a
    list of zeros only tells present items from absent ones; an empty table gives
    no rows; other columns are ignored.
    """
    rows = df.select(F.col(key).alias("q"), F.col(criterion).alias("c"), F.col(item).alias("i"), F.col(value).cast("double").alias("x"))
    rows = rows.where("q is not null and c is not null and i is not null and x is not null and not isnan(x)")
    once = rows.groupBy("q", "c", "i").agg(F.min("x").alias("x"))
    # one row per criterion, broadcast only if they are few
    bounds, _ = write_table(rows.groupBy("c").agg(F.percentile_approx("x", list(winsor), 10_000).alias("b")), "bounds")
    few = bounds.limit(CRITERIA + 1).count() <= CRITERIA
    clipped = once.join(F.broadcast(bounds) if few else bounds, "c").select("q", "c", "i", F.greatest(F.col("b")[0], F.least(F.col("b")[1], "x")).alias("x"))
    lists = clipped.groupBy("q", "c").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.min("x").alias("low"), F.max("x").alias("high"))
    norm = F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0)
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("c") == name, float(w)).otherwise(weight)
    worst = F.when(F.col("high") > 0, F.col("high") / norm * MISSING).otherwise(F.col("high") / norm + 1.0)
    lists = lists.select("q", "c", norm.alias("norm"), (F.col("low") / norm).alias("ideal"), worst.alias("anti"), weight.alias("w"))
    whole = lists.groupBy("q").agg(F.sum(F.col("w") * F.pow(F.col("anti") - F.col("ideal"), 2)).alias("all"))
    v = F.col("x") / F.col("norm")
    present = clipped.join(lists, ["q", "c"]).groupBy("q", "i").agg(
        F.sum(F.col("w") * (F.pow(v - F.col("ideal"), 2) - F.pow(F.col("anti") - F.col("ideal"), 2))).alias("less"),
        F.sum(F.col("w") * F.pow(F.col("anti") - v, 2)).alias("far"),
    )
    near = F.sqrt(F.greatest(F.lit(0.0), F.col("all") + F.col("less")))
    far = F.sqrt("far")
    score = F.when(near + far > 0, far / (near + far)).otherwise(0.5)
    return present.join(whole, "q").select(F.col("q").alias(key), F.col("i").alias(item), score.alias(closeness))


def best_item(scores: DataFrame, key: str, item: str, closeness: str = "closeness") -> DataFrame:
    """The head of each key's ranking; ties (to 12 decimals) go to the smaller item. An aggregation, no sort of a key."""
    order = F.struct(-F.round(closeness, 12), F.col(item))
    return scores.groupBy(key).agg(F.min_by(F.col(item), order).alias(item))
