"""Fusion of neighbour lists (query_id, ref_id, distance or rank) and evaluation of ranked answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def _ranked(df: DataFrame, k: int | None) -> DataFrame:
    out = df.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("distance", "ref_id")))
    return (out.where(F.col("rank") <= k) if k else out).select("query_id", "rank", "ref_id", "distance")


def _lists(lists: list[DataFrame], scale: list[float] | None) -> DataFrame:
    """All lists with their number, a repeated reference of a list with its smallest distance; queries absent from list 0 are dropped."""
    scale = scale or [1.0] * len(lists)
    union = reduce(DataFrame.unionByName, (x.select("query_id", "ref_id", (F.col("distance") * float(s)).alias("distance")).withColumn("list", F.lit(i)) for i, (x, s) in enumerate(zip(lists, scale))))
    return union.join(lists[0].select("query_id").distinct(), "query_id", "left_semi").groupBy("query_id", "ref_id", "list").agg(F.min("distance").alias("distance"))


def limit_list(result: DataFrame, most: int | None = None, farthest: float | None = None) -> DataFrame:
    """A list of neighbours as it is loaded for a fusion: at most ``most`` per query, none over the distance ``farthest``."""
    out = result.where(F.col("distance") <= farthest) if farthest is not None else result
    return _ranked(out.select("query_id", "ref_id", "distance"), most)


def longest_list(result: DataFrame) -> int:
    """Neighbours of the longest list of a result: the length of a fusion that is to be as long as its first list."""
    return int(result.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0])


def fuse_search_times(times: list[DataFrame], how: str = "SUM") -> DataFrame:
    """name_file, search_time of the files of the first result: SUM, MAX, or AVG (to whole numbers) of their times in all results."""
    union = reduce(DataFrame.unionByName, (t.select("name_file", "search_time").distinct().withColumn("list", F.lit(i)) for i, t in enumerate(times)))
    total = {"SUM": F.sum("search_time"), "MAX": F.max("search_time"), "AVG": F.floor(F.avg("search_time") + 0.5).cast("double")}
    if how not in total:
        raise ValueError(f"unknown way to fuse times {how}")
    return union.join(times[0].select("name_file").distinct(), "name_file", "left_semi").groupBy("name_file").agg(total[how].alias("search_time"))


def merge_concatenate(lists: list[DataFrame], k: int | None = None, scale: list[float] | None = None) -> DataFrame:
    """Union of the lists of a query; a reference in several lists keeps its smallest distance."""
    return _ranked(_lists(lists, scale).groupBy("query_id", "ref_id").agg(F.min("distance").alias("distance")), k)


def merge_distance_sum(lists: list[DataFrame], k: int | None = None, not_found: float = 1.0, scale: list[float] | None = None) -> DataFrame:
    """Sum of a reference's distances; a list without it adds not_found."""
    n = len(lists)
    total = F.sum("distance") + (F.lit(n) - F.count(F.lit(1))) * float(not_found)
    return _ranked(_lists(lists, scale).groupBy("query_id", "ref_id").agg(total.alias("distance")), k)


def merge_rank_aggregation(lists: list[DataFrame], k: int | None = None) -> DataFrame:
    """Votes of 1 / rank per list; the distance is the place by votes, best first. Ties go to the smaller reference."""
    place = F.row_number().over(W.partitionBy("query_id", "list").orderBy("distance", "ref_id"))
    votes = _lists(lists, None).withColumn("r", place).groupBy("query_id", "ref_id").agg(F.sum(1.0 / F.col("r")).alias("votes"))
    ranked = votes.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.round("votes", 12).desc(), "ref_id")))
    out = ranked.select("query_id", "rank", "ref_id", F.col("rank").cast("double").alias("distance"))
    return out.where(F.col("rank") <= k) if k else out


def local_to_global(local: DataFrame, k: int, decay: float = 0.97) -> DataFrame:
    """Lists of local vectors to one list per frame: score = sum of decay^place, distance = 1 / score.

    local: query_id (frame), local_id, rank (from 1), ref_id (frame).
    """
    score = F.sum(F.pow(F.lit(decay), F.col("rank") - 1))
    return _ranked(local.groupBy("query_id", "ref_id").agg((1.0 / score).alias("distance")), k)


def judged(answers: DataFrame, truth: DataFrame) -> DataFrame:
    """answers (query_id, rank, ref_id) with correct (1 or 0, a repeated reference only once) and found (correct ones so far).

    truth: query_id, ref_id. Queries without truth are left out.
    """
    known = truth.select("query_id", "ref_id").distinct()
    expected = known.groupBy("query_id").agg(F.count(F.lit(1)).alias("expected"))
    marked = answers.join(known.withColumn("hit", F.lit(1)), ["query_id", "ref_id"], "left").join(expected, "query_id")
    again = F.row_number().over(W.partitionBy("query_id", "ref_id").orderBy("rank"))
    marked = marked.withColumn("again", again).withColumn("correct", F.when((F.col("hit") == 1) & (F.col("again") == 1), 1).otherwise(0))
    found = F.sum("correct").over(W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    return marked.withColumn("found", found).select("query_id", "rank", "ref_id", "correct", "found", "expected")


def average_precision(answers: DataFrame, truth: DataFrame) -> DataFrame:
    """Per query with truth: expected, answered, corrects, ap (0 without a correct answer), first_correct (null if none)."""
    known = truth.select("query_id", "ref_id").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("expected"))
    rows = judged(answers, truth).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("answered"), F.sum("correct").alias("corrects"), F.sum(F.when(F.col("correct") == 1, F.col("found") / F.col("rank"))).alias("gain"), F.min(F.when(F.col("correct") == 1, F.col("rank"))).alias("first_correct")
    )
    out = known.join(rows, "query_id", "left")
    zero = F.lit(0).cast("long")
    return out.select("query_id", "expected", F.coalesce("answered", zero).alias("answered"), F.coalesce("corrects", zero).alias("corrects"), (F.coalesce("gain", F.lit(0.0)) / F.col("expected")).alias("ap"), "first_correct")


def evaluation_summary(answers: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: queries, map, mean_first_rank (a missed query counts as one more than the largest rank), corrects."""
    per = average_precision(answers, truth)
    top = answers.agg(F.coalesce(F.max("rank"), F.lit(0)).alias("top"))
    first = F.coalesce(F.col("first_correct"), F.col("top") + 1)
    return per.join(F.broadcast(top)).agg(F.count(F.lit(1)).alias("queries"), F.avg("ap").alias("map"), F.avg(first).alias("mean_first_rank"), F.sum("corrects").alias("corrects"))


def rank_curve(answers: DataFrame, truth: DataFrame) -> DataFrame:
    """Per rank: corrects up to it over all queries, and the largest precision of a query at it."""
    rows = judged(answers, truth)
    return rows.groupBy("rank").agg(F.sum("found").alias("corrects"), F.max(F.col("found") / F.col("rank")).alias("best_precision"))


def recall_curve(answers: DataFrame, truth: DataFrame) -> DataFrame:
    """Per rank, over all queries with truth: recall and precision of what is answered up to it; a list that ends before counts as it is."""
    rows = judged(answers, truth)
    total = truth.select("query_id", "ref_id").distinct().count()
    per = rows.groupBy("rank").agg(F.sum("correct").alias("hits"), F.count(F.lit(1)).alias("answers"))
    # one row per rank, bounded by the answers asked for
    upto = W.orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    return per.select("rank", (F.sum("hits").over(upto) / F.lit(max(total, 1))).alias("recall"), (F.sum("hits").over(upto) / F.sum("answers").over(upto)).alias("precision"))


def by_category(per_query: DataFrame, categories: DataFrame) -> DataFrame:
    """Means of average precision per category; a query of the category without answers counts as 0."""
    joined = categories.select("query_id", "category").join(per_query, "query_id", "left")
    return joined.groupBy("category").agg(F.count(F.lit(1)).alias("queries"), F.avg(F.coalesce("ap", F.lit(0.0))).alias("map"))


def outcome_strings(answers: DataFrame, truth: DataFrame) -> DataFrame:
    """Per query a character per answer in order: C correct, D a repeated correct one, . wrong, ? of a query without truth."""
    known = truth.select("query_id", "ref_id").distinct().withColumn("hit", F.lit(1))
    asked = truth.select("query_id").distinct().withColumn("asked", F.lit(1))
    marked = answers.join(asked, "query_id", "left").join(known, ["query_id", "ref_id"], "left")
    again = F.row_number().over(W.partitionBy("query_id", "ref_id").orderBy("rank"))
    mark = F.when(F.col("asked").isNull(), "?").when(F.col("hit").isNull(), ".").when(F.col("again") > 1, "D").otherwise("C")
    # a list is bounded by the answers asked for
    rows = marked.withColumn("again", again).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", mark.alias("m")))).alias("s"))
    return rows.select("query_id", F.array_join(F.transform("s", lambda x: x["m"]), "").alias("outcome"))
