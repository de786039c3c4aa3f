"""Consolidating pairwise matches: one group id for all records that are linked, directly or not."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sembla.session import drop_table, map_arrow, write_table

#: A vertex with more than this share of all links is hot; there are at most 2 / share such vertices.
HOT_SHARE = 0.001
#: A frontier of at most so many vertices may be broadcast.
SMALL = 10_000
#: Levels of the breadth-first search, at most; giant components of real links are less deep.
LEVELS = 24
#: Links of a partition that are propagated over together.
BLOCK = 1_000_000


def _join_links(links: DataFrame, frontier: DataFrame, hot: DataFrame, small: bool) -> DataFrame:
    """Neighbours of the frontier, each once.

    A small frontier (counted) is broadcast. A larger one is split: hot vertices
    (a bounded set) are broadcast against the links, so that no task gets all
    links of a hub; the rest is joined by shuffle.
    """
    if small:
        return links.join(F.broadcast(frontier), "src", "left_semi").select(F.col("dst").alias("v"))
    some = links.join(F.broadcast(frontier.join(F.broadcast(hot), "src", "left_semi")), "src", "left_semi")
    rest = links.join(F.broadcast(hot), "src", "left_anti").join(frontier, "src", "left_semi")
    return some.unionByName(rest).select(F.col("dst").alias("v"))


def _peel(links: DataFrame, hub: object, hot: DataFrame, most: int) -> tuple[DataFrame, list[str]]:
    """Breadth-first levels from the hub until one is empty, or ``most`` are made.

    In an undirected graph the neighbours of a level lie in it, in the one
    before, or in the next, so a level is anti-joined with two levels only.
    """
    spark = links.sparkSession
    kind = dict(links.dtypes)["src"]
    level = spark.createDataFrame([(hub,)], f"v {kind}")
    level, path = write_table(level, "level")
    paths, levels, size = [path], [level], 1
    while size and len(levels) <= most:
        near = _join_links(links, level.select(F.col("v").alias("src")), hot, size <= SMALL).distinct()
        for old in levels[-2:]:
            near = near.join(old, "v", "left_anti")
        level, path = write_table(near, "level")
        paths.append(path)
        levels.append(level)
        size = level.count()
    return spark.read.schema(level.schema).parquet(*paths), paths


def smallest_linked(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """For each of the vertices 0..n-1 the smallest one it is linked to by x-y, directly or not: minimum propagation with shortcuts."""
    label = np.arange(n)
    while True:
        a, b = label[x], label[y]
        open_ = a != b
        if not open_.any():
            return label
        x, y, a, b = x[open_], y[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            after = label[label]
            if (after == label).all():
                break
            label = after


def _stars(batches: list[pa.RecordBatch], roots: bool) -> pa.RecordBatch:
    """Every vertex of some links with the smallest one these link it to; those that are the smallest themselves only with roots."""
    table = pa.Table.from_batches(batches).combine_chunks()
    both = pa.concat_arrays([table.column(i).chunk(0) for i in range(2)]).dictionary_encode()
    order = pc.rank(both.dictionary, tiebreaker="dense").to_numpy() - 1
    code = order[both.indices.to_numpy()]
    root = smallest_linked(code[: len(table)], code[len(table) :], len(order))
    names = both.dictionary.take(pa.array(np.argsort(order)))
    kept = np.arange(len(root)) if roots else np.flatnonzero(root != np.arange(len(root)))
    return pa.RecordBatch.from_arrays([names.take(pa.array(kept)), names.take(pa.array(root[kept]))], names=["src", "dst"])


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stars of every block of links."""
    waiting: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            size += batch.num_rows
        if size > BLOCK:
            yield _stars(waiting, False)
            waiting, size = [], 0
    if waiting:
        yield _stars(waiting, False)


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stars of all links of a partition, a vertex that is a root included."""
    some = [b for b in batches if b.num_rows]
    if some:
        yield _stars(some, True)


def symmetric(links: DataFrame) -> DataFrame:
    """Links (src, dst) and their reverses, each once."""
    return links.select(F.inline(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))).distinct()


def hot_join(big: DataFrame, key: str, small: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Inner join on key, few rows a key in small; rows of big with a hot key (a bounded set) meet these by broadcast, so that they stay where they are."""
    if hot is None:
        return big.join(small, key)
    few = small.join(F.broadcast(hot), key, "left_semi")
    return big.join(F.broadcast(few), key).unionByName(big.join(F.broadcast(hot), key, "left_anti").join(small, key))


def _hot_keys(df: DataFrame, key: str, total: int) -> DataFrame | None:
    """Keys with more than HOT_SHARE of ``total`` rows, and more than a task takes easily; at most 1 / HOT_SHARE; None if there are none."""
    least = max(BLOCK // 10, int(HOT_SHARE * total))
    rows = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).select(key).collect() if total > least else []
    return df.sparkSession.createDataFrame([(r[0],) for r in rows], f"{key} {dict(df.dtypes)[key]}") if rows else None


def _propagate(links: DataFrame) -> tuple[DataFrame, str]:
    """(v, f): every vertex of symmetric links with the smallest vertex of its component, by minimum propagation with shortcuts.

    First the links of a block (what lies in one partition, in stretches of BLOCK) are
    propagated over within the block, which leaves one link per vertex and block;
    what fits into one block is finished in it. Then every vertex points to a smaller
    or equal vertex of its component. A round offers each vertex, and the vertex it
    points to, the smallest grandparent among its neighbours, and then its own
    grandparent; chains shrink geometrically, so a component of diameter d takes
    about log d rounds. A vertex that many links or many vertices point to is joined by broadcast.
    """
    kind = dict(links.dtypes)["src"]
    spark, pairs = links.sparkSession, f"src {kind}, dst {kind}"
    stars, stars_path = write_table(links.transform(map_arrow, _within, pairs), "stars")
    if stars.count() <= BLOCK:
        state, path = write_table(stars.coalesce(1).transform(map_arrow, _labelled, pairs).select(F.col("src").alias("v"), F.col("dst").alias("f")), "labels")
        drop_table(spark, stars_path)
        return state, path
    short, short_path = write_table(symmetric(stars), "short")
    drop_table(spark, stars_path)
    total = short.count()
    hot = _hot_keys(short, "src", total)
    state, path = write_table(short.groupBy(F.col("src").alias("v")).agg(F.least(F.col("v"), F.min("dst")).alias("f")), "labels")
    while True:
        grand = hot_join(state, "f", state.select(F.col("v").alias("f"), F.col("f").alias("g")), _hot_keys(state, "f", total)).select("v", "f", "g")
        offered = hot_join(short, "src", grand.select(F.col("v").alias("src"), "g"), hot).groupBy(F.col("dst").alias("v")).agg(F.min("g").alias("m"))
        both = grand.join(offered, "v")
        offers = both.select(F.inline(F.array(
            F.struct(F.col("v"), F.least("m", "g", "f").alias("o"), F.col("f").alias("f")),
            F.struct(F.col("f").alias("v"), F.col("m").alias("o"), F.lit(None).cast(kind).alias("f")),
        )))
        merged = offers.groupBy("v").agg(F.min("o").alias("o"), F.max("f").alias("old"))
        after = merged.select("v", F.least("o", "old").alias("f"), (F.least("o", "old") < F.col("old")).alias("changed"))
        after, new_path = write_table(after, "labels")
        moved = after.where("changed").limit(1).count()
        drop_table(spark, path)
        state, path = after.select("v", "f"), new_path
        if not moved:
            drop_table(spark, short_path)
            return state, path


def group_ids(pairs: DataFrame, left: str, right: str, record: str = "record", group: str = "group_id", levels: int = LEVELS) -> DataFrame:
    """One row per record that stands in a link: its id and the smallest id it is linked to.

    The links are made symmetric and distinct. From the vertex of the highest
    degree, breadth-first frontier joins collect the giant component, which is
    anti-joined away; the remaining components are labelled by minimum
    propagation. If the component is deeper than ``levels``, what was reached is
    one vertex from then on, to which the rest of its component (long thin chains)
    is still linked, so no link is lost.

    Edge cases: pairs with a null side or of a record with itself link nothing;
    repeated pairs and pairs in both directions count once; ids are compared in
    their own order (strings by code point); an empty table gives no rows; other
    columns are ignored. A hub may hold any share of the links.
    """
    spark = pairs.sparkSession
    a, b = F.col(left).alias("src"), F.col(right).alias("dst")
    once = pairs.select(a, b).where("src is not null and dst is not null and src <> dst")
    links, links_path = write_table(symmetric(once), "links")
    total = links.count()
    degrees = links.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    top = degrees.where(F.col("n") > max(1, int(HOT_SHARE * total))).orderBy(F.desc("n"), "src").limit(int(2 / HOT_SHARE)).collect()
    if not top:
        top = degrees.orderBy(F.desc("n"), "src").limit(1).collect()
    kind = dict(links.dtypes)["src"]
    if not total:
        return links.select(F.col("src").alias(record), F.col("dst").alias(group)).limit(0)
    hot = spark.createDataFrame([(r["src"],) for r in top], f"src {kind}")
    reached, level_paths = _peel(links, top[0]["src"], hot, levels)
    reached, reached_path = write_table(reached, "reached")
    for path in level_paths:
        drop_table(spark, path)
    least = reached.agg(F.min("v")).collect()[0][0]

    # the reached part becomes one vertex, named by its smallest id
    mark = reached.select(F.col("v").alias("src"))
    outside = links.join(mark, "src", "left_anti")
    inward = outside.join(mark.select(F.col("src").alias("dst"), F.lit(True).alias("inside")), "dst", "left")
    rest = inward.select("src", F.when(F.col("inside"), F.lit(least)).otherwise(F.col("dst")).alias("dst")).distinct()
    back = rest.where(F.col("dst") == F.lit(least)).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    small, small_path = write_table(rest.unionByName(back), "rest")
    labels, _ = _propagate(small)
    giant = labels.where(F.col("v") == F.lit(least)).select("f").collect()
    name = giant[0][0] if giant else least
    out = labels.where(F.col("v") != F.lit(least)).select("v", "f").unionByName(reached.select("v", F.lit(name).alias("f")))
    for path in (links_path, small_path):
        drop_table(spark, path)
    return out.select(F.col("v").alias(record), F.col("f").alias(group))
