"""Hierarchical density clusters of vectors, from a neighbour graph and its minimum spanning tree.

Steps: neighbour graph along Hilbert curves; core distances and mutual
reachability; minimum spanning forest by cycle-rule reduction per region and
distributed Borůvka rounds; contraction below a resolution; accretion of small
nodes; condensed hierarchy of the remaining nodes with selection by stability;
the most persistent members of each cluster as its exemplars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sembla.llm.groups import _propagate, hot_join, smallest_linked
from sembla.llm.neighbours import NEAR, distinct_vectors, hot_nodes, pack, window_neighbours
from sembla.llm.topn import top_n
from sembla.session import drop_table, map_arrow, write_table

#: After the first distributed round, a graph of at most so many edges is finished by one task; beyond, by further rounds.
LOCAL_EDGES = 1_000_000
#: Edges that a region takes up before it drops what the cycle rule excludes.
BLOCK = 1_000_000
#: Edges of neighbouring partitions that one task reduces together, at most.
MERGED = 2_000_000


class _Union:
    """Disjoint sets over 0..n-1, the smallest member as root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x


def _forest(a: np.ndarray, b: np.ndarray, w: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Indices of the minimum spanning forest of the edges (a, b), by Borůvka rounds; ties by the ends (low, high) the edge had at first.

    Edges of one (w, low, high) are one edge. With them in order, the first edge of every component is
    its cheapest; these edges make no cycle, as their order is strict.
    """
    order = np.lexsort((high, low, w))
    nodes, ends = np.unique(np.concatenate([a[order], b[order]]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label, alive, kept = np.arange(len(nodes)), np.arange(len(order)), []
    while True:
        p, q = label[x[alive]], label[y[alive]]
        between = p != q
        alive, p, q = alive[between], p[between], q[between]
        if not len(alive):
            return np.sort(order[np.concatenate(kept)]) if kept else np.zeros(0, np.int64)
        first = np.full(len(nodes), len(alive))
        # written from the last to the first, so that the first edge of a component stays
        back = np.arange(len(alive) - 1, -1, -1)
        first[p[::-1]] = back
        other = np.full(len(nodes), len(alive))
        other[q[::-1]] = back
        chosen = np.unique(np.minimum(first, other))
        chosen = chosen[chosen < len(alive)]
        kept.append(alive[chosen])
        label = smallest_linked(p[chosen], q[chosen], len(nodes))[label]


_EDGE = "a long, b long, w double, low long, high long"
_NAMES = ["a", "b", "w", "low", "high"]


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spanning forest of a partition's edges: an edge outside it can't be in that of the whole graph (cycle rule)."""
    waiting: list[tuple[np.ndarray, ...]] = []
    size = 0

    def settle() -> list[tuple[np.ndarray, ...]]:
        columns = [np.concatenate(x) for x in zip(*waiting)]
        keep = _forest(*columns)
        return [tuple(c[keep] for c in columns)]

    for batch in batches:
        waiting.append(tuple(batch.column(i).to_numpy() for i in range(5)))
        size += batch.num_rows
        if size > BLOCK + len(waiting[0][0]):
            waiting, size = settle(), 0
    if waiting:
        columns = settle()[0]
        for at in range(0, len(columns[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000]) for c in columns], names=_NAMES)


def spanning_forest(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """Minimum spanning forest of edges (a, b, w): its edges, as low < high and w.

    edges should be spread so that a partition holds a neighbourhood: each
    partition first drops what the cycle rule excludes, then several partitions
    together do. Then Borůvka rounds, one at least: every component takes its cheapest
    edge, the components these edges join become one (minimum propagation), and
    edges within a component vanish. Once at most local_edges are left, one task
    finishes. Ties are decided by (w, low, high), so the result doesn't depend on the partitions.
    """
    spark = edges.sparkSession
    named = edges.select("a", "b", F.col("w").cast("double").alias("w"), F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).where("a <> b")
    graph, path = write_table(named.transform(map_arrow, _reduce, _EDGE), "graph")
    done: list[DataFrame] = []
    left, parts = graph.count(), max(1, graph.rdd.getNumPartitions())
    while left > local_edges and parts > 1 and 4 * left / parts <= MERGED:
        # forests of several regions share most of their nodes: reduced together they lose edges again
        parts = max(1, parts // 4)
        graph, new_path = write_table(graph.coalesce(parts).transform(map_arrow, _reduce, _EDGE), "graph")
        drop_table(spark, path)
        before, path, left = left, new_path, graph.count()
        if left > 0.8 * before:
            break
    while left and (left > local_edges or not done):
        order = F.struct("w", "low", "high")
        ends = graph.select(F.inline(F.array(F.struct(F.col("a").alias("v"), F.col("w").alias("w"), "low", "high", F.col("b").alias("to")), F.struct(F.col("b").alias("v"), F.col("w").alias("w"), "low", "high", F.col("a").alias("to")))))
        cheapest, _ = write_table(ends.groupBy("v").agg(F.min(F.struct("w", "low", "high", "to")).alias("e")).select("v", "e.*"), "cheapest")
        done.append(cheapest.select("low", "high", "w").distinct())
        labels, labels_path = _propagate(cheapest.select(F.col("v").alias("src"), F.col("to").alias("dst")))
        moved = graph
        for end in ("a", "b"):
            moved = moved.join(labels.select(F.col("v").alias(end), F.col("f").alias("f")), end).drop(end).withColumnRenamed("f", end)
        moved = moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w", "low", "high")
        moved = moved.groupBy("a", "b").agg(F.min(order).alias("e")).select("a", "b", "e.*")
        graph, new_path = write_table(moved, "graph")
        for old in (path, labels_path):
            drop_table(spark, old)
        path, left = new_path, graph.count()
    out = graph.coalesce(1).transform(map_arrow, _reduce, _EDGE).select("low", "high", "w")
    for part in done:
        out = out.unionByName(part)
    forest, _ = write_table(out, "forest")
    drop_table(spark, path)
    return forest


def components(edges: DataFrame) -> DataFrame:
    """(v, f): every node of edges (low, high) with the smallest node of its component."""
    return _propagate(edges.select(F.col("low").alias("src"), F.col("high").alias("dst")))[0]


def _accrete(nodes: DataFrame, edges: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Merges every small node whose cheapest edge leads to a large one into that one.

    Exact for the condensed hierarchy: at the length of its cheapest edge such a
    node joins the component of its neighbour, and being small it never is a
    cluster of its own. It adds to the neighbour's records a part (size, w).
    """
    ends = edges.select(F.inline(F.array(F.struct(F.col("a").alias("v"), "w", F.col("b").alias("to")), F.struct(F.col("b").alias("v"), "w", F.col("a").alias("to")))))
    cheapest = ends.groupBy("v").agg(F.min_by("to", F.struct("w", "to")).alias("to"), F.min("w").alias("w"))
    sized = cheapest.join(nodes.select(F.col("leaf").alias("v"), F.col("size").alias("mine")), "v").join(nodes.select(F.col("leaf").alias("to"), F.col("size").alias("other")), "to")
    moves, _ = write_table(sized.where((F.col("mine") < least) & (F.col("other") >= least)).select("v", "to", "w", "mine"), "moves")
    # size counts what joined at or below the resolution; late counts what joined later, late_l its summed 1/w
    gained = moves.groupBy(F.col("to").alias("leaf")).agg(F.sum("mine").alias("gain"), F.sum(F.col("mine") / F.col("w")).alias("gain_l"))
    kept = nodes.join(moves.select(F.col("v").alias("leaf")), "leaf", "left_anti").join(gained, "leaf", "left")
    kept = kept.select("leaf", "size", "inner", (F.col("late") + F.coalesce("gain", F.lit(0))).alias("late"), (F.col("late_l") + F.coalesce("gain_l", F.lit(0.0))).alias("late_l"))
    moved = edges
    for end in ("a", "b"):
        moved = moved.join(moves.select(F.col("v").alias(end), F.col("to").alias("t")), end, "left").withColumn(end, F.coalesce("t", end)).drop("t")
    return write_table(kept, "nodes")[0], write_table(moved.where("a <> b").select("a", "b", "w"), "upper")[0]


def condensed_clusters(leaf: np.ndarray, size: np.ndarray, inner: np.ndarray, late: np.ndarray, late_l: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, least: int) -> list[tuple[int, int, float]]:
    """Cluster (its smallest leaf) and stability of every leaf that is in a selected cluster.

    Leaves merge along the edges from the shortest on. When two sides of at least
    ``least`` records merge at distance d, both are clusters born at 1/d and their
    parent begins; a smaller side only falls out of the parent at 1/d. A cluster's
    stability sums, over its records, the lambda at which each leaves it minus its
    birth. A parent is selected where it is more stable than the selected clusters
    below it together; a root that has children is never selected.
    """
    where = {int(x): i for i, x in enumerate(leaf)}
    n = len(leaf)
    sets = _Union(n)
    total = (size + late).astype(np.int64).tolist()
    alive: list[int | None] = [None] * n
    stored: list[dict] = []

    def fresh(gains: float, members: int, children: tuple[int, ...]) -> int:
        stored.append({"gain": gains, "members": members, "children": children, "stability": 0.0})
        return len(stored) - 1

    for i in range(n):
        if total[i] >= least:
            alive[i] = fresh(float(inner[i] + late_l[i]), total[i], ())
    for e in np.lexsort((b, a, w)).tolist():
        p, q = sets.find(where[int(a[e])]), sets.find(where[int(b[e])])
        if p == q:
            continue
        if p > q:
            p, q = q, p
        lam = 1.0 / max(float(w[e]), 1e-12)
        cp, cq = alive[p], alive[q]
        if cp is not None and cq is not None:
            for c in (cp, cq):
                stored[c]["stability"] = stored[c]["gain"] - stored[c]["members"] * lam
            both = total[p] + total[q]
            made: int | None = fresh(both * lam, both, (cp, cq))
        elif cp is not None or cq is not None:
            made, other = (cp, q) if cp is not None else (cq, p)
            stored[made]["gain"] += total[other] * lam
            stored[made]["members"] += total[other]
        else:
            made = fresh((total[p] + total[q]) * lam, total[p] + total[q], ()) if total[p] + total[q] >= least else None
        sets.up[q] = p
        total[p] += total[q]
        alive[p] = made
    # roots: born at 0
    roots = {alive[sets.find(i)] for i in range(n)} - {None}
    for r in roots:
        stored[r]["stability"] = stored[r]["gain"]
    chosen = [False] * len(stored)
    best = [0.0] * len(stored)
    for c, x in enumerate(stored):
        below = sum(best[k] for k in x["children"])
        if x["children"] and (c in roots or x["stability"] < below):
            best[c] = below
        else:
            best[c], chosen[c] = x["stability"], True
    over = [-1] * len(stored)
    for c in range(len(stored) - 1, -1, -1):
        if over[c] < 0 and chosen[c]:
            over[c] = c
        for k in stored[c]["children"]:
            over[k] = over[c]
    # the clusters of large leaves were stored first, in their order; small leaves joined beyond the resolution
    out: list[tuple[int, int, float]] = []
    names: dict[int, int] = {}
    large = np.flatnonzero(size + late >= least).tolist()
    for i, c in zip(large, over):
        if c >= 0:
            names[c] = min(names.get(c, int(leaf[i])), int(leaf[i]))
            out.append((int(leaf[i]), c, stored[c]["stability"]))
    return [(x, names[c], s) for x, c, s in out]


def _merged(neighbours: int):
    """Neighbour lists of a node on all curves as one: each neighbour once, and the core distance.

    Copies count: the node's own ones are at distance 0, a neighbour counts as often as it has records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            counts = np.diff(lists.offsets.to_numpy())
            parts = lists.flatten()
            bytes_ = pc.binary_length(parts).to_numpy()
            found = np.frombuffer(b"".join(parts.to_pylist()), NEAR)
            row = np.repeat(np.repeat(np.arange(batch.num_rows), counts), bytes_ // NEAR.itemsize)
            order = np.lexsort((found["id"], row))
            row, found = row[order], found[order]
            fresh = np.ones(len(row), bool)
            fresh[1:] = (row[1:] != row[:-1]) | (found["id"][1:] != found["id"][:-1])
            row, found = row[fresh], found[fresh]
            order = np.lexsort((found["id"], found["d"], row))
            row, found = row[order], found[order]
            starts = np.searchsorted(row, np.arange(batch.num_rows))
            ends = np.searchsorted(row, np.arange(batch.num_rows), "right")
            wanted = neighbours + 1 - batch.column(3).to_numpy()
            total = np.concatenate([[0], np.cumsum(found["n"].astype(np.int64))])
            # the neighbour with which as many records are reached as wanted, or the last
            at = np.searchsorted(total, total[starts] + np.maximum(wanted, 1)) - 1
            core = np.where(wanted > 0, found["d"][np.minimum(at, np.maximum(ends - 1, 0))] if len(found) else 0.0, 0.0).astype(np.float32)
            some = ends > starts
            offsets = np.concatenate([[0], np.cumsum((ends - starts)[some])]).astype(np.int32)
            near = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(found["d"])), pa.array(np.ascontiguousarray(found["id"]))], names=["d", "b"])
            keep = pa.array(np.flatnonzero(some))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(2).take(keep), pa.array(core[some]), pa.ListArray.from_arrays(pa.array(offsets), near)], names=["a", "region", "core_a", "near"])

    return run


def density_clusters(df: DataFrame, key: str, vector: str, resolution: float, least: int = 20, neighbours: int = 6, dtype: str = "float32", local_edges: int = LOCAL_EDGES, summary: bool = True, **curves: int) -> tuple[DataFrame, DataFrame | None]:
    """Members and summary of the clusters of similar vectors (no summary unless asked for).

    Members: key, cluster (smallest key among the members), persistence (1 / core
    distance: the density up to which the record stays in). Summary: cluster,
    num_elements, stability, exemplars (the 3 most persistent members).

    resolution is the distance below which no cluster is split, and within which a
    member has to be joined to its cluster; records joined farther out are noise
    and have no row. Distances are L2, neighbours are searched along Hilbert curves
    (approximate), and every row of a curve is linked with the next one, so that a
    dense group hangs together even where a neighbour list is incomplete. Copies of
    a vector are one node, whatever their number, and all count in density and sizes.

    What goes to one task is a region of the graph, at most local_edges edges of
    the contracted graph, or the contracted hierarchy with one row per node that
    is left after small nodes have been merged into large ones, never records.

    Edge cases: null keys and vectors that are null or hold a null or NaN are left
    out; repeated rows count once; an empty table, or one without a group of
    ``least`` records, gives no rows; other columns are ignored.
    """
    if not resolution > 0:
        raise ValueError("resolution must be positive")
    rows = df.where(F.col(key).isNotNull() & (F.size(vector) > 0))
    rows = pack(rows.select(F.col(key).cast("long").alias("key"), F.lit(True).alias("q"), F.lit(True).alias("b"), F.col(vector).alias("v")), "v", dtype)
    rows, _ = write_table(rows, "vectors")
    nodes, _ = write_table(distinct_vectors(rows, "key", "q", "b"), "nodes")
    settings = {"curves": 4, "width": 64} | curves
    found = window_neighbours(nodes, neighbours, dtype, chain=True, **settings)
    # one blob per node and curve
    lists = found.groupBy("qid").agg(F.collect_list("near").alias("near"), F.coalesce(F.min(F.when(F.col("lane") == 0, F.col("block"))), F.lit(-1)).alias("region"), F.max("own").alias("own"))
    lists, lists_path = write_table(lists.select("qid", "near", "region", "own").transform(map_arrow, _merged(neighbours), "a long, region long, core_a float, near array<struct<d: float, b: long>>"), "lists")
    cores = lists.select(F.col("a").alias("b"), F.col("core_a").alias("core_b"))
    edges = lists.select("a", "region", "core_a", F.inline("near")).join(cores, "b")
    edges = edges.select("a", "b", F.greatest("d", "core_a", "core_b").alias("w"), "region")
    # a region is a stretch of the first curve; its edges go to one task, whose number isn't lowered by the size of the shuffle
    edges = edges.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "region").drop("region")
    forest = spanning_forest(edges, local_edges)

    labels = components(forest.where(F.col("w") <= resolution))
    sizes = nodes.select(F.col("bid").alias("v"), "size").join(cores.withColumnRenamed("b", "v"), "v", "left")
    floor = max(resolution * 1e-3, 1e-9)
    lam = 1.0 / F.greatest(F.coalesce(F.col("core_b").cast("double"), F.lit(floor)), F.lit(floor))
    placed, _ = write_table(sizes.join(labels, "v", "left").select("v", F.coalesce("f", "v").alias("leaf"), "size", lam.alias("persistence")), "placed")
    drop_table(df.sparkSession, lists_path)
    inner = F.sum(F.col("size") * (F.greatest(F.col("persistence"), F.lit(1.0 / resolution))))
    leaves = placed.groupBy("leaf").agg(F.sum("size").alias("size"), inner.alias("inner")).select("leaf", "size", "inner", F.lit(0).cast("long").alias("late"), F.lit(0.0).alias("late_l"))
    upper = forest.where(F.col("w") > resolution).select(F.col("low").alias("a"), F.col("high").alias("b"), "w")
    for end in ("a", "b"):
        upper = upper.join(labels.select(F.col("v").alias(end), F.col("f").alias("t")), end, "left").withColumn(end, F.coalesce("t", end)).drop("t")
    upper, _ = write_table(upper.select("a", "b", "w"), "upper")
    # a round halves the small nodes at least; what is left at the end is about as many nodes as clusters
    left = upper.count()
    while left:
        leaves, upper = _accrete(leaves, upper, least)
        after = upper.count()
        if after <= local_edges or after == left:
            break
        left = after
    touched = upper.select(F.col("a").alias("leaf")).unionByName(upper.select(F.col("b").alias("leaf"))).distinct()
    useful = leaves.where(F.col("size") >= least).join(touched, "leaf", "left_anti").unionByName(leaves.join(touched, "leaf", "left_semi"))
    nan = F.lit(None).cast("double")
    both = useful.select("leaf", "size", "inner", "late", "late_l", F.lit(None).cast("long").alias("b"), nan.alias("w")).unionByName(
        upper.select(F.col("a").alias("leaf"), F.lit(None).cast("long").alias("size"), nan.alias("inner"), F.lit(None).cast("long").alias("late"), nan.alias("late_l"), "b", "w")
    )

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [x for x in batches if x.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts).to_pandas()
        e, v = t[t["b"].notna()], t[t["b"].isna()].sort_values("leaf")
        got = condensed_clusters(*(v[c].to_numpy() for c in ("leaf", "size", "inner", "late", "late_l")), e["leaf"].to_numpy(np.int64), e["b"].to_numpy().astype(np.int64), e["w"].to_numpy(), least)
        yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["leaf", "c", "stability"])

    chosen, _ = write_table(both.coalesce(1).transform(map_arrow, select, "leaf long, c long, stability double"), "chosen")
    inside = placed.join(chosen, "leaf").select("v", "c", "stability", "persistence")
    # every key of a node, by its vector
    twins = nodes.select(F.col("vec").alias("__vec"), F.col("bid").alias("v"))
    hot = hot_nodes(nodes)
    vectors, hubs = (hot.select(F.col("vec").alias("__vec")), hot.select(F.col("bid").alias("v"))) if hot is not None else (None, None)
    keys = hot_join(rows.select("__vec", "key").distinct(), "__vec", twins, vectors).select("key", "v")
    members, _ = write_table(hot_join(keys, "v", inside, hubs).select("key", "c", "stability", "persistence"), "members")
    names = members.groupBy("c").agg(F.min("key").alias("cluster"), F.count(F.lit(1)).alias("num_elements"), F.max("stability").alias("stability"))
    names, _ = write_table(names.where(F.col("num_elements") >= least), "names")
    out = members.join(names.select("c", "cluster"), "c").select(F.col("key").alias(key), "cluster", "persistence")
    if not summary:
        return out, None
    ranked = top_n(members.join(names.select("c", "cluster"), "c").withColumn("sparsity", 1.0 / F.col("persistence")), ["cluster"], "sparsity", "key", 3, position="p")
    exemplars = ranked.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "key"))), lambda x: x["key"]).alias("exemplars"))
    return out, names.join(exemplars, "cluster").select("cluster", "num_elements", "stability", "exemplars")
