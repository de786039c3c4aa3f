"""One entry to all searches: an index string picks the physical strategy."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sembla.functions.distances import distance_kernel, parse_parameters
from sembla.operators import cluster as C
from sembla.operators import search as S
from sembla.operators.stats import histogram, value_at_quantile

Strategy = Callable[..., DataFrame]


def _exact(q: DataFrame, r: DataFrame, key: str, vector: str, distance: str, k: int, limit: float | None, far: bool, p: dict[str, str]) -> DataFrame:
    return S.knn_join(q, r, key, vector, distance, k, limit, far)


def _pivots(q: DataFrame, r: DataFrame, key: str, vector: str, distance: str, k: int, limit: float | None, far: bool, p: dict[str, str]) -> DataFrame:
    if far:
        raise ValueError("pivots search the nearest only")
    chosen = [v for _, v in S.select_pivots(r, key, vector, int(p.get("num_pivots", 5)), distance)]
    out = S.laesa_join(q, r, key, vector, chosen, distance, k, p.get("method", "EXACT").upper(), float(p.get("approximation", 0.1)))
    return out.where(F.col("distance") <= limit) if limit else out


def _hashing(q: DataFrame, r: DataFrame, key: str, vector: str, distance: str, k: int, limit: float | None, far: bool, p: dict[str, str]) -> DataFrame:
    if far or distance.upper() not in ("L2", "HAMMING"):
        raise ValueError("hashing searches the nearest by L2 or HAMMING")
    tables, bits = int(p.get("table_number", 12)), int(p.get("key_size", 6))
    out = bit_lsh_join(q, r, key, vector, k, tables, bits) if distance.upper() == "HAMMING" else S.lsh_join(q, r, key, vector, k, tables, bits)
    return out.where(F.col("distance") <= limit) if limit else out


def _cells(q: DataFrame, r: DataFrame, key: str, vector: str, distance: str, k: int, limit: float | None, far: bool, p: dict[str, str]) -> DataFrame:
    if far or distance.upper() != "L2":
        raise ValueError("cells search the nearest by L2")
    sample = S.hashed_sample(r.where(F.col(vector).isNotNull()), key, 20_000)
    state = C.kmeans(sample, key, vector, int(p.get("branching", 32)), max_steps=int(p.get("iterations", 5)))
    out = S.ivf_join(q, r, key, vector, state.centroids.tolist(), k, int(p.get("probe", 4)))
    return out.where(F.col("distance") <= limit) if limit else out


#: Strategies by index id. Dynamic pivots give the exact result, and in a batch the exact plan is the best for it; a tree of
#: cells stands for the approximate trees. The automatic choice is exact at every size.
INDEXES: dict[str, Strategy] = {
    "LINEARSCAN": _exact, "SNAKETABLE": _exact, "FLANN-LINEARSCAN": _exact, "LAESA": _pivots, "LSH": _hashing, "FLANN-LSH": _hashing, "KMEANS": _cells, "FLANN-KMEANS": _cells, "FLANN-KDTREE": _cells, "AUTO": _exact, "FLANN-AUTO": _exact,
}


def register_index(name: str, strategy: Strategy) -> None:
    """Makes a strategy known under an id."""
    INDEXES[name.upper()] = strategy


def search(queries: DataFrame, references: DataFrame, key: str, vector: str, distance: str = "L2", index: str = "LINEARSCAN", knn: int = 2, range_: float = 0, method: str = "NEAREST") -> DataFrame:
    """Rows (query_id, rank, ref_id, distance) of a search.

    index is an id with parameters, such as ``LAESA,num_pivots=8,method=APPROX``. range_ 0
    is no limit; method FARTHEST looks for the largest distances.
    """
    name, p = parse_parameters(index)
    if name not in INDEXES:
        raise ValueError(f"unknown index {name}")
    return INDEXES[name](queries, references, key, vector, distance, knn, range_ or None, method.upper() == "FARTHEST", p)


def bit_lsh_join(queries: DataFrame, references: DataFrame, key: str, vector: str, k: int = 5, tables: int = 12, bits: int = 8, seed: int = 1) -> DataFrame:
    """Approximate Hamming k-NN: sampled coordinates as buckets, exact re-ranking of bucket mates.

    For coordinates of 0 and 1; queries also look into the buckets that differ in one sampled coordinate.
    """
    first = references.where(F.col(vector).isNotNull()).select(F.size(vector)).first()
    if first is None:
        return references.sparkSession.createDataFrame([], "query_id long, rank int, ref_id long, distance double")
    rng = np.random.default_rng(seed)
    picks = [rng.choice(first[0], min(bits, first[0]), replace=False).tolist() for _ in range(tables)]

    def bucketed(df: DataFrame, name: str, column: str, probing: bool) -> DataFrame:
        flipped = lambda pick: [None, *pick] if probing else [None]
        bit = lambda i, flip: 1.0 - F.col(vector)[i] if i == flip else F.col(vector)[i].cast("double")
        keys = F.array(*(F.xxhash64(F.lit(t), *(bit(i, flip) for i in pick)) for t, pick in enumerate(picks) for flip in flipped(pick)))
        return df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias(name), F.col(vector).alias(column), F.explode(keys).alias("bucket"))

    pairs = bucketed(queries, "query_id", "qv", True).join(bucketed(references, "ref_id", "rv", False), "bucket").dropDuplicates(["query_id", "ref_id"])
    unequal = F.size(F.filter(F.zip_with("qv", "rv", lambda x, y: x != y), lambda x: x)).cast("double")
    return S.ranked(pairs.select("query_id", "ref_id", unequal.alias("distance")), k)


def distance_norm(df: DataFrame, key: str, vector: str, distance: str, alpha: float, sample: int = 500) -> float:
    """The alpha-quantile of distances between a bounded sample in hashed order and all rows; 0 counts as 1."""
    some = S.hashed_sample(df.where(F.col(vector).isNotNull()), key, sample)
    pairs = S.range_join(S.hashed_sample(some, key, max(10, sample // 10)), some, key, vector, float("inf"), distance).where("query_id <> ref_id")
    row = value_at_quantile(histogram(pairs, "distance", 1000), alpha).first()
    return float(row[0]) if row and row[0] else 1.0


def multi_search(queries: DataFrame, references: DataFrame, key: str, parts: dict[str, str], weights: dict[str, float], alpha: float | None = None, k: int = 5) -> DataFrame:
    """k-NN by the weighted sum of several distances, each on its own vector column.

    parts maps vector columns to distances. With alpha every distance is divided by
    the alpha-quantile of its values on a sample. Columns of weight 0 aren't compared.
    """
    used = {c: d for c, d in parts.items() if weights.get(c, 1.0)}
    norms = {c: distance_norm(references, key, c, d, alpha) if alpha else 1.0 for c, d in used.items()}
    widths = {c: references.where(F.col(c).isNotNull()).select(F.size(c)).first()[0] for c in used}
    edges = np.cumsum([0, *widths.values()]).tolist()
    name = f"__multi{abs(hash(tuple(sorted((c, d, norms[c], weights.get(c, 1.0)) for c, d in used.items()))))}"

    def kernel(q: np.ndarray, r: np.ndarray) -> np.ndarray:
        total = np.zeros((len(q), len(r)))
        for (c, d), a, b in zip(used.items(), edges, edges[1:]):
            total += distance_kernel(d)(q[:, a:b], r[:, a:b]) / norms[c] * weights.get(c, 1.0)
        return total

    joined = lambda df: df.withColumn(name, F.concat(*(F.col(c).cast("array<double>") for c in used)))
    return S.knn_join(joined(queries), joined(references), key, name, kernel, k)


def save_kmeans(state: C.KMeansState, spark: SparkSession, path: str) -> None:
    """A k-means state as a table."""
    rows = [(i, int(n), [float(x) for x in c], float(state.error), state.steps, state.moved) for i, (n, c) in enumerate(zip(state.counts, state.centroids))]
    spark.createDataFrame(rows, "centroid_id long, num_elements long, centroid array<double>, error double, steps int, moved long").coalesce(1).write.mode("overwrite").parquet(path)


def load_kmeans(spark: SparkSession, path: str) -> C.KMeansState:
    """The state that save_kmeans wrote."""
    rows = spark.read.parquet(path).orderBy("centroid_id").collect()
    return C.KMeansState(np.array([r.centroid for r in rows]), np.array([r.num_elements for r in rows]), rows[0].error, rows[0].steps, rows[0].moved)


def save_pca(state: C.PCAState, path: str) -> None:
    """A PCA state as JSON (dims x dims numbers)."""
    with open(path, "w") as f:
        json.dump({"averages": state.averages.tolist(), "transformation": state.transformation.tolist(), "eigenvalues": state.eigenvalues.tolist()}, f)


def load_pca(path: str) -> C.PCAState:
    """The state that save_pca wrote."""
    with open(path) as f:
        x = json.load(f)
    return C.PCAState(*(np.array(x[n]) for n in ("averages", "transformation", "eigenvalues")))


def save_pivots(pivots: list[tuple[int, list[float]]], spark: SparkSession, path: str) -> None:
    """Pivots (id, vector) as a table; the distances to them are made anew when they are used."""
    spark.createDataFrame([(i, int(k), [float(x) for x in v]) for i, (k, v) in enumerate(pivots)], "number int, id long, vector array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load_pivots(spark: SparkSession, path: str) -> list[tuple[int, list[float]]]:
    """The pivots that save_pivots wrote."""
    return [(r.id, r.vector) for r in spark.read.parquet(path).orderBy("number").collect()]


def save_histogram(hist: DataFrame, path: str) -> None:
    """A histogram as text: bin, interval, amount, share, accumulated amount and share, a line per bin in order."""
    cols = ["bin", "interval_start", "interval_end", "amount", "pct", "accumulated", "accumulated_pct"]
    hist.orderBy("bin").select(F.concat_ws("\t", *(F.col(c).cast("string") for c in cols)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def load_histogram(spark: SparkSession, path: str) -> DataFrame:
    """The histogram that save_histogram wrote."""
    kinds = {"bin": "long", "interval_start": "double", "interval_end": "double", "amount": "long", "pct": "double", "accumulated": "long", "accumulated_pct": "double"}
    parts = F.split("value", "\t")
    return spark.read.text(path).select(*(parts[i].cast(k).alias(c) for i, (c, k) in enumerate(kinds.items())))


def save_search(path: str, distance: str, index: str, spark: SparkSession) -> None:
    """A distance and an index, each as its parameter string, to search again with what search takes."""
    spark.createDataFrame([("distance", distance), ("index", index)], "name string, value string").coalesce(1).write.mode("overwrite").json(path)


def load_search(spark: SparkSession, path: str) -> tuple[str, str]:
    """(distance, index) that save_search wrote."""
    found = {r.name: r.value for r in spark.read.schema("name string, value string").json(path).collect()}
    return found["distance"], found["index"]


def report(result: DataFrame, references: DataFrame | None = None, key: str = "id", description: str = "description", most: int = 50) -> DataFrame:
    """Result lines (query_id, rank, line) with the references' descriptions, which are left out over ``most`` rows."""
    few = references is not None and result.limit(most + 1).count() <= most
    text = F.format_string("%d %d %.6f", "rank", "ref_id", "distance")
    if few:
        named = references.select(F.col(key).alias("ref_id"), F.col(description).cast("string").alias("__d"))
        result, text = result.join(named, "ref_id", "left"), F.concat_ws(" ", text, "__d")
    return result.select("query_id", "rank", text.alias("line"))
