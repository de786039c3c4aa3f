"""Queries on vectors: distances, searches, fusion, evaluation, algebra, statistics, clusters.

The query set of a search is every row whose vec_id is divisible by 100, against all rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sembla.functions import vectors as V
from sembla.functions.distances import distance_column
from sembla.operators import cluster as C
from sembla.operators import dataset as D
from sembla.operators import fusion as U
from sembla.operators import planner as L
from sembla.operators import search as S
from sembla.operators import stats as T
from sembla.session import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_V = "SELECT vec_id, label, {e} AS e FROM embeddings WHERE embedding IS NOT NULL"
_DOUBLE = "CAST(embedding AS DOUBLE[])"
_ABS = "list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x))"
_SIGNS = "list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)"
_WHOLE = "list_transform(embedding, lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 1000) AS BIGINT))"


def vectors(spark: SparkSession, sf_dir: str, f: Callable[[Column], Column] | None = None) -> DataFrame:
    """vec_id, label, e."""
    e = F.col("embedding").cast("array<double>")
    return read_table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", "label", (f(e) if f else e).alias("e"))


def queries_of(v: DataFrame) -> DataFrame:
    """The query set."""
    return v.where("vec_id % 100 = 0")


def _out(df: DataFrame) -> DataFrame:
    return df.select("query_id", F.col("rank").cast("long").alias("rank"), "ref_id", (F.round("distance", 6) + 0.0).alias("distance"))


def zipped(body: str, a: str = "q.e", b: str = "r.e") -> str:
    """Sum over coordinate pairs z[1], z[2]."""
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST({body} AS DOUBLE)))"


def knn_sql(expr: str, k: int = 5, e: str = _DOUBLE, direction: str = "ASC", condition: str = "TRUE") -> str:
    """Brute force in SQL."""
    return f"""
WITH v AS ({_V.format(e=e)}), q AS (SELECT * FROM v WHERE vec_id % 100 = 0),
d AS (SELECT q.vec_id AS query_id, r.vec_id AS ref_id, q.label AS q_label, r.label AS r_label, {expr} AS d FROM q, v r),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d {direction}, ref_id) AS rank FROM d WHERE {condition})
SELECT query_id, rank, ref_id, round(d, 6) AS distance FROM k WHERE rank <= {k}"""


L1, L2SQ, DOT = zipped("abs(z[1] - z[2])"), zipped("(z[1] - z[2]) * (z[1] - z[2])"), zipped("z[1] * z[2]")
L2 = f"sqrt({L2SQ})"
NORMS = f"(sqrt({zipped('z[1] * z[2]', 'q.e', 'q.e')}) * sqrt({zipped('z[1] * z[2]', 'r.e', 'r.e')}))"
COSINE = f"CASE WHEN {NORMS} > 0 THEN {DOT} / {NORMS} ELSE 0 END"
HALF = "((z[1] + z[2]) / 2)"


def _add_knn(name: str, distance: str, expr: str, e: str = _DOUBLE, f: Callable[[Column], Column] | None = None, k: int = 5, **kw) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = vectors(spark, sf_dir, f)
        return _out(S.knn_join(queries_of(v), v, "vec_id", "e", distance, k, **kw))

    run.__doc__ = f"k-NN join with {distance}."
    QUERIES[name] = run
    conditions = []
    if kw.get("range_"):
        conditions.append(f"d {'>=' if kw.get('farthest') else '<='} {kw['range_']}")
    if kw.get("exclude"):
        conditions.append("q_label <> r_label")
    if kw.get("skip_self"):
        conditions.append("query_id <> ref_id")
    SQL[name] = knn_sql(expr, k, e, "DESC" if kw.get("farthest") else "ASC", " AND ".join(conditions) or "TRUE")


def _abs(v: Column) -> Column:
    return F.transform(v, lambda x: F.abs(x))


def _whole(v: Column) -> Column:
    return F.transform(v, lambda x: F.floor(F.abs(x) * 1000).cast("double"))


_add_knn("knn_l2", "L2", L2)
_add_knn("knn_l1", "L1", L1)
_add_knn("knn_lmax", "LMAX", "list_max(list_transform(list_zip(q.e, r.e), lambda z: abs(z[1] - z[2])))")
_add_knn("knn_lp3", "LP,order=3", f"power({zipped('power(abs(z[1] - z[2]), 3)')}, 1.0 / 3)")
_add_knn("knn_l05", "LP,order=0.5", f"power({zipped('sqrt(abs(z[1] - z[2]))')}, 2)")
_add_knn("knn_l2squared", "L2SQUARED", L2SQ)
_add_knn("knn_cosine", "COSINE_DISTANCE", f"CASE WHEN ({COSINE}) = 0 THEN sqrt(2) ELSE sqrt(2 * abs(1 - ({COSINE}))) END")
_add_knn("knn_chi2", "CHI2", zipped(f"CASE WHEN {HALF} > 0 THEN (z[1] - {HALF}) * (z[1] - {HALF}) / {HALF} ELSE 0 END"), _ABS, _abs)
_add_knn("knn_hellinger", "HELLINGER", f"sqrt({zipped('(sqrt(z[1]) - sqrt(z[2])) * (sqrt(z[1]) - sqrt(z[2]))')} / 2)", _ABS, _abs)
_add_knn("knn_hamming", "HAMMING", zipped("CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END"), _SIGNS, lambda v: F.transform(v, lambda x: F.when(x > 0, 1.0).otherwise(0.0)))
_add_knn("knn_bits", "BITS", zipped("bit_count(xor(z[1], z[2]))"), _WHOLE, _whole)
_add_knn("knn_dpf", "DPF,order=2,dims_discard=16", "sqrt(list_sum(list_transform(list_sort(list_transform(list_zip(q.e, r.e), lambda z: abs(z[1] - z[2])))[1:48], lambda x: x * x)))")
_add_knn("knn_dpf_as_coded", "DPF,order=2,dims_discard=16,mode=as_coded", "sqrt(list_sum(list_transform(list_sort(list_transform(list_zip(q.e, r.e), lambda z: abs(z[1] - z[2])))[17:64], lambda x: x * x)))")
_add_knn("farthest_l2", "L2", L2, farthest=True)
_add_knn("similarity_farthest_cosine", "COSINE_SIMILARITY", COSINE, farthest=True)
_add_knn("knn_with_range", "L2", L2, range_=1.2, k=10)
_add_knn("knn_exclude_same_label", "L2", L2, exclude="label")
_add_knn("snake_exact", "L2", L2, k=3)


def range_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All references within a radius."""
    v = vectors(spark, sf_dir)
    return S.range_join(queries_of(v), v, "vec_id", "e", 1.1).withColumn("distance", F.round("distance", 6))


QUERIES["range_l2"] = range_l2
SQL["range_l2"] = f"WITH v AS ({_V.format(e=_DOUBLE)}) SELECT query_id, ref_id, round(d, 6) AS distance FROM (SELECT q.vec_id AS query_id, r.vec_id AS ref_id, {L2} AS d FROM v q, v r WHERE q.vec_id % 100 = 0) WHERE d <= 1.1"


def distance_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distance as a Column expression, between each vector and the mean of its label."""
    v = vectors(spark, sf_dir)
    means = C.average_descriptor(v, ["label"], "e").withColumnRenamed("vector", "m")
    pair = v.join(F.broadcast(means), "label")
    a, b = F.col("e"), F.col("m")
    names = {"l1": "L1", "l2": "L2", "l2squared": "L2SQUARED", "lmax": "LMAX", "l05": "LP,order=0.5", "lp3": "LP,order=3", "cosine": "COSINE_DISTANCE", "dot": "COSINE_SIMILARITY,normalize_vectors=false"}
    return pair.select("vec_id", *(F.round(distance_column(d, a, b), 5).alias(n) for n, d in names.items()))


QUERIES["distance_columns"] = distance_columns
SQL["distance_columns"] = f"""
WITH v AS ({_V.format(e=_DOUBLE)}), u AS (SELECT label, generate_subscripts(e, 1) AS i, unnest(e) AS x FROM v), a AS (SELECT label, i, avg(x) AS x FROM u WHERE label IS NOT NULL GROUP BY label, i),
m AS (SELECT label, list(x ORDER BY i) AS e FROM a GROUP BY label),
p AS (SELECT q.vec_id, {L1} AS l1, {L2} AS l2, {L2SQ} AS l2squared, list_max(list_transform(list_zip(q.e, r.e), lambda z: abs(z[1] - z[2]))) AS lmax, power({zipped('sqrt(abs(z[1] - z[2]))')}, 2) AS l05, power({zipped('power(abs(z[1] - z[2]), 3)')}, 1.0 / 3) AS lp3,
CASE WHEN ({COSINE}) = 0 THEN sqrt(2) ELSE sqrt(2 * abs(1 - ({COSINE}))) END AS cosine, {DOT} AS dot FROM v q JOIN m r ON q.label = r.label)
SELECT vec_id, round(l1, 5) AS l1, round(l2, 5) AS l2, round(l2squared, 5) AS l2squared, round(lmax, 5) AS lmax, round(l05, 5) AS l05, round(lp3, 5) AS lp3, round(cosine, 5) AS cosine, round(dot, 5) AS dot FROM p"""


def multidistance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two modalities (halves of the vector): L1 / 10 with weight 1 and L2 with weight 2, by label mean."""
    v = vectors(spark, sf_dir)
    means = C.average_descriptor(v, ["label"], "e").withColumnRenamed("vector", "m")
    half = lambda c, s: F.slice(c, s, 32)
    d = distance_column("L1", half(F.col("e"), 1), half(F.col("m"), 1)) / 10.0 + distance_column("L2", half(F.col("e"), 33), half(F.col("m"), 33)) * 2.0
    return v.join(F.broadcast(means), "label").select("vec_id", F.round(d, 5).alias("distance"))


QUERIES["multidistance"] = multidistance
SQL["multidistance"] = f"""
WITH v AS ({_V.format(e=_DOUBLE)}), u AS (SELECT label, generate_subscripts(e, 1) AS i, unnest(e) AS x FROM v), a AS (SELECT label, i, avg(x) AS x FROM u WHERE label IS NOT NULL GROUP BY label, i), m AS (SELECT label, list(x ORDER BY i) AS e FROM a GROUP BY label)
SELECT q.vec_id, round({zipped('abs(z[1] - z[2])', 'q.e[1:32]', 'r.e[1:32]')} / 10 + 2 * sqrt({zipped('(z[1] - z[2]) * (z[1] - z[2])', 'q.e[33:64]', 'r.e[33:64]')}), 5) AS distance FROM v q JOIN m r ON q.label = r.label"""


def knn_emd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earth mover's distance over 8 bins."""
    v = vectors(spark, sf_dir, lambda e: F.slice(_abs(e), 1, 8))
    return _out(S.knn_join(queries_of(v), v, "vec_id", "e", "EMD,normalize_vectors=true", 5))


def _pivots(v: DataFrame) -> list[list[float]]:
    return [r.e for r in v.where("vec_id in (0, 1, 2, 3, 4, 5, 6, 7)").orderBy("vec_id").collect()]


def laesa_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pivot-pruned search, equal to the exact one."""
    v = vectors(spark, sf_dir)
    return _out(S.laesa_join(queries_of(v), v, "vec_id", "e", _pivots(v), "L2", 5))


def laesa_lb_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search by the lower bound of eight pivots."""
    v = vectors(spark, sf_dir)
    return _out(S.laesa_join(queries_of(v), v, "vec_id", "e", _pivots(v), "L2", 5, "LB_ONLY"))


def laesa_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tenth of the references with the smallest bounds, ranked exactly."""
    v = vectors(spark, sf_dir)
    return _out(S.laesa_join(queries_of(v), v, "vec_id", "e", _pivots(v), "L2", 5, "APPROX", 0.1))


_BOUND = f"""WITH v AS ({_V.format(e=_DOUBLE)}), p AS (SELECT * FROM v WHERE vec_id < 8), t AS (SELECT q.vec_id AS id, r.vec_id AS p, {L2} AS d FROM v q, p r),
b AS (SELECT x.id AS query_id, y.id AS ref_id, max(abs(x.d - y.d)) AS d FROM t x JOIN t y ON x.p = y.p WHERE x.id % 100 = 0 GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, ref_id) AS rank FROM b)"""
QUERIES |= {"knn_emd": knn_emd, "laesa_exact": laesa_exact, "laesa_lb_only": laesa_lb_only, "laesa_approx": laesa_approx}
SQL["laesa_exact"] = SQL["knn_l2"]
SQL["laesa_lb_only"] = _BOUND + " SELECT query_id, rank, ref_id, round(d, 6) AS distance FROM k WHERE rank <= 5"
SQL["laesa_approx"] = _BOUND + f""", c AS (SELECT query_id, ref_id FROM k WHERE rank <= greatest(1, (SELECT floor(count(*) * 0.1) FROM v))), e AS (SELECT c.query_id, c.ref_id, {L2} AS d FROM c JOIN v q ON q.vec_id = c.query_id JOIN v r ON r.vec_id = c.ref_id),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, ref_id) AS rank FROM e) SELECT query_id, rank, ref_id, round(d, 6) AS distance FROM z WHERE rank <= 5"""


def pivots_sss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse spatial selection of 8 pivots."""
    v = vectors(spark, sf_dir)
    return spark.createDataFrame([(i, int(p)) for i, (p, _) in enumerate(S.select_pivots(v, "vec_id", "e", 8))], "number int, vec_id long")


def lsh_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random-plane hashing with exact re-ranking."""
    v = vectors(spark, sf_dir)
    return _out(S.lsh_join(queries_of(v), v, "vec_id", "e", 5, probes=6))


def ivf_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of k-means centroids with exact re-ranking."""
    v = vectors(spark, sf_dir)
    state = C.kmeans(v, "vec_id", "e", 12, max_steps=5)
    return _out(S.ivf_join(queries_of(v), v, "vec_id", "e", state.centroids.tolist(), 5, probe=10))


def match_2nn_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest references that are clearly nearer than the second."""
    v = vectors(spark, sf_dir)
    found = S.two_nn_matches(S.knn_join(queries_of(v), v, "vec_id", "e", "L2", 2, skip_self=True), 0.97)
    return found.select("query_id", "ref_id", F.round("distance", 6).alias("distance"))


def bit_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled signs as buckets, exact Hamming re-ranking."""
    v = vectors(spark, sf_dir, lambda e: F.transform(e, lambda x: F.when(x > 0, 1.0).otherwise(0.0)))
    return _out(L.search(queries_of(v), v, "vec_id", "e", "HAMMING", "LSH,table_number=16,key_size=8", 5))


def search_planner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact result by the automatic choice of a strategy."""
    v = vectors(spark, sf_dir)
    return _out(L.search(queries_of(v), v, "vec_id", "e", "L2", "AUTO", 5))


def knn_multidistance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-NN over two halves of the vector, L1 by 10 and twice L2."""
    v = vectors(spark, sf_dir).withColumns({"a": F.slice("e", 1, 32), "b": F.slice("e", 33, 32)})
    return _out(L.multi_search(queries_of(v), v, "vec_id", {"a": "L1", "b": "L2"}, {"a": 0.1, "b": 2.0}))


def knn_multidistance_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, each distance by its median on a sample."""
    v = vectors(spark, sf_dir).withColumns({"a": F.slice("e", 1, 32), "b": F.slice("e", 33, 32)})
    return _out(L.multi_search(queries_of(v), v, "vec_id", {"a": "L1", "b": "L2"}, {}, 0.5))


_HALVES = f"0.1 * {zipped('abs(z[1] - z[2])', 'q.e[1:32]', 'r.e[1:32]')} + 2 * sqrt({zipped('(z[1] - z[2]) * (z[1] - z[2])', 'q.e[33:64]', 'r.e[33:64]')})"
QUERIES |= {"bit_lsh": bit_lsh, "search_planner": search_planner, "knn_multidistance": knn_multidistance, "knn_multidistance_normalised": knn_multidistance_normalised}
SQL |= {"search_planner": SQL["knn_l2"], "knn_multidistance": knn_sql(_HALVES)}
QUERIES |= {"pivots_sss": pivots_sss, "lsh_knn": lsh_knn, "ivf_knn": ivf_knn, "match_2nn_ratio": match_2nn_ratio}
SQL["match_2nn_ratio"] = f"""
WITH v AS ({_V.format(e=_DOUBLE)}), d AS (SELECT q.vec_id AS query_id, r.vec_id AS ref_id, {L2} AS d FROM v q, v r WHERE q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, ref_id) AS rank FROM d)
SELECT a.query_id, a.ref_id, round(a.d, 6) AS distance FROM k a JOIN k b ON a.query_id = b.query_id AND b.rank = 2 WHERE a.rank = 1 AND a.d <= 0.97 * b.d"""

# fusion: two lists of ten, by L2 and by L1


def _two(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    v = vectors(spark, sf_dir)
    return [S.knn_join(queries_of(v), v, "vec_id", "e", d, 10) for d in ("L2", "L1")]


_LISTS = f"""
WITH v AS ({_V.format(e=_DOUBLE)}), d AS (SELECT q.vec_id AS query_id, r.vec_id AS ref_id, {L2} AS a, {L1} AS b FROM v q, v r WHERE q.vec_id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY a, ref_id) AS ra, row_number() OVER (PARTITION BY query_id ORDER BY b, ref_id) AS rb FROM d),
n AS (SELECT query_id, ref_id, a AS d, ra AS r FROM k WHERE ra <= 10 UNION ALL SELECT query_id, ref_id, b, rb FROM k WHERE rb <= 10)"""
_TOP = " SELECT query_id, rank, ref_id, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {o}, ref_id) AS rank FROM m) WHERE rank <= 10"
QUERIES["merge_concatenate"] = lambda s, d: _out(U.merge_concatenate(_two(s, d), 10))
SQL["merge_concatenate"] = _LISTS + ", m AS (SELECT query_id, ref_id, min(d) AS d FROM n GROUP BY 1, 2)" + _TOP.format(o="d")
QUERIES["merge_distsum"] = lambda s, d: _out(U.merge_distance_sum(_two(s, d), 10, 3.0))
SQL["merge_distsum"] = _LISTS + ", m AS (SELECT query_id, ref_id, sum(d) + (2 - count(*)) * 3.0 AS d FROM n GROUP BY 1, 2)" + _TOP.format(o="d")
QUERIES["merge_rank_aggregation"] = lambda s, d: _out(U.merge_rank_aggregation(_two(s, d), 10))
SQL["merge_rank_aggregation"] = _LISTS + ", m AS (SELECT query_id, ref_id, round(sum(1.0 / r), 12) AS w FROM n GROUP BY 1, 2) SELECT query_id, rank, ref_id, CAST(rank AS DOUBLE) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, ref_id) AS rank FROM m) WHERE rank <= 10"


def local_to_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as local descriptors of a frame (vec_id div 10): lists of local neighbours become lists of frames."""
    v = vectors(spark, sf_dir)
    near = S.knn_join(queries_of(v), v, "vec_id", "e", "L2", 10)
    frame = lambda c: F.floor(F.col(c) / 10)
    local = near.select(frame("query_id").alias("query_id"), F.col("query_id").alias("local_id"), "rank", frame("ref_id").alias("ref_id"))
    return _out(U.local_to_global(local, 5))


QUERIES["local_to_global"] = local_to_global
SQL["local_to_global"] = f"""
WITH v AS ({_V.format(e=_DOUBLE)}), d AS (SELECT q.vec_id AS q, r.vec_id AS r, {L2} AS d FROM v q, v r WHERE q.vec_id % 100 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, r) AS rank FROM d),
m AS (SELECT q // 10 AS query_id, r // 10 AS ref_id, 1.0 / sum(power(0.97, rank - 1)) AS d FROM k WHERE rank <= 10 GROUP BY 1, 2) SELECT query_id, rank, ref_id, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, ref_id) AS rank FROM m) WHERE rank <= 5"""

# evaluation: the label is the category


def _judging(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    v = vectors(spark, sf_dir)
    q = queries_of(v)
    answers = S.knn_join(q, v, "vec_id", "e", "L2", 10, skip_self=True)
    truth = q.select(F.col("vec_id").alias("query_id"), "label").join(v.select(F.col("vec_id").alias("ref_id"), "label"), "label").where("query_id <> ref_id").select("query_id", "ref_id")
    return answers, truth, q.select(F.col("vec_id").alias("query_id"), F.col("label").alias("category"))


_EVAL = f"""
WITH v AS ({_V.format(e=_DOUBLE)}), d AS (SELECT q.vec_id AS query_id, r.vec_id AS ref_id, q.label AS category, q.label = r.label AS hit, {L2} AS d FROM v q, v r WHERE q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id),
t AS (SELECT query_id, any_value(category) AS category, count(*) AS expected FROM d WHERE hit GROUP BY query_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, ref_id) AS rank FROM d), a AS (SELECT k.query_id, rank, CASE WHEN hit THEN 1 ELSE 0 END AS c, expected, t.category FROM k JOIN t USING (query_id) WHERE rank <= 10),
f AS (SELECT *, sum(c) OVER (PARTITION BY query_id ORDER BY rank) AS found FROM a),
p AS (SELECT query_id, any_value(category) AS category, any_value(expected) AS expected, count(*) AS answered, sum(c) AS corrects, coalesce(sum(CASE WHEN c = 1 THEN found / rank END), 0) / any_value(expected) AS ap, min(CASE WHEN c = 1 THEN rank END) AS first_correct FROM f GROUP BY query_id)"""


def eval_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision of every query."""
    answers, truth, _ = _judging(spark, sf_dir)
    return U.average_precision(answers, truth).select("query_id", "expected", "answered", "corrects", F.round("ap", 9).alias("ap"), F.col("first_correct").cast("long").alias("first_correct"))


def eval_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean average precision and mean rank of the first correct answer."""
    answers, truth, _ = _judging(spark, sf_dir)
    return U.evaluation_summary(answers, truth).select("queries", F.round("map", 9).alias("map"), F.round("mean_first_rank", 9).alias("mean_first_rank"), "corrects")


def eval_rank_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrects and best precision up to every rank."""
    answers, truth, _ = _judging(spark, sf_dir)
    return U.rank_curve(answers, truth).select(F.col("rank").cast("long").alias("rank"), "corrects", F.round("best_precision", 9).alias("best_precision"))


def eval_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean average precision per label."""
    answers, truth, categories = _judging(spark, sf_dir)
    return U.by_category(U.average_precision(answers, truth), categories).select("category", "queries", F.round("map", 9).alias("map"))


def eval_outcome_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of every answer as a string."""
    answers, truth, _ = _judging(spark, sf_dir)
    return U.outcome_strings(answers, truth)


QUERIES |= {"eval_average_precision": eval_average_precision, "eval_map": eval_map, "eval_rank_curve": eval_rank_curve, "eval_by_category": eval_by_category, "eval_outcome_string": eval_outcome_string}
SQL["eval_average_precision"] = _EVAL + " SELECT query_id, expected, answered, CAST(corrects AS BIGINT) AS corrects, round(ap, 9) AS ap, first_correct FROM p"
SQL["eval_map"] = _EVAL + " SELECT count(*) AS queries, round(avg(ap), 9) AS map, round(avg(coalesce(first_correct, 11)), 9) AS mean_first_rank, CAST(sum(corrects) AS BIGINT) AS corrects FROM p"
SQL["eval_rank_curve"] = _EVAL + " SELECT rank, CAST(sum(found) AS BIGINT) AS corrects, round(max(found / rank), 9) AS best_precision FROM f GROUP BY rank"
SQL["eval_by_category"] = _EVAL + " SELECT category, count(*) AS queries, round(avg(ap), 9) AS map FROM p GROUP BY category"
SQL["eval_outcome_string"] = _EVAL + " SELECT query_id, string_agg(CASE WHEN c = 1 THEN 'C' ELSE '.' END, '' ORDER BY rank) AS outcome FROM f GROUP BY query_id"

# dataset algebra

_FIRST = "((((vec_id % 1000003 + 1000003) % 1000003) * 2654435761 + 1013904223::BIGINT * {s}) % 4294967296)"
_HASH = f"(({_FIRST} % 65521) * 65497 + {_FIRST} // 65521) * 1664525 % 4294967296"


def ds_concatenate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even ids after odd ids."""
    v = vectors(spark, sf_dir).select("vec_id")
    return D.concatenate([v.where("vec_id % 2 = 1"), v.where("vec_id % 2 = 0")], "vec_id").select("vec_id", F.col("subset").cast("long").alias("subset"), "subset_pos", "pos")


def ds_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two modalities of each object."""
    a, b = vectors(spark, sf_dir, lambda e: F.slice(e, 1, 2)), vectors(spark, sf_dir, lambda e: F.slice(e, 3, 2))
    p = D.combine(a, b, "vec_id", "e")
    return p.select("vec_id", F.col("parts.a")[0].alias("a1"), F.col("parts.b")[1].alias("b2"))


QUERIES |= {
    "ds_concatenate": ds_concatenate, "ds_combine": ds_combine,
    "ds_subset_segment": lambda s, d: D.subset_segment(vectors(s, d).select("vec_id"), ["vec_id"], 40, 100),
    "ds_subset_positions": lambda s, d: D.subset_positions(vectors(s, d).select("vec_id"), ["vec_id"], [5, 3, 3, 99, 0]).select(F.col("ord").cast("long").alias("ord"), "vec_id"),
    "ds_sample_hash": lambda s, d: D.sample_hashed(vectors(s, d).select("vec_id", "label"), "vec_id", 0.2, 7),
    "ds_permute_hash": lambda s, d: D.permute_hashed(vectors(s, d).select("vec_id"), "vec_id", 3),
    "include_exclude_ids": lambda s, d: D.include_exclude(read_table(s, d, "documents").select("doc_id", "lang"), "doc_id", None, read_table(s, d, "documents").where("lang = 'en'").select(F.col("parent_id").alias("doc_id"))),
}
SQL |= {
    "ds_concatenate": "WITH x AS (SELECT vec_id, CASE WHEN vec_id % 2 = 1 THEN 0 ELSE 1 END AS subset FROM embeddings WHERE embedding IS NOT NULL) SELECT vec_id, CAST(subset AS BIGINT) AS subset, row_number() OVER (PARTITION BY subset ORDER BY vec_id) - 1 AS subset_pos, row_number() OVER (ORDER BY subset, vec_id) - 1 AS pos FROM x",
    "ds_combine": "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a1, CAST(embedding[4] AS DOUBLE) AS b2 FROM embeddings WHERE embedding IS NOT NULL",
    "ds_subset_segment": "SELECT vec_id, pos FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings WHERE embedding IS NOT NULL) WHERE pos >= 40 AND pos < 140",
    "ds_subset_positions": "WITH x AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings WHERE embedding IS NOT NULL) SELECT CAST(ord AS BIGINT) AS ord, vec_id FROM (VALUES (0, 5), (1, 3), (2, 3), (3, 99), (4, 0)) AS w(ord, pos) JOIN x USING (pos)",
    "ds_sample_hash": f"SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (ORDER BY {_HASH.format(s=7)}, vec_id) AS n FROM embeddings WHERE embedding IS NOT NULL) WHERE n <= (SELECT round(count(*) * 0.2) FROM embeddings WHERE embedding IS NOT NULL)",
    "ds_permute_hash": f"SELECT vec_id, row_number() OVER (ORDER BY {_HASH.format(s=3)}, vec_id) - 1 AS pos FROM embeddings WHERE embedding IS NOT NULL",
    "include_exclude_ids": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT parent_id FROM documents WHERE lang = 'en' AND parent_id IS NOT NULL)",
}


def vector_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Casts, square roots, quantisation and the three norms; sums and single elements of the results."""
    v = vectors(spark, sf_dir)
    e, a = F.col("e"), _abs(F.col("e"))
    total = lambda c: F.aggregate(c.cast("array<double>"), F.lit(0.0), lambda s, x: s + x)
    return v.select(
        "vec_id", total(V.convert(F.transform(e, lambda x: x * 10), "int")).alias("whole"), F.round(total(V.root(a)), 6).alias("roots"), total(V.quantize_u8(a)).alias("up"), total(V.quantize_u8(a, True)).alias("near"),
        F.round(V.norm_sum1(a)[0], 9).alias("sum1"), F.round(V.norm_l2(e)[1], 9).alias("l2"), F.round(V.norm_max1(a)[2], 9).alias("max1"), F.round(total(V.rootsift(a)), 6).alias("rootsift"),
    )


QUERIES["vector_conversions"] = vector_conversions
SQL["vector_conversions"] = f"""
WITH v AS (SELECT vec_id, {_DOUBLE} AS e, {_ABS} AS a FROM embeddings WHERE embedding IS NOT NULL)
SELECT vec_id, list_sum(list_transform(e, lambda x: CAST(trunc(x * 10) AS DOUBLE))) AS whole, round(list_sum(list_transform(a, lambda x: sqrt(x))), 6) AS roots, list_sum(list_transform(a, lambda x: least(255.0, ceil(x * 255)))) AS up, list_sum(list_transform(a, lambda x: least(255.0, round(x * 255)))) AS near,
round(a[1] / list_sum(a), 9) AS sum1, round(e[2] / sqrt(list_sum(list_transform(e, lambda x: x * x))), 9) AS l2, round(a[3] / list_max(a), 9) AS max1, round(list_sum(list_transform(a, lambda x: sqrt(x / list_sum(a)))), 6) AS rootsift FROM v"""

# statistics


def stats_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every dimension."""
    s = T.dimension_stats(vectors(spark, sf_dir), "e")
    return s.select("dim", "n", *(F.round(c, 6).alias(c) for c in ("low", "high", "mean", "variance", "deviation")))


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def stats_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariances of four columns."""
    return T.covariance_matrix(read_table(spark, sf_dir, "lineitem"), _NUM).select("x", "y", (F.round("covariance", 3) + 0.0).alias("covariance"))


def quantiles_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """19 quantiles of the prices."""
    return T.fixed_quantiles(read_table(spark, sf_dir, "lineitem"), "l_extendedprice")


def _distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return S.range_join(queries_of(v), v, "vec_id", "e", float("inf"), "L1").withColumn("distance", F.round("distance", 6))


def distance_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of the distances between the query set and all rows."""
    h = T.histogram(_distances(spark, sf_dir), "distance", 20, 0.0, 100.0)
    return h.select("bin", "interval_start", "interval_end", "amount", F.round("pct", 9).alias("pct"), "accumulated", F.round("accumulated_pct", 9).alias("accumulated_pct"))


def alpha_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance that a tenth of the pairs lie under, from the histogram."""
    return T.value_at_quantile(T.histogram(_distances(spark, sf_dir), "distance", 20, 0.0, 100.0), 0.1).select(F.round("value", 6).alias("value"))


_PAIRS = f"WITH v AS ({_V.format(e=_DOUBLE)}), d AS (SELECT round({L1}, 6) AS d FROM v q, v r WHERE q.vec_id % 100 = 0), c AS (SELECT least(19, CAST(floor(d / 5) AS BIGINT)) AS bin, count(*) AS n FROM d WHERE d BETWEEN 0 AND 100 GROUP BY 1), h AS (SELECT b.bin, coalesce(n, 0) AS amount FROM range(20) b(bin) LEFT JOIN c USING (bin)), s AS (SELECT *, CAST(sum(amount) OVER (ORDER BY bin) AS BIGINT) AS accumulated, sum(amount) OVER () AS total FROM h)"
QUERIES |= {"stats_dimension": stats_dimension, "stats_covariance": stats_covariance, "quantiles_fixed": quantiles_fixed, "distance_histogram": distance_histogram, "alpha_quantile": alpha_quantile}
SQL |= {
    "stats_dimension": f"WITH u AS (SELECT generate_subscripts(embedding, 1) - 1 AS dim, unnest({_DOUBLE}) AS x FROM embeddings WHERE embedding IS NOT NULL) SELECT dim, count(*) AS n, round(min(x), 6) AS low, round(max(x), 6) AS high, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS variance, round(stddev_pop(x), 6) AS deviation FROM u GROUP BY dim",
    "stats_covariance": " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(covar_pop({a}, {b}), 3) + 0.0 AS covariance FROM lineitem" for i, a in enumerate(_NUM) for b in _NUM[i:]),
    "quantiles_fixed": f"WITH x AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS p FROM lineitem WHERE l_extendedprice IS NOT NULL), f AS (SELECT unnest([{', '.join(map(str, T.FRACTIONS))}])::DOUBLE AS fraction) SELECT fraction, v AS value FROM f JOIN x ON p = floor(((SELECT count(*) FROM x) - 1) * fraction + 0.5)",
    "distance_histogram": _PAIRS + " SELECT bin, bin * 5.0::DOUBLE AS interval_start, (bin + 1) * 5.0::DOUBLE AS interval_end, amount, round(amount / total, 9) AS pct, accumulated, round(accumulated / total, 9) AS accumulated_pct FROM s",
    "alpha_quantile": _PAIRS + " SELECT round(bin * 5.0 + 5.0 * greatest(0, (0.1 - (accumulated - amount) / total) / (amount / total)), 6) AS value FROM s WHERE accumulated / total >= 0.1 AND amount > 0 ORDER BY bin LIMIT 1",
}


def distance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the means of the labels (a bounded set)."""
    means = C.average_descriptor(vectors(spark, sf_dir), ["label"], "e").select(F.col("label").cast("long").alias("vec_id"), F.col("vector").alias("e"))
    return S.range_join(means, means, "vec_id", "e", float("inf")).where("query_id <= ref_id").select("query_id", "ref_id", (F.round("distance", 6) + 0.0).alias("distance"))


_MEANS = f"v AS ({_V.format(e=_DOUBLE)}), u AS (SELECT label, generate_subscripts(e, 1) AS i, unnest(e) AS x FROM v WHERE label IS NOT NULL), a AS (SELECT label, i, avg(x) AS x FROM u GROUP BY label, i), m AS (SELECT label, list(x ORDER BY i) AS e FROM a GROUP BY label)"
QUERIES["distance_matrix"] = distance_matrix
SQL["distance_matrix"] = f"WITH {_MEANS} SELECT CAST(q.label AS BIGINT) AS query_id, CAST(r.label AS BIGINT) AS ref_id, round({L2}, 6) AS distance FROM m q JOIN m r ON q.label <= r.label"

# clusters; the first ten vectors are the first centroids


def _first(v: DataFrame) -> np.ndarray:
    return np.array([r.e for r in v.where("vec_id < 10").orderBy("vec_id").collect()])


def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest of ten centroids."""
    v = vectors(spark, sf_dir)
    return C.assign(v, "vec_id", "e", _first(v)).select(F.col("id").alias("vec_id"), "centroid_id", (F.round("distance", 6) + 0.0).alias("distance"))


def kmeans_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The centroids after one step: elements and first coordinates."""
    v = vectors(spark, sf_dir)
    points = _first(v)
    total, counts, _, _ = C._step(v, "e", points, "L2")
    after = C.adjust(points, total, counts)
    return spark.createDataFrame([(i, int(n), round(float(p[0]), 6), round(float(p[1]), 6)) for i, (n, p) in enumerate(zip(counts, after))], "centroid_id long, elements long, x1 double, x2 double")


def kmeans_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and distances of every cluster."""
    v = vectors(spark, sf_dir)
    s = C.cluster_stats(C.assign(v, "vec_id", "e", _first(v)))
    return s.select("centroid_id", "elements", *(F.round(c, 5).alias(c) for c in ("sum_sse", "average_sse", "dist_min", "dist_max", "dist_avg", "dist_std")))


def _state(spark: SparkSession, s: C.KMeansState) -> DataFrame:
    return spark.createDataFrame([(i, int(n), [float(x) for x in p]) for i, (n, p) in enumerate(zip(s.counts, s.centroids))], "centroid_id long, num_elements long, centroid array<double>")


_NEAREST = f"WITH v AS ({_V.format(e=_DOUBLE)}), d AS (SELECT q.vec_id, q.e, r.vec_id AS centroid_id, {L2} AS d FROM v q, v r WHERE r.vec_id < 10), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, centroid_id) AS k FROM d) WHERE k = 1)"
QUERIES |= {
    "kmeans_assign": kmeans_assign, "kmeans_update": kmeans_update, "kmeans_stats": kmeans_stats,
    "kmeans_full": lambda s, d: _state(s, C.kmeans(vectors(s, d), "vec_id", "e", 10)), "kmeans_subset_runs": lambda s, d: _state(s, C.kmeans_subsets(vectors(s, d), "vec_id", "e", 8)),
}
SQL |= {
    "kmeans_assign": _NEAREST + " SELECT vec_id, centroid_id, round(d, 6) AS distance FROM n",
    "kmeans_update": _NEAREST + ", a AS (SELECT centroid_id, count(*) AS elements, avg(e[1]) AS x1, avg(e[2]) AS x2 FROM n GROUP BY 1) SELECT v.vec_id AS centroid_id, coalesce(elements, 0) AS elements, round(coalesce(x1, e[1]), 6) AS x1, round(coalesce(x2, e[2]), 6) AS x2 FROM v LEFT JOIN a ON v.vec_id = a.centroid_id WHERE v.vec_id < 10",
    "kmeans_stats": _NEAREST + " SELECT centroid_id, count(*) AS elements, round(sum(d * d), 5) AS sum_sse, round(avg(d * d), 5) AS average_sse, round(min(d), 5) AS dist_min, round(max(d), 5) AS dist_max, round(avg(d), 5) AS dist_avg, round(stddev_pop(d), 5) AS dist_std FROM n GROUP BY 1",
}


def pca_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages and the first entries of every axis."""
    s = C.pca_fit(vectors(spark, sf_dir), "e")
    return spark.createDataFrame([(i, float(m), [float(x) for x in a]) for i, (m, a) in enumerate(zip(s.averages, s.transformation))], "number long, average double, axis array<double>")


def pca_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the first eight axes."""
    v = vectors(spark, sf_dir)
    return C.pca_apply(v, "vec_id", "e", C.pca_fit(v, "e"), 8)


def pca_total_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eigenvalues sum to the variance of all dimensions."""
    s = C.pca_fit(vectors(spark, sf_dir), "e")
    return spark.createDataFrame([(len(s.eigenvalues), round(float(s.eigenvalues.sum()), 5))], "dims long, variance double")


QUERIES |= {
    "pca_fit": pca_fit, "pca_apply": pca_apply, "pca_total_variance": pca_total_variance,
    "pca_eigen_report": lambda s, d: s.createDataFrame(C.pca_report(C.pca_fit(vectors(s, d), "e")), "number long, eigenvalue double, accumulated double"),
}
SQL["pca_total_variance"] = f"WITH u AS (SELECT generate_subscripts(embedding, 1) AS i, unnest({_DOUBLE}) AS x FROM embeddings WHERE embedding IS NOT NULL), s AS (SELECT i, var_pop(x) AS v FROM u GROUP BY i) SELECT count(*) AS dims, round(sum(v), 5) AS variance FROM s"


def bow_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visual words of frames (vec_id div 20) over ten centroids: the first three cells."""
    v = vectors(spark, sf_dir)
    h = C.bow_histogram(C.assign(v, "vec_id", "e", _first(v)), v.withColumn("frame", F.floor(F.col("vec_id") / 20)), "vec_id", "frame", 10)
    return h.select("frame", *(F.round(F.col("histogram")[i], 9).alias(f"w{i}") for i in range(3)))


def avg_descriptor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector per label: the first two entries."""
    m = C.average_descriptor(vectors(spark, sf_dir), ["label"], "e")
    return m.select("label", F.round(F.col("vector")[0], 9).alias("x1"), F.round(F.col("vector")[1], 9).alias("x2"))


QUERIES |= {"bow_histogram": bow_histogram, "avg_descriptor": avg_descriptor}
SQL["bow_histogram"] = _NEAREST + ", c AS (SELECT vec_id // 20 AS frame, centroid_id, count(*) AS n FROM n GROUP BY 1, 2), t AS (SELECT frame, sqrt(sum(n * n)) AS s FROM c GROUP BY 1) SELECT t.frame, " + ", ".join(f"round(coalesce(max(CASE WHEN centroid_id = {i} THEN n END), 0) / any_value(s), 9) AS w{i}" for i in range(3)) + " FROM t JOIN c USING (frame) GROUP BY t.frame"
SQL["avg_descriptor"] = "SELECT label, round(avg(CAST(embedding[1] AS DOUBLE)), 9) AS x1, round(avg(CAST(embedding[2] AS DOUBLE)), 9) AS x2 FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL GROUP BY label"
