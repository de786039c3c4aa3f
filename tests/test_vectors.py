"""Distances, searches, fusion, evaluation, clusters."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sembla.functions import distances as D
from sembla.functions import vectors as V
from sembla.operators import cluster as C
from sembla.operators import fusion as U
from sembla.operators import search as S

POINTS = [(0.0, 0.0), (3.0, 4.0), (6.0, 8.0), (3.0, 4.0)]
NAMES = ["L1", "L2", "LMAX", "L2SQUARED", "LP,order=3", "LP,order=0.5", "HAMMING", "CHI2", "HELLINGER", "COSINE_SIMILARITY", "COSINE_DISTANCE", "COSINE_SIMILARITY,normalize_vectors=false", "DPF,order=2,dims_discard=1", "DPF,order=2,dims_discard=1,mode=as_coded", "DPF,order=1,pct_discard=0.5"]


def test_hand_values():
    x = np.array(POINTS)
    pair = lambda n, i, j: D.distance_kernel(n)(x[i : i + 1], x[j : j + 1])[0, 0]
    assert pair("L1", 0, 1) == 7 and pair("L2", 0, 1) == 5 and pair("LMAX", 0, 1) == 4 and pair("L2", 1, 3) == 0
    assert pair("CHI2", 0, 1) == 3.5 and pair("COSINE_DISTANCE", 0, 1) == math.sqrt(2)
    assert pair("COSINE_DISTANCE", 1, 2) == pytest.approx(0, abs=1e-7) and pair("HAMMING", 1, 2) == 2
    assert pair("DPF,order=1,dims_discard=1", 0, 1) == 3 and pair("DPF,order=1,dims_discard=1,mode=as_coded", 0, 1) == 4
    assert pair("BITS", 1, 2) == bin(3 ^ 6).count("1") + bin(4 ^ 8).count("1")


@pytest.mark.parametrize("name", NAMES)
def test_column_equals_kernel(spark, name):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.uniform(0, 5, (12, 6)).round(1), np.zeros((1, 6)), np.ones((2, 6))])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i long, v array<double>")
    pairs = df.crossJoin(df.select(F.col("i").alias("j"), F.col("v").alias("u")))
    got = np.zeros((15, 15))
    for r in pairs.select("i", "j", D.distance_column(name, F.col("v"), F.col("u"), 6).alias("d")).collect():
        got[r.i, r.j] = r.d
    assert np.allclose(got, D.distance_kernel(name)(x, x), atol=1e-9)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.floats(-50, 50), min_size=3, max_size=3), min_size=3, max_size=3))
def test_metric_properties(rows):
    x = np.array(rows)
    for name in ("L1", "L2", "LMAX"):
        d = D.distance_kernel(name)(x, x)
        assert np.allclose(d, d.T) and (np.diag(d) == 0).all() and d[0, 2] <= d[0, 1] + d[1, 2] + 1e-9


def test_earth_movers():
    cost = np.abs(np.arange(4)[:, None] - np.arange(4)[None]).astype(float)
    assert D.transport_cost(np.array([1.0, 0, 0, 0]), np.array([0, 0, 0, 1.0]), cost) == 3
    assert D.transport_cost(np.array([2.0, 0, 0, 0]), np.array([0, 1.0, 0, 0]), cost) == 1
    assert D.transport_cost(np.zeros(4), np.ones(4), cost) == math.inf
    rng = np.random.default_rng(2)
    for _ in range(20):
        a, b = rng.random(5), rng.random(5)
        a, b = a / a.sum(), b / b.sum()
        line = np.abs(np.arange(5)[:, None] - np.arange(5)[None]).astype(float)
        assert D.transport_cost(a, b, line) == pytest.approx(np.abs(np.cumsum(a - b))[:-1].sum(), abs=1e-9)
        assert D.distance_kernel("EMD,normalize_vectors=true")(a[None], b[None])[0, 0] == pytest.approx(D.transport_cost(a, b, line), abs=1e-9)
    # whole masses: every assignment tried
    random_cost = rng.integers(1, 20, (4, 4)).astype(float)
    best = min(sum(random_cost[i, p[i]] for i in range(4)) for p in itertools.permutations(range(4)))
    assert D.transport_cost(np.ones(4), np.ones(4), random_cost) == pytest.approx(best / 4)
    matrix = "EMD,matrix_dims=4x4,matrix=" + ";".join(str(v) for v in random_cost.ravel())
    assert D.distance_kernel(matrix)(np.ones((1, 4)), np.ones((1, 4)))[0, 0] == pytest.approx(best / 4)


def test_parameters():
    assert D.parse_parameters("MULTI,distances=(L1;L2,x=1),weights=1;2") == ("MULTI", {"distances": "L1;L2,x=1", "weights": "1;2"})
    for bad in ("L2,(a", "L2,x"):
        with pytest.raises(ValueError):
            D.parse_parameters(bad)
    with pytest.raises(ValueError):
        D.distance_kernel("NONE")
    with pytest.raises(ValueError):
        D.distance_kernel("LP,order=0")


def frame(spark, x, extra=()):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + list(extra), "id long, v array<double>").withColumn("g", F.col("id") % 3)


def brute(x, q, k, d="L2", far=False, ok=lambda i, j: True):
    m = D.distance_kernel(d)(x[q], x)
    out = set()
    for a, i in enumerate(q):
        best = sorted((((-v if far else v), j) for j, v in enumerate(m[a]) if ok(i, j)))[:k]
        out |= {(i, n + 1, j) for n, (_, j) in enumerate(best)}
    return out


@pytest.mark.parametrize("block", [S.QUERY_BLOCK, 3])
def test_exact_search(spark, monkeypatch, block):
    monkeypatch.setattr(S, "QUERY_BLOCK", block)
    rng = np.random.default_rng(4)
    x = rng.integers(0, 4, (80, 3)).astype(float)
    df = frame(spark, x, [(900, None), (901, []), (902, [1.0, None, 2.0]), (None, [1.0, 1.0, 1.0]), (5, x[5].tolist())]).repartition(4)
    q = list(range(0, 80, 9))
    asked = df.where("id % 9 = 0 and id < 80")
    got = lambda **kw: {(r.query_id, r["rank"], r.ref_id) for r in S.knn_join(asked, df, "id", "v", k=4, **kw).collect()}
    assert got() == brute(x, q, 4)
    assert got(farthest=True) == brute(x, q, 4, far=True)
    assert got(exclude="g") == brute(x, q, 4, ok=lambda i, j: i % 3 != j % 3)
    assert got(skip_self=True, distance="L1") == brute(x, q, 4, "L1", ok=lambda i, j: i != j)
    assert got(range_=1.0) == {t for t in brute(x, q, 4) if np.linalg.norm(x[t[0]] - x[t[2]]) <= 1}
    assert S.knn_join(asked.limit(0), df, "id", "v").count() == 0 and S.knn_join(asked, df.limit(0), "id", "v").count() == 0
    near = {(r.query_id, r.ref_id) for r in S.range_join(asked, df, "id", "v", 1.5).collect()}
    assert near == {(i, j) for i in q for j in range(80) if np.linalg.norm(x[i] - x[j]) <= 1.5}


def test_repeated_references_take_one_place(spark):
    x = np.random.default_rng(12).normal(size=(60, 4))
    near = int(np.argsort(np.linalg.norm(x - x[0], axis=1))[1])
    df = frame(spark, x, [(i, x[i].tolist()) for i in (0, near) for _ in range(20)]).coalesce(1)
    asked = df.where("id = 0").limit(1)
    got = lambda found: {(r.query_id, r["rank"], r.ref_id) for r in found.collect()}
    assert got(S.knn_join(asked, df, "id", "v", k=5)) == brute(x, [0], 5)
    far = int(np.argmax(np.linalg.norm(x - x[0], axis=1)))
    more = df.unionByName(frame(spark, x).where(F.col("id") == far).crossJoin(spark.range(20).select())).coalesce(1)
    assert got(S.knn_join(asked, more, "id", "v", k=5, farthest=True)) == brute(x, [0], 5, far=True)
    pivots = x[[3, 5, 7]].tolist()
    assert got(S.laesa_join(asked, df, "id", "v", pivots, k=5)) == brute(x, [0], 5)
    once = frame(spark, x)
    assert got(S.laesa_join(asked, df, "id", "v", pivots, k=5, method="LB_ONLY")) == got(S.laesa_join(asked, once, "id", "v", pivots, k=5, method="LB_ONLY"))


@pytest.mark.parametrize("d", ["L1", "L2", "LMAX"])
def test_pivot_search_is_exact_for_metrics(spark, d):
    x = np.random.default_rng(5).normal(size=(120, 5))
    df = frame(spark, x).repartition(3)
    pivots = [p for _, p in S.select_pivots(df, "id", "v", 4, d)]
    assert len(pivots) == 4
    got = {(r.query_id, r["rank"], r.ref_id) for r in S.laesa_join(df.where("id < 9"), df, "id", "v", pivots, d, 5).collect()}
    assert got == brute(x, list(range(9)), 5, d)


def test_approximate_searches(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 1, (60, 8)) for c in (-6, 0, 6)])
    df = frame(spark, x)
    want = {(a, c) for a, _, c in brute(x, list(range(0, 180, 6)), 5)}
    for found in (S.lsh_join(df.where("id % 6 = 0"), df, "id", "v", 5), S.ivf_join(df.where("id % 6 = 0"), df, "id", "v", [[-6.0] * 8, [0.0] * 8, [6.0] * 8], 5, 2), S.laesa_join(df.where("id % 6 = 0"), df, "id", "v", x[:6].tolist(), "L2", 5, "APPROX", 0.5)):
        got = {(r.query_id, r.ref_id) for r in found.collect()}
        assert len(got & want) >= 0.9 * len(want)


def test_ratio_matches(spark):
    r = spark.createDataFrame([(1, 1, 10, 1.0), (1, 2, 11, 1.1), (2, 1, 20, 1.0), (2, 2, 21, 3.0), (3, 1, 30, 9.0)], "query_id long, rank int, ref_id long, distance double")
    assert {(x.query_id, x.ref_id) for x in S.two_nn_matches(r, 0.5).collect()} == {(2, 20), (3, 30)}
    assert S.two_nn_matches(r, 1.5).count() == 3


def test_spatial_inliers(spark):
    rng = np.random.default_rng(7)
    a = rng.uniform(0, 100, (20, 2))
    turn = np.array([[0.8, -0.6], [0.6, 0.8]]) * 1.1
    b = a @ turn.T + [5, 7]
    b[:6] += rng.uniform(50, 90, (6, 2))
    rows = [(1, *map(float, (*p, *q))) for p, q in zip(a, b)] + [(2, 0.0, 0.0, 1.0, 1.0), (3, None, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k long, x1 double, y1 double, x2 double, y2 double")
    for model in ("similarity", "affine"):
        got = {r.k: (r.matches, r.inliers) for r in S.spatial_inliers(df, ["k"], model, 200, 0.5).collect()}
        assert got == {1: (20, 14), 2: (1, 0)}


LIST = "query_id long, ref_id long, distance double"


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 0.1), (1, 11, 0.4), (1, 10, 0.3), (2, 20, 0.5)], LIST)
    b = spark.createDataFrame([(1, 11, 0.2), (1, 12, 0.3), (9, 90, 0.1)], LIST)
    rows = lambda df: {(r.query_id, r["rank"], r.ref_id, round(r.distance, 6)) for r in df.collect()}
    assert rows(U.merge_concatenate([a, b])) == {(1, 1, 10, 0.1), (1, 2, 11, 0.2), (1, 3, 12, 0.3), (2, 1, 20, 0.5)}
    assert rows(U.merge_distance_sum([a, b])) == {(1, 1, 11, 0.6), (1, 2, 10, 1.1), (1, 3, 12, 1.3), (2, 1, 20, 1.5)}
    assert rows(U.merge_rank_aggregation([a, b])) == {(1, 1, 11, 1.0), (1, 2, 10, 2.0), (1, 3, 12, 3.0), (2, 1, 20, 1.0)}
    assert rows(U.merge_concatenate([a, a], 1)) == {(1, 1, 10, 0.1), (2, 1, 20, 0.5)}
    local = spark.createDataFrame([(1, 0, 1, 7), (1, 0, 2, 8), (1, 1, 1, 8)], "query_id long, local_id long, rank int, ref_id long")
    assert rows(U.local_to_global(local, 5)) == {(1, 1, 8, round(1 / 1.97, 6)), (1, 2, 7, 1.0)}


def test_evaluation(spark):
    answers = spark.createDataFrame([(1, 1, 10), (1, 2, 99), (1, 3, 10), (1, 4, 11), (2, 1, 98), (7, 1, 1)], "query_id long, rank int, ref_id long")
    truth = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (2, 20), (3, 30), (1, 10)], "query_id long, ref_id long")
    per = {r.query_id: (r.expected, r.corrects, round(r.ap, 6), r.first_correct) for r in U.average_precision(answers, truth).collect()}
    assert per == {1: (3, 2, 0.5, 1), 2: (1, 0, 0.0, None), 3: (1, 0, 0.0, None)}
    s = U.evaluation_summary(answers, truth).first()
    assert (s.queries, round(s.map, 6), round(s.mean_first_rank, 6), s.corrects) == (3, round(0.5 / 3, 6), round(11 / 3, 6), 2)
    assert {r.query_id: r.outcome for r in U.outcome_strings(answers, truth).collect()} == {1: "C.DC", 2: ".", 7: "?"}
    assert {(r["rank"], r.corrects, r.best_precision) for r in U.rank_curve(answers, truth).collect()} == {(1, 1, 1.0), (2, 1, 0.5), (3, 1, 1 / 3), (4, 2, 0.5)}
    cats = spark.createDataFrame([(1, "a"), (8, "a"), (2, "b")], "query_id long, category string")
    assert {(r.category, r.queries, round(r.map, 6)) for r in U.by_category(U.average_precision(answers, truth), cats).collect()} == {("a", 2, 0.25), ("b", 1, 0.0)}


def test_kmeans_and_pca(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 0.4, (50, 2)) for c in ((0, 0), (0, 9), (9, 0), (9, 9))])
    df = frame(spark, x, [(777, None)])
    for init in ("sss", "random", x[[0, 60, 110, 160]]):
        state = C.kmeans(df, "id", "v", 4, init=init, max_steps=30)
        assert state.counts.sum() == 200
    assert sorted(state.counts.tolist()) == [50] * 4 and state.error < 200
    assert C.kmeans_subsets(df, "id", "v", 4).counts.sum() == 200
    keep = C.adjust(np.array([[1.0, 1.0], [5.0, 5.0]]), np.array([[4.0, 8.0], [0.0, 0.0]]), np.array([2, 0]))
    assert keep.tolist() == [[2.0, 4.0], [5.0, 5.0]]
    p = C.pca_fit(df, "v")
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1]
    assert np.allclose(p.eigenvalues, values) and np.allclose(p.averages, x.mean(0))
    y = np.array([r.vector for r in C.pca_apply(df, "id", "v", p, 2).orderBy("id").collect()])
    assert np.allclose(np.cov(y.T, bias=True), np.diag(values), atol=1e-8)
    assert C.pca_report(p)[-1][2] == pytest.approx(1)


def test_vector_functions(spark):
    df = spark.createDataFrame([(1, [1.0, 3.0]), (2, [0.0, 0.0]), (3, [-0.4, 2.0]), (4, None)], "i long, v array<double>")
    v = F.col("v")
    rows = df.select("i", V.norm_sum1(v), V.norm_l2(v), V.norm_max1(v), V.quantize_u8(v), V.quantize_u8(v, True), V.convert(v, "int"), V.root(v), V.rootsift(v)).orderBy("i").collect()
    assert rows[0][1] == [0.25, 0.75] and rows[1][1:4] == ([0.0, 0.0],) * 3 and rows[0][3] == [1 / 3, 1.0]
    assert rows[0][4] == [255, 255] and rows[2][4] == [0, 255] and rows[2][6] == [0, 2] and rows[2][7] == [None, math.sqrt(2)]
    assert all(x is None for x in rows[3][1:])
