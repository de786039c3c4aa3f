"""Neighbours and clusters of vectors against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from sembla.llm import clusters as C
from sembla.llm import neighbours as N
from sembla.llm.neighbours import hilbert_keys, similar_vectors


def blobs(seed=0, groups=6, size=60, dims=16, spread=4.0):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(0, 400, (groups, dims))
    x = np.concatenate([c + rng.normal(0, spread, (size, dims)) for c in centres] + [rng.uniform(0, 400, (25, dims))])
    return np.round(x, 3)


def frame(spark, x, extra=()):
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "id long, v array<double>").withColumn("vec", F.lit(1)).withColumn("qid", F.lit(2))


def test_hilbert_is_a_path():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    key = hilbert_keys(cells, 3)
    assert sorted(key.tolist()) == list(range(512))
    walk = cells[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("hot", [100_000, 2])
def test_neighbours_recall_copies_and_bad_rows(spark, monkeypatch, hot):
    monkeypatch.setattr(N, "HOT_ROWS", hot)
    x = blobs()
    n = len(x)
    bad = [(9000, None), (9001, []), (9002, [None] + [1.0] * 15), (9003, [float("nan")] * 16), (None, [1.0] * 16)]
    copies = [(5000 + i, x[7].tolist()) for i in range(6)] + [(0, x[0].tolist())]
    df = frame(spark, x, bad + copies)
    got = {}
    for r in similar_vectors(df, "id", "v", 4).collect():
        got.setdefault(r.id, []).append((r.distance, r.neighbour))
    all_x = np.concatenate([x, np.repeat(x[7:8], 6, 0)])
    ids = np.array([*range(n), *range(5000, 5006)])
    d = np.sqrt(((all_x[:, None] - all_x[None]) ** 2).sum(2))
    hits = 0
    for i, key in enumerate(ids.tolist()):
        want = sorted((round(float(d[i, j]), 4), int(ids[j])) for j in range(len(ids)) if j != i)[:4]
        hits += len({w[1] for w in want} & {p for _, p in got[key]})
        assert len(got[key]) == 4 and key not in {p for _, p in got[key]}
    assert hits >= 0.95 * 4 * len(ids)
    assert {p for _, p in got[7]} == {5000, 5001, 5002, 5003} and {p for _, p in got[5002]} == {7, 5000, 5001, 5003}


def test_neighbours_roles_and_empty(spark):
    df = frame(spark, blobs(1, 2, 20)).withColumn("q", F.col("id") < 5).withColumn("b", F.col("id") >= 5)
    got = similar_vectors(df, "id", "v", 3, "q", "b").collect()
    assert {r.id for r in got} == set(range(5)) and all(r.neighbour >= 5 for r in got)
    assert similar_vectors(df.limit(0), "id", "v", 3).count() == 0


def test_forest_like_taking_edges_in_order():
    rng = np.random.default_rng(5)
    for n in (1, 2, 30, 200):
        a, b = rng.integers(0, n, 4 * n), rng.integers(0, n, 4 * n)
        a, b = a[a != b], b[a != b]
        w, low, high = rng.integers(0, 9, len(a)).astype(float), np.minimum(a, b), np.maximum(a, b)
        up, kept = list(range(n)), 0

        def root(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        total = 0.0
        for i in np.lexsort((high, low, w)).tolist():
            p, q = root(int(a[i])), root(int(b[i]))
            if p != q:
                up[p], kept, total = q, kept + 1, total + w[i]
        got = C._forest(a, b, w, low, high)
        assert len(got) == kept and w[got].sum() == total


@pytest.mark.parametrize("local_edges", [0, 50, 1_000_000])
def test_spanning_forest(spark, local_edges):
    rng = np.random.default_rng(3)
    edges = {(int(a), int(b)): float(rng.integers(1, 30)) for a, b in rng.integers(0, 200, (700, 2)) if a != b}
    rows = [(a, b, w) for (a, b), w in edges.items()]
    got = C.spanning_forest(spark.createDataFrame(rows, "a long, b long, w double").repartition(4), local_edges).collect()
    low = np.array([min(r[0], r[1]) for r in rows])
    high = np.array([max(r[0], r[1]) for r in rows])
    keep = C._forest(low, high, np.array([r[2] for r in rows]), low, high)
    assert len(got) == len(keep) and sum(r.w for r in got) == sum(rows[i][2] for i in keep)


@pytest.mark.parametrize("local_edges", [60, 1_000_000])
def test_clusters(spark, local_edges):
    x = blobs(5, 5, 50)
    df = frame(spark, x, [(7000 + i, x[3].tolist()) for i in range(5)] + [(8000, None)])
    members, summary = C.density_clusters(df, "id", "v", resolution=60.0, least=20, local_edges=local_edges)
    got = {r.id: r.cluster for r in members.collect()}
    want = {i: i // 50 * 50 for i in range(250)} | {7000 + i: 0 for i in range(5)}
    assert got == want
    rows = {r.cluster: r for r in summary.collect()}
    assert {c: r.num_elements for c, r in rows.items()} == {0: 55, 50: 50, 100: 50, 150: 50, 200: 50}
    assert all(len(r.exemplars) == 3 and {got[e] for e in r.exemplars} == {c} for c, r in rows.items())


@pytest.mark.parametrize("hot", [100_000, 2])
def test_groups_of_few_vectors_with_many_copies(spark, monkeypatch, hot):
    monkeypatch.setattr(N, "HOT_ROWS", hot)
    rng = np.random.default_rng(9)
    far = np.round(rng.uniform(0, 400, (40, 16)), 3)
    few = far[0] + np.round(rng.normal(0, 3, (3, 16)), 3)
    two = far[1] + np.round(rng.normal(0, 3, (2, 16)), 3)
    x = np.concatenate([np.repeat(few, 10, 0), np.repeat(two, [90, 10], 0), far[2:]])
    members, summary = C.density_clusters(frame(spark, x), "id", "v", resolution=60.0, least=20)
    assert {r.id: r.cluster for r in members.collect()} == {i: 0 if i < 30 else 30 for i in range(130)}
    assert {(r.cluster, r.num_elements) for r in summary.collect()} == {(0, 30), (30, 100)}


def test_clusters_empty(spark):
    df = frame(spark, blobs(6, 1, 5))
    for part in (df, df.limit(0)):
        members, summary = C.density_clusters(part, "id", "v", resolution=10.0)
        assert members.count() == 0 and summary.count() == 0
    with pytest.raises(ValueError):
        C.density_clusters(df, "id", "v", resolution=0.0)


def test_hierarchy_prefers_stable_children():
    ids = np.arange(4)
    size, zero = np.array([30, 30, 30, 5]), np.zeros(4)
    inner = size / 10.0
    a, b, w = np.array([0, 1, 2]), np.array([1, 2, 3]), np.array([20.0, 200.0, 300.0])
    got = C.condensed_clusters(ids, size, inner, zero.astype(int), zero, a, b, w, 20)
    # each of 0 and 1 is stable for 30/10 - 30/20, their parent for 60/20 - 60/200
    assert {(x, c, round(s, 6)) for x, c, s in got} == {(0, 0, 1.5), (1, 1, 1.5), (2, 2, 2.85)}
    close = C.condensed_clusters(ids, size, size / 19.0, zero.astype(int), zero, a, b, w, 20)
    assert {(x, c) for x, c, _ in close} == {(0, 0), (1, 0), (2, 2)}
