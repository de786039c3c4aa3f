"""The search planner, domains, saved states and the small additions."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from sembla.domains import parse_domain
from sembla.functions import distances as D
from sembla.functions import strings as X
from sembla.functions import vectors as V
from sembla.operators import cluster as C
from sembla.operators import planner as L
from sembla.operators import search as S
from sembla.operators import segments as G
from sembla.operators import stats as T
from sembla.operators import text as W
from sembla.plans import registry
from sembla.sources import datasource as Q
from sembla.sources import files as Z


@pytest.fixture(scope="module")
def table(spark):
    x = np.random.default_rng(1).normal(size=(150, 6)).round(3)
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>"), x


def pairs(df):
    return {(r.query_id, r["rank"], r.ref_id) for r in df.collect()}


@pytest.mark.parametrize("index", ["LINEARSCAN", "SNAKETABLE,x=1", "LAESA,num_pivots=4", "AUTO", "LAESA,num_pivots=3,method=APPROX,approximation=1.0"])
def test_exact_indexes_agree(table, index):
    df, _ = table
    q = df.where("id < 6")
    assert pairs(L.search(q, df, "id", "v", "L2", index, 4)) == pairs(S.knn_join(q, df, "id", "v", "L2", 4))


@pytest.mark.parametrize("index", ["AUTO,exact_pairs=0", "FLANN-AUTO,exact_pairs=0,branching=12,probe=1"])
def test_automatic_choice_is_exact_at_every_size(table, index):
    df, _ = table
    q = df.where("id < 30")
    assert pairs(L.search(q, df, "id", "v", "L2", index, 4)) == pairs(S.knn_join(q, df, "id", "v", "L2", 4))


def test_approximate_indexes_and_limits(table, spark):
    df, _ = table
    q = df.where("id < 12")
    exact = {(a, c) for a, _, c in pairs(S.knn_join(q, df, "id", "v", "L2", 3))}
    for index in ("FLANN-KDTREE,branching=6,probe=4", "LSH,table_number=20,key_size=4"):
        got = {(a, c) for a, _, c in pairs(L.search(q, df, "id", "v", "L2", index, 3))}
        assert len(got & exact) >= 0.85 * len(exact)
    near = L.search(q, df, "id", "v", "L2", "LINEARSCAN", 9, 1.0).collect()
    assert near and all(r.distance <= 1.0 for r in near)
    far = L.search(q, df, "id", "v", "L2", "LINEARSCAN", 1, method="FARTHEST").collect()
    assert len(far) == 12
    for bad in (lambda: L.search(q, df, "id", "v", "L2", "NONE"), lambda: L.search(q, df, "id", "v", "L1", "LSH"), lambda: L.search(q, df, "id", "v", "L2", "LAESA", method="FARTHEST")):
        with pytest.raises(ValueError):
            bad()
    bits = df.select("id", F.transform("v", lambda x: F.when(x > 0, 1.0).otherwise(0.0)).alias("v"))
    got = L.search(bits.where("id < 5"), bits, "id", "v", "HAMMING", "LSH,table_number=12,key_size=3", 1).collect()
    assert {r.query_id for r in got} == set(range(5)) and all(r.distance == 0 for r in got)
    assert L.bit_lsh_join(bits, bits.limit(0), "id", "v").count() == 0


@pytest.mark.parametrize("name, exact", [("bit_lsh", "knn_hamming"), ("ivf_knn", "knn_l2"), ("lsh_knn", "knn_l2")])
def test_recall_on_real_embeddings(spark, name, exact):
    got, want = ({(r.query_id, r.ref_id) for r in registry.queries()[n](spark, "/root/testdata/sf0.1").collect() if r.query_id != r.ref_id} for n in (name, exact))
    assert len(got & want) >= 0.9 * len(want)


def test_registered_distance_and_index(table):
    df, x = table
    D.register_distance("FIRST", lambda p: lambda q, r: np.abs(q[:, :1] - r[:, 0][None]) * float(p.get("factor", 1)))
    L.register_index("MINE", lambda q, r, key, vector, distance, k, limit, far, p: S.knn_join(q, r, key, vector, distance, k))
    got = L.search(df.where("id = 3"), df, "id", "v", "FIRST,factor=2", "MINE", 3).collect()
    want = np.sort(np.abs(x[3, 0] - x[:, 0]))[:3] * 2
    assert np.allclose(sorted(r.distance for r in got), want)


def test_multi_search(table):
    df, x = table
    two = df.withColumns({"a": F.slice("v", 1, 3), "b": F.slice("v", 4, 3)})
    got = pairs(L.multi_search(two.where("id < 4"), two, "id", {"a": "L1", "b": "LMAX"}, {"a": 0.5, "b": 2.0}, k=3))
    d = 0.5 * np.abs(x[:4, None, :3] - x[None, :, :3]).sum(2) + 2 * np.abs(x[:4, None, 3:] - x[None, :, 3:]).max(2)
    assert got == {(i, n + 1, int(j)) for i in range(4) for n, j in enumerate(np.argsort(d[i], kind="stable")[:3])}
    one = pairs(L.multi_search(two.where("id < 4"), two, "id", {"a": "L1", "b": "LMAX"}, {"b": 0}, alpha=0.5, k=3))
    assert one == pairs(S.knn_join(two.where("id < 4"), two, "id", "a", "L1", 3))
    assert L.distance_norm(two, "id", "a", "L1", 0.5) > 0


def test_states(table, spark, tmp_path):
    df, _ = table
    k = C.kmeans(df, "id", "v", 3, max_steps=3)
    L.save_kmeans(k, spark, str(tmp_path / "k"))
    again = L.load_kmeans(spark, str(tmp_path / "k"))
    assert np.array_equal(k.centroids, again.centroids) and k.counts.tolist() == again.counts.tolist() and k.steps == again.steps
    p = C.pca_fit(df, "v")
    L.save_pca(p, str(tmp_path / "p.json"))
    assert np.array_equal(L.load_pca(str(tmp_path / "p.json")).transformation, p.transformation)
    Z.write_vectors_raw(df, "id", "v", "DOUBLE", str(tmp_path / "raw"))
    raw = b"".join(f.read_bytes() for f in sorted((tmp_path / "raw").glob("*.raw")))
    assert np.frombuffer(raw, "<f8").reshape(150, 6).tolist() == [r.v for r in df.orderBy("id").collect()]


def test_domains():
    for text in ("STRING", "VECTOR:20:FLOAT", "MULTIOBJECT:2:(VECTOR:2:UINT8):(STRING)", "CUSTOM:pixels"):
        assert str(parse_domain(text)) == text
        parse_domain(text).spark_type()
    assert parse_domain("VECTOR:2:FLOAT").matches(parse_domain("VECTOR:2:DOUBLE"), element=False) and not parse_domain("VECTOR:2:FLOAT").matches(parse_domain("VECTOR:2:DOUBLE"))
    for bad in ("VECTOR:2", "VECTOR:0:FLOAT", "VECTOR:2:X", "MULTIOBJECT:2:(STRING)", "", "STRING:1"):
        with pytest.raises(ValueError):
            parse_domain(bad)


def test_names_and_truth(spark):
    names = spark.createDataFrame([("a.mp4@3",), ("b@x@4|17",), ("none",), (None,)], "n string")
    file, number = S.name_parts(F.col("n"))
    assert [tuple(r) for r in names.select(file, number).collect()] == [("a.mp4", 3), ("b@x", 4), (None, None), (None, None)]
    segs = spark.createDataFrame([("a.mp4", 3, 77)], "file_id string, num_segment long, uid long")
    assert [r.uid for r in S.find_segments(names, "n", segs).collect()] == [77]
    d = spark.createDataFrame([(1, "q", "r", 0.0, 5.0, 10.0, 15.0), (2, "q", "r", 0.0, 5.0, 90.0, 95.0)], "detection_id long, video_q string, video_r string, sec_start_q double, sec_end_q double, sec_start_r double, sec_end_r double")
    t = spark.createDataFrame([(8, "q", "r", 4.0, 9.0, 14.0, 19.0), (7, "q", "r", 5.0, 6.0, 15.0, 16.0)], "truth_id long, video_q string, video_r string, start_q double, end_q double, start_r double, end_r double")
    assert [tuple(r) for r in S.join_truth(d, t).collect()] == [(1, 7)]
    keys = spark.createDataFrame([("f10",), ("f9",), ("F2b",)], "n string").orderBy(X.natural_key(F.col("n"))).collect()
    assert [r.n for r in keys] == ["F2b", "f9", "f10"]


def test_texts_of_segments_and_sparse_l1(spark):
    lines = spark.createDataFrame([("f", 0.0, 2.0, ["a", "b", "a"]), ("f", 5.0, 6.0, ["c"]), ("g", 0.0, 9.0, ["z"])], "file string, start_second double, end_second double, words array<string>")
    segs = spark.createDataFrame([("f", 0, 0.0, 3.0), ("f", 1, 4.0, 8.0)], "file string, num_segment long, start_second double, end_second double")
    assert {tuple(r) for r in W.segment_terms(lines, segs, "file").collect()} == {("f", 0, "a", 2), ("f", 0, "b", 1), ("f", 1, "c", 1)}
    w = spark.createDataFrame([(0, "a", 0.6), (0, "b", 0.8), (1, "a", 1.0), (2, "b", 0.5), (2, "c", 0.5), (3, "d", 1.0)], "id long, word string, weight double")
    got = {(r["rank"], r.ref_id, round(r.distance, 6)) for r in W.sparse_knn(w, "id", spark.createDataFrame([(0,)], "id long"), 5, metric="L1").collect()}
    assert got == {(1, 1, 1.2), (2, 2, 1.4)}
    with pytest.raises(ValueError):
        W.sparse_knn(w, "id", w, 1, metric="x")


def test_sparse_l1_among_all_documents(spark):
    rng = np.random.default_rng(11)
    x = np.where(rng.random((60, 40)) < 0.08, rng.random((60, 40)).round(3), 0.0)
    rows = [(int(i), f"w{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    w = spark.createDataFrame(rows, "id long, word string, weight double").repartition(3)
    full = np.flatnonzero(x.any(1)).tolist()
    asked = full[::9]
    d = np.abs(x[:, None] - x[None]).sum(2).round(9)
    want = {(q, n + 1, j) for q in asked for n, (_, j) in enumerate(sorted((d[q, j], j) for j in full if j != q)[:5])}
    queries = spark.createDataFrame([(q,) for q in asked], "id long")
    for block in (2000, 2):
        assert pairs(W.sparse_knn(w, "id", queries, 5, block, "L1", unrelated=True)) == want
    assert any(not (x[q] * x[j]).any() for q, _, j in want)
    with pytest.raises(ValueError):
        W.sparse_knn(w, "id", queries, 5, unrelated=True)


def test_pixel_statistics(spark):
    still = [[0.0] * 8 for _ in range(8)]
    moving = [[0.0, 9.0, 9.0] + [0.0] * 5 if 2 <= y < 6 else [0.0] * 8 for y in range(8)]
    df = spark.createDataFrame([("f", still), ("f", moving), ("f", None)], "file string, frame array<array<double>>")
    stats = T.pixel_stats(df, "file", "frame")
    assert stats.count() == 64 and stats.where("mean = 4.5 and variance = 20.25").count() == 8
    assert [tuple(r) for r in T.static_crop(stats, "file").collect()] == [("f", 2, 5, 1, 2)]
    s = T.shape_stats(spark.createDataFrame([(1.0,), (2.0,), (9.0,), (None,), (float("nan"),)], "v double"), "v").first()
    assert s.n == 3 and s.mean == 4 and s.skewness > 0


def test_pivots_report_pairs_and_sources(table, spark, tmp_path):
    df, x = table
    pivots = S.select_pivots(df, "id", "v", 3)
    L.save_pivots(pivots, spark, str(tmp_path / "p"))
    assert L.load_pivots(spark, str(tmp_path / "p")) == [(i, list(v)) for i, v in pivots]
    found = S.knn_join(df.where("id < 2"), df, "id", "v", "L2", 2)
    named = df.select("id", F.concat(F.lit("n"), F.col("id")).alias("description"))
    lines = {(r.query_id, r["rank"]): r.line for r in L.report(found, named).collect()}
    assert lines[0, 1] == "1 0 0.000000 n0" and L.report(found, named, most=1).where("line like '%n%'").count() == 0
    p = T.sample_pairs(df, df, "id").collect()
    assert 90 <= len(p) <= 100 and all(r.a != r.b for r in p) and len({r.a for r in p}) == len(p) and p == T.sample_pairs(df, df, "id").collect()
    seen = []
    C.kmeans(df, "id", "v", 2, max_steps=3, callback=lambda s: seen.append(s.steps))
    assert seen == list(range(1, len(seen) + 1)) and seen
    Q.register_sources(spark)
    r = spark.read.format("random_vectors").option("count", 30).option("dims", 3).option("min", 2).option("max", 4).load()
    rows = r.orderBy("id").collect()
    assert [x.id for x in rows] == list(range(30)) and all(2 <= v < 4 and len(x.vector) == 3 for x in rows for v in x.vector)
    made = Q.custom_dataset(spark, 10, lambda i: (i, [float(i), 1.0]), "id long, v array<double>").orderBy("id").collect()
    assert [(x.id, x.v) for x in made] == [(i, [float(i), 1.0]) for i in range(10)]


def test_keypoints_codes_and_perspective(spark, tmp_path):
    df = spark.createDataFrame([([(1.0, 2.0, 3.0, 0.5)],)], "p array<struct<x: double, y: double, radius: double, angle: double>>")
    assert tuple(df.select(V.rescale_keypoints(F.col("p"), 4.0, 1.0)).first()[0][0]) == (4.0, 2.0, 6.0, 0.5)
    assert spark.range(1).select(V.scale_convert(F.array(F.lit(1.26), F.lit(-0.5)), 10.0, "int")).first()[0] == [13, -5]
    f = spark.createDataFrame([("a", 10.0)], "file string, n double")
    shots = spark.createDataFrame([("a", 0.0, 4.0), ("z", 0.0, 4.0)], "file string, start_second double, end_second double")
    n = lambda c: G.segment_by_code(f, "file", "n", c, shots).count()
    assert (n("SEGCTE_5"), n("SEGCTE_5/2_1"), n("VIDEOSAMPLE_3"), n("FILESHOTS_2_0.5")) == (2, 9, 3, 2)
    with pytest.raises(ValueError):
        n("NONE_1")
    rng = np.random.default_rng(3)
    a = rng.uniform(0, 100, (24, 2))
    h = np.array([[1.1, 0.1, 3], [-0.05, 0.9, 7], [0.001, 0.0005, 1]])
    q = np.concatenate([a, np.ones((24, 1))], 1) @ h.T
    b = q[:, :2] / q[:, 2:]
    b[:4] += 60
    rows = [(1, *map(float, (*u, *v))) for u, v in zip(a, b)]
    got = S.spatial_inliers(spark.createDataFrame(rows, "k long, x1 double, y1 double, x2 double, y2 double"), ["k"], "perspective", 200, 0.5).first()
    assert (got.matches, got.inliers) == (24, 20)
    zoom = [(2, float(u[0]), float(u[1]), float(2 * u[0] + 1), float(2 * u[1] + 3)) for u in a]
    assert S.spatial_inliers(spark.createDataFrame(zoom, "k long, x1 double, y1 double, x2 double, y2 double"), ["k"], "scale", 20, 0.1).first().inliers == 24
    segs = spark.createDataFrame([("a", 0, 0, 1, 2, 0.0, 0.5, 1.0, 25.0), ("a", 1, 3, 4, 5, 1.0, 1.5, 2.0, 25.0)], "file string, num_segment long, start_frame long, selected_frame long, end_frame long, start_second double, selected_second double, end_second double, fps double")
    Z.write_segmentation(segs, "file", str(tmp_path / "s"))
    assert [tuple(r)[1:] for r in Z.read_segmentation(spark, str(tmp_path / "s") + "/*").orderBy("num_segment").collect()] == [tuple(r)[1:] for r in segs.collect()]
