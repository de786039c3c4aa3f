"""Segments, detections, texts, pixels, sources, streams and the small operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from sembla.functions import pixels as P
from sembla.functions import strings as X
from sembla.operators import dataset as D
from sembla.operators import detect as E
from sembla.operators import fusion as U
from sembla.operators import segments as G
from sembla.operators import stats as T
from sembla.operators import text as W
from sembla.operators.asof import asof_join
from sembla.operators.ordered import with_positions
from sembla.plans import media_queries as M
from sembla.sources import files as S
from sembla.streaming import streams as R


def test_positions_and_subsets(spark):
    df = spark.range(500).withColumn("k", (F.col("id") * 7919) % 500).repartition(6)
    got = {(r.k, r.pos) for r in with_positions(df, ["k"]).collect()}
    assert got == {(i, i) for i in range(500)}
    assert [r.k for r in D.subset_segment(df, ["k"], 495, 50).orderBy("pos").collect()] == [495, 496, 497, 498, 499]
    assert [(r.ord, r.k) for r in D.subset_positions(df, ["k"], [3, 3, 0, 900]).orderBy("ord").collect()] == [(0, 3), (1, 3), (2, 0)]
    assert D.sample_hashed(df, "id", 0.1).count() == 50 and D.sample_hashed(df, "id", 7).count() == 7 and D.sample_hashed(df, "id", 0).count() == 500
    assert sorted(r.pos for r in D.permute_hashed(df, "id").collect()) == list(range(500))
    assert D.nearest_chain(np.array([[5.0], [1.0], [2.0], [9.0]])) == [1, 2, 0, 3] and D.nearest_chain(np.zeros((0, 2))) == []
    both = D.concatenate([df.where("id < 3"), df.where("id >= 497")], "id").collect()
    assert {(r.id, r.subset, r.subset_pos, r.pos) for r in both} == {(0, 0, 0, 0), (1, 0, 1, 1), (2, 0, 2, 2), (497, 1, 0, 3), (498, 1, 1, 4), (499, 1, 2, 5)}
    with pytest.raises(ValueError):
        D.concatenate([df, df.drop("k")], "id")
    assert 0 < D.sample_levels(df, [(["k"], 0.5), (["id"], 0.5)]).count() < 250
    ids = spark.createDataFrame([(1,), (2,), (None,)], "id long")
    assert {r.id for r in D.include_exclude(df, "id", ids, spark.createDataFrame([(2,)], "id long")).collect()} == {1}


def test_asof(spark):
    rng = random.Random(3)
    points = [(i, rng.choice(["hot", "hot", "a", None]), rng.choice([None, float("nan"), *range(200)])) for i in range(600)]
    edges = [(rng.choice(["hot", "a", None, "b"]), rng.choice([None, float("nan"), *range(200)])) for _ in range(150)]
    p = spark.createDataFrame([(i, k, None if x is None else float(x)) for i, k, x in points], "id long, k string, x double").repartition(5)
    e = spark.createDataFrame([(k, None if x is None else float(x), 1) for k, x in edges], "k string, e double, id int")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        for forward in (False, True):
            got = {r.id: r.edge for r in asof_join(p, e, ["k"], "x", "e", forward).collect()}
            for i, k, x in points:
                if x is None or x != x:
                    assert got[i] is None
                    continue
                near = [y for h, y in edges if h == k and y is not None and y == y and (y >= x if forward else y <= x)]
                assert got[i] == ((min(near) if forward else max(near)) if near else None)
            assert len(got) == 600
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_statistics(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(3, 2, (301, 4))
    df = spark.createDataFrame([(r.tolist(),) for r in x] + [(None,)], "v array<double>").repartition(3)
    s = {r.dim: r for r in T.dimension_stats(df, "v").collect()}
    assert all(np.isclose(s[i].mean, x[:, i].mean()) and np.isclose(s[i].variance, x[:, i].var()) and s[i].n == 301 for i in range(4))
    one = spark.createDataFrame([(float(v),) for v in x[:, 0]] + [(None,), (float("nan"),)], "a double")
    want = np.sort(x[:, 0])
    for r in T.fixed_quantiles(one, "a").collect():
        assert r.value == want[int(np.floor(300 * r.fraction + 0.5))]
    h = T.histogram(one, "a", 10)
    rows = h.orderBy("bin").collect()
    assert sum(r.amount for r in rows) == 301 and rows[-1].accumulated_pct == 1 and len(rows) == 10
    v = T.value_at_quantile(h, 0.5).first().value
    assert abs(v - np.median(x[:, 0])) < (want[-1] - want[0]) / 10
    assert T.histogram(one.limit(0), "a", 3).count() == 0 and T.fixed_quantiles(one.limit(0), "a").count() == 0 and T.dimension_stats(df.limit(0), "v").count() == 0


def test_segments(spark):
    f = spark.createDataFrame([("a", 10.0), ("b", 0.2), ("c", None), ("d", -1.0), ("e", float("nan"))], "file string, n double")
    got = lambda df: [(r.file, r.num_segment, round(r.start_second, 4), round(r.end_second, 4)) for r in df.orderBy("file", "num_segment").collect()]
    assert got(G.segment_constant(f, "file", "n", 4.0)) == [("a", 0, 0, 3.3333), ("a", 1, 3.3333, 6.6667), ("a", 2, 6.6667, 10), ("b", 0, 0, 0.2)]
    assert got(G.segment_constant(f, "file", "n", 4.0, 3.0)) == [("a", 0, 0, 4), ("a", 1, 3, 7), ("a", 2, 6, 10), ("b", 0, 0, 0.2)]
    assert len(got(G.segment_sample(f, "file", "n", 3))) == 6
    shots = spark.createDataFrame([("a", 0.0, 4.0), ("a", 4.0, 4.5), ("b", 1.0, 3.0)], "file string, start_second double, end_second double")
    assert got(G.segment_shots(shots, "file", 2, 0.5, 0.5)) == [("a", 0, 0.5, 2.0), ("a", 1, 2.0, 3.5), ("b", 0, 1.5, 2.0), ("b", 1, 2.0, 2.5)]
    with pytest.raises(ValueError):
        G.segment_constant(f, "file", "n", 0)
    bad = spark.createDataFrame([("a", 0, 0.0, 1.0, 2.0), ("a", 1, 1.5, 1.6, 3.0), ("b", 0, 5.0, 4.0, 3.0)], "file string, num_segment long, start_second double, selected_second double, end_second double")
    assert {(r.file, r.num_segment, r.problem) for r in G.invalid_segments(bad, "file").collect()} == {("a", 1, "overlap"), ("b", 0, "reversed")}
    q = spark.createDataFrame([("q", 0, 5.0), ("q", 1, 50.0)], "q_file string, q_segment long, q_second double")
    t = spark.createDataFrame([("q", 0.0, 10.0, "r", 100.0, 120.0)], "q_file string, start_q double, end_q double, r_file string, start_r double, end_r double")
    r = spark.createDataFrame([("r", 3, 105.0, 111.0), ("r", 4, 111.0, 130.0)], "r_file string, r_segment long, r_start double, r_end double")
    assert [(x.q_segment, x.r_segment, x.r_second) for x in G.interpolate_truth(q, t, r).collect()] == [(0, 3, 110.0)]


def copies(spark):
    """A query of 12 frames of 0.25 s that copies seconds 10 to 13 of file r, and noise."""
    rng = random.Random(5)
    rows = []
    for i in range(12):
        a = i * 0.25
        if i != 5:
            rows.append(("q", "r", a, a + 0.25, 10 + a, 10 + a + 0.25, 1, 0.9))
        for rank in (2, 3):
            s = rng.uniform(100, 900)
            rows.append(("q", rng.choice(["r", "n1", "n2"]), a, a + 0.25, s, s + 0.25, rank, 0.3))
    rows.append(("q", "r", None, 1.0, 2.0, 3.0, 1, 0.5))
    return spark.createDataFrame(rows, "q_file string, r_file string, q_start double, q_end double, r_start double, r_end double, rank int, closeness double")


def test_voting(spark):
    m = copies(spark)
    islands = E.offset_islands(m, 0.25, 6).collect()
    assert [(r.r_file, r.voters) for r in islands] == [("r", 11)] and islands[0].low <= 10 <= islands[0].high
    probes = E.offset_probes(E.offset_islands(m, 0.25, 6)).orderBy("probe").collect()
    assert probes[0].probe_low == islands[0].low - 0.125 and probes[-1].probe_low + 0.25 >= islands[0].high
    found = E.detect_copies(m, rank_weight=0.75).collect()
    assert len(found) == 1
    d = found[0]
    assert (d.video_q, d.video_r, d.num_voters, d.num_misses) == ("q", "r", 11, 1) and abs(d.sec_start_q) < 1e-9 and abs(d.sec_end_q - 3) < 1e-9 and abs(d.sec_start_r - 10) < 1e-9
    assert d.score == pytest.approx((11 * 0.9 - 0.1) * 1.5 * 1.5)
    assert E.detect_copies(m.limit(0)).count() == 0
    assert E.offset_islands(m.withColumn("r_file", F.lit("q")), 0.25, 1, skip_near=600).where("low > -600 and high < 600").count() == 0


def test_vote_scan_resets_and_counts_each_frame_once():
    frame = lambda t, r: (t, t + 1, [(r, r + 1, r - t - 0.5, r - t + 0.5, 1, 1.0)] if r is not None else [], 0)
    one = E.scan_votes([frame(0, 10), frame(1, 11), *[frame(t, None) for t in range(2, 30)], frame(30, 40)], 9.9, 10.1, 0.75, 1.0, -0.1)
    assert [(round(s["score"], 6), s["voters"]) for s in one] == [(2.0, 2), (1.0, 1)]
    far = E.scan_votes([frame(0, 10), (30, 31, [(40, 41, 9.5, 10.5, 1, 1.0)], 29)], 9.9, 10.1, 0.75, 1.0, -0.1)
    assert [s["voters"] for s in far] == [1, 1]
    same = E.scan_votes([frame(0, 10), (1, 2, [(10, 11, 9.0, 11.0, 1, 1.0)], 0)], 9.9, 10.1, 0.75, 1.0, -0.1)
    assert [s["voters"] for s in same] == [1]


def test_equalise():
    a, b, c, d = E.equalise(10, 20, 100, 106)
    assert b - a == d - c == 8 and (a, c) == (11, 99)
    a, b, c, d = E.equalise(0, 4, 0, 8)
    assert a >= 0 and c >= 0 and b - a == d - c
    a, b, c, d = E.equalise(5, 9, 5, 9, 8, 100)
    assert (b, d) == (8, 8) and (a, c) == (5, 5)


def test_merge_fit_print(spark):
    kind = "score double, video_q string, sec_start_q double, sec_end_q double, video_r string, sec_start_r double, sec_end_r double, num_voters long, num_misses long"
    rows = [(5.0, "q", 0.0, 10.0, "r", 0.0, 10.0, 5, 1), (3.0, "q", 2.0, 12.0, "r", 2.0, 12.0, 3, 0), (2.0, "q", 0.0, 10.0, "r", 50.0, 60.0, 2, 0), (float("nan"), "q", 0.0, 1.0, "r", 0.0, 1.0, 1, 1), (4.0, None, 0.0, 1.0, "r", 0.0, 1.0, 1, 1)]
    df = spark.createDataFrame(rows, kind)
    got = {(r.score, r.sec_start_q, r.sec_end_q, r.sec_end_r, r.num_voters, r.num_merged) for r in E.merge_detections(df).collect()}
    assert got == {(8.0, 0.0, 12.0, 12.0, 8, 2), (2.0, 0.0, 10.0, 60.0, 2, 1)}
    assert E.merge_detections(df.limit(0)).count() == 0
    segs = spark.createDataFrame([("q", 1.0, 9.0), ("q", 9.0, 11.0), ("q", None, 3.0)], "file_id string, start_second double, end_second double")
    fit = E.fit_to_segments(df.where("video_q is not null").withColumn("detection_id", F.monotonically_increasing_id()), segs)
    assert {(r.sec_start_q, r.sec_end_q) for r in fit.collect()} == {(1.0, 9.0), (1.0, 11.0), (1.0, 1.0)}
    lines = [r.line for r in E.printable(df.where("video_q = 'q'"), 2).orderBy("rank").collect()]
    assert lines == ["5.0000\tq\t0.000\t10.000\tr\t0.000\t10.000\t5\t1", "3.0000\tq\t2.000\t12.000\tr\t2.000\t12.000\t3\t0"]


def test_detections_without_counts_are_printed(spark, data):
    kind = "score double, video_q string, sec_start_q double, sec_end_q double, video_r string, sec_start_r double, sec_end_r double, num_voters long, num_misses long"
    rows = [(5.0, "null.mp4", 0.0, 10.0, "r", 0.0, 10.0, None, 1), (3.0, "null.mp4", 2.0, 12.0, "r", 2.0, 12.0, 3, None)]
    lines = [r.line for r in E.printable(spark.createDataFrame(rows, kind), 2).orderBy("rank").collect()]
    assert [x.split("\t")[-2:] for x in lines] == [["0", "1"], ["3", "0"]]
    d = M._spans(spark, data).where("score > 0")
    want = d.groupBy("video_q").count().select(F.sum(F.least("count", F.lit(3)))).first()[0]
    assert M.detect_print_txt(spark, data).count() == want


def tied(spark, layout):
    """Lines of detections that differ only in their ends, for two orders of the rows."""
    ends = [(20.0, 30.0), (10.0, 30.0), (10.0, 20.0)]
    media = spark.createDataFrame([("q", "/m/q.mp4", 0.0), ("r", "/m/r.avi", 0.0)], "file_id string, path string, time_start double")
    frames = (spark.createDataFrame([(1.0, "q", 5.0, a, "r", 7.0, b, 1, 0) for a, b in rows], E._DETECTION).coalesce(1) for rows in (ends, ends[::-1]))
    return [[r.line for r in S.detection_lines(d, media, layout).orderBy("rank").collect()] for d in frames]


def test_tied_detections_as_calls_of_a_player(spark):
    want = [f"vlc --start-time 5 --stop-time {a} /m/q.mp4 --start-time 7 --stop-time {b} /m/r.avi" for a, b in ((10, 20), (10, 30), (20, 30))]
    assert tied(spark, "VLC") == [want, want]


def test_tied_detections_as_links(spark):
    want = [f"q Q0 r 0.7 0.{b} {rank} 1.0000" for rank, b in ((1, 20), (2, 30), (3, 30))]
    assert tied(spark, "LNK") == [want, want]


def test_links_give_scores_as_their_sql(spark, tmp_path):
    import duckdb
    from sembla.plans import source_queries as Z

    scores = [float("inf"), 1e22, 1e15 + 0.3, 7.4, 2.00015, 1.00005, 0.00025, 0.00015, 0.0, -0.00015, float("-inf")]
    rows = [(i, x, "q", 5.0, 10.0, "r", 7.0, 20.0, 1, 0) for i, x in enumerate(scores)]
    spark.createDataFrame(rows, "detection_id long, " + E._DETECTION).write.parquet(f"{tmp_path}/detection.parquet")
    spark.createDataFrame([("q", "/m/q.mp4", 0.0), ("r", "/m/r.avi", 0.0)], "file_id string, path string, time_start double").write.parquet(f"{tmp_path}/media_catalog.parquet")
    con = duckdb.connect()
    for table in ("media_catalog", "detection"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    got = [tuple(r) for r in Z.detect_print_lnk(spark, str(tmp_path)).orderBy("rank").collect()]
    assert [x[2].split()[-1] for x in got][:3] == ["inf", "10000000000000000000000.0000", "1000000000000000.2500"]
    assert got == con.execute(f"SELECT * FROM ({Z.SQL['detect_print_lnk']}) ORDER BY rank").fetchall()
    unknown = spark.createDataFrame([(None, *rows[0][2:])], E._DETECTION)
    assert S.detection_lines(unknown, spark.read.parquet(f"{tmp_path}/media_catalog.parquet"), "LNK").first().line == "q Q0 r 0.7 0.20 1 null"


def test_porter():
    stem = W.Porter()
    pairs = "caresses caress ponies poni cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat hopping hop falling fall filing file happy happi sky sky relational relat rational ration digitizer digit triplicate triplic hopeful hope goodness good revival reviv allowance allow adjustment adjust adoption adopt effective effect probate probat rate rate controll control roll roll as as".split()
    assert [(w, stem(w)) for w in pairs[::2]] == list(zip(pairs[::2], pairs[1::2]))


def test_texts(spark):
    docs = spark.createDataFrame([(0, "the Cats sat"), (1, "the cat ran the ran"), (2, None), (3, ""), (4, "the dog")], "id long, text string")
    t = W.terms(docs, "id", "text")
    assert {(r.id, r.word, r.f) for r in t.where("id = 1").collect()} == {(1, "the", 2), (1, "cat", 1), (1, "ran", 2)}
    v = W.vocabulary(t, "id", 3)
    assert "the" not in {r.word for r in v.collect()} and "the" in {r.word for r in W.vocabulary(t, "id", 3, True).collect()}
    stemmed = {r.word: r.df for r in W.vocabulary(W.terms(docs, "id", "text", True), "id", 5).collect()}
    assert stemmed["cat"] == 2
    w = W.tfidf(W.terms(docs, "id", "text", True), W.vocabulary(W.terms(docs, "id", "text", True), "id", 5), "id", 5)
    norms = w.groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert all(abs(r.n - 1) < 1e-9 for r in norms)
    near = W.sparse_knn(w, "id", docs.where("id = 0"), 2, block=1).collect()
    assert [(r.query_id, r["rank"], r.ref_id) for r in sorted(near, key=lambda r: r["rank"])][0] == (0, 1, 1)


def test_pixels(spark):
    ramp = np.arange(64, dtype=float).reshape(8, 8) * 4
    assert P.histogram_gray(ramp, 1, 1, 4).tolist() == [0.25] * 4 and P.keyframe(ramp, 2, 2).tolist() == [ramp[:4, :4].mean(), ramp[:4, 4:].mean(), ramp[4:, :4].mean(), ramp[4:, 4:].mean()]
    assert P.ordinal(ramp, 2, 2).tolist() == [0, 1, 2, 3] and P.ordinal(np.zeros((4, 4)), 2, 2).tolist() == [0, 1, 2, 3]
    step = np.zeros((8, 8))
    step[:, 4:] = 200
    both = dict(absolute=True)
    assert P.edges(step[:, 3:5], 1, 1, **both).tolist() == [0] and P.edges(step.T[3:5], 1, 1, **both).tolist() == [1] and P.edges(np.zeros((2, 2)), 1, 1).tolist() == [-1]
    assert P.edges(step[:, 3:5], 1, 1).tolist() == [3] and P.edges(step[:, 3:5], 1, 1, kernels=10).tolist() == [0] and P.edges(255 - step[:, 3:5], 1, 1, kernels=10).tolist() == [4]
    assert P.edge_histogram(step, 1, 1, 4, 4, **both).tolist() == [0] * 5 and P.edge_histogram(step[:, 1:7], 1, 1, 3, 4, **both).tolist() == [1, 0, 0, 0, 0]
    assert P.quantize(np.array([0, 0.001, 0.5, 1]), "1U").tolist() == [0, 1, 128, 255] and P.quantize(np.array([0.001]), "R1U").tolist() == [0]
    red = np.zeros((1, 1, 3))
    red[..., 0] = 255
    assert P.color_space(red, "HSV").ravel().tolist() == [0, 255, 255] and P.color_space(red, "HLS").ravel().tolist() == [0, 128, 255] and P.color_space(red, "LAB").ravel().tolist() == [136, 208, 195]
    assert P.gray_chain(step, ["c1/2", "b10", "t100"]).max() == 255 and P.gray_chain(step, ["ERODE"]).sum() == 200 * 24 and P.straighten(step) is step
    assert P.mark_template(ramp, ramp[3:6, 3:6], 1.0)[3:6, 3:6].sum() == 0 and P.gradient_histogram(step, 1, 1, 4)[0] > 0
    assert P.canny(step).any() and not P.canny(np.zeros((8, 8))).any() and P.canny_bits(step, 8, 8).shape == (8,)
    assert P.edge_centroids(np.zeros((8, 8)), 2, 2).tolist() == [0.5] * 8
    color = np.stack([step, step, 255 - step], 2)
    assert P.histogram_color(color, 1, 1, 2, 2, 2).sum() == 1 and P.histogram_channels(color, 1, 1, 4).sum() == 3
    assert P.gray(step, 0.5, 10).max() == 110 and P.gray(step, threshold=100).sum() == 255 * 32 and P.gray(step, equalize=True).max() == 255
    assert P.rank_filter(step, 3, 3, "max").sum() > step.sum() > P.rank_filter(step, 3, 3, "min").sum() and P.rank_filter(step, 1, 1, "median").tolist() == step.tolist()
    assert P.sobel(step).max() == 255 and P.laplace(step).max() == 200 and P.difference_of_gaussians(step, 0.8, 1.6).max() == 255
    assert P.rotate(ramp, "90")[0, -1] == ramp[0, 0] and P.rotate(ramp, "45") is ramp and P.rotate(ramp, "HFLIP")[0, 0] == ramp[0, -1]
    assert P.crop(ramp, 4, 2).shape == (2, 4) and P.crop(ramp, 4, 4, 6, 6).shape == (2, 2)
    framed = np.zeros((10, 10))
    framed[2:8, 3:9] = 100
    assert P.crop_black(framed).shape == (6, 6) and P.otsu(step) < 200 and P.threshold(step).sum() == 255 * 32
    assert P.template(ramp, ramp[3:6, 3:6], 1.0) == (3, 3, 0.0) and P.template(ramp, ramp[:3, :3] + 99, 1.0) is None
    assert P.principal_angle(np.zeros((30, 30))) is None and (P.noise(ramp, 1, 0) == 0).all()
    df = spark.createDataFrame([(1, ramp.tolist()), (2, None)], "i long, p array<array<double>>")
    rows = df.select("i", P.extract(F.col("p"), "KF_2x2").alias("d"), P.transform(F.col("p"), "RESIZE_2x2").alias("t")).orderBy("i").collect()
    assert rows[0].d == P.keyframe(ramp, 2, 2).tolist() and np.array(rows[0].t).shape == (2, 2) and rows[1].d is None and rows[1].t is None


def test_strings(spark):
    df = spark.createDataFrame([("01:02:03.5",), ("2:03",), ("7",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(X.parse_seconds(F.col("t"))).collect()] == [3723.5, 123.0, 7.0, None, None]
    one = spark.range(1).select(X.format_seconds(F.lit(3723.5)), X.format_seconds(F.lit(-0.25)), X.parse_fraction(F.lit("30/4")), X.parse_fraction(F.lit("1/0")), X.trim_decimals(F.lit("1.500")), X.trim_decimals(F.lit("10.000")), X.disk_size(F.lit(1536)), X.extension(F.lit("/a/b.MP4")), X.base_name(F.lit("/a/b.MP4")), X.truncate(F.lit("abcdef"), 5), X.parse_bool(F.lit("No")), X.extension(F.lit("none"))).first()
    assert tuple(one) == ("01:02:03.500", "-00:00:00.250", 7.5, None, "1.5", "10", "1.5 KB", "mp4", "b.MP4", "ab...", False, None)
    assert X.split_brackets("a,(b,c),d") == ["a", "(b,c)", "d"] and X.interval_bins(10, 3) == [3, 3, 4]


def test_sources(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    assert [(r.id, r.value) for r in S.read_strings(spark, put("s", "b\n#x\n\na\n")).orderBy("id").collect()] == [(0, "b"), (1, "a")]
    v = S.read_vectors_text(spark, put("v", "# c\n1 2\t3\n4 5 6\n"), "INT32")
    assert [r.vector for r in v.orderBy("id").collect()] == [[1, 2, 3], [4, 5, 6]]
    with pytest.raises(Exception, match="widths"):
        S.read_vectors_text(spark, put("w", "1 2\n3\n"), "DOUBLE").collect()
    S.write_vectors_text(v, "vector", str(tmp_path / "out"))
    assert {tuple(r.vector) for r in S.read_vectors_text(spark, str(tmp_path / "out"), "INT32").collect()} == {(1, 2, 3), (4, 5, 6)}
    np.arange(6, dtype="<f4").tofile(tmp_path / "raw")
    assert [r.vector for r in S.read_vectors_raw(spark, str(tmp_path / "raw"), 2, 3, "FLOAT").orderBy("id").collect()] == [[0, 1, 2], [3, 4, 5]]
    with pytest.raises(ValueError):
        S.read_vectors_raw(spark, str(tmp_path / "raw"), 3, 3, "FLOAT")
    r = S.random_vectors(spark, 50, 3, 2, 5)
    assert r.orderBy("id").collect() == r.repartition(3).orderBy("id").collect() and all(2 <= x < 5 for row in r.collect() for x in row.vector)
    cat = put("cat", "V\ta\t/m/a.mp4\t10\t640\t480\t0\t1:00\t30/1\t1\tcrop\tnull\nV\tb\t/m/b.mp4\t20\t640\t480\t0\t9.5\t25\t0\nV\tc\t/m/c.mp4\t30\t1\t1\t0\t2\t25\t0\n")
    rows = S.read_catalog(spark, cat).orderBy("pos").collect()
    assert [(x.file_id, x.time_end, x.fps, len(x.transforms)) for x in rows] == [("a", 60.0, 30.0, 1), ("b", 9.5, 25.0, 0), ("c", 2.0, 25.0, 0)] and rows[0].transforms[0].preprocess is None
    ids = lambda o: [x.file_id for x in S.read_catalog(spark, cat, o).orderBy("pos").collect()]
    assert ids("%start=1") == ["b"] and ids("start=1;length=5") == ["b", "c"] and ids("idExclude=b") == ["a", "c"] and ids("idInclude=c;idInclude=a") == ["a", "c"]
    ss = put("ss", "query=q1\tsegments=2\tsearch_time=1.5\nq1@0\tr@1\t0.1\tq1@4\t0.2\tr@2\t0.3\tr@3\t0.2\nq1@1\n")
    nn = S.read_neighbours(spark, ss)
    assert [(x.name_query, x["rank"], x.name_nn) for x in nn.orderBy("rank").collect()] == [("q1@0", 1, "r@1"), ("q1@0", 2, "q1@4"), ("q1@0", 3, "r@2")]
    assert [(x["rank"], x.name_nn) for x in S.load_profile(nn, 2).orderBy("rank").collect()] == [(1, "r@1"), (2, "r@2")]
    S.write_neighbours(nn, str(tmp_path / "ssout"))
    assert {tuple(x) for x in S.read_neighbours(spark, str(tmp_path / "ssout") + "/*").collect()} == {tuple(x) for x in nn.collect()}
    det = put("det", "#score\n2.5\tq\t0:01\t0:05\tr\t1:00\t1:04\t9\t1\n7\tq\t1\t2\ts\t3\t4\t5\t0\n-1\tq\t1\t2\ts\t3\t4\t5\t0\n")
    d = S.read_detections(spark, det)
    assert [(x["rank"], x.score, x.sec_start_r) for x in d.orderBy("rank").collect()] == [(1, 7.0, 3.0), (2, 2.5, 60.0), (3, -1.0, 3.0)]
    S.write_detections(d, str(tmp_path / "detout"))
    assert S.read_detections(spark, str(tmp_path / "detout")).count() == 2
    media = spark.createDataFrame([("q", "/m/q.mp4", 10.0), ("r", "/m/r.avi", 0.0), ("s", "/m/s.avi", None)], "file_id string, path string, time_start double")
    for layout, n in (("VLC", 3), ("VIEW", 3), ("FFMPEG", 6), ("TXT", 3), ("LNK", 3)):
        assert S.detection_lines(d.drop("rank"), media, layout).count() == n
    seg = put("seg", "2\t25\n0\t1\t2\t0\t0.5\t1\n3\t4\t5\t1\t1.5\t2\n")
    assert [(x.num_segment, x.end_frame, x.fps) for x in S.read_segmentation(spark, seg).collect()] == [(0, 2, 25.0), (1, 5, 25.0)]
    got = lambda version, text: [(x.name, x.num_shot, x.start_second, x.end_second) for x in S.read_shots(spark, put("sh", text), version).collect()]
    assert got(1, "a\t1\t25\t9\nx\t0\t4\n") == [("a", 0, 0.0, 4.0)]
    assert got(2, "a\n100\n4\n25\n1\n50\n") == [("a", 0, 0.0, 2.0), ("a", 1, 2.0, 4.0)]
    assert got(3, "a\n100\n4\n25\n2\n25 75\n") == [("a", 0, 0.0, 2.0), ("a", 1, 2.0, 4.0)]
    assert [tuple(x) for x in S.read_truth_segments(spark, put("gt", "/x/Q.mp4\t1\t3/2\tr\t5\t6\n")).collect()] == [("q", 1.0, 1.5, "r", 5.0, 6.0)]
    assert S.read_truth_frames(spark, put("gf", "q@1\tr@2\nq@1\tr@2\n")).count() == 1
    assert [tuple(x) for x in S.read_truth_categories(spark, put("c1", "q@1\tk\n"), put("c2", "k\tr@2\n")).collect()] == [("q@1", "k", "r@2")]
    assert [(x.start_second, x.words) for x in S.read_subtitles(spark, put("sub", "0:01\t0:02\tThe cats\n1\t2\t--\n"), True).collect()] == [(1.0, ["the", "cat"])]
    vocab = spark.createDataFrame([("Bee", 2), ("ant", 1)], "word string, df long")
    S.write_vocabulary(vocab, 10, str(tmp_path / "voc"))
    assert {(x.word, x.df, round(x.weight, 6)) for x in S.read_vocabulary(spark, str(tmp_path / "voc")).collect()} == {("ant", 1, round(float(np.log(10)), 6)), ("Bee", 2, round(float(np.log(5)), 6))}
    (tmp_path / "m" / "x").mkdir(parents=True)
    (tmp_path / "m" / "x" / "one.MP4").write_bytes(b"12")
    (tmp_path / "m" / "two.txt").write_bytes(b"1")
    assert [(x.file_id, x.filesize) for x in S.new_catalog(spark, str(tmp_path / "m"), "V").collect()] == [("x/one", 2)]


def test_streams(spark, tmp_path):
    data = spark.range(100).selectExpr("cast(timestamp_seconds(id * 60) as timestamp) as ts", "cast(id as double) as value", "id", "array(cast(id as double), 1.0) as v")
    data.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    out = R.run_to_table(R.windowed_stats(stream.select("ts", "value"), "ts", "value", "10 minutes"), "win", str(tmp_path / "c1"))
    assert out.count() == 10 and {r.n for r in out.collect()} == {10}
    h = R.run_to_table(R.running_histogram(stream.select("value"), "value", 0.0, 25.0, 3), "his", str(tmp_path / "c2"))
    assert {(r.bin, r.amount) for r in h.collect()} == {(0, 25), (1, 25), (2, 50)}
    got = []
    R.stream_search(stream.where("id < 5"), data, "id", "v", "L2", 2, lambda df, n: got.extend(df.collect()), str(tmp_path / "c3")).awaitTermination()
    assert {(r.query_id, r.ref_id) for r in got if r["rank"] == 1} == {(i, i) for i in range(5)}


def test_single_detections(spark):
    rows = [(5.0, "q", 0.0, 10.0, "a", 0.0, 10.0, 3, 0), (4.0, "q", 1.0, 9.0, "a", 1.0, 9.0, 3, 0), (3.0, "q", 20.0, 30.0, "a", 0.0, 10.0, 3, 0), (2.0, "q", 0.0, 10.0, "b", 50.0, 60.0, 3, 0), (1.0, "q", 40.0, 50.0, "a", 90.0, 99.0, 3, 0), (9.0, None, 0.0, 1.0, "a", 0.0, 1.0, 1, 0), (None, "q", 0.0, 1.0, "a", 0.0, 1.0, 1, 0)]
    df = spark.createDataFrame(rows, E._DETECTION)
    kept = {m: sorted((r.score for r in E.keep_single(df, m).collect()), reverse=True) for m in E.ALIKE}
    assert kept == {1: [5.0], 2: [5.0, 2.0], 3: [5.0, 2.0, 1.0], 4: [5.0, 3.0, 1.0], 5: [5.0, 3.0, 2.0, 1.0], 6: [5.0, 3.0, 2.0, 1.0]}
    assert [r.score for r in E.keep_single(df, 6, 2).collect()] == [5.0, 3.0] and E.keep_single(df.limit(0), 4).count() == 0


def _shared(s1, e1, s2, e2):
    over = min(e1, e2) - max(s1, s2) if None not in (s1, e1, s2, e2) else 0
    return over > 0 and over >= min(e1 - s1, e2 - s2) / 2


def test_single_detections_like_all_pairs(spark):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        (s, e), (t, f) = ((x, x + rng.choice([0.0, -1.0, 0.25, 2.0, 7.5, 60.0, float("inf"), 900.0])) for x in (rng.randrange(-400, 400) / 8, rng.randrange(400) / 8))
        rows.append((float(rng.randrange(40)), rng.choice("qqqp"), s, e if i % 50 else None, rng.choice("aaab"), t, f if i % 70 else None, i, 0))
    df = spark.createDataFrame(rows, E._DETECTION)
    order = lambda d: (-d[0], d[4], *((x is not None, x or 0.0) for x in (d[2], d[5], d[3], d[6])), d[7])
    for mode in (3, 4, 5, 6):
        q, r = E.ALIKE[mode]
        kept = []
        for d in sorted(rows, key=order):
            same = [k for k in kept if k[1] == d[1] and (r == "any" or k[4] == d[4])]
            if not any((not q or _shared(*k[2:4], *d[2:4])) and (r != "stretch" or _shared(*k[5:7], *d[5:7])) for k in same):
                kept.append(d)
        assert {x.num_voters for x in E.keep_single(df, mode).collect()} == {k[7] for k in kept}
        best = [k[7] for name in "pq" for k in [k for k in kept if k[1] == name][:5]]
        assert sorted(x.num_voters for x in E.keep_single(df, mode, 5).collect()) == sorted(best)


def test_single_detections_of_one_file(spark, monkeypatch):
    # a query file with all rows is spread over tasks, and a pair of files isn't compared row by row
    rows = spark.range(2000).selectExpr("double(id) score", "'q' video_q", "0d sec_start_q", "9d sec_end_q", "string(id) video_r", "0d sec_start_r", "9d sec_end_r", "1L num_voters", "0L num_misses")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        kept = E.keep_single(rows, 6)
        assert kept.count() == 2000 and kept.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    calls = []
    plain = E._overlap
    monkeypatch.setattr(E, "_overlap", lambda *x: calls.append(1) or plain(*x))
    rng = random.Random(6)
    boxes = E._Boxes()
    for _ in range(5000):
        s, t, n = rng.uniform(0, 3600), rng.uniform(0, 3600), 2 ** rng.uniform(0, 6)
        boxes.add((s, s + n, t, t + n))
    assert len(calls) < 100 * 5000


def test_fusion_options(spark):
    near = spark.createDataFrame([(1, 7, 0.5), (1, 8, 0.7), (1, 9, 2.0), (2, 7, 0.1)], "query_id long, ref_id long, distance double")
    assert [(r.query_id, r.ref_id) for r in U.limit_list(near, 2, 1.0).orderBy("query_id", "rank").collect()] == [(1, 7), (1, 8), (2, 7)]
    assert U.longest_list(near) == 3 and U.longest_list(near.limit(0)) == 0
    one, two = (spark.createDataFrame(x, "name_file string, search_time double") for x in ([("a", 1.0)], [("a", 2.0), ("b", 5.0)]))
    assert [[tuple(r) for r in U.fuse_search_times([one, two], how).collect()] for how in ("SUM", "MAX", "AVG")] == [[("a", 3.0)], [("a", 2.0)], [("a", 2.0)]]
    answers = spark.createDataFrame([(1, 1, 7), (1, 2, 8), (2, 1, 9), (3, 1, 1)], "query_id long, rank int, ref_id long")
    truth = spark.createDataFrame([(1, 7), (1, 5), (2, 1)], "query_id long, ref_id long")
    assert {(r["rank"], round(r.recall, 6), round(r.precision, 6)) for r in U.recall_curve(answers, truth).collect()} == {(1, 0.333333, 0.5), (2, 0.333333, 0.333333)}
    assert {tuple(r) for r in U.outcome_strings(answers, truth).collect()} == {(1, "C."), (2, "."), (3, "?")}


def test_sources_and_sinks(spark, data):
    """Every query on files gives what its SQL gives."""
    import duckdb
    from sembla.plans import source_queries as Z

    con = duckdb.connect()
    for table in ("media_catalog", "search_segment", "detection", "query_txt", "documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    for name in ("io_strings", "io_catalog", "io_neighbours", "io_vector_neighbours", "io_detections", "io_shots", "io_vocabulary"):
        df = Z.QUERIES[name](spark, data)
        columns = sorted(df.columns)
        sql = con.execute(f"SELECT {', '.join(columns)} FROM ({Z.SQL[name]})").fetchall()
        assert sorted(map(str, map(tuple, df.select(*columns).collect()))) == sorted(map(str, sql)), name
