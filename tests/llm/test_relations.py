"""Top N, groups and ranking against plain models."""

import random

import pytest
from sembla.llm import groups as G
from sembla.llm.groups import group_ids
from sembla.llm.rank_fusion import best_item, ideal_point_scores
from sembla.llm.topn import top_n


def test_top_n_random_with_hot_group_ties_and_repeats(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.4 else rng.choice(["a", "b", None, ""]), rng.choice([None, float("nan"), 0.0, -0.0, *map(float, range(5))]), rng.randrange(300)) for _ in range(4000)]
    rows += rows[:200]
    df = spark.createDataFrame(rows, "g string, s double, i long").repartition(5)
    for asc in (True, False):
        want = set()
        for g in {r[0] for r in rows}:
            mine = {(s + 0.0, i) for h, s, i in rows if h == g and s is not None and s == s}
            best = sorted(mine, key=lambda x: (x[0] if asc else -x[0], x[1]))[:7]
            want |= {(g, s, i, p + 1) for p, (s, i) in enumerate(best)}
        got = [tuple(r) for r in top_n(df, ["g"], "s", "i", 7, asc, position="p").collect()]
        assert len(got) == len(want) and set(got) == want


def test_top_n_small_runs_empty_and_extra_columns(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        df = spark.range(5000).selectExpr("id % 2 as g", "id as s", "id as i", "1 as p", "2 as __s")
        got = {tuple(r) for r in top_n(df, ["g"], "s", "i", 600).collect()}
        assert got == {(i % 2, i, i) for i in range(1200)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert top_n(df.limit(0), ["g"], "s", "i", 3).count() == 0
    with pytest.raises(ValueError):
        top_n(df, ["g"], "s", "i", 0)


def components(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            p, q = find(a), find(b)
            up[max(p, q)] = min(p, q)
    return {v: find(v) for v in up}


@pytest.mark.parametrize("levels, block", [(100, 10**6), (3, 10**6), (1, 0), (100, 0)])
def test_groups(spark, monkeypatch, levels, block):
    monkeypatch.setattr(G, "BLOCK", block)
    monkeypatch.setattr(G, "HOT_SHARE", 0.05)
    rng = random.Random(2)
    pairs = [(f"v{rng.randrange(400):03}", f"v{rng.randrange(400):03}") for _ in range(230)]
    pairs += [("v399", f"leaf{i}") for i in range(60)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(40)]
    pairs += [("leaf3", "c020"), (None, "v001"), ("v002", None), ("self", "self")] + pairs[:30] + [(b, a) for a, b in pairs[:9]]
    # a second hub, outside the component of the first
    pairs += [("w0", f"twig{i}") for i in range(50)] + [("twig7", "w1"), ("w1", "w2")]
    df = spark.createDataFrame(pairs, "a string, b string").selectExpr("a", "b", "1 as v", "2 as f")
    got = [tuple(r) for r in group_ids(df, "a", "b", levels=levels).collect()]
    assert len(got) == len(dict(got)) and dict(got) == components(pairs)


def test_groups_empty_and_numbers(spark):
    assert group_ids(spark.createDataFrame([(None, 1), (2, 2)], "a long, b long"), "a", "b").count() == 0
    got = {tuple(r) for r in group_ids(spark.createDataFrame([(10, 9), (9, 2), (30, 31)], "a long, b long"), "a", "b").collect()}
    assert got == {(10, 2), (9, 2), (2, 2), (30, 30), (31, 30)}


def test_ideal_point(spark):
    rows = [("q", "wide", "x", 9000.0), ("q", "wide", "y", 8000.0), ("q", "wide", "z", 8500.0), ("q", "narrow", "x", 0.01), ("q", "narrow", "y", 0.02), ("q", "narrow", "z", 0.9)]
    rows += [("q", "third", "x", 1.0), ("q", "third", "y", 5.0), ("q", "third", "x", 7.0), ("q", "third", "n", None), ("q", "third", "m", float("nan")), (None, "third", "k", 1.0)]
    rows += [("zero", "a", "u", 0.0), ("zero", "a", "t", 0.0), ("zero", "b", "u", 0.0)] + rows[:3]
    df = spark.createDataFrame(rows, "q string, c string, i string, v double").selectExpr("*", "1 as norm", "2 as closeness")
    scores = ideal_point_scores(df, "q", "c", "i", "v")
    got = {(r.q, r.i): r.closeness for r in scores.collect()}
    assert set(got) == {("q", "x"), ("q", "y"), ("q", "z"), ("zero", "u"), ("zero", "t")}
    assert got["q", "y"] > got["q", "z"] and all(0 <= v <= 1 for v in got.values())
    assert {tuple(r) for r in best_item(scores, "q", "i").collect()} >= {("zero", "u")}
    assert ideal_point_scores(df.limit(0), "q", "c", "i", "v").count() == 0
