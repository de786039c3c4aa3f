"""Interval merging against a sequential model."""

import random

from sembla.operators.intervals import merge_intervals, overlap_join, overlap_ratio
from pyspark.sql import functions as F


def model(rows):
    out, by = set(), {}
    for e, s, t in rows:
        if s is not None and t is not None and t > s:
            by.setdefault(e, []).append((s, t))
    for e, spans in by.items():
        top = start = None
        for s, t in sorted(spans):
            if top is None:
                start, top = s, t
            elif s > top:
                out |= {(e, "period", start, top), (e, "gap", top, s)}
                start, top = s, t
            else:
                top = max(top, t)
        out.add((e, "period", start, top))
    return out


def got(spark, rows, **kw):
    df = spark.createDataFrame(rows, "e string, s long, t long")
    found = [tuple(r) for r in merge_intervals(df.repartition(3), ["e"], "s", "t", **kw).collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_random_and_hot_entity(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.5 else rng.choice(["a", "b", None]), s := rng.randrange(0, 9000), s + rng.randrange(-2, 12)) for _ in range(3000)]
    rows += [("one", 5, 9)] * 500 + [("c", None, 3), ("c", 3, None), ("c", 3, 3)]
    assert got(spark, rows) == model(rows)


def test_touching_nested_and_negative(spark):
    rows = [("a", 0, 5), ("a", 5, 8), ("a", 1, 2), ("a", -9, -3), ("b", -(2**61), 2**61)]
    assert got(spark, rows) == {("a", "period", -9, -3), ("a", "gap", -3, 0), ("a", "period", 0, 8), ("b", "period", -(2**61), 2**61)}


def test_empty_and_extra_columns(spark):
    assert got(spark, []) == set()
    df = spark.createDataFrame([("a", 1, 2, "x", 7)], "e string, s long, t long, kind string, __g long")
    assert [tuple(r) for r in merge_intervals(df, ["e"], "s", "t").collect()] == [("a", "period", 1, 2)]


def test_many_small_runs(spark):
    rng = random.Random(2)
    rows = [("x", s := rng.randrange(0, 100_000), s + rng.randrange(1, 60)) for _ in range(4000)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert got(spark, rows) == model(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_overlap_join_and_ratio(spark):
    rng = random.Random(3)
    a = [(i, rng.choice("xy"), s := rng.uniform(0, 50), s + rng.uniform(0, 9)) for i in range(60)]
    b = [(i, rng.choice("xy"), s := rng.uniform(0, 50), s + rng.uniform(0, 9)) for i in range(60)]
    left = spark.createDataFrame(a, "i long, k string, s double, e double")
    right = spark.createDataFrame(b, "i long, k string, s double, e double")
    found = {(r.i, r.i_r) for r in overlap_join(left, right, ["k"], ("s", "e"), ("s", "e"), 3.0).collect()}
    assert found == {(p[0], q[0]) for p in a for q in b if p[1] == q[1] and max(p[2], q[2]) <= min(p[3], q[3])}
    c = [F.lit(x) for x in (0.0, 4.0, 2.0, 10.0)]
    row = spark.range(1).select(overlap_ratio(*c).alias("a"), overlap_ratio(c[0], c[1], c[1], c[3]).alias("b"), overlap_ratio(c[0], c[3], c[2], c[1]).alias("c"), overlap_ratio(F.lit(None).cast("double"), *c[1:]).alias("d")).first()
    assert tuple(row) == (0.5, 0.0, 1.0, None)


def test_overlaps_of_very_different_lengths(spark):
    rng = random.Random(9)
    make = lambda n: [(rng.choice("xy"), i, a := rng.uniform(-50, 1000), a + rng.choice([0.0, 0.1, 3.0, 40.0, 600.0, 1e7])) for i in range(n)]
    one, two = make(120), make(120)
    a, b = (spark.createDataFrame(x, "k string, i long, s double, e double") for x in (one, two))
    got = [(r.i, r.i_r) for r in overlap_join(a, b, ["k"], ("s", "e"), ("s", "e"), 1.0).collect()]
    want = {(x[1], y[1]) for x in one for y in two if x[0] == y[0] and max(x[2], y[2]) <= min(x[3], y[3])}
    assert len(got) == len(want) and set(got) == want
    assert overlap_join(a.limit(0), b, ["k"], ("s", "e"), ("s", "e"), 1.0).count() == 0
