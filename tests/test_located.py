"""The as-of join of positions and slots, against a plain version."""

import random

from pyspark.sql import functions as F

from helixframe.operators import seeds

POINTS = "p long, position long, start string"


def plain(points, slots):
    out = []
    for p, at, tag in points:
        if at is None:
            continue
        before = [(s, e, n) for n, s, e in slots if s is not None and s <= at]
        if before:
            s, e, n = max(before, key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2]))
            if e is None or at < e:
                out.append((p, n, s))
    return sorted(out)


def found(spark, points, slots, ended=True):
    s = spark.createDataFrame(slots, "node_id long, start long, end long")
    p = spark.createDataFrame(points, "p long, position long, tag string")
    return sorted((r["p"], r["node_id"], r["start"]) for r in seeds.located(p, s if ended else s.drop("end")).collect())


def test_random_slots(spark):
    r = random.Random(4)
    starts = sorted(r.sample(range(5_000), 300))
    slots = [(i + 1, a, b - (i % 3 == 0) * r.randrange(0, b - a)) for i, (a, b) in enumerate(zip(starts, [*starts[1:], 5_400]))]
    points = [(i, r.randrange(-20, 6_000), "x") for i in range(3_000)]
    assert found(spark, points, slots) == plain(points, slots)
    open_ended = [(n, s, None) for n, s, _ in slots]
    assert found(spark, points, open_ended, False) == plain(points, open_ended)


def test_one_slot_of_a_billion_bases_and_hot_position(spark):
    slots = [(1, 0, 10), (2, 10, 10**9), (3, 10**9, 10**9 + 1)]
    points = [(i, 500_000_000, "hot") for i in range(2_000)] + [(5_000, 9, "a"), (5_001, 10, "a"), (5_002, 10**9, "b"), (5_003, 10**9 + 1, "b"), (5_004, None, "c"), (5_005, -1, "d")]
    assert found(spark, points, slots) == plain(points, slots)


def test_nothing(spark):
    assert found(spark, [], [(1, 0, 5)]) == [] and found(spark, [(1, 3, "x")], []) == []
    assert found(spark, [(1, 3, "x"), (1, 3, "x")], [(None, 0, 5), (7, None, 9)]) == [(1, None, 0)] * 2


def test_points_are_not_multiplied_by_a_wide_slot(spark):
    s = spark.createDataFrame([(1, 0, 10**12)], "node_id long, start long, end long")
    p = spark.range(100).select(F.col("id").alias("p"), (F.col("id") * 10**9).alias("position"))
    assert seeds.located(p, s).count() == 100
