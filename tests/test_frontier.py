import random

import numpy as np
import pytest

from helixframe.functions.align import Rows
from helixframe.operators import extend, frontier

K = 5


def turned(x):
    return x[::-1].translate(str.maketrans("ACGT", "TGCA"))


@pytest.mark.parametrize("trial", range(20))
def test_rows_of_many_patterns(trial):
    r = random.Random(trial)
    made = lambda low, high: "".join(r.choices("ACGTN" if trial % 2 else "ACGT", k=r.randrange(low, high)))
    patterns, parts = [made(1, 30) for _ in range(25)], [made(0, 40) for _ in range(25)]
    width = max(map(len, patterns)) + 1
    rows = np.zeros((25, width), np.int32)
    for i, p in enumerate(patterns):
        rows[i] = np.arange(width) * -3
        one = Rows(p)
        rows[i, : len(p) + 1] = one.after(one.first, ord("A")) if i % 2 else one.first
    got, best, times, first = frontier.advance(patterns, rows, parts)
    for i, (p, part) in enumerate(zip(patterns, parts)):
        one, row, scores = Rows(p), rows[i, : len(p) + 1].astype(np.int64), []
        for base in part.encode():
            row = one.after(row, base)
            scores.append(int(row[-1]))
        assert got[i, : len(p) + 1].tolist() == row.tolist()
        assert frontier.attainable(got[i : i + 1], np.array([len(p)]))[0] == one.attainable(row)
        assert times[i] == (scores.count(max(scores)) if scores else 0)
        if scores:
            assert best[i] == max(scores) and first[i] == scores.index(max(scores)) + 1


def random_graph(r, n):
    """Nodes that overlap by K - 1 bases wherever they can: a small alphabet of ends makes many arcs."""
    ends = ["ACGT", "CCAG", "GATT"]
    nodes = {i: r.choice(ends) + "".join(r.choices("ACGT", k=r.randrange(0, 7))) + r.choice(ends) for i in range(1, n + 1)}
    both = nodes | {-i: turned(t) for i, t in nodes.items()}
    arcs = [(a, b) for a, x in both.items() for b, y in both.items() if x[-(K - 1) :] == y[: K - 1]]
    return nodes, both, arcs


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_the_search_of_one_read(spark, seed):
    r = random.Random(seed)
    nodes, both, arcs = random_graph(r, 9)
    right = {}
    for a, b in arcs:
        right.setdefault(a, []).append(b)
    local = extend.LocalGraph(K, both, right)
    tasks = []
    for i in range(40):
        last = r.choice(list(both))
        offset = r.randrange(0, len(both[last]) + 1)
        walk, text = last, both[last][offset:]
        while len(text) < 30 and right.get(walk):
            walk = r.choice(right[walk])
            text += both[walk][K - 1 :]
        pattern = list(text[: r.randrange(1, 30)])
        for _ in range(r.randrange(0, 3)):
            at = r.randrange(len(pattern) + 1)
            pattern[at : at + r.choice([0, 1])] = r.choice(["", "A", "C", "N"])
        tasks.append((i, "".join(pattern) or "A", last, offset, []))
    found = frontier.search_all(
        spark.createDataFrame(tasks, "task long, pattern string, last int, offset int, context array<int>"),
        spark.createDataFrame([(i, t, len(t)) for i, t in nodes.items()], "node_id int, seq string, len int"),
        spark.createDataFrame(arcs, "src int, dst int"), K, visits=100_000,
    )
    got = {x["task"]: x for x in found.collect()}
    assert len(got) == len(tasks)
    states = set()
    for i, pattern, last, offset, _ in tasks:
        score, chain, text, state = extend.search(local, pattern, (last,), offset, visits=1_000_000)
        assert (got[i]["score"], got[i]["state"]) == (score, state), (i, pattern)
        states.add(state)
        if state == extend.OPTIMAL and text:
            assert (tuple(got[i]["chain"]), got[i]["text"]) == (chain, text)
            assert list(got[i]["lens"]) == [len(both[x]) for x in chain]
        elif not text:
            assert got[i]["text"] == ""
    assert states == {extend.OPTIMAL, extend.MULTIPLE}


def test_visit_limit_and_wide_repeats(spark):
    """A node with 10,000 next ones, all alike: the search ends as exhausted; its neighbour's search isn't touched."""
    nodes = [(1, "ACGTA")] + [(i, "CGTAC") for i in range(2, 10_002)] + [(20_000, "GGGGA"), (20_001, "GGGAT")]
    arcs = [(1, i) for i in range(2, 10_002)] + [(20_000, 20_001)]
    tasks = [(1, "CCCC", 1, 5, []), (2, "T", 20_000, 5, []), (3, "", 1, 5, [])]
    found = frontier.search_all(
        spark.createDataFrame(tasks, "task long, pattern string, last int, offset int, context array<int>"),
        spark.createDataFrame([(i, t, len(t)) for i, t in nodes], "node_id int, seq string, len int"),
        spark.createDataFrame(arcs, "src int, dst int"), K,
    )
    got = {x["task"]: (x["score"], x["state"], x["text"]) for x in found.collect()}
    assert got[1][1] == extend.EXHAUSTED and got[2] == (1, extend.OPTIMAL, "T") and 3 not in got


def test_only_the_asked_bases_of_a_long_node_travel(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(3, "ACGTTGCA"), (-3, "ACGTTGCA"), (-4, "ACCGG")], "node int, seq string").withColumn("len", F.length("seq"))
    for start, size in ((0, 3), (2, 4), (4, 100), (8, 5), (0, 0)):
        got = [r["x"] for r in df.select(frontier.oriented(F.col("node"), F.col("len"), F.col("seq"), F.lit(start), F.lit(size)).alias("x")).collect()]
        assert got == [t[start : start + size] for t in ("ACGTTGCA", turned("ACGTTGCA"), turned("ACCGG"))]
