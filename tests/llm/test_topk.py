import math
import random

import numpy as np
import pytest

from helixframe.llm import topk

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, queries, k):
    q = {i: [math.floor(256 * x) for x in v] for i, v in rows if usable(v)}
    dot = lambda a, b: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b))))
    out = {}
    for i in queries:
        if i in q:
            best = sorted((-dot(q[i], v), j) for j, v in q.items() if j != i)[:k]
            out.update({(i, r): (j, -s) for r, (s, j) in enumerate(best, 1)})
    return out


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def run(spark, rows, divisor, k):
    v = topk.quantised(spark.createDataFrame([(i, x, 0) for i, x in rows], VECTORS), "vec_id", "embedding")
    return {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(v, v.filter(f"vec_id % {divisor} = 0"), k).collect()}


def float32(rng, n):
    return [rng.randint(-300, 300) / 256 for _ in range(n)]


@pytest.mark.parametrize(("n", "dims", "k"), [(300, 8, 5), (40, 1, 3), (4, 6, 5), (500, 3, 7)])
def test_brute_force(spark, monkeypatch, n, dims, k):
    monkeypatch.setattr(topk, "TILE_ROWS", 64)
    rng = random.Random(n)
    rows = [(i, float32(rng, dims)) for i in range(n)]
    assert run(spark, rows, 5, k) == brute(rows, range(0, n, 5), k)


def test_ties_repeats_and_unusable(spark):
    same = [0.5, -0.25, 1.0]
    rows = [(0, same), (1, None), (2, [0.5, None, 1.0]), (3, [math.nan, 0.0, 0.0]), (4, [math.inf, 0.0, 0.0]), *[(i, same) for i in range(5, 15)], (20, [])]
    assert run(spark, rows[:-1], 5, 5) == brute(rows[:-1], [0, 5, 10], 5)
    assert run(spark, rows, 20, 3)
    assert run(spark, [], 5, 5) == {}
    assert run(spark, [(0, same)], 5, 5) == {}


def test_query_groups(spark, monkeypatch):
    monkeypatch.setattr(topk, "GROUP_BYTES", 2000)
    rng = random.Random(9)
    rows = [(i, float32(rng, 4)) for i in range(120)]
    assert run(spark, rows, 2, 4) == brute(rows, range(0, 120, 2), 4)


def single(x):
    return float(np.float32(x))


@pytest.mark.parametrize("large", [3e6, 3e7])
def test_large_components(spark, large):
    """Scores below 64 bits stay exact; those beyond stop at the ends, ties to the smaller id."""
    rows = [(i, [single(large + i), single(-large * (1 - i % 2)), 1.5]) for i in range(12)]
    assert run(spark, rows, 3, 4) == brute(rows, range(0, 12, 3), 4)
    rows += [(i, [single(-large * 9), 0.0, 0.0]) for i in range(12, 20)]
    assert run(spark, rows, 3, 12) == brute(rows, range(0, 20, 3), 12)


def test_sums_beyond_a_single(spark):
    """Slices of just under 2^24 whose sum is above it."""
    rows = [(0, [4095 / 256, 4095 / 256]), (1, [4095 / 256, 4094 / 256])]
    assert run(spark, rows, 50, 1) == {(0, 1): (1, 33_533_955 - 4095 + 4095)} == brute(rows, [0], 1)
    rng = random.Random(4)
    rows = [(i, [rng.randint(4000, 4095) / 256 for _ in range(2)]) for i in range(200)]
    assert run(spark, rows, 5, 5) == brute(rows, range(0, 200, 5), 5)


def plain(q, tile, k):
    out = {}
    for i, row in zip(q.ids.tolist(), q.rows.tolist()):
        out[i] = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(row, c)))), j) for j, c in zip(tile.ids.tolist(), tile.rows.tolist()) if j != i)[:k]
    return out


@pytest.mark.parametrize("trial", range(60))
def test_blocks_at_any_magnitude(monkeypatch, trial):
    monkeypatch.setattr(topk, "BOUND_ROWS", 8)
    r = np.random.default_rng(trial)
    size, n, width, k = 2 ** int(r.integers(0, 41)), int(r.integers(2, 80)), int(r.integers(1, 9)), int(r.integers(1, 6))
    rows = r.integers(-size, size + 1, (n, width))
    if trial % 3 == 0:
        rows[0] = r.integers(-(2**62), 2**62, width)
    ids = np.sort(r.choice(300, n, replace=False)).astype(np.int64)
    q, tile = topk.Side(ids[::3], rows[::3]), topk.Side(ids, rows)
    at, _, scores = topk.leaders(q, tile, k)
    cutoff = np.full(len(q.ids), -(2**63), np.int64)
    for i in range(len(q.ids)):
        best = sorted(scores[at == i].tolist(), reverse=True)
        if len(best) >= k:
            cutoff[i] = best[k - 1]
    at, found, scores, _ = topk.sufficient(q, cutoff, tile, k)
    got = {int(q.ids[i]): sorted((-s, j) for s, j in zip(scores[at == i].tolist(), found[at == i].tolist())) for i in range(len(q.ids))}
    assert got == plain(q, tile, k)


def test_blocks_below_the_cutoff_are_not_scored():
    r = np.random.default_rng(1)
    rows = r.integers(-50, 50, (2048, 8))
    rows[:20] *= 100
    tile, q = topk.Side(np.arange(2048), rows), topk.Side(np.arange(0, 2048, 64), rows[::64])
    full = plain(q, tile, 5)
    cutoff = np.array([-full[i][-1][0] for i in q.ids.tolist()])
    at, found, scores, cells = topk.sufficient(q, cutoff, tile, 5)
    assert cells <= len(q.ids) * topk.BOUND_ROWS
    assert {int(q.ids[i]): sorted((-s, j) for s, j in zip(scores[at == i].tolist(), found[at == i].tolist())) for i in range(len(q.ids))} == full
