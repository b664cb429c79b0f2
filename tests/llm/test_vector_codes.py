import hashlib
import math
import random

import numpy as np
import pytest

from helixframe.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, scale=1024, parts=4, entries=256, rounds=4):
    """Plain Lloyd rounds in Python's whole numbers."""
    kept = [(i, v, tag) for i, v, tag in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = max((len(v) for _, v, _ in kept), default=0)
    width += -width % parts
    size = width // parts
    most = math.isqrt((2**63 - 1) // (4 * max(width, 1)))
    whole = [[max(-most, min(most, math.floor(scale * x))) for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(v, p) for v in whole[:entries]] for p in range(parts)]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for v in whole:
                members.setdefault(best(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(members[e]) for c in zip(*members[e])] if e in members else old for e, old in enumerate(books[p])]
    out = []
    for (i, _, tag), v in zip(kept, whole):
        found = [best(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, tag, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    sums = {}
    for _, tag, _, error in out:
        sums[tag] = min(sums.get(tag, 0) + error, 2**63 - 1)
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted(((i, code, error, sums[tag]) for i, tag, code, error in out), key=str), digest


def run(spark, rows, **kind):
    coded, books = vector_codes.compress(spark.createDataFrame(rows, SCHEMA), **kind)
    got = vector_codes.with_label_error(coded).collect()
    return sorted(((r["id"], r["codes"].hex(), r["error"], r["label_error"]) for r in got), key=str), vector_codes.codebooks_sha256(books)


def float32(x):
    return float(np.float32(x))


@pytest.mark.parametrize(("n", "width", "entries"), [(300, 8, 16), (90, 12, 256), (40, 4, 3)])
def test_brute_force(spark, n, width, entries):
    r = random.Random(n)
    rows = [(i, [float32(r.gauss(0, 0.3)) for _ in range(width)], r.choice([None, 0, 1, 1, 1])) for i in r.sample(range(10 * n), n)]
    assert run(spark, rows, entries=entries) == brute(rows, entries=entries)


def test_awkward_rows(spark):
    r = random.Random(7)
    same = [0.5, -0.25, 1.0, 0.125]
    rows = [(0, None, 1), (1, [0.1, None, 0.2, 0.3], 1), (2, [math.nan] * 4, 1), (3, [math.inf, 0.0, 0.0, 0.0], 1), (4, [], None), (5, [0.25], 2), (6, [0.5, 0.25, -0.5, 1.0, 2.0], 2)]
    rows += [(7, same, 3)] * 5 + [(None, same, None), (None, [float32(0.3)] * 4, 3)]
    rows += [(i, [float32(r.uniform(-1, 1)) for _ in range(4)], 3) for i in range(20, 60)]
    assert run(spark, rows, entries=8) == brute(rows, entries=8)
    for few in ([], rows[:4], [(4, [], None)], [(7, same, 3)]):
        assert run(spark, few) == brute(few)


def test_large_components(spark):
    rows = [(i, [float32(s * (1e5 + 977 * i)), float32(i), 3e4, float32(-1e4 * i)], 0) for i, s in enumerate([1, -1] * 15)]
    assert run(spark, rows, entries=4) == brute(rows, entries=4)
    huge = [*rows, (99, [3e38, -3e38, 1.0, 0.0], 0)]
    assert run(spark, huge, entries=4) == brute(huge, entries=4)


def test_only_changed_parts_are_sent(spark):
    r = random.Random(3)
    rows = [(i, [float32((i % 5) + r.gauss(0, 0.05)) for _ in range(8)], 0) for i in range(400)]
    moves = []
    vector_codes.compress(spark.createDataFrame(rows, SCHEMA), entries=5, rounds=6, trace=moves)
    assert moves[0] == 4 * 400  # every part joins an entry
    assert moves[-1] == 0 and all(m < 1600 for m in moves[1:])
    quiet = []
    vector_codes.compress(spark.createDataFrame([(i, [float(i % 3)] * 4, 0) for i in range(99)], SCHEMA), entries=3, trace=quiet)
    assert quiet == [396, 0, 0, 0]


def test_decoding_and_clashing_names(spark):
    rows = [(i, [float(i % 4), 0.5, -1.0, 2.0], 0) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS codes", "'y' AS slot", "1 AS error", "2 AS v", "3 AS x", "4 AS id")
    coded, books = vector_codes.compress(df, entries=4)
    assert {tuple(r["v"]) for r in vector_codes.decode(coded, books).collect()} == {(1024 * i, 512, -1024, 2048) for i in range(4)}
    assert {r["error"] for r in coded.collect()} == {0}


def test_a_label_of_most_rows(spark):
    rows = [(i, [float(i % 7)] * 4, 1 if i % 10 else None) for i in range(500)]
    coded, _ = vector_codes.compress(spark.createDataFrame(rows, SCHEMA), entries=2)
    sums = {}
    for x in coded.collect():
        sums[x["label"]] = sums.get(x["label"], 0) + x["error"]
    got = vector_codes.with_label_error(coded).collect()
    assert len(got) == 500 and all(x["label_error"] == sums[x["label"]] for x in got)
