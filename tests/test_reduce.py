"""Reductions by chains, against a plain version and to the fixpoint."""

import random

from pyspark.sql import functions as F

from helixframe.operators import graph, markov, reduce
from helixframe.plans import jobs

from .test_graph import genome, table, turn

K = 15


def back(path):
    return tuple(-n for n in reversed(path))


def sections(chains, a, b):
    for c in chains:
        for s in (c, back(c)):
            for i in range(len(s) - 1):
                if s[i] == a and s[i + 1] == b:
                    yield s[i:]


def plain_reductions(arcs, chains):
    out = set()
    right = {}
    for u, v in arcs:
        right.setdefault(u, set()).add(v)
    for a, after in right.items():
        if len(after) != 1 or abs(a) == abs(min(after)):
            continue
        path = (a, min(after))
        while True:
            ahead = {s[len(path)] for s in sections(chains, *path[:2]) if len(s) > len(path) and s[: len(path)] == path}
            if len(ahead) != 1 or abs(min(ahead)) == abs(a):
                break
            path += (min(ahead),)
            if abs(path[-1]) in map(abs, path[:-1]):
                continue
            rc = back(path)
            seen = [s[: len(path)] for s in sections(chains, *rc[:2])]
            if all(s == rc[: len(s)] for s in seen) and any(len(s) == len(path) for s in seen):
                if len({u for u, v in arcs if v == path[-1]}) > 1 or path < rc:
                    out.add(path)
                break
    return out


def mirrored(arcs):
    return {*arcs, *((-v, -u) for u, v in arcs)}


def frames(spark, arcs, chains):
    return spark.createDataFrame(sorted(arcs), "src int, dst int"), spark.createDataFrame([(i, list(c)) for i, c in enumerate(chains)], "chain_id long, chain array<int>")


def test_found_as_by_the_plain_version(spark):
    for seed in range(3):
        r = random.Random(seed)
        walks = [tuple(r.choice([-1, 1]) * n for n in r.sample(range(1, 12), r.randrange(3, 7))) for _ in range(6)]
        arcs = mirrored({s for w in walks for s in zip(w, w[1:])})
        chains = [w[i:j] for w in walks for i in range(len(w)) for j in (i + 2, i + 4, len(w)) if j <= len(w) and r.random() < 0.7]
        a, c = frames(spark, arcs, chains)
        assert {tuple(x["path"]) for x in reduce.find_reductions(a, c).collect()} == plain_reductions(arcs, chains)


def test_a_repeat_is_taken_apart(spark):
    arcs = mirrored({(1, 2), (2, 3), (3, 4), (5, 2), (3, 6)})
    chains = [(1, 2, 3, 4), (-6, -3, -2, -5), (2, 3, 4), (1, 2), (3,), (-4, -3), (5, 2, 3)]
    a, c = frames(spark, arcs, chains)
    found = reduce.find_reductions(a, c)
    assert {tuple(x["path"]) for x in found.collect()} == {(-4, -3, -2, -1), (-6, -3, -2, -5)}
    chosen = reduce.apart(found).collect()
    assert {tuple(x["path"]) for x in chosen} == {(-6, -3, -2, -5), (-4, -3, -2, -1)}
    index = reduce.place_index(c)
    new, changed = reduce.reduce_chains(c, reduce.apart(found), index)
    got = {x["chain_id"]: tuple(x["chain"]) for x in new.collect()}
    assert got == {0: (1, 4), 1: (-6, -5), 2: (4,), 3: (1, 4), 4: (3,), 5: (-4,), 6: (5, 6)}
    left = {(x["src"], x["dst"]) for x in reduce.reduce_arcs(a, reduce.apart(found)).collect()}
    assert left == mirrored({(1, 4), (5, 6), (2, 3)})
    assert {x["chain_id"] for x in changed.collect()} == {0, 1, 2, 3, 5, 6}


def test_fixpoint_keeps_every_read(spark):
    r, q = genome(60, 21), genome(45, 22)
    parts = [genome(120, s) for s in range(30, 35)]
    whole = [parts[0] + r + parts[1] + q + parts[2], parts[3] + r + parts[4] + turn(q) + genome(100, 40)]
    reads = [s[i : i + 100] for s in whole for i in range(0, len(s) - 99, 7)]
    nodes, arcs = jobs.build_graph(table(spark, *whole), K, 1)
    chains = markov.seed_chains(table(spark, *reads), nodes, arcs, K, least=1).select(F.col("rec_id").alias("chain_id"), "chain")
    new_nodes, new_arcs, new_chains = reduce.reduce_all(nodes, arcs, chains, K)
    assert reduce.find_reductions(new_arcs, new_chains).isEmpty()
    assert graph.asymmetric_arcs(new_arcs).isEmpty() and graph.overlap_breaks(new_nodes, new_arcs, K).isEmpty()
    assert new_chains.agg(F.sum(F.size("chain"))).first()[0] < chains.agg(F.sum(F.size("chain"))).first()[0]
    spelled = {x["chain_id"]: x["seq"] for x in graph.spell(new_chains, new_nodes, K, ["chain_id"]).collect()}
    assert len(spelled) == len(reads) and all(reads[i] in s for i, s in spelled.items())
    known = {(x["src"], x["dst"]) for x in new_arcs.collect()}
    assert all(step in known for x in new_chains.collect() for step in zip(x["chain"], x["chain"][1:]))
    assert new_nodes.count() == nodes.count()


def test_nothing_to_reduce(spark):
    a, c = frames(spark, mirrored({(1, 2), (2, 1)}), [(1, 2, 1, 2, 1), (1,), ()])
    assert reduce.find_reductions(a, c).isEmpty()
    none = spark.createDataFrame([], "chain_id long, chain array<int>")
    assert reduce.find_reductions(a, none).isEmpty()
