import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import suffix_lm as lm

from .util import AWKWARD, clashing, documents, empty, real_texts


def base_scores(rows, train):
    c = Counter()
    for i, t in rows:
        if train(i):
            c.update([*lm.tokens(t), b"<end>"])
    n, v = sum(c.values()), len(c)
    return {i: (sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*lm.tokens(t), b"<end>"]), sum(c[w] > 0 for w in [*lm.tokens(t), b"<end>"]), n) for i, t in rows}


def test_base_scores_are_exact(spark):
    rows = real_texts(200, "sf0.001")
    from helixframe.llm.queries import op2_suffix_lm

    want = base_scores(rows, lambda i: zlib.crc32(str(i).encode()) % 7 != 2)
    got = {r["doc_id"]: r for r in op2_suffix_lm(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    for i, (base, known, n) in want.items():
        assert got[i]["base_score"] == pytest.approx(base, rel=1e-9)
        assert (got[i]["n_known"], got[i]["train_tokens"]) == (known, n)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)


def brute(tree, stream):
    """Longest retained suffix by plain search through the automaton's table of moves."""
    state, total = 0, 0.0
    for k, b in enumerate(bytes([lm.END]) * lm.DEPTH + stream):
        c = int(tree.classes[b])
        if k >= lm.DEPTH:
            total += float(tree.log_p[state, c])
        state = int(tree.move[state, c])
    return total


def small_tree(streams, least=2):
    g, n = lm.gram_counts(streams)
    rows = []
    for d in range(lm.DEPTH + 1):
        c = Counter()
        for key, k in zip(g.tolist(), n.tolist()):
            c[key & ((1 << 8 * (d + 1)) - 1)] += k
        total = Counter()
        for key, k in c.items():
            total[key >> 8] += k
        rows += [(d, key >> 8, key & 255, k) for key, k in c.items() if total[key >> 8] >= least]
    return lm.SuffixTree(*(np.asarray(x) for x in zip(*rows)))


def test_distributions_sum_to_one_and_lanes_agree():
    streams = [lm.stream_of(lm.tokens(t)) for _, t in real_texts(60)]
    tree = small_tree(streams)
    p = 10.0 ** tree.log_p.astype(float)
    unseen = 256 - (tree.log_p.shape[1] - 1)
    assert np.allclose(p[:, :-1].sum(axis=1) + unseen * p[:, -1], 1, atol=1e-4)
    for s, x in zip(streams[:10], tree.score(streams)[:10]):
        assert x == pytest.approx(brute(tree, s), rel=1e-4)
    assert tree.retained > 20


def test_grams_count_every_symbol():
    streams = [b"ab\n", b"\n", b"abab\n"]
    g, n = lm.gram_counts(streams)
    assert n.sum() == sum(map(len, streams))
    c = Counter()
    for s in streams:
        padded = bytes([lm.END]) * lm.DEPTH + s
        for i in range(lm.DEPTH, len(padded)):
            c[int.from_bytes(padded[i - lm.DEPTH : i + 1], "big")] += 1
    assert dict(zip(g.tolist(), n.tolist())) == c


def test_awkward_rows(spark):
    got = lm.score_texts(clashing(documents(spark)), F.lit(True)).collect()
    assert len(got) == len(AWKWARD)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert {r["doc_id"]: r["n_tokens"] for r in got}[0] == 1
    assert lm.score_texts(empty(spark), F.lit(True)).count() == 0
    none = lm.score_texts(documents(spark), F.lit(False)).collect()
    assert {r["train_tokens"] for r in none} == {0}


def test_held_out_texts_gain(spark):
    from helixframe.llm.queries import op2_suffix_lm

    rows = op2_suffix_lm(spark, "/root/testdata/sf0.1").filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert rows["s"] > rows["b"]


def test_distributed_model_equals_the_plain_one(spark):
    rows = real_texts(150)
    streams = [lm.stream_of(lm.tokens(t)) for i, t in rows if i % 3]
    tree = small_tree(streams, lm.LEAST)
    got = {r["doc_id"]: r for r in lm.score_texts(documents(spark, rows), F.col("doc_id") % 3 != 0).collect()}
    want = tree.score([lm.stream_of(lm.tokens(t)) for _, t in rows])
    for (i, _), x in zip(rows, want):
        assert got[i]["score"] == pytest.approx(x, rel=1e-4)
        assert got[i]["states"] == tree.retained


def test_rare_contexts_stay_in_a_larger_corpus(spark):
    """Thirty occurrences of a word teach the same among 0.1 and 20 MB of other text."""
    rare = [(i, "qzxjvk") for i in range(30)]

    def run(copies):
        other = [(100 + i, "lorem ipsum dolor sit amet " * 400) for i in range(copies)]
        got = lm.score_texts(documents(spark, [*rare, *other, (99, "qzxjvk")]), F.col("doc_id") != 99)
        return got.filter("doc_id = 99").first()["score"]

    small, large = run(10), run(2000)
    assert large > small - 4  # only the first letter grows rarer
