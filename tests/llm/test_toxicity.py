import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import toxicity as tx

from .util import AWKWARD, clashing, documents, empty

LABELS = "doc_id long, toxic int"


def test_held_out_accuracy(spark):
    from helixframe.llm.queries import op6_toxicity

    got = op6_toxicity(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    rows = got.filter("held_out").join(labels, "doc_id").collect()
    y, p = np.asarray([r["toxic"] for r in rows]), np.asarray([r["predicted"] for r in rows])
    assert len(rows) > 300
    assert ((p == 1) & (y == 0)).sum() <= 0.005 * (y == 0).sum()
    assert ((p == 1) & (y == 1)).sum() >= 0.9 * (y == 1).sum()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_labels_outside_training_have_no_influence(spark):
    docs = documents(spark, [(i, f"plain words {i}" if i % 2 else f"nasty slur {i}") for i in range(60)])
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(60)], LABELS)
    turned = spark.createDataFrame([(i, int(i % 2 == 0) if i < 40 else 1 - int(i % 2 == 0)) for i in range(60)], LABELS)
    run = lambda l: {r["doc_id"]: r["score"] for r in tx.classify(docs, l, F.col("doc_id") < 40).collect()}
    a, b = run(labels), run(turned)
    assert a == b
    assert min(a[i] for i in range(0, 60, 2)) > 0.5 > max(a[i] for i in range(1, 60, 2))


@pytest.mark.parametrize("labels", [[], [(5, 1)], [(5, 0), (6, None), (None, 1)], [(5, 1), (5, 0), (6, 0)]])
def test_awkward(spark, labels):
    got = tx.classify(clashing(documents(spark)), spark.createDataFrame(labels, LABELS), F.lit(True)).collect()
    assert len(got) == len(AWKWARD)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert tx.classify(empty(spark), spark.createDataFrame(labels, LABELS), F.lit(True)).count() == 0


def test_features_are_distinct_and_whole():
    assert len(tx.features(None)) == len(tx.features("")) == 0
    f = tx.features("abc " * 5000 + "unusual ending")
    assert (np.diff(f.astype(np.int64)) > 0).all()
    assert np.isin(tx.features("unusual ending")[:5], f).sum() >= 4


def plain_fit(rows, steps=tx.STEPS):
    """The same classifier over dictionaries of unhashed n-grams."""
    import math
    from collections import Counter

    def grams(text):
        t = f" {' '.join(text.lower().split())} "
        return {t[i : i + n] for n in tx.ORDERS for i in range(len(t) - n + 1)}

    held = [(grams(t), y) for t, y in rows]
    n = [sum(y == k for _, y in held) for k in (0, 1)]
    count = [Counter(g for gs, y in held if y == k for g in gs) for k in (0, 1)]
    scale = {}
    for g in set(count[0]) | set(count[1]):
        p = [(count[k][g] + tx.SMOOTHING) / (n[k] + 2 * tx.SMOOTHING) for k in (0, 1)]
        r = math.log(p[1] / (1 - p[1])) - math.log(p[0] / (1 - p[0]))
        e = math.sqrt(sum(1 / (count[k][g] + tx.SMOOTHING) + 1 / (n[k] - count[k][g] + tx.SMOOTHING) for k in (0, 1)))
        if abs(r) > tx.SHRINK * e:
            scale[g] = math.copysign(abs(r) - tx.SHRINK * e, r)
    share = [0.5 / n[0], 0.5 / n[1]]
    w, m, v = dict.fromkeys(scale, 0.02), dict.fromkeys(scale, 0.0), dict.fromkeys(scale, 0.0)
    toxic = n[1] / sum(n)
    bias, mb, vb = math.log((toxic + 1e-3) / (1 - toxic + 1e-3)), 0.0, 0.0
    for t in range(1, steps + 1):
        slope, off_all = {g: tx.RIDGE * x for g, x in w.items()}, 0.0
        for gs, y in held:
            off = (1 / (1 + math.exp(-bias - sum(w[g] * scale[g] for g in gs if g in scale))) - y) * share[y]
            off_all += off
            for g in gs:
                if g in scale:
                    slope[g] += off * scale[g]
        move = lambda m, v: 0.05 * (m / (1 - 0.9**t)) / (math.sqrt(v / (1 - 0.999**t)) + 1e-9)
        for g, x in slope.items():
            m[g], v[g] = 0.9 * m[g] + 0.1 * x, 0.999 * v[g] + 0.001 * x * x
            w[g] -= move(m[g], v[g])
        mb, vb = 0.9 * mb + 0.1 * off_all, 0.999 * vb + 0.001 * off_all * off_all
        bias -= move(mb, vb)
    return lambda text: 1 / (1 + math.exp(-bias - sum(w[g] * scale[g] for g in grams(text) if g in scale)))


def test_fit_as_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(tx, "STEPS", 40)
    words = ["tree", "stone", "river", "grün", "vile", "straße"]
    rows = [(" ".join(words[(i * k) % 4 + (k % 3 == 0 and i % 3 == 0)] for k in range(1, 8)) + (" vile thing" if i % 3 == 0 else f" calm {i % 5}"), int(i % 3 == 0)) for i in range(45)]
    docs = documents(spark, list(enumerate(t for t, _ in rows)))
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], LABELS)
    want = plain_fit(rows, 40)
    got = {r["doc_id"]: r["score"] for r in tx.classify(docs, labels, F.lit(True)).collect()}
    for i, (t, _) in enumerate(rows):
        assert got[i] == pytest.approx(want(t), rel=1e-3)


def test_one_text_of_megabytes(spark):
    docs = documents(spark, [(1, "plain text"), (2, "vile thing"), (3, "plain words here " * 2_000_000 + "vile thing")])
    labels = spark.createDataFrame([(1, 0), (2, 1)], LABELS)
    assert all(0 <= r["score"] <= 1 for r in tx.classify(docs, labels, F.lit(True)).collect())
