import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from helixframe.llm import resample

from .util import AWKWARD, clashing, documents, empty, real_texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return len(w), [" ".join(w[i : i + n]) for i in range(len(w)) for n in range(1, longest + 1) if i + n <= len(w)]


def brute(rows, target, longest=1, buckets=10_000, least=20, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, features(text, longest)[1]))
    for text in target:
        t.update(map(bucket, features(text, longest)[1]))
    big, small = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big + buckets) / ((s[b] + 1) * (small + buckets))))
    out = []
    for i, text in rows:
        n, f = features(text, longest)
        weight = sum(gain(bucket(x)) for x in f)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    drawn = able[: percent * len(able) // 100]
    rank = {}
    for r, x in enumerate(drawn, 1):
        rank.setdefault(x, []).append(r)
    return sorted((str((*x, (rank[x].pop() if rank.get(x) else None))) for x in out))


def run(spark, rows, target, **kind):
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resample.resample(documents(spark, rows), bench, **kind).collect()
    return sorted(str((r["id"], r["n_words"], r["n_features"], r["weight"], r["score"], r["rank"])) for r in got)


TARGET = ["the quick brown fox", "One two THREE", None, "", "word word", "straße ünï"]


@pytest.mark.parametrize(("longest", "nodes", "percent"), [(1, 500_000, 10), (3, 500_000, 50), (3, 40, 100), (1, 3, 30)])
def test_brute_force(spark, monkeypatch, longest, nodes, percent):
    monkeypatch.setattr(resample, "NODES", nodes)  # executors import the module anew; the trie itself is tested below
    rows = [*AWKWARD, *[(100 + i, t) for i, t in real_texts(60)]]
    assert run(spark, rows, TARGET, longest=longest, percent=percent, least_words=5) == brute(rows, TARGET, longest, percent=percent, least=5)


@pytest.mark.parametrize(("longest", "nodes"), [(1, 5), (2, 1), (3, 7), (4, 30)])
def test_trie_starts_anew(monkeypatch, longest, nodes):
    import numpy as np

    monkeypatch.setattr(resample, "NODES", nodes)
    r = random.Random(longest)
    totals = np.zeros(97, np.int64)
    trie = resample.Trie(longest, 97, totals=totals)
    want = Counter()
    for _ in range(20):
        text = " ".join(r.choices(["a", "b", "cc", "D", "é"], k=r.randrange(0, 40)))
        for node in trie.walk(text.encode()):
            trie.count[node] += 1
        n, f = features(text, longest)
        assert trie.length == n
        want.update(zlib.crc32(x.encode()) % 97 for x in f)
    trie.flush()
    assert {i: int(n) for i, n in enumerate(totals) if n} == dict(want)


def test_words_in_chunks(monkeypatch):
    r = random.Random(2)
    for size in (1, 2, 5, 64):
        monkeypatch.setattr(resample, "CHUNK", size)
        for _ in range(60):
            text = "".join(r.choices(["A", "b", "é", " ", "\x00", "9", "_", "東", "z" * 9], k=r.randrange(0, 60)))
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            assert [w.decode() for w in resample.words(text.encode())] == WORD.findall(low)
    assert list(resample.words(None)) == []


def test_ties_repeats_nulls(spark):
    long = "alpha beta gamma " * 10
    rows = [(7, long)] * 30 + [(None, long)] * 4 + [(i, long) for i in range(20, 60)] + [(1, None), (2, "")]
    got, want = run(spark, rows, ["alpha"], percent=50), brute(rows, ["alpha"], percent=50)
    assert got == want
    assert run(spark, [], ["alpha"]) == []
    assert run(spark, rows, []) == brute(rows, [])
    assert run(spark, rows, ["alpha"], percent=0) == brute(rows, ["alpha"], percent=0)


def test_clashing_names(spark):
    df = clashing(documents(spark)).selectExpr("*", "'own' AS n_features", "'own' AS _hplace", "'own' AS id")
    got = resample.weigh(df, "text", [1] * 10)
    assert {"ids", "id", "_hplace", "n_words"} <= set(got.columns) and got.columns.count("n_features") == 1
    drawn = resample.draw(got, "doc_id", least_words=1, percent=100)
    assert drawn.columns.count("rank") == 1 and drawn.filter("rank IS NOT NULL").count() == drawn.filter("n_words > 0").count()
    assert resample.resample(empty(spark), df).collect() == []


def test_a_long_text(spark):
    rows = [(1, "lorem Ipsum " * 300_000), (2, "x" * 2_000_000), (3, "a b c")]
    assert run(spark, rows, ["ipsum"], longest=2, least_words=1, percent=100) == brute(rows, ["ipsum"], 2, least=1, percent=100)
