import itertools
import random

import numpy as np
import pytest

from helixframe.llm import jaccard_join as jj

from .util import AWKWARD, clashing, documents, empty, near_copies, real_texts


def sets(rows, size):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    return out


def brute(rows, size, percent):
    s = sets(rows, size)
    root = {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(s), 2):
        if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s[i]), find(i)) for i in s}


def check(spark, rows, size, percent, wrap=lambda d: d):
    got = {r["doc"]: (r["n_shingles"], r["component"]) for r in jj.similar_groups(wrap(documents(spark, rows)), size=size, percent=percent).collect()}
    assert got == brute(rows, size, percent)


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80), (1, 60)])
def test_near_copies(spark, size, percent):
    check(spark, near_copies(size), size, percent)


def test_awkward(spark):
    check(spark, AWKWARD, 3, 90, clashing)


def test_real(spark):
    check(spark, real_texts(400), 3, 90)


def test_chains_need_recursion(spark):
    """Each document is near its neighbour only: the ends are far apart, and pivots settle few."""
    words = [f"w{i}" for i in range(140)]
    rows = [(i, " ".join(words[i * 2 : i * 2 + 60])) for i in range(40)]
    check(spark, rows, 1, 90)
    assert len({c for _, c in brute(rows, 1, 90).values()}) == 1


def test_parts_never_miss_a_link():
    r = np.random.default_rng(5)
    for percent in (80, 90):
        for n in (1, 2, 5, 9, 10, 19, 20, 57, 300, 1500):
            for _ in range(30):
                a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
                most = len(a) * (100 - percent) // percent
                extra = np.unique(r.integers(0, 1 << 63, max(1, most), dtype=np.uint64))[:most]
                gone = r.integers(0, max(1, len(a) * (100 - percent) // 100) + 1)
                for b in (np.union1d(a, extra), a[gone:]):
                    both = len(np.intersect1d(a, b))
                    if len(b) and 100 * both >= percent * len(np.union1d(a, b)):
                        assert np.intersect1d(jj.part_hashes(a, percent), jj.part_hashes(b, percent)).size


def test_empty_and_keep_one(spark):
    assert jj.similar_groups(empty(spark)).count() == 0
    rows = near_copies(3)
    want = {c for _, c in brute(rows, 5, 80).values()}
    assert {r["doc_id"] for r in jj.keep_one_per_group(documents(spark, rows)).collect()} == want
    assert jj.keep_one_per_group(empty(spark)).count() == 0


def test_rows_that_share_an_id_are_judged_one_by_one(spark):
    base = [f"w{i}" for i in range(60)]
    other = [f"v{i}" for i in range(60)]
    third = [f"u{i}" for i in range(60)]
    rows = [
        (1, " ".join(base)), (1, " ".join(other)), (2, " ".join(base[:59])), (3, " ".join(other[:59])),
        (None, " ".join(third)), (None, "no other text is like this one at all"), (None, "no other text is like this one at all"),
        (4, ""), (4, ""), (4, None),
    ]
    kept = jj.keep_one_per_group(documents(spark, rows)).collect()
    want = [(1, rows[0][1]), (1, rows[1][1]), (None, rows[4][1]), (None, rows[5][1]), (4, ""), (4, None)]
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in kept))) == sorted(map(repr, want))
    groups = jj.similar_groups(documents(spark, rows)).collect()
    assert len(groups) == len(rows)
    assert {r["component"] for r in groups if r["doc"] in (1, 2, 3)} == {1}  # the texts of both rows of id 1 link


def dense_group(count, seed=4, words=80):
    """Edits of one text, from a few words to too many to link, and one text per word changed twice."""
    r = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    rows = []
    for i in range(count):
        own = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 5, 9, 20])):
            own[r.randrange(words)] = r.choice([f"x{r.randrange(40)}", f"only{i}"])
        rows.append((i, " ".join(own)))
    return rows


def test_dense_group(spark):
    check(spark, dense_group(400), 1, 90)
    check(spark, dense_group(300), 3, 80)


@pytest.mark.parametrize("most", [6, 40])
def test_regions_too_large_for_a_task(spark, monkeypatch, most):
    """Voronoi cells, windows, blocks and peeling by Spark jobs give what one task gives."""
    monkeypatch.setattr(jj, "MOST_SETS", most)
    monkeypatch.setattr(jj, "PLACED", 16)
    monkeypatch.setattr(jj, "PIVOTS", 3)
    check(spark, dense_group(90), 1, 90)
    words = [f"w{i}" for i in range(140)]
    chain = [(i, " ".join(words[i * 2 : i * 2 + 60])) for i in range(40)]
    check(spark, chain, 1, 90)
    check(spark, near_copies(8, groups=3, size=30), 3, 80)


def test_cells_within_a_task():
    r = np.random.default_rng(3)
    for leaf in (2, 6, 30):
        for trial in range(6):
            percent, found = int(r.choice([60, 80, 90])), []
            for _ in range(int(r.integers(1, 5))):
                base = r.integers(0, 1 << 62, int(r.integers(3, 90)), dtype=np.uint64)
                for _ in range(int(r.integers(1, 30))):
                    own, k = base.copy(), int(r.integers(0, len(base) // 4 + 1))
                    own[r.integers(0, len(own), k)] = r.integers(0, 50 if trial % 2 else 1 << 62, k, dtype=np.uint64)
                    found.append(np.unique(own))
            root = jj._Cells(found, percent, leaf=leaf, pivots=3).root
            plain = [set(s.tolist()) for s in found]
            want = list(range(len(plain)))
            for a, b in itertools.combinations(range(len(plain)), 2):
                if 100 * len(plain[a] & plain[b]) >= percent * len(plain[a] | plain[b]) and want[a] != want[b]:
                    low, high = sorted((want[a], want[b]))
                    want = [low if x == high else x for x in want]
            first = {}
            assert [first.setdefault(int(x), i) for i, x in enumerate(root)] == want


def test_rows_of_one_id_lose_no_link(spark):
    base, other = [f"w{i}" for i in range(60)], [f"v{i}" for i in range(60)]
    rows = [(5, " ".join(base)), (5, " ".join(other)), (7, " ".join([*base, "one"])), (9, " ".join([*other, "two"]))]
    found = jj.similar_groups(documents(spark, rows)).collect()
    assert len(found) == 4 and {r["component"] for r in found} == {5}


def test_one_text_of_megabytes(spark):
    r = random.Random(2)
    long = [r.choice(["a", "b", "c", f"n{i}"]) for i in range(3_000_000)]
    rows = [(3, " ".join(long)), (8, " ".join([*long[:-5], "end"])), (9, "short text")]
    got = {r["doc"]: r["component"] for r in jj.similar_groups(documents(spark, rows), size=1, percent=90).collect()}
    assert got == {3: 3, 8: 3, 9: 9}


def test_own_names(spark):
    """Input columns that bear helper names stay as they are."""
    from pyspark.sql import functions as F

    rows = near_copies(3)
    names = ["row", "region", "component", "label", "maybe", "_hrow", "_hmaybe", "_hw", "_hbits", "kept_doc__", "v", "w", "bits"]
    df = documents(spark, rows).withColumns({n: F.lit("own") for n in names})
    kept = jj.keep_one_per_group(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {c for _, c in brute(rows, 5, 80).values()}


def test_components_of_many_edges(spark):
    """A star with a hub and a long path; sums of hashes don't overflow."""
    from helixframe.llm.components import components
    from pyspark.sql import functions as F

    hub = spark.range(1, 3000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    path = spark.range(5000, 5300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r["node"]: r["component"] for r in components(hub.unionByName(path).unionByName(hub)).collect()}
    assert got == {i: 0 for i in range(3000)} | {i: 5000 for i in range(5000, 5301)}
