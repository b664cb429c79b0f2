"""k-mers of 32 to 63 bases as two longs, against plain versions."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from helixframe.functions import seq as S
from helixframe.operators import graph, kmers, seeds
from helixframe.plans import jobs

from .test_graph import canon, genome, table, turn


def plain_counts(seqs, k):
    return Counter(canon(s[i : i + k]) for s in seqs for i in range(len(s) - k + 1) if set(s[i : i + k]) <= set("ACGT"))


def reads():
    a = genome(400, 3)
    return [a, turn(a)[30:200], "A" * 150, "T" * 90 + "N" + a[:70], "ACG", "", a[100:170], "AT" * 60, "A" * 31 + "GATAGATA" * 8]


@pytest.mark.parametrize("k", [31, 32, 33, 47, 62, 63, 64])
def test_counts_and_masks(spark, k):
    seqs = reads()
    want = plain_counts(seqs, k)
    rows = kmers.kmer_counts(table(spark, *seqs), k).collect()
    assert len(rows) == len(want)
    assert {r["canon"]: r["n"] for r in rows} == want
    masks = Counter()
    for s in seqs:
        for i in range(len(s) - k + 1):
            w = s[i : i + k]
            if set(w) <= set("ACGT"):
                m = (128 >> "ACGT".index(s[i - 1]) if i and s[i - 1] in "ACGT" else 0) | (8 >> "ACGT".index(s[i + k]) if i + k < len(s) and s[i + k] in "ACGT" else 0)
                masks[canon(w)] |= m if canon(w) == w else int(f"{m:08b}"[::-1], 2)
    over = {r["canon"]: (r["n"], r["bf"]) for r in kmers.overlap_table(table(spark, *seqs), k).collect()}
    assert over == {c: (n, masks[c]) for c, n in want.items()}


@pytest.mark.parametrize("k", [32, 33, 63])
def test_pack_order_and_letters(spark, k):
    words = sorted({w for w in plain_counts(reads(), k)} | {b * k for b in "ACGT"} | {"A" * 31 + "G" + "A" * (k - 32), "A" * 31 + "G" + "T" * (k - 32), "A" * (k - 1) + "T", "T" + "A" * (k - 1), "A" * 31 + "T" + "A" * (k - 32)}, key=lambda w: w[::-1])
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i long, w string").withColumn("code", S.pack_long(F.col("w")))
    rows = df.withColumn("back", S.unpack_long(F.col("code"), k)).orderBy("code").collect()
    assert [r["w"] for r in rows] == words
    for r in rows:
        whole = sum("ACGT".index(b) << 2 * i for i, b in enumerate(r["w"]))
        assert r["back"] == r["w"]
        assert (r["code"]["high"], r["code"]["low"]) == (whole >> 64, (whole & (1 << 64) - 1) - (1 << 63))


def test_codes_of_batches_equal_packed_letters(spark):
    rows = kmers.canonical_rows(table(spark, *reads()), 45, ["rec_id"])
    assert rows.schema["canon"].dataType.names == ["high", "low"]
    seqs = reads()
    letters = {(i, p): s[p : p + 45] for i, s in enumerate(seqs) for p in range(len(s) - 44) if set(s[p : p + 45]) <= set("ACGT")}
    got = {(r["rec_id"], r["pos"]): (r["text"], r["turned"]) for r in rows.withColumn("text", S.unpack_long(F.col("canon"), 45)).collect()}
    assert got == {at: (canon(w), canon(w) != w) for at, w in letters.items()}


def test_graph_and_lookup(spark):
    seqs = [genome(500, 8), genome(300, 9) + genome(500, 8)[100:300] + genome(200, 10)]
    t = table(spark, *seqs)
    nodes, arcs = jobs.build_graph(t, 63, 1)
    assert graph.asymmetric_arcs(arcs).isEmpty() and graph.overlap_breaks(nodes, arcs, 63).isEmpty()
    placed = plain_counts([n["seq"] for n in nodes.collect()], 63)
    assert set(placed) == set(plain_counts(seqs, 63)) and set(placed.values()) == {1}
    hits = seeds.lookup(t, seeds.kmer_index(nodes, 63), 63).collect()
    spelled = {n["node_id"]: n["seq"] for n in nodes.collect()}
    spelled |= {-i: turn(s) for i, s in spelled.items()}
    assert len(hits) == sum(len(s) - 62 for s in seqs)
    for h in hits:
        assert spelled[h["node"]][h["pos"] : h["pos"] + 63] == seqs[h["rec_id"]][h["rpos"] : h["rpos"] + 63]
